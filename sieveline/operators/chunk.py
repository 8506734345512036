"""Section-aware chunking: one paper's text to a sequence of chunks, by a state machine in Arrow batches.

Packing, merging and repair depend on what was emitted before, within one paper; papers are independent, so the
operator is a plain map over rows and shuffles nothing.  Tokens are white-space words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from sieveline import lexicon as L

CHUNK_SCHEMA = (
    "chunk_id string, paper_id string, label string, section string, chunk_index int, raw_text string, n_tokens_raw int, "
    "n_chars_raw int, text string, text_display string, n_tokens int, n_chars int, overlap_tokens int, "
    "n_tokens_body_only int, n_tokens_overlap_only int, n_tokens_header_only int"
)
_HEADING = re.compile(
    r"^(?:" + "|".join(sorted(map(re.escape, L.CHUNK_HEADINGS), key=len, reverse=True)) + r")\b[\s:.\-–—]*$", re.I
)
_SENTENCE = re.compile(r"(?<=[.?!])\s+(?=[A-Z0-9])")
_TABLE_LINE = re.compile(L.TABLEISH_LINE)
_TABLE_PARTS = [re.compile(p) for p in (L.PIPE_TABLE, L.REPEATED_SEPARATOR, L.MANY_NUMBERS)]
_BAD_SENTENCE = re.compile(L.BAD_KEY_SENTENCE, re.I)
_MID_THOUGHT = re.compile("^[,;:)\\]]|^[a-z]|^’|^\"")


def n_tokens(text: str) -> int:
    return max(1, len(text.split())) if text else 0


def table_free(text: str) -> str:
    """Without lines that read as tables, captions or columns of numbers."""
    kept = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            kept.append("")
        elif not _TABLE_LINE.search(bare) and not any(p.search(line) for p in _TABLE_PARTS):
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def sections_of(text: str, c: L.Chunking) -> list[tuple[str, str]]:
    """(section, text) of a text with two or more heading lines; none for other texts."""
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if _HEADING.match(x)]
    if len(marks) < 2:
        return []
    out = []
    for at, stop in zip(marks, [*marks[1:], len(lines)], strict=True):
        name = re.sub(r"[\s:.\-–—]+$", "", lines[at]).strip().upper()
        body = "\n".join(lines[at + 1 : stop]).strip()
        if name not in L.SKIP_SECTIONS and body and n_tokens(body) >= c.min_section:
            out.append((name, body))
    return out


def paragraphs_of(text: str, least: int) -> list[str]:
    """Paragraphs; while what is gathered has fewer than ``least`` tokens the next one joins it by a line end."""
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n+", text)):
        if not part:
            continue
        if held and n_tokens(held) < least:
            held = f"{held}\n{part}"
        else:
            if held:
                out.append(held)
            held = part
    return [*out, held] if held else out


def word_windows(text: str, size: int) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


@dataclass
class Piece:
    section: str
    raw: str
    index: int
    text: str = ""
    overlap: str = ""


class Packer:
    """Units in, pieces out: greedy up to the target, small pieces go to the one before if its section is the same."""

    def __init__(self, c: L.Chunking) -> None:
        self.c = c
        self.pieces: list[Piece] = []
        self.parts: list[str] = []
        self.size = 0
        self.section = ""

    def emit(self, raw: str) -> None:
        raw = raw.strip()
        if not raw:
            return
        last = self.pieces[-1] if self.pieces else None
        if last and last.section == self.section and n_tokens(raw) < self.c.min_chunk:
            last.raw = f"{last.raw.rstrip()}\n\n{raw}"
        else:
            self.pieces.append(Piece(self.section, raw, len(self.pieces)))

    def flush(self) -> None:
        raw = "\n\n".join(self.parts).strip()
        self.parts, self.size = [], 0
        for part in word_windows(raw, self.c.target) if n_tokens(raw) > self.c.target else [raw]:
            self.emit(part)

    def _gather(self, texts: list[str]) -> None:
        """Sentences of a long unit, up to the target; longer ones as windows of words."""
        held: list[str] = []
        size = 0
        for s in texts:
            n = n_tokens(s)
            if held and (n > self.c.target or size + n > self.c.target):
                self.emit("\n\n".join(held))
                held, size = [], 0
            if n > self.c.target:
                for part in word_windows(s, self.c.target):
                    self.emit(part)
            else:
                held.append(s)
                size += n
        self.emit("\n\n".join(held))

    def add(self, section: str, unit: str) -> None:
        n = n_tokens(unit)
        if self.parts and (section != self.section or n > self.c.target or self.size + n > self.c.target):
            self.flush()
        self.section = section
        if n > self.c.target:
            self._gather([s.strip() for s in _SENTENCE.split(unit) if s.strip()])
        else:
            self.parts.append(unit)
            self.size += n


def key_idea(text: str, most: int = 25) -> str:
    body = text.split("---\n", 1)[-1].strip() if "---\n" in text else text
    chosen = body.strip()
    for s in [x.strip() for x in _SENTENCE.split(body) if x.strip()][:12]:
        soup = re.match(r"^[\d\W_]+$", re.sub(r"\s+", "", s))
        if len(s.split()) >= 6 and not _BAD_SENTENCE.search(s) and not soup and s[0] not in "0123456789([{":
            chosen = s
            break
    words = chosen.split()
    return f"{' '.join(words[:most]).rstrip()}…" if len(words) > most else chosen


def _repair(pieces: list[Piece], c: L.Chunking) -> list[Piece]:
    """Small pieces go to the one before (same section), else to the next, where the sum stays in bounds."""
    out: list[Piece] = []
    most = c.max_final + c.slack
    for i, p in enumerate(pieces):
        n = n_tokens(p.text)
        if n < c.min_final:
            if out and out[-1].section == p.section and n_tokens(out[-1].text) + n <= most:
                out[-1].text = f"{out[-1].text.rstrip()}\n\n{p.text.lstrip()}"
                continue
            if i + 1 < len(pieces) and n + n_tokens(pieces[i + 1].text) <= most:
                pieces[i + 1].text = f"{p.text.rstrip()}\n\n{pieces[i + 1].text.lstrip()}"
                continue
        out.append(p)
    return out


def chunk_text(paper: str, label: str, text: str | None, c: L.Chunking | None = None) -> list[dict]:
    """The chunks of one paper; an empty text has none."""
    c = c or L.Chunking()
    body = table_free(text or "")
    packer = Packer(c)
    for section, part in sections_of(body, c) or [("UNKNOWN", body)]:
        for unit in paragraphs_of(part, c.min_paragraph):
            packer.add(section, unit)
    packer.flush()
    before = ""
    for p in packer.pieces:
        p.raw = p.raw.strip()
        tail = " ".join(before.split()[-c.overlap :])
        joined = f"{tail}\n\n{p.raw}".strip()
        p.overlap = tail if tail and not _MID_THOUGHT.match(joined.lstrip()) and joined != p.raw else ""
        p.text = joined if p.overlap else p.raw
        before = p.raw
    display = {
        p.index: (f"[Cancer: {label} | Section: {p.section} | Paper: {paper}]\nKey idea: {key_idea(p.raw)}\n---\n", p.text)
        for p in packer.pieces
    }
    return [
        {
            "chunk_id": f"{paper}::c{p.index:04d}",
            "paper_id": paper,
            "label": label,
            "section": p.section,
            "chunk_index": p.index,
            "raw_text": p.raw,
            "n_tokens_raw": n_tokens(p.raw),
            "n_chars_raw": len(p.raw),
            "text": p.text,
            "text_display": "".join(display[p.index]),
            "n_tokens": n_tokens(p.text),
            "n_chars": len(p.text),
            "overlap_tokens": c.overlap if p.overlap else 0,
            "n_tokens_body_only": n_tokens(p.raw),
            "n_tokens_overlap_only": n_tokens(p.overlap),
            "n_tokens_header_only": n_tokens(display[p.index][0]),
        }
        for p in _repair(packer.pieces, c)
    ]


def chunk_papers(df: DataFrame, paper: str, label: str, text: str, chunking: L.Chunking | None = None) -> DataFrame:
    """The chunks of every row, in CHUNK_SCHEMA."""
    c = chunking or L.Chunking()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                rows = [
                    row
                    for p, k, t in zip(part[paper], part[label], part[text], strict=True)
                    for row in chunk_text(str(p), "" if k is None else str(k), t if isinstance(t, str) else None, c)
                ]
                if rows:
                    yield pd.DataFrame(rows)

    return df.select(paper, label, text).mapInPandas(run, CHUNK_SCHEMA)
