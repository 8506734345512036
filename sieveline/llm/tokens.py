"""Tokenizing whole texts exactly, at the speed of a dictionary.

Both vocabularies used here split a text into words before they merge, and no word spans certain borders.  So a text
is cut at such borders, each distinct unit of a block of texts is encoded once by the tokenizers library, and a text's
ids are its units' ids in a row.  Arrow cuts the texts and finds the distinct units; Python sees these only.  Texts for which the borders are not sure go to the library whole.  The library works as it does by
default: strings of special tokens in a text become these tokens.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import sys
import types

import numpy as np
import pyarrow as pa

#: Units kept over blocks, about 200 bytes each.  A fuller cache starts anew with the units of the block at hand, the
#: frequent ones among them; it only saves time.
CACHE_UNITS = 400_000
#: Longer units are not kept.
UNIT_CHARS = 48
#: Units that are encoded as one text, to be parted by their bytes.
JOINED = 64


def _kinds() -> bytes:
    """The kind of each Latin-1 character: _ the space, s other white space, P full stop or comma, x letter or digit,
    Q any other sign."""
    out = bytearray(b"Q" * 256)
    for c in range(256):
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = ord("s")
        elif chr(c).isalpha() and chr(c) not in "\xaa\xb5\xba" or "0" <= chr(c) <= "9":
            out[c] = ord("x")
    out[ord(" ")] = ord("_")
    out[ord(".")] = out[ord(",")] = ord("P")
    return bytes(out)


_KINDS = _kinds()
_GLUED = (b"PP", b"PQ", b"QP", b"sP", b"_P")
#: A space after other white space, or after one: the borders of such a run depend on all of it.
_RUNS = (b"s_", b"__")
_RUN = re.compile(r"[\s\u180e\u200b\ufeff] ")
#: Units that keep their bytes, and their borders, beside others of this kind: with spaces, those that have theirs and
#: end in none; without, small letters, digits and signs that no normal form changes.
_PLAIN = {
    True: re.compile(r"[^\s\x01\u180e\u200b\ufeff](.*[^\s\u180e\u200b\ufeff])?", re.DOTALL),
    False: re.compile(r"[!-;=-@\[-~\xdf-\xf6\xf8-\xff]+"),
}


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def worker_encoder(path: str, spaced: bool) -> UnitEncoder:
    """This process's encoder for a vocabulary: a Python worker serves many tasks, and keeps its units over them.

    The module that holds it is made here, as this package's own functions are sent anew with each task.
    """
    kept = sys.modules.setdefault("_sieveline_worker", types.ModuleType("_sieveline_worker")).__dict__
    name = f"{path}|{spaced}"
    if name not in kept:
        kept[name] = UnitEncoder(path, spaced)
    return kept[name]


def distinct_units(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What single spaces part: the distinct units, all texts' units in a row as numbers of these, and where each text's
    begin and the last one's end."""
    if not texts:
        return [], np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    flat = [t.encode() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in flat])
    flat = b" ".join([*flat, b""])
    # A unit reaches to the space behind it, so that the texts themselves are the units' buffer.
    cuts = np.concatenate([[0], np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32) + 1])
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(flat)).dictionary_encode()
    at = np.concatenate([[0], np.searchsorted(cuts, ends)])
    names = units.dictionary
    found = names.buffers()[2].to_pybytes()[: names.nbytes and np.frombuffer(names.buffers()[1], dtype=np.int64)[len(names)]]
    return found.decode().split(" ")[:-1], units.indices.to_numpy(), at


def _strung(ids: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in a row, and how many stand before each unit and in all."""
    table = np.frombuffer(b"".join(ids), dtype="<u4")
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    first = np.cumsum(sizes) - sizes
    own = sizes[numbers]
    ends = np.concatenate([[0], np.cumsum(own)])
    return table[np.arange(ends[-1]) + np.repeat(first[numbers] - ends[:-1], own)], ends


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced`` is True for a byte-level vocabulary, whose words begin with their space: a text is cut before each
    single space.  Inside a run of white space the last space belongs to the next word but the others do not, so texts
    with a space right after other white space are encoded whole, and so are texts that hold a special token's string.
    A unit is written without its space, and with \x01 in front where it has none: a text's first, and signs cut off.
    It is False for a vocabulary that drops white space: a text is cut at spaces and line ends.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.spaced = spaced
        self.cache: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        # A byte-level token has a character for each of its bytes; a word's last token has its mark besides.
        self.bytes_of = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, at in names.items():
            self.bytes_of[at] = len(name.removesuffix("</w>"))

    def _encode(self, units: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def _encode_joined(self, units: list[str]) -> list[bytes]:
        """Ids of plain units, many at a time: their common ids are parted where the tokens' bytes sum up to a unit.

        If the sums do not meet every unit's end, all are encoded unit by unit.
        """
        first = " " if self.spaced else ""
        texts = [first + " ".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype="<u4")
        if len(ids) and ids.max() < len(self.bytes_of):
            at = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(first) + len(u.encode()) for u in units])
            last = np.searchsorted(at, ends)
            whole = np.cumsum([len(x) for x in found])
            if at[-1] == ends[-1] and np.array_equal(at[last], ends) and np.array_equal(last[JOINED - 1 :: JOINED] + 1, whole[: len(units) // JOINED]):
                flat = ids.tobytes()
                cuts = [0, *(4 * (last + 1)).tolist()]
                return [flat[a:b] for a, b in itertools.pairwise(cuts)]
        return self._encode([first + u for u in units])

    def _kinds_of(self, text: str) -> bytes:
        """The text's characters by kind; empty if some are beyond Latin-1."""
        try:
            return text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            return b""

    def _whole(self, text: str, kinds: bytes) -> bool:
        """Whether a text for a vocabulary with spaces has borders that are not sure."""
        if "\x01" in text or any(x in text for x in self.special):
            return True
        if kinds:
            return any(x in kinds for x in _RUNS)
        return _RUN.search(text) is not None

    def _spread(self, text: str, kinds: bytes) -> str:
        """The text with its units parted by single spaces.  Full stops and commas that touch no other sign are units
        with what follows them: words that end a sentence and words inside it are then the same units."""
        apart = bool(kinds) and not any(x in kinds for x in _GLUED)
        if not self.spaced:
            low = text.lower() if kinds else text
            if kinds and not ("<" in low and any(x.lower() in low for x in self.special)):
                text = low.replace(".", " . ").replace(",", " , ") if apart else low
            return text.replace("\n", " ")
        if apart:
            text = text.replace(".", " \x01.").replace(",", " \x01,")
        return "\x01" + text

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        plain = list(map(_PLAIN[self.spaced].fullmatch, units))
        some = [u for u, x in zip(units, plain, strict=True) if x]
        rest = [u for u, x in zip(units, plain, strict=True) if not x]
        if self.spaced:
            rest = [u[1:] if u[:1] == "\x01" else " " + u for u in rest]
        found = [iter(f(part)) for f, part in ((self._encode, rest), (self._encode_joined, some))]
        return [next(found[x is not None]) for x in plain]

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of a block's distinct units, from the cache or else from the library."""
        out = list(map(self.cache.get, units))
        new = [u for u, x in zip(units, out, strict=True) if x is None]
        made = [x for at in range(0, len(new), 20_000) for x in self._learn(new[at : at + 20_000])]
        found = iter(made)
        out = [next(found) if x is None else x for x in out]
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache, new, made = {}, units[:CACHE_UNITS], out
        self.cache.update((u, x) for u, x in zip(new, made) if len(u) <= UNIT_CHARS)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of a block of texts, some megabytes at best."""
        out: list[bytes] = [b""] * len(texts)
        cut, spread = [], []
        for i, text in enumerate(texts):
            kinds = self._kinds_of(text)
            if self.spaced and self._whole(text, kinds):
                out[i] = self._encode([text])[0]
            else:
                cut.append(i)
                spread.append(self._spread(text, kinds))
        units, numbers, at = distinct_units(spread)
        ids = self._ids_of(units)
        flat, ends = _strung(ids, numbers)
        bounds = ends[at].tolist()
        for i, a, b in zip(cut, bounds[:-1], bounds[1:], strict=True):
            out[i] = flat[a:b].tobytes()
        return out

    def unit_ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """The texts as numbers of units, and each unit's ids; only for vocabularies that drop white space.

        The numbers are those of the units of these texts alone.
        """
        units, numbers, at = distinct_units([self._spread(t, self._kinds_of(t)) for t in texts])
        empty = units.index("") if "" in units else -1
        docs = [own[own != empty] for own in np.split(numbers, at[1:-1])] if texts else []
        return docs, self._ids_of(units)
