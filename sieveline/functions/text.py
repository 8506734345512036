"""Cleaning and normalising of texts, as Column functions.  A null text reads as the empty one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline import rx


def empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def contains_any(col: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in parts])


def fix_mojibake(col: Column) -> Column:
    """UTF-8 text that was read as Latin-1 put right, where every character of it has a byte there.

    Only texts with signs of it are tried, and only those whose bytes are UTF-8 are changed.
    """

    def mend(t: Column) -> Column:
        one_byte = ~rx.has(t, "[^\\x00-\\xff]")
        raw = F.when(contains_any(t, L.MOJIBAKE_HINTS) & one_byte, F.encode(t, "iso-8859-1"))
        return F.try_validate_utf8(raw.cast("string"))

    return rx.let(col, lambda t: F.coalesce(mend(t), t))


def basic_clean(col: Column) -> Column:
    t = F.replace(fix_mojibake(empty(col)), F.lit("ï¬"), F.lit(""))
    t = F.replace(t, F.lit("\r"), F.lit("\n"))
    t = rx.sub(t, r"\n{3,}", "\n\n")
    return rx.strip(rx.sub(t, r"[ \t]+", " "))


def detect_headings(col: Column) -> Column:
    return contains_any(F.lower(empty(col)), L.HEADING_HINTS)


def word_count(col: Column) -> Column:
    return rx.count(empty(col), r"\b\w+\b")


def word_count_fast(col: Column) -> Column:
    return rx.count(empty(col), r"\S+")


def canonical(col: Column) -> Column:
    return rx.strip(rx.squeeze(F.lower(empty(col))))


def fingerprint(col: Column) -> Column:
    """sha1 of the lower-cased text with white space squeezed."""
    return F.sha1(canonical(col).cast("binary"))


def unflatten_headings(col: Column) -> Column:
    names = "|".join(sorted(L.UNFLATTEN_HEADINGS, key=lambda h: (-len(h), L.UNFLATTEN_HEADINGS.index(h))))
    return rx.sub(col, f"({names})", "\n$1\n", "i")


def remove_boilerplate_lines(col: Column) -> Column:
    """Lines with addresses, marks of a publisher or numbers of an issue; only texts with a part of such a mark are tried.

    White space before a line is taken whole: what makes a line boilerplate begins with a sign that is none, and trying
    each shorter run would cost the square of the run.
    """

    def remove(t: Column) -> Column:
        low, digit = F.lower(t), rx.has(t, r"\d")
        marked = contains_any(low, L.BOILERPLATE_PARTS) | (contains_any(low, L.BOILERPLATE_NUMBERED) & digit)
        return F.when(marked, rx.sub(t, L.BOILERPLATE_LINE.replace(r"^\s*", r"^\s*+", 1), "", "im")).otherwise(t)

    return rx.let(col, remove)


def remove_junk_and_supplements(col: Column) -> Column:
    lines = L.JUNK_LINE.replace(r"^\s*", r"^\s*+", 1)
    return rx.sub(rx.sub(col, lines, "", "im"), L.SUPPLEMENT_BLOCK, "\n\n", "is")


def strip_figure_mentions(col: Column) -> Column:
    for pattern in (L.FIGURE_INLINE, L.FIGURE_AS_SHOWN, L.FIGURE_LABEL):
        col = rx.sub(col, pattern, "", "i")
    return col


def remove_table_dumps(col: Column) -> Column:
    """Six and more lines with a digit.

    A line's first digit is the one that counts and lines are kept once matched: with any digit of a line to choose from,
    five such lines before one without would be tried in all combinations.
    """
    return rx.sub(col, L.TABLE_DUMP_ONCE, "\n[TABLE_OMITTED]\n", "is")


def remove_inline_citations(col: Column) -> Column:
    def bracket(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("[")), rx.sub(t, L.CITE_BRACKET, "")).otherwise(t)

    def paren(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("(")), rx.sub(t, L.CITE_PAREN, "")).otherwise(t)

    def author(t: Column) -> Column:
        dated = F.contains(t, F.lit("(")) & rx.has(t, L.YEAR_HINT)
        return F.when(dated, rx.sub(rx.sub(t, L.CITE_AUTHOR_PAREN, ""), L.CITE_AUTHOR, "")).otherwise(t)

    def doi(t: Column) -> Column:
        cited = F.contains(F.lower(t), F.lit("doi")) | F.contains(t, F.lit("10."))
        return F.when(cited, rx.sub(t, L.CITE_DOI, "", "i")).otherwise(t)

    for step in (bracket, paren, author, doi):
        col = rx.let(col, step)
    return col


def cut_references(col: Column) -> Column:
    """The text before the first tail heading that is found, heading patterns in order of priority.

    Headings are matched without case on the text itself, so letters that grow when upper-cased do not shift the cut.
    """

    def cut(t: Column) -> Column:
        start = F.greatest(F.length(t) - L.TAIL_CHARS, F.lit(0))

        def place(tail: Column) -> Column:
            headed = rx.has(tail, L.TAIL_BEGINS, "i")
            cuts = [F.when(headed, F.nullif(F.regexp_instr(tail, F.lit(rx.java(p, "i"))), F.lit(0))) for p in L.TAIL_CUTS]
            heavy = (rx.literal_count(tail, " PMID ") > 5) | (rx.literal_count(tail, " PubMed ") > 5)
            return F.coalesce(*cuts, F.when(heavy, F.nullif(F.locate(" PMID ", F.upper(tail)), F.lit(0))))

        at = rx.let(F.substring(t, start + 1, F.lit(L.TAIL_CHARS)), place)
        return rx.let(at, lambda n: F.when(n.isNotNull(), rx.strip(F.substring(t, F.lit(1), start + n - 1))).otherwise(t))

    return rx.let(col, cut)


def normalize_whitespace(col: Column) -> Column:
    t = F.replace(col, F.lit("\r"), F.lit("\n"))
    t = rx.sub(t, r"[ \t]{2,}|\t", " ")  # a single space stays
    t = rx.sub(t, r"\n[ \t]+", "\n")
    return rx.strip(rx.sub(t, r"\n{3,}", "\n\n"))


def basic_clean_fast(col: Column, remove_tables: bool = True) -> Column:
    """All cleaning steps in order; each one's guard is part of what it does."""

    def headings(t: Column) -> Column:
        hinted = contains_any(F.upper(F.substring(t, 1, 4000)), L.DEEP_CLEAN_HEADING_HINTS)
        return F.when(hinted, unflatten_headings(t)).otherwise(t)

    def figures_and_citations(t: Column) -> Column:
        """The guards of both steps look at the text before either, but for brackets and years."""
        low = F.lower(t)
        figure = contains_any(low, ["figure", "fig.", "table"])

        def cite(u: Column) -> Column:
            cited = F.contains(u, F.lit("[")) | (F.contains(u, F.lit("(")) & rx.has(u, L.YEAR_HINT))
            cited = cited | F.contains(low, F.lit("doi")) | F.contains(u, F.lit("10."))
            return F.when(cited, remove_inline_citations(u)).otherwise(u)

        return rx.let(F.when(figure, strip_figure_mentions(t)).otherwise(t), cite)

    def junk(t: Column) -> Column:
        return F.when(contains_any(F.lower(t), L.JUNK_TRIGGERS), remove_junk_and_supplements(t)).otherwise(t)

    def tables(t: Column) -> Column:
        tabular = (F.contains(F.lower(t), F.lit("table")) | F.contains(t, F.lit("\t"))) & F.contains(t, F.lit("\n"))
        return F.when(tabular, remove_table_dumps(t)).otherwise(t)

    def clean(raw: Column) -> Column:
        t = cut_references(F.replace(fix_mojibake(raw), F.lit("ï¬"), F.lit("")))
        for step in (headings, remove_boilerplate_lines, figures_and_citations, junk, *([tables] if remove_tables else [])):
            t = rx.let(t, step)
        return F.when(rx.strip(raw) == "", F.lit("")).otherwise(normalize_whitespace(t))

    return rx.let(empty(col), clean)


def fix_spacing_v1(col: Column) -> Column:
    t = F.replace(empty(col), F.lit("­"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    for pattern in (r"([a-z])([A-Z])", r"([A-Za-z])(\d)", r"(\d)([A-Za-z])", r"([.\?!;:])([A-Za-z])"):
        t = rx.sub(t, pattern, "$1 $2")
    return rx.strip(rx.squeeze(t))


def fix_spacing_v2(col: Column, split_stopwords: bool = True) -> Column:
    """The second pass's repair.  Splitting at stopwords also splits words that merely begin or end with one; without
    ``split_stopwords`` these two steps are left out."""
    t = F.replace(empty(col), F.lit(" "), F.lit(" "))
    t = rx.sub(rx.sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = rx.sub(t, L.OCR_GARBAGE, " ", "i")
    if split_stopwords:
        t = rx.sub(t, rf"\b({'|'.join(L.JOINED_AFTER)})([a-z]{{4,}})\b", "$1 $2", "i")
        t = rx.sub(t, rf"\b([a-z]{{4,}})({'|'.join(L.JOINED_BEFORE)})\b", "$1 $2", "i")
    t = rx.sub(t, L.DRUG_BOUNDARY, "$1 $2", "i")
    for left, rights in L.SUFFIX_SPLITS.items():
        t = rx.sub(t, rf"\b({left})({'|'.join(sorted(rights.split(), key=len, reverse=True))})\b", "$1 $2", "i")
    t = rx.sub(t, L.COMMON_SUFFIX, "$1 $2", "i")
    t = rx.sub(t, r"([a-z])([A-Z])", "$1 $2")
    t = rx.sub(t, r"\s+([,.;:!?])", "$1")
    t = rx.sub(rx.sub(t, r"(\()\s+", "$1"), r"\s+(\))", "$1")
    return rx.strip(rx.sub(t, r"[ \t]{2,}", " "))


def content_hash(col: Column) -> Column:
    """md5 of the text without its header line and key-idea mark, white space squeezed, case as it is."""
    t = rx.sub(empty(col), r"\[Cancer:.*?\]", " ", "is")
    return F.md5(rx.strip(rx.squeeze(rx.sub(t, r"Key idea:", " ", "i"))).cast("binary"))


def audit_fingerprint(col: Column) -> Column:
    return F.md5(rx.squeeze(rx.strip(F.lower(empty(col)))).cast("binary"))


def prefix_fingerprint(col: Column, chars: int = 400) -> Column:
    """md5 of the first letters, digits and spaces: texts that begin alike share it."""
    t = F.lower(rx.strip(rx.squeeze(empty(col))))
    return F.md5(F.substring(F.regexp_replace(t, "[^a-z0-9 ]+", ""), 1, chars).cast("binary"))


def strip_header(col: Column) -> Column:
    """The body after a micro header and its rule; a text without a rule loses the header's marks only.

    A header whose rule ends the text has an empty body.
    """
    bare = r"^\[Cancer:.*?\]\s*Key idea:.*?\n---\z"

    def body(t: Column) -> Column:
        empty_body = ~F.contains(t, F.lit("\n---\n")) & F.endswith(t, F.lit("\n---")) & rx.has(t, bare, "is")
        return F.when(empty_body, "").otherwise(rx.let(rx.strip(rx.sub(t, r"^\[Cancer:.*?\]\s*Key idea:\s*", "", "is")), cut))

    def cut(t: Column) -> Column:
        ruled = F.when(F.contains(t, F.lit("\n---\n")), F.regexp_replace(t, r"(?s)^.*?\n---\n", ""))
        inline = F.when(F.contains(t, F.lit(" --- ")), F.regexp_replace(t, r"(?s)^.*? --- ", ""))
        return rx.strip(F.coalesce(ruled, inline, t))

    return rx.let(rx.strip(empty(col)), body)


def body_text(col: Column) -> Column:
    """After the first ``---``; else after the first ``]``; else the whole text."""

    def cut(t: Column) -> Column:
        ruled = F.regexp_replace(t, rx.java(r"^.*?\s*---\s*", "s"), "")
        closed = F.regexp_replace(t, rx.java(r"^[^\]]*\]\s*", "s"), "")
        return F.when(F.contains(t, F.lit("---")), ruled).when(F.contains(t, F.lit("]")), closed).otherwise(t)

    return rx.strip(rx.let(empty(col), cut))


def body_text_indexed(col: Column) -> Column:
    t = empty(col)
    body = F.regexp_replace(t, r"(?s)^.*?\n---\n", "")
    return F.when(F.contains(t, F.lit("\n---\n")), rx.strip(body)).otherwise(rx.strip(t))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(empty(col)), F.lit(r"[A-Za-z0-9\-_/]+"), F.lit(0))


def normalize_for_match(col: Column) -> Column:
    return rx.squeeze(F.translate(F.lower(empty(col)), "/-", "  "))


def normalize(col: Column) -> Column:
    return rx.strip(rx.squeeze(F.lower(empty(col))))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(empty(col), "<[^>]+>", "")


def count_tokens(col: Column) -> Column:
    """White-space words, at least 1 for a text that is not empty."""
    n = rx.count(empty(col), r"\S+")
    return F.when(F.length(empty(col)) == 0, 0).otherwise(F.greatest(n, F.lit(1)))


def take_last_tokens(col: Column, n: int) -> Column:
    words = rx.find_all(empty(col), r"\S+")
    first = F.greatest(F.size(words) - n + 1, F.lit(1))
    return F.array_join(F.slice(words, first, F.lit(max(n, 0))), " ")


def window_split(col: Column, n: int) -> Column:
    """Runs of ``n`` words, each joined by one space."""
    words = rx.find_all(empty(col), r"\S+")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(n))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))


def split_paragraphs(col: Column) -> Column:
    parts = F.transform(F.split(empty(col), rx.java(r"\n\s*\n+"), -1), rx.strip)
    return F.filter(parts, lambda p: p != "")


def split_sentences(col: Column) -> Column:
    parts = F.transform(F.split(empty(col), rx.java(r"(?<=[.?!])\s+(?=[A-Z0-9])"), -1), rx.strip)
    return F.filter(parts, lambda p: p != "")


def tag_injection(label: Column, section: Column, text: Column, on: bool = False) -> Column:
    if not on:
        return empty(text)
    return F.concat(F.lit("CancerType: "), empty(label), F.lit("\nSection: "), empty(section), F.lit("\n"), empty(text))
