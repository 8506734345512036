"""Regular expressions as the JVM reads them.

The patterns of the lexicon are written for Unicode-aware matching with ``\\n`` as the only line end.  Java needs flags
for that: ``U`` for Unicode classes, ``u`` for Unicode case folding, ``d`` for the line end.  All patterns are
literals, so Spark compiles each once for a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, flags: str = "") -> str:
    """``pattern`` with ``flags`` (of i, m, s) and Unicode classes and line ends."""
    return f"(?{flags}Ud{'u' if 'i' in flags else ''}){pattern}"


def has(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(java(pattern, flags))


def count(col: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(col, F.lit(java(pattern, flags)))


def sub(col: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(col, java(pattern, flags), to)


def find_all(col: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(java(pattern, flags)), F.lit(group))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return sub(col, r"^\s+|\s+$", "")


def squeeze(col: Column, to: str = " ") -> Column:
    return sub(col, r"\s+", to)


def literal_count(col: Column, text: str) -> Column:
    """How often ``text`` stands in ``col`` without overlap."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(text), F.lit("")))) / len(text)).cast("int")


def words(terms: list[str]) -> str:
    """An alternation of whole words; spaces inside a term match any white space."""
    return r"\b(?:" + "|".join(r"\s+".join(re.escape(w) for w in t.split()) for t in terms) + r")\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once.

    A Column that stands in an expression several times is copied into the plan each time; nested steps that each
    use their input three times would make a plan of exponential size.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(*cols: Column) -> Column:
    """The first of ``cols`` that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
