"""Statistics, scores and drop rules for chunks, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline import rx
from sieveline.functions.text import audit_fingerprint, empty


def _length(t: Column) -> Column:
    return F.greatest(F.length(t), F.lit(1)).cast("double")


def space_ratio(col: Column) -> Column:
    t = empty(col)
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / _length(t)


def digit_ratio(col: Column) -> Column:
    t = empty(col)
    return rx.count(t, r"\p{Nd}") / _length(t)


def upper_ratio(col: Column) -> Column:
    t = empty(col)
    letters = rx.count(t, r"\p{L}")
    return F.when(letters > 0, rx.count(t, r"\p{Lu}") / letters.cast("double")).otherwise(0.0)


def uppercase_heavy(col: Column) -> Column:
    return upper_ratio(col) > 0.80


def numeric_heavy(col: Column) -> Column:
    return digit_ratio(col) > 0.18


def dna_heavy(col: Column, runs: int = 3) -> Column:
    t = empty(col)
    return (rx.count(F.upper(t), r"\b[ACGT]{12,}\b") >= runs) | rx.has(t, r"\brs\d{3,}\b", "i")


def weird_artifact(col: Column) -> Column:
    low = F.lower(empty(col))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in L.WEIRD_PARTS])


def pass1_reason(col: Column) -> Column:
    """Why the first pass drops a chunk (its text already repaired), or null."""
    sr = space_ratio(col)
    return (
        F.when(sr < 0.10, "low_space")
        .when(dna_heavy(col), "dna_heavy")
        .when((sr < 0.12) & uppercase_heavy(col) & numeric_heavy(col), "upper_numeric")
        .when(weird_artifact(col), "artifact")
    )


def reference_block(col: Column) -> Column:
    t = empty(col)
    pairs = rx.count(t, L.AUTHOR_PAIR, "i")
    separators = rx.literal_count(t, ";") + rx.literal_count(t, ",")
    listed = ((pairs >= 8) & (separators >= 8)) | ((pairs >= 6) & (rx.count(t, L.YEAR) >= 1) & (separators >= 6))
    listed = listed | (rx.has(t, L.JOURNALISH, "i") & (pairs >= 5) & (separators >= 6))
    return (F.length(t) >= 220) & (rx.has(t, L.REF_CUE, "i") | listed)


def delimiter_heavy(col: Column) -> Column:
    t = empty(col)
    return (rx.literal_count(t, "|") >= 6) | (rx.literal_count(t, "\t") >= 6)


def table_header_junk(col: Column) -> Column:
    t, sr = empty(col), space_ratio(col)
    caption = rx.has(t, L.CAPTION, "im")
    header = rx.has(t, L.URL, "i") | rx.has(t, L.PUBLISHER_HEADER, "i") | caption
    return (
        ((sr < 0.11) & numeric_heavy(t) & header)
        | ((sr < 0.11) & rx.has(t, L.ASSAY_TABLE, "i"))
        | (delimiter_heavy(t) & (sr < 0.13))
        | (caption & (sr < 0.14))
    )


def figure_table_dump(col: Column) -> Column:
    t = empty(col)
    sign = rx.has(t, L.FIG_TABLE_NOISE, "i") | rx.has(t, L.PAGE_ARTIFACT, "i") | rx.has(t, L.OCR_CODE, "i")
    plain = numeric_heavy(t) | delimiter_heavy(t) | (space_ratio(t) < 0.14)
    return (F.length(t) >= 160) & sign & plain


def pass2_reason(col: Column) -> Column:
    """Why the second pass drops a chunk, or null."""
    junk = table_header_junk(col)
    return (
        F.when((space_ratio(col) < 0.11) & (numeric_heavy(col) | junk), "low_space")
        .when(junk, "table_header_junk")
        .when(reference_block(col), "reference_block")
        .when(figure_table_dump(col), "figure_table_dump")
    )


def ref_score(col: Column, min_words: int = 40) -> Column:
    """Weighted signs of a reference list, not below 0.

    A pattern is tried only where a substring that each of its matches holds is there.
    """
    seen = rx.let(empty(col), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), rx.has(t, r"\d").alias("digit")))
    return rx.let(seen, lambda s: _ref_score(s["t"], s["low"], s["digit"], min_words))


def _ref_score(t: Column, low: Column, digit: Column, min_words: int) -> Column:
    def plus(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    def some(guard: Column, pattern: str, flags: str = "") -> Column:
        return F.when(guard, rx.count(t, pattern, flags)).otherwise(0)

    def holds(part: str) -> Column:
        return F.contains(low, F.lit(part))

    dash = F.contains(t, F.lit("-")) | F.contains(t, F.lit("–"))
    years = some(digit, L.YEAR)
    authors = rx.count(t, L.REF_AUTHOR) + rx.count(t, L.REF_AUTHOR_PREFIX, "i")
    journal = reduce(lambda a, b: a | b, [holds(j) for j in L.JOURNAL_HINTS])
    sentences = rx.literal_count(t, ". ")
    parts = [
        plus((holds("doi") | (digit & holds("10."))) & rx.has(t, L.REF_DOI, "i"), 4),
        plus((holds("http") | holds("www.")) & rx.has(t, L.REF_LINK, "i"), 2),
        plus(digit & holds("pmc") & rx.has(t, L.REF_PMC, "i"), 3),
        plus(some(digit | holds("pmid"), L.REF_PMID, "i") >= 2, 2),
        rx.let(years, lambda n: plus(n >= 3, 2) + plus(n >= 6, 1)),
        plus(holds("et") & holds("al") & rx.has(t, L.REF_ET_AL, "i"), 2),
        plus(journal, 2),
        rx.let(authors, lambda n: plus(n >= 8, 2) + plus(n >= 14, 1)),
        plus(some(digit, L.REF_NUMBERED_LINE) >= 2, 2),
        plus(some(digit & holds("["), L.REF_BRACKET) >= 4, 2),
        plus(digit & holds("(") & dash & rx.has(t, L.REF_ISSUE), 2),
        plus(some(digit & dash, L.REF_RANGE) >= 4, 2),
        plus((rx.literal_count(t, "\n") >= 3) & (sentences <= 2), 1),
        plus((rx.literal_count(t, ",") >= 10) & (sentences <= 3), 1),
        plus(rx.literal_count(t, ";") >= 5, 1),
    ]
    tiny = F.when(rx.count(t, r"\S+") < min_words, 2).otherwise(0)
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(0), reduce(lambda a, b: a + b, parts) - tiny))


def is_reference_list(col: Column, threshold: int = 6) -> Column:
    return ref_score(col) >= threshold


def merged_word_score(col: Column) -> Column:
    t, sr = empty(col), space_ratio(col)
    low = F.lower(t)
    score = (
        3.0 * rx.count(low, r"\b[a-z0-9]{26,}\b")
        + 2.0 * rx.count(low, r"\b[a-z]{22,}\b")
        + 1.5 * rx.count(low, L.STOPWORD_GLUE)
        + 1.0 * rx.count(t, r"[a-z]{3,}[A-Z][a-z]{2,}")
    )
    return score + F.when(sr < 0.085, 2.0).otherwise(0.0) + F.when(sr < 0.070, 3.0).otherwise(0.0)


def suspicious(col: Column) -> Column:
    return (merged_word_score(col) >= 6) | (space_ratio(col) < 0.085)


def very_bad(col: Column) -> Column:
    return (merged_word_score(col) >= 10) | (space_ratio(col) < 0.070)


def worst_by_fingerprint(df: DataFrame, row_id: str, text: str, n: int = 25, examples: int = 5) -> DataFrame:
    """The ``n`` worst distinct texts: fp, highest score, lowest space ratio, n_dupes and the lowest ids of each.

    Groups hold a count and ``examples`` ids: ids are ranked for the worst groups only.
    """
    rows = df.select(
        F.col(row_id).alias("row_id"), audit_fingerprint(F.col(text)).alias("fp"), merged_word_score(F.col(text)).alias("score"),
        space_ratio(F.col(text)).alias("sr"),
    )
    groups = rows.groupBy("fp").agg(F.max("score").alias("score"), F.min("sr").alias("sr"), F.count(F.lit(1)).alias("n_dupes"))
    worst = groups.orderBy(F.desc("score"), "sr", "fp").limit(n)
    own = rows.select("fp", "row_id").join(F.broadcast(worst.select("fp")), "fp")  # n rows
    first = own.withColumn("at", F.row_number().over(Window.partitionBy("fp").orderBy("row_id"))).where(F.col("at") <= examples)
    listed = first.groupBy("fp").agg(F.array_sort(F.collect_list("row_id")).alias("examples"))
    return worst.join(listed, "fp").orderBy(F.desc("score"), "sr", "fp")


def tokenish_count(col: Column) -> Column:
    return rx.count(empty(col), r"\w+|[^\w\s]")


def sentence_count(col: Column) -> Column:
    return rx.count(empty(col), "[.!?]")


def bullet_count(col: Column) -> Column:
    return rx.count(empty(col), r"(^|\s)[•\-]\s")


def norm_space(col: Column) -> Column:
    return rx.strip(rx.squeeze(empty(col)))


def keyword_soup_score(col: Column) -> Column:
    return rx.let(norm_space(col), _soup)


def _soup(t: Column) -> Column:
    body = rx.sub(t, r"^\[Cancer:.*?\]\s*Key idea:\s*", "")
    separators = rx.count(body, "[,;:/|]") / _length(body)
    score = (
        F.when(sentence_count(body) <= 1, 1.0).otherwise(0.0)
        + F.when(space_ratio(body) < 0.11, 1.0).otherwise(0.0)
        + F.when(digit_ratio(body) > 0.18, 1.0).otherwise(0.0)
        + F.when(separators > 0.015, 1.0).otherwise(0.0)
    )
    return F.when(t == "", 0.0).when(~rx.has(body, "[A-Za-z]{3,}"), 5.0).otherwise(score)


def is_dna_or_genotype(col: Column) -> Column:
    return dna_heavy(col, 2)


def is_table_or_header_junk(col: Column) -> Column:
    t, dr = empty(col), digit_ratio(col)
    dense = ((space_ratio(t) < 0.11) & (dr > 0.12)) | ((upper_ratio(t) > 0.85) & (dr > 0.10))
    return dense | rx.has(t, L.URL, "i") | rx.has(t, L.TABLE_SIGN, "i")


def answerability_score(col: Column) -> Column:
    return rx.let(norm_space(col), _answerability)


def _answerability(t: Column) -> Column:
    tok = tokenish_count(t)
    score = (
        F.when(tok >= 150, 1.0).otherwise(0.0)
        + F.when(tok <= 800, 0.5).otherwise(0.0)
        + F.when(sentence_count(t) >= 2, 1.0).otherwise(0.0)
        - F.when(_soup(t) >= 3.0, 2.0).otherwise(0.0)
        - F.when(is_table_or_header_junk(t), 3.0).otherwise(0.0)
    )
    return F.when(t == "", 0.0).otherwise(score)


def good_chunk(col: Column) -> Column:
    tok = tokenish_count(norm_space(col))
    clean = ~is_table_or_header_junk(col) & ~is_dna_or_genotype(col)
    return clean & (answerability_score(col) >= 1.5) & tok.between(180, 650)
