"""Exact dedupe, dense ids and diversification over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators.numbering import running_total


def dedupe_report(df: DataFrame, row_id: str, text: str, min_chars: int = 200) -> DataFrame:
    """Every row with its fingerprint, status (kept, too_short, duplicate_exact) and the row that is kept for it.

    Short texts are set aside before duplicates are looked for, so they never stand for others.  Copies are found by
    an aggregate (the lowest row for each fingerprint) and a join, so a text with very many copies is not sorted in
    one task.  ``kept_row`` is null for short texts.
    """
    cleaned = df.withColumn("fingerprint", T.fingerprint(F.col(text)))
    cleaned = cleaned.withColumn("_long", F.length(F.coalesce(text, F.lit(""))) >= min_chars)
    first = cleaned.where("_long").groupBy("fingerprint").agg(F.min(row_id).alias("kept_row"))
    found = cleaned.join(first, "fingerprint", "left")
    status = F.when(~F.col("_long"), "too_short").when(F.col("kept_row") < F.col(row_id), "duplicate_exact").otherwise("kept")
    return found.withColumn("status", status).withColumn("kept_row", F.when(F.col("_long"), F.col("kept_row"))).drop("_long")


def number_kept(report: DataFrame, row_id: str, name: str = "paper_id") -> DataFrame:
    """The kept rows with ids ``paper_000000`` and up, in row order, without a single-task window."""
    kept = running_total(report.where("status = 'kept'"), [row_id], name="_n")
    return kept.withColumn(name, F.format_string("paper_%06d", F.col("_n"))).drop("_n")


def diversify(
    df: DataFrame, query: str, score: str, row_id: str, content_hash: str, paper: str,
    max_per_hash: int = 1, max_per_paper: int = 1, top_k: int = 10,
) -> DataFrame:
    """Of each query's candidates by falling score: at most so many with one hash, of these so many of one paper.

    Rows with an empty hash (paper) are exempt from that limit.  Equal to a scan that counts as it goes.
    """

    def rank(of: Column) -> Column:
        return F.row_number().over(Window.partitionBy(query, of).orderBy(F.col(score).desc(), F.col(row_id)))

    h, p = F.coalesce(content_hash, F.lit("")), F.coalesce(paper, F.lit(""))
    some = df.withColumn("_rh", rank(h)).where((h == "") | (F.col("_rh") <= max_per_hash))
    some = some.withColumn("_rp", rank(p)).where((p == "") | (F.col("_rp") <= max_per_paper))
    last = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(row_id))
    return some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top_k).drop("_rh", "_rp")
