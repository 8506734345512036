"""Incremental ingest: clean, filter and drop repeats of a stream of documents, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import quality as Q
from sieveline.functions import text as T


def ingest_stream(df: DataFrame, text: str, time: str, min_chars: int = 200, late: str = "1 day") -> DataFrame:
    """Rows with clean_text and fingerprint; short ones, junk and repeats within ``late`` of each other are dropped.

    Works on streams and on tables alike.  Junk is told from the repaired text.  A stream keeps the row that comes
    first, and its state holds one key for each fingerprint of the last ``late``; of a table the earliest row stays,
    of equally early ones the one with the lowest text.
    """
    cleaned = df.withColumn("clean_text", T.basic_clean(F.col(text))).where(F.length("clean_text") >= min_chars)
    cleaned = cleaned.where(Q.pass1_reason(T.fix_spacing_v1(F.col("clean_text"))).isNull())
    cleaned = cleaned.withColumn("fingerprint", T.fingerprint(F.col("clean_text")))
    if not df.isStreaming:
        row = F.struct(*[F.col(c) for c in cleaned.columns if c != "fingerprint"])
        first = F.min_by(row, F.struct(F.col(time), F.col(text))).alias("row")
        return cleaned.groupBy("fingerprint").agg(first).select("row.*", "fingerprint")
    return cleaned.withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(events: DataFrame, time: str, key: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum for each key in tumbling windows; rows later than ``late`` are not counted."""
    at = events.withWatermark(time, late) if events.isStreaming else events
    grouped = at.groupBy(F.window(time, size).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("start"), key, "n", "total"
    )
