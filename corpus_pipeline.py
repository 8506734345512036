"""A corpus from raw documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

Odd rows are the same to all stages: a null text is an empty one, columns of any other name are carried along unread, an
empty table stays empty, and a row is judged by itself even where others share its doc_id, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.decontaminate import find_leaks
from sieveline.llm.lines import dedup_lines
from sieveline.llm.minhash import near_duplicates
from sieveline.llm.packing import pack_documents
from sieveline.llm.quality import filter_quality
from sieveline.llm.tokens import tokenizer_path
from sieveline.session import read_table, staged

#: The stages' results are token windows and model verdicts, which SQL cannot express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep.

    Null, empty and short texts (under 50 words) fail the rules and go.  Repeated rows share their fate.  Where
    ``labels`` has no rows of both kinds the rules alone decide.
    """
    return filter_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents that lose all their lines go.

    Texts of fewer than three lines, null and empty ones among them, stay as they are.  Of repeated rows of three lines
    or more one stays, the others lose all their lines and go.
    """
    found = dedup_lines(docs)
    found = found.where("n_removed = 0 OR n_removed < n_lines")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the lowest doc_id.

    Two texts are near if their sets of five-word shingles have a similarity of 0.8 or more.  Null and empty texts are
    near to none and stay; so do rows without a doc_id.  Rows that share a doc_id are one document: all of them stay or
    go.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item.

    A null or empty text holds none and stays, as all do where the benchmark is empty.
    """
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(F.size("spans") == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens of related documents: a row for each piece of a document.

    A null or empty text is its end id alone; rows that share a doc_id are documents of their own.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
