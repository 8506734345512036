"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.decontaminate import find_leaks
from sieveline.llm.lines import LINE_SQL, dedup_lines
from sieveline.llm.minhash import near_duplicates
from sieveline.llm.packing import pack_documents
from sieveline.llm.quality import judge_quality
from sieveline.llm.secrets import scan_secrets
from sieveline.llm.sharding import assign_shards
from sieveline.llm.substring import remove_repeats
from sieveline.llm.token_files import token_index, write_tokens
from sieveline.llm.tokens import tokenizer_path
from sieveline.llm.wrappers import extract_pages
from sieveline.session import read_table, table_path

SHARDS = 16


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents with the forest's verdict; secrets as digests."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"), path="source")
    return found.select(
        "doc_id", "word_at", F.sha2("candidate", 256).alias("secret_sha256"), "length", "score", "is_secret"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by jump consistent hashing of doc_id."""
    return assign_shards(read_table(spark, sf_dir, "documents"), SHARDS)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows: counts and a digest of the text."""
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_removed", digest)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside eight-word windows of benchmark items."""
    found = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.8 of their two-word shingles."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in Parquet files with dictionary pages, read back."""
    out = table_path(spark, "token-files")
    docs = read_table(spark, sf_dir, "documents")
    write_tokens(docs, out, tokenizer_path("byte_bpe_50k.json"), spaced=True, end_id=2)
    return token_index(spark, out)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts for all documents; the forest's threshold comes from ``labels``."""
    found = judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return found.select("doc_id", *names)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 35-word windows."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_secret_scan,
            op2_sharding,
            op3_html_extraction,
            op4_line_dedup,
            op5_decontamination,
            op6_near_dedup,
            op7_token_files,
            op8_quality_rules,
            op9_substring_dedup,
            op10_packing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_SQL}
