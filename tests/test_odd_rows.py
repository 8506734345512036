"""Odd rows against the SQL: blank texts, white space at the ends, letters at word borders."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.plans.catalog import QUERIES, SQL

TEXTS = ["", " ", "\n \n", " a", "a \t", "\ta", "a\r\nb\r", "\r", "\x00", '"q" ', "\\", "\n---\n", "\n---\nb\n---\nc", "# c", " null", "null", "x\n", "a,\nb", None]


def compare(spark, tmp_path, name: str, table: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def documents(texts: list) -> list[tuple]:
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_csv_keeps_white_space_and_nulls(spark, tmp_path):
    compare(spark, tmp_path, "csv_round_trip", "documents", documents(TEXTS), DOCUMENTS)


def test_blank_bodies_under_a_header(spark, tmp_path):
    compare(spark, tmp_path, "text_forms", "documents", documents([t for t in TEXTS if t is not None]), DOCUMENTS)


def test_header_alone_has_an_empty_body(spark):
    rows = ["[Cancer: a | Section: b | Paper: 1]\nKey idea: it\n---\n \n", "[Cancer: a] Key idea: it", "plain\n---", "a\n---\nb", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r.v for r in df.select("i", T.strip_header(F.col("t")).alias("v")).orderBy("i").collect()] == ["", "it", "plain\n---", "b", ""]


def test_labels_at_letters_beyond_ascii(spark, tmp_path):
    rows = [(0, "über les élans"), (1, "élos caminos"), (2, "queé va"), (3, "mit UND"), (4, "losa dere"), (5, ""), (6, None)]
    compare(spark, tmp_path, "label_detect", "benchmark", rows, "item_id long, text string")


def test_lines_of_digits_and_runs_of_space(spark, tmp_path):
    # Each of these would take hours, or the square of its length, with a choice of digits or of runs.
    digits = "\n" + ("1 2 " * 100 + "\n") * 5 + "no digit\n"
    texts = [digits, digits * 2 + "7\n" * 6 + "end", "a@b.org\n" + "\n" * 3000 + "end page 1 of it", "x" + " " * 9000 + "y@z.org at", "table 1\n" * 7]
    compare(spark, tmp_path, "deep_clean", "documents", documents(texts), DOCUMENTS)
