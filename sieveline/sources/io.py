"""Readers and writers with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sieveline.session import staged

#: What a field without a value is known by while it is read; no file needs to hold it.
NULL_SIGN = "\x01null\x01"
RAW_CSV = StructType([StructField("0", StringType()), StructField("a", StringType())])


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType = RAW_CSV, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with header, quoted fields and line ends in fields; Latin-1 where a line's bytes are not UTF-8.

    A replacement character that the file itself holds is a character like any other.  An empty field is null without
    quotes and the empty text within them.
    """
    utf8 = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).isEmpty()
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    # Spark reads a quoted empty field as null too, unless null has a sign of its own.
    reader = reader.option("nullValue", NULL_SIGN)
    found = reader.option("encoding", "UTF-8" if utf8 else "ISO-8859-1").csv(path)
    return found.select(*[f"`{c}`" for c in columns]) if columns else found


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that cannot be read is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_counted(spark: SparkSession, path: str, schema: StructType, text: list[str]) -> tuple[DataFrame, DataFrame]:
    """The readable rows with text, and one row of counts: lines, bad_json, empty_text, kept.  The file is read once."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = staged(lines.select(F.from_json("value", wide, options).alias("r")).select("r.*"), "jsonl")
    body = F.trim(coalesce_text(*[F.col(c) for c in text]))
    counts = read.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("_bad").alias("bad_json"),
        F.coalesce(F.sum((F.col("_bad").isNull() & (body == "")).cast("long")), F.lit(0)).alias("empty_text"),
        F.coalesce(F.sum((F.col("_bad").isNull() & (body != "")).cast("long")), F.lit(0)).alias("kept"),
    )
    return read.where(F.col("_bad").isNull() & (body != "")).drop("_bad"), counts


def coalesce_text(*cols: Column) -> Column:
    """The first text that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def write_csv(df: DataFrame, path: str) -> None:
    """Every text as it is: Spark's writer would cut white space and control signs at both ends of a field."""
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report (a row for each label or so) as one indented JSON file, through Spark's file system."""
    rows = json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2, ensure_ascii=False)
    spark = df.sparkSession
    spark.createDataFrame([(rows,)], "value string").coalesce(1).write.mode("overwrite").text(path)
