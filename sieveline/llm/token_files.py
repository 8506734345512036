"""Token ids in Parquet: list columns, dictionary or delta encoding, small row groups and pages with indexes.

The files hold one row for each document, in ascending order of its key over all files (their names sort in the same
order), with the token count as a column of its own, which can be read without the ids.  Row groups and pages are small
enough that a reader with a range of keys skips what it does not need by the page index.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.arrow import map_batches, values
from sieveline.llm.tokens import worker_encoder
from sieveline.operators.numbering import running_total
from sieveline.session import stable, tasks_for

__all__ = ["read_tokens", "token_index", "tokenize_table", "write_tokens"]

#: Parquet settings: "dictionary" suits ids below 65,536; "delta" writes DELTA_BINARY_PACKED pages.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
#: Text bytes for each file, so that the number of tasks follows the input.
FILE_BYTES = 64 << 20
#: Text bytes that are encoded at a time: a unit is looked up once in each.
BLOCK_BYTES = 8 << 20


def _blocks(texts: pa.Array) -> list[tuple[int, int]]:
    """First row and rows of parts of BLOCK_BYTES each, and up to one text more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1).tolist(), len(ends)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def tokenize_table(
    df: DataFrame, path: str, spaced: bool, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens and ids of every row: the ids of its whole text and the end id.  A null text is empty."""

    def make() -> Callable[[pa.RecordBatch], list[dict]]:
        encoder = worker_encoder(path, spaced)
        end = np.asarray([end_id], dtype="<u4").tobytes()

        def encode(batch: pa.RecordBatch) -> list[dict]:
            keys, made = values(batch, key), []
            column = values(batch, text)
            for at, rows in _blocks(column):
                found = [x + end for x in encoder.encode([t or "" for t in column.slice(at, rows).to_pylist()])]
                counts = np.asarray([len(x) // 4 for x in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                made.append(
                    {
                        "doc_id": keys.slice(at, rows),
                        "n_tokens": counts,
                        "ids": pa.ListArray.from_arrays(pa.array(offsets), flat),
                    }
                )
            return made

        return encode

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), make, f"doc_id {kind}, n_tokens long, ids array<int>")


def write_tokens(
    df: DataFrame,
    out: str,
    path: str,
    spaced: bool,
    end_id: int,
    encoding: str = "dictionary",
    key: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode all texts and write the token files under ``out`` in ascending order of the key.

    Ids must be below 2**31; keys may be of any type that orders.  Null keys come first.  Rows that share a key stand
    next to each other, in any order.  An empty table writes files without rows.  Extra columns are not read.
    """
    n = tasks_for(df, FILE_BYTES)
    slim = df.select(F.col(key), F.col(text)).repartitionByRange(n, F.col(key).asc_nulls_first())
    slim = slim.sortWithinPartitions(F.col(key).asc_nulls_first())
    rows = tokenize_table(slim, path, spaced, end_id, key, text)
    options = ENCODINGS[encoding] | {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": "2000",
    }
    rows.write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, out: str, ids: bool = True) -> DataFrame:
    """The token files' rows; without ids only the small columns are read."""
    rows = spark.read.parquet(out)
    return rows if ids else rows.drop("ids")


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: counts and checksums of the ids that stand there.

    ``start`` counts the ids before a row in the files' order, also where rows share a key.
    """
    rows = read_tokens(spark, out).select("doc_id", "ids", "_metadata.file_name", "_metadata.row_index")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def check(batch: pa.RecordBatch) -> dict:
            column = values(batch, "ids")
            flat = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            offsets = column.offsets.to_numpy().astype(np.int64)
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            named = {n: values(batch, n) for n in ("doc_id", "file_name", "row_index")}
            return named | {"n_tokens": np.diff(offsets), "ids_crc32": crcs}

        return check

    schema = f"doc_id {kind}, file_name string, row_index long, n_tokens long, ids_crc32 long"
    slim = stable(map_batches(rows, make, schema))
    placed = running_total(slim, ["doc_id", "file_name", "row_index"], value=F.col("n_tokens"), name="start")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")
