"""Arrow helpers for the operators in Python: batch functions over chosen columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | list[dict] | None]], schema: str | StructType
) -> DataFrame:
    """``df`` through a function from a record batch to columns (name to list or array).

    ``make`` runs once for each task and returns the function, so what it sets up (tokenizers, caches) is shared by
    the task's batches only.  The function may return a list of column sets, or None for no rows.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        f = make()
        for batch in batches:
            made = f(batch)
            for columns in made if isinstance(made, list) else [made]:
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [_array(columns[field.name], field.type) for field in out], schema=out
                    )

    return df.mapInArrow(run, kind)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
