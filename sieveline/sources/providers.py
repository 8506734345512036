"""Services behind narrow interfaces, with stand-ins that need no network."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scoring import l2_normalize
from sieveline.functions.text import tokens


def hashing_vectors(df: DataFrame, row_id: str, text: str, dims: int = 64) -> DataFrame:
    """row_id and vec: a deterministic vector of each text, its tokens' hashes counted with signs, at unit length.

    A text without tokens has the zero vector.
    """
    rows = df.select(row_id, F.explode_outer(tokens(F.col(text))).alias("t")).withColumn("h", F.xxhash64("t"))
    sign = F.when(F.col("t").isNull(), 0.0).when(F.shiftrightunsigned("h", 63) == 0, 1.0).otherwise(-1.0)
    cells = rows.groupBy(row_id, F.pmod("h", F.lit(dims)).cast("int").alias("i")).agg(F.sum(sign).alias("x"))
    maps = cells.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return maps.select(row_id, l2_normalize(full).alias("vec"))


def embed_with(
    df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 256, tries: int = 5, pause: float = 2.0
) -> DataFrame:
    """``df`` with ``vec`` from a service, so many texts a call; a call that fails is tried again, then the task fails."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def call(texts: list[str]) -> list[list[float]]:
        for left in range(tries - 1, -1, -1):
            try:
                return embed(texts)
            except Exception:
                if not left:
                    raise
                time.sleep(pause)
        raise AssertionError

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch]
                made = call([t if isinstance(t, str) else "" for t in own[text]])
                unit = [[x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for v in made]
                yield own.assign(vec=unit)

    return df.mapInPandas(run, f"{schema}, vec array<float>")


def embedding_cost(df: DataFrame, tokens_column: str, per_million: float = 0.13) -> DataFrame:
    """texts, tokens and the estimated cost of embedding them."""
    return df.agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(tokens_column).alias("tokens"),
        (F.sum(tokens_column) * per_million / 1e6).alias("cost"),
    )
