"""Connected components by alternating large and small stars (Kiveris et al., 2014), in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import stable


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v): the lowest node that it reaches.

    Each star step takes the minimum over a node's neighbours as an aggregate, then joins it back, so a node with
    very many links is neither gathered nor sorted in one task.  Steps are cut by reliable checkpoints.  The number
    of rounds is logarithmic; an error is raised if ``rounds`` did not settle it.
    """
    now = stable(_ordered(edges))
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        now = stable(_small_star(_large_star(now)))
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, from the higher node u to the lower v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the lowest of u and its neighbours."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    # A node's lower neighbours are its v; those above it are the u of links that end in it.
    up = edges.select(F.col("v").alias("n"), F.col("u").alias("w"))
    joined = up.join(lowest.withColumnRenamed("u", "n"), "n", "left")
    return joined.select(F.col("w").alias("u"), F.coalesce("m", "n").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u, are linked to the lowest of them."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(lowest.withColumnRenamed("m", "v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0
