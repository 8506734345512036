"""Sharding by jump consistent hashing (Lamping and Veach, 2014), as one Column expression.

A key's shard follows from the key and the shard count alone: there is no ring table to build, ship or keep.  Adding
a shard moves about ``1 / (n + 1)`` of the keys, all of them into the new shard.

The generator multiplies modulo 2**64.  Spark's longs are signed and raise on overflow, so the state is kept as two
32-bit halves and multiplied in 16-bit limbs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.numbering import running_total

# The multiplier of the published generator, in two halves.
_MULTIPLIER = 2862933555777941757
_MUL_HI, _MUL_LO = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF
_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF


def _low32_product(a: Column, b: int) -> Column:
    """``a * b`` modulo 2**32 for a, b below 2**32, without a product over 2**49."""
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(_LOW16)), 16)
    return (high + a.bitwiseAND(F.lit(_LOW16)) * F.lit(b)).bitwiseAND(F.lit(_LOW32))


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The state after ``key = key * multiplier + 1``."""
    low = lo.bitwiseAND(F.lit(_LOW16)) * F.lit(_MUL_LO) + F.lit(1)
    mid = F.shiftright(lo, 16) * F.lit(_MUL_LO) + F.shiftright(low, 16)
    new_lo = F.shiftleft(mid.bitwiseAND(F.lit(_LOW16)), 16) + low.bitwiseAND(F.lit(_LOW16))
    carry = F.shiftright(mid, 16)
    new_hi = _low32_product(hi, _MUL_LO) + _low32_product(lo, _MUL_HI) + carry
    return new_hi.bitwiseAND(F.lit(_LOW32)), new_lo


def jump_shards(key: Column, counts: Sequence[int]) -> Column:
    """An array with the key's shard under each shard count of ``counts``.

    ``key`` is a long, read as an unsigned 64-bit number; a null key counts as 0.  The key's jumps do not depend on
    the shard count, so all counts share one walk: a shard is the last jump below its count.
    """
    if not counts or min(counts) < 1:
        raise ValueError("shard counts must be 1 or more")
    most = max(counts)
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW32)).alias("lo"),
        F.lit(0).cast("long").alias("at"),
        F.array(*[F.lit(0).cast("long") for _ in counts]).alias("shards"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next_state(s["hi"], s["lo"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        to = F.floor((s["at"] + F.lit(1)).cast("double") * ratio).cast("long")
        shards = F.array(*[F.when(to < F.lit(n), to).otherwise(s["shards"][i]) for i, n in enumerate(counts)])
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), to.alias("at"), shards.alias("shards"))
        return F.when(s["at"] >= F.lit(most), s).otherwise(moved)

    # Every jump goes up by one shard at least, so this many steps end every walk; done keys only pass through.
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, jump, lambda s: s["shards"])


def assign_shards(
    df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", order: Sequence[str] | None = None
) -> DataFrame:
    """One row for each row of ``df``: key, size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the UTF-8 length of the text plus 1, ``slot`` the row's position in its shard in the order of the key
    (then of the text's checksum), ``grown_shard`` the shard under ``shards + 1``.

    A null text has size 1 and the checksum of no bytes (0); a null key is hashed as 0 and ordered first.  Repeated
    rows share a shard and get slots of their own.  Other columns of ``df`` are not read.  A non-numeric key is
    hashed to a long first.
    """
    kind = df.schema[key].dataType.typeName()
    number = F.col(key) if kind in ("byte", "short", "integer", "long") else F.xxhash64(F.col(key))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = df.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shards(number, [shards, shards + 1]).alias("_s"),
    ).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("_s")[0].cast("int").alias("shard"),
        F.col("_s")[1].cast("int").alias("grown_shard"),
    )
    placed = running_total(slim, list(order or (key, "text_crc32")), by=["shard"], name="slot")
    return placed.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
