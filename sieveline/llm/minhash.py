"""Near-duplicate detection by b-bit MinHash (Li and König, 2010), with every link confirmed on full shingle sets.

Texts with equal shingle sets are one class, known by its lowest key.  Each class has minima of HASHES random
bijections over its shingles.  Bands of four full minima give candidate pairs; of each minimum the low four bits are
kept, packed into longs.  Equal bits are counted on the packed words, and the count corrected for chance equality
estimates the similarity; pairs far below the threshold go.  The others are compared set by set.

Candidates of a band's bucket are first linked to the bucket's lowest and highest class only: a group of thousands of
copies costs a link or two for each member.  Where the members of a bucket of four or more then still lie in different
components, they are compared by what sets them apart.  Such buckets are put together in cells, one for each component
that is the largest of a bucket.  The shingles that more than half of a cell's members hold are its core; a member's
rest are the shingles it has beside the core and those of the core that it lacks.  Two sets differ by the symmetric
difference of their rests, so with ``a`` shingles in the rest of a set of ``n``, and P the percentage, the score
``s = (100 + P) * a - (100 - P) * n`` says it all:

* two members are linked if and only if their rests share at least ``(s1 + s2) / (2 * (100 + P))`` shingles;
* members with ``s1 + s2 <= 0`` are linked whatever they share, and then both are linked with the member of the lowest
  score: one link to it each stands for all of these pairs;
* of the others, a pair with two members that are linked with the best needs no look.  One of the two is thus far from
  the core and must share shingles of its rest, rarest first, within prefixes that both scores bound.

A text that is near to none of a large group is so not compared with all of it, and no candidate pair is left out.  At
the threshold a true pair shares no bucket with a chance of (1 - 0.8**4)**24 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrow import map_batches, texts, values
from sieveline.llm.graph import connected_components
from sieveline.llm.hashing import LOWER, mix, shingle_hashes, word_hashes
from sieveline.session import Scratch, staged

BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
PACKED = HASHES * BITS // 64
#: Six standard deviations of the estimate below the threshold.
ESTIMATE_SLACK = 0.25
_NIBBLE = 0x1111111111111111


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (sets x BANDS) and packed low bits (sets x PACKED) of non-empty sets."""
    rng = np.random.default_rng(41)
    factor = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets])[:-1]
    minima = np.empty((HASHES, len(sets)), dtype=np.uint64)
    for k in range(HASHES):
        minima[k] = np.minimum.reduceat(flat * factor[k] + shift[k], at)
    bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), b + 1, dtype=np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[k])
        bands[:, b] = h
    low = minima.T & np.uint64((1 << BITS) - 1)
    packed = np.zeros((len(sets), PACKED), dtype=np.uint64)
    for k in range(HASHES):
        packed[:, k * BITS // 64] |= low[:, k] << np.uint64(k * BITS % 64)
    return bands.view(np.int64), packed.view(np.int64)


def shingle_sets(bodies: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    flat, at = word_hashes([b and b.translate(LOWER) for b in bodies])
    return [np.unique(shingle_hashes(flat[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]


def _slices(batch: pa.RecordBatch, text: str) -> list[tuple[int, list[bytes | None]]]:
    """The batch's texts in runs of about a megabyte, each with its first row."""
    out: list[tuple[int, list[bytes | None]]] = []
    run: list[bytes | None] = []
    first = size = 0
    for i, body in enumerate(texts(batch, text)):
        run.append(body)
        size += len(body or b"")
        if size >= 1 << 20:
            out.append((first, run))
            run, first, size = [], i + 1, 0
    if run:
        out.append((first, run))
    return out


def sketches(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, c1, c2 (the set's identity), bands and sig of every row; sets without shingles have none."""
    kind = df.schema[key].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], list[dict]]:
        def sketch(batch: pa.RecordBatch) -> list[dict]:
            made = []
            for first, bodies in _slices(batch, text):
                sets = shingle_sets(bodies, size)
                n = np.asarray([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(n)
                bands: list = [None] * len(sets)
                sig: list = [None] * len(sets)
                c1, c2 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                if len(some):
                    full = [sets[i] for i in some]
                    b, s = _signatures(full)
                    flat, at = np.concatenate(full), np.cumsum([0] + [len(x) for x in full])[:-1]
                    c1[some] = np.add.reduceat(mix(flat), at)
                    c2[some] = np.add.reduceat(mix(flat ^ np.uint64(0xD6E8FEB86659FD93)), at)
                    for j, i in enumerate(some):
                        bands[i], sig[i] = b[j], s[j]
                made.append(
                    {
                        "doc_id": values(batch, key).slice(first, len(bodies)),
                        "n_shingles": n,
                        "c1": c1.view(np.int64),
                        "c2": c2.view(np.int64),
                        "bands": bands,
                        "sig": sig,
                    }
                )
            return made

        return sketch

    schema = f"doc_id {kind}, n_shingles long, c1 long, c2 long, bands array<long>, sig array<long>"
    return map_batches(df.select(key, text), make, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal nibbles, corrected for chance equality."""

    def unequal(x: Column) -> Column:
        any_bit = x
        for d in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, d))
        return F.bit_count(any_bit.bitwiseAND(F.lit(_NIBBLE)))

    differ = sum((unequal(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PACKED)), F.lit(0))
    equal = (F.lit(float(HASHES)) - differ) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (equal - F.lit(chance)) / F.lit(1 - chance)


def near_duplicates(
    df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept for every row of ``df``.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their sets of ``size``-word shingles;
    ``component_id`` is the lowest key that a row reaches over links, ``class_id`` the lowest with an equal set.
    Null texts and texts without words have empty sets, are linked with nothing and are kept.  Rows that share a key
    are one document for the components, with the links of all its texts; rows with a null key are kept and linked
    with nothing.  Extra columns are not read; an empty table gives no rows.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(sketches(docs, size, "doc_id", "text"), "sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["c1", "c2", "n_shingles"]
    classes = staged(full.groupBy(*same).agg(F.min("doc_id").alias("class_id")), "classes")
    heads = full.join(classes.withColumnRenamed("class_id", "doc_id"), [*same, "doc_id"], "left_semi")
    with Scratch(df.sparkSession) as kept:
        heads = kept.table(
            heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sig"), "heads"
        )
        members = _bucket_members(heads, kept)
        sets = _candidate_sets(docs, members.select("id").distinct(), size, kept)
        stars = members.where("id <> lo").select(F.col("id").alias("u"), F.col("lo").alias("v"))
        stars = stars.unionByName(members.where("id <> hi").select(F.col("hi").alias("u"), F.col("id").alias("v")))
        links = kept.table(_confirmed(_plausible(stars.distinct(), heads, percent), sets, percent), "star-links")
        components = connected_components(links)
        cells = kept.table(_cells(members, components, kept), "cells")
        more = _cell_pairs(cells, sets, percent, kept)
        tried = stars.distinct()
        more = _plausible(more.join(tried, ["u", "v"], "left_anti"), heads, percent)
        more = kept.table(_confirmed(more, sets, percent), "cell-links")
        if not more.isEmpty():
            known = components.select(F.col("node").alias("u"), F.col("component").alias("v"))
            components = connected_components(known.unionByName(more))
    out = rows.join(classes, same, "left").withColumn(
        "class_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id"))
    )
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(components, out["class_id"] == components["node"], "left")
    component = F.coalesce("component", "class_id").alias("component_id")
    out = out.select("doc_id", "n_shingles", "class_id", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _bucket_members(heads: DataFrame, kept: Scratch) -> DataFrame:
    """h, id, lo, hi and m: the classes of every bucket of two or more, with its lowest and highest and their number."""
    banded = heads.select("id", F.explode("bands").alias("h"))
    buckets = banded.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m"))
    buckets = kept.table(buckets.where("lo <> hi"), "buckets")
    return kept.table(banded.join(buckets, "h"), "members")


def _plausible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes allow the similarity, and whose signatures do not put it far below."""
    of = [heads.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "uv"]
    both = pairs.join(of[0], "u").join(of[1], "v")
    fits = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    near = estimate(F.col("su"), F.col("sv")) >= F.lit(percent / 100 - ESTIMATE_SLACK)
    return both.where(fits & near).select("u", "v").distinct()


def _cells(members: DataFrame, components: DataFrame, kept: Scratch) -> DataFrame:
    """cell, id and c of the classes of buckets that hold several components: c is a class's own component, cell
    the one that most classes of the bucket belong to.  In buckets of up to three all pairs were star pairs."""
    inner = members.where("m > 3").select("h", "id")
    inner = inner.join(components, inner["id"] == components["node"], "left")
    inner = kept.table(inner.select("h", "id", F.coalesce("component", "id").alias("c")), "bucket-components")
    by_c = inner.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    top = by_c.groupBy("h").agg(F.max(F.struct("k", "c"))["c"].alias("cell"), F.count(F.lit(1)).alias("cs"))
    # A table of its own, so that Spark can split a hot bucket's members in the join.
    top = kept.table(top.where("cs > 1").select("h", "cell"), "bucket-tops")
    return inner.join(top, "h").select("cell", "id", "c").distinct()


def _cell_pairs(cells: DataFrame, sets: DataFrame, percent: int, kept: Scratch) -> DataFrame:
    """Pairs (u, v) in one cell and different components of which no link is left out; the module says how."""
    plus, minus = 100 + percent, 100 - percent
    held = kept.table(cells.join(sets, "id").select("cell", "id", "c", "set"), "cell-sets")
    sizes = kept.table(held.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell-sizes")
    counts = held.select("cell", F.explode("set").alias("t")).groupBy("cell", "t").agg(F.count(F.lit(1)).alias("f"))
    cores = counts.join(sizes, "cell").where("2 * f > m").groupBy("cell").agg(F.collect_list("t").alias("core"))
    cores = kept.table(cores, "cores")
    none = F.array().cast("array<long>")
    apart = held.join(cores, "cell", "left").withColumn("core", F.coalesce("core", none))
    rest = F.concat(
        F.transform(F.array_except("set", "core"), lambda t: F.struct(t.alias("t"), F.lit(True).alias("has"))),
        F.transform(F.array_except("core", "set"), lambda t: F.struct(t.alias("t"), F.lit(False).alias("has"))),
    )
    apart = apart.select("cell", "id", "c", F.size("set").cast("long").alias("n"), rest.alias("rest"))
    score = F.size("rest") * F.lit(plus) - F.col("n") * F.lit(minus)
    apart = kept.table(apart.withColumn("s", score), "rests")
    best = apart.groupBy("cell").agg(F.min(F.struct("s", "id", "c")).alias("best"))
    best = kept.table(best.select("cell", *[F.col(f"best.{x}").alias(f"best_{x}") for x in ("s", "id", "c")]), "best")
    apart = apart.join(best, "cell")
    linked = apart.where("s + best_s <= 0 AND c <> best_c")
    pairs = [linked.select(F.greatest("id", "best_id").alias("u"), F.least("id", "best_id").alias("v"))]
    # Shingles of the rests that two or more members share, the rarest first; left: how many are still to come.
    shown = apart.select("cell", "id", "c", "n", "s", "best_s", F.explode("rest").alias("x"))
    shown = shown.select("cell", "id", "c", "n", "s", "best_s", "x.t", "x.has")
    shared = shown.groupBy("cell", "t", "has").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = kept.table(shared, "shared-rests")
    of = ["cell", "id", "c", "n", "s", "best_s"]
    ranked = shown.join(shared, ["cell", "t", "has"]).groupBy(*of).agg(
        F.array_sort(F.collect_list(F.struct("f", "t", "has"))).alias("common")
    )
    placed = ranked.select(*of, F.size("common").alias("all"), F.posexplode("common").alias("at", "x"))
    placed = placed.select(*of, "x.t", "x.has", (F.col("all") - F.col("at")).alias("left"))
    far = F.col("s") + F.col("best_s") > 0
    # The least score of a partner: any member's for far ones, a far member's for near ones.
    least_far = F.greatest(F.lit(1) - F.col("best_s"), F.col("best_s"))
    reach = F.col("left") * F.lit(2 * plus)
    placed = placed.withColumn("far", far).withColumn("to_far", reach >= F.col("s") + least_far)
    placed = kept.table(placed.where((F.col("far") & (reach >= F.col("s") + F.col("best_s"))) | F.col("to_far")), "prefixes")
    on = ["cell", "t", "has"]
    for a, b, once in (
        (placed.where("far"), placed.where("NOT far"), F.lit(True)),
        (placed.where("far AND to_far"), placed.where("far AND to_far"), F.col("a.id") < F.col("b.id")),
    ):
        a, b = a.alias("a"), b.alias("b")
        near = F.least("a.left", "b.left") * F.lit(2 * plus) >= F.col("a.s") + F.col("b.s")
        fits = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
        for x in on:
            near = near & (F.col(f"a.{x}") == F.col(f"b.{x}"))
        found = a.join(b, near & fits & once & (F.col("a.c") != F.col("b.c")))
        pairs.append(found.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")))
    return kept.table(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct(), "cell-pairs")


def _candidate_sets(docs: DataFrame, ids: DataFrame, size: int, kept: Scratch) -> DataFrame:
    """id and set of the chosen rows, from the whole texts; an id that has several texts has several sets."""
    chosen = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], list[dict]]:
        def build(batch: pa.RecordBatch) -> list[dict]:
            return [
                {
                    "id": values(batch, "doc_id").slice(first, len(bodies)),
                    "set": [s.view(np.int64) for s in shingle_sets(bodies, size)],
                }
                for first, bodies in _slices(batch, "text")
            ]

        return build

    return kept.table(map_batches(chosen, make, f"id {kind}, set array<long>"), "candidate-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv")).cast("long")
    union = F.size("su") + F.size("sv") - shared
    return both.where(shared * 100 >= union * percent).select("u", "v").distinct()
