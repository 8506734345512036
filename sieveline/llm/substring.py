"""Substring dedup by a log-structured index of window fingerprints.

A window is 35 consecutive words.  Writing every window of a corpus into an index would be many times the corpus, so
windows are gathered by their anchors: of a window's eight-word grams the one with the lowest hash, the leftmost of
equal ones.  Equal windows have equal anchors, neighbouring windows mostly share theirs, and an anchor stands for a
run of about eleven windows.  For each anchor the index keeps how often it occurred and the lowest and the highest
hash of its run's words (its span):

* one occurrence: none of its windows occurs twice;
* several, all with the same span: all of their windows do;
* several with different spans: the windows of these runs are compared one by one, by 128 bits of hash.

The index is a list of immutable runs, each a Parquet table in buckets by anchor and sorted in them, so that runs meet
by merge joins without a shuffle.  Texts come in batches.  ``add`` merge-joins a batch's anchors with each run for what
the index knew of them, writes them as a run of their own, and merges all runs into one when there are too many.
``remove_repeats`` sends its table through an index in batches and reads the repeated anchors off the merged run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.arrow import map_batches, texts, values
from sieveline.llm.hashing import mix, powers, window_hashes, word_hashes
from sieveline.session import delete_path, staged, table_path, tasks_for

WINDOW, GRAM = 35, 8
MAX_RUNS = 2
#: Stored bytes of texts for each bucket of a run.
BUCKET_BYTES = 64 << 20
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
RUN_SCHEMA = "g long, n long, low long, apart long"


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost lowest value in every run of ``width`` values, in a few passes over the array.

    The lowest of a run of 2 * w is the lower of two runs of w; a width is covered by two overlapping powers of two.
    """
    at = np.arange(len(x))
    have = 1
    while have * 2 <= width:
        a, b = at[: len(at) - have], at[have:]
        at = np.where(x[b] < x[a], b, a)
        have *= 2
    shift = width - have
    if shift:
        a, b = at[: len(at) - shift], at[shift:]
        at = np.where(x[b] < x[a], b, a)
    return at


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, span hash, first and last window start of every run of one text's windows."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = window_hashes(words, gram)
    at = _sliding_argmin(grams, window - gram + 1)
    edge = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [n]]) - 1
    anchor = at[first]
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words ^ _BASE) * powers(_BASE, len(words)), out=prefix[1:])
    stop = last + window
    span = (prefix[stop] - prefix[first]) * powers(_INVERSE, len(words))[first]
    shape = (stop - first).astype(np.uint64) * np.uint64(65536) + (anchor - first).astype(np.uint64)
    return grams[anchor], mix(span + mix(shape)), first, last


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and the text's hash: together they name a row's text even where keys repeat."""
    return df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("x"), F.col(text).alias("t"))


def _slices(batch: pa.RecordBatch) -> list[tuple[int, list[bytes | None]]]:
    return [(at, texts(batch.slice(at, 256), "t")) for at in range(0, batch.num_rows, 256)]


def anchor_table(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """g, span, k, x, first, last: a row for each anchor of each text."""
    kind = keyed.schema["k"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], list[dict]]:
        def find(batch: pa.RecordBatch) -> list[dict]:
            made = []
            for at, bodies in _slices(batch):
                flat, ends = word_hashes(bodies)
                parts = [anchors(flat[a:b], window) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                rows = np.repeat(np.arange(len(bodies)), [len(p[0]) for p in parts])
                g, span, first, last = (np.concatenate([p[i] for p in parts]) for i in range(4))
                own = batch.slice(at, 256)
                made.append(
                    {
                        "g": g.view(np.int64),
                        "span": span.view(np.int64),
                        "k": values(own, "k").take(pa.array(rows)),
                        "x": values(own, "x").take(pa.array(rows)),
                        "first": first,
                        "last": last,
                    }
                )
            return made

        return find

    return map_batches(keyed, make, f"g long, span long, k {kind}, x long, first int, last int")


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs put together by anchor: a merge join, as both are sorted by it."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col("x.g") == F.col("y.g"), "full_outer")
    low = F.least("x.low", "y.low")  # the other where one is null
    high = F.greatest(F.expr("x.low ^ x.apart"), F.expr("y.low ^ y.apart"))
    n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
    return both.select(F.coalesce("x.g", "y.g").alias("g"), n.alias("n"), low.alias("low"), high.bitwiseXOR(low).alias("apart"))


class FingerprintIndex:
    """Sorted immutable runs of anchors in the shared folder; ``apart`` is 0 where all spans are equal."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, max_runs: int = MAX_RUNS, buckets: int | None = None) -> None:
        self.spark, self.window, self.max_runs, self.buckets = spark, window, max_runs, buckets
        self.runs: list[tuple[str, str]] = []

    def _write(self, rows: DataFrame) -> None:
        """A new run: one sorted file for each bucket."""
        path = table_path(self.spark, "fingerprints")
        name = "run_" + path.rsplit("-", 1)[1]
        dealt = rows.repartition(self.buckets, "g").sortWithinPartitions("g")
        writer = dealt.write.format("parquet").bucketBy(self.buckets, "g").sortBy("g")
        writer.option("path", path).option("compression", "zstd").saveAsTable(name)
        self.runs.append((name, path))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)

    def _joined(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return reduce(_merged, [self.spark.table(name) for name, _ in self.runs])

    def add(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Add a batch of texts as a run; runs beyond ``max_runs`` are merged into one."""
        if self.buckets is None:
            self.buckets = tasks_for(df, BUCKET_BYTES)
        found = anchor_table(_keyed(df, key, text), self.window)
        counted = found.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high")
        )
        self._write(counted.select("g", "n", "low", F.expr("low ^ high").alias("apart")))
        if len(self.runs) > self.max_runs:
            self.compact()

    def known(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """What the index has of a batch that is not in it yet: k, x, first, last and same for the runs of windows
        whose anchor stands in the index; ``same`` tells that all its places there have the very words of this one.

        Where it is false the windows differ in part, and have to be compared with those of the texts themselves.
        """
        found = anchor_table(_keyed(df, key, text), self.window)
        met = found.join(self._joined(), "g")
        same = (F.col("apart") == 0) & (F.col("span") == F.col("low"))
        return met.select("k", "x", "first", "last", same.alias("same"))

    def compact(self) -> None:
        """Merge all runs into one, then drop the old ones."""
        if len(self.runs) > 1:
            old, merged = list(self.runs), self._joined()
            self._write(merged)
            self.runs = self.runs[-1:]
            self._drop(old)

    def close(self) -> None:
        """Delete all runs."""
        self._drop(self.runs)
        self.runs = []

    def repeated(self) -> DataFrame:
        """g and mixed for the anchors that occur more than once in all runs."""
        return self._joined().where("n > 1").select("g", (F.col("apart") != 0).alias("mixed"))


def repeated_runs(keyed: DataFrame, index: FingerprintIndex) -> DataFrame:
    """k, x and runs (first, last, mixed) of the texts that hold repeated anchors."""
    shared = staged(index.repeated(), "repeated-anchors")
    found = anchor_table(keyed, index.window).drop("span").join(shared, "g")
    # Repeated rows have the same runs: a set holds them once.
    return found.groupBy("k", "x").agg(F.collect_set(F.struct("first", "last", "mixed")).alias("runs"))


def _mixed_windows(keyed: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """h, h2, k, x, at of the windows whose anchors have different spans."""
    some = runs.where(F.exists("runs", lambda r: r["mixed"]))
    joined = _with_runs(keyed, some, "inner")
    kind = keyed.schema["k"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], list[dict]]:
        def find(batch: pa.RecordBatch) -> list[dict]:
            made = []
            for at, bodies in _slices(batch):
                own = batch.slice(at, 256)
                flat, ends = word_hashes(bodies)
                h, h2, starts, rows = [], [], [], []
                for i, of in enumerate(values(own, "runs").to_pylist()):
                    words = flat[ends[i] : ends[i + 1]]
                    spans = [np.arange(r["first"], r["last"] + 1) for r in of if r["mixed"]]
                    where = np.unique(np.concatenate(spans))
                    h.append(window_hashes(words, window, 1)[where])
                    h2.append(window_hashes(words, window, 2)[where])
                    starts.append(where)
                    rows.append(np.full(len(where), i))
                take = pa.array(np.concatenate(rows))
                made.append(
                    {
                        "h": np.concatenate(h).view(np.int64),
                        "h2": np.concatenate(h2).view(np.int64),
                        "k": values(own, "k").take(take),
                        "x": values(own, "x").take(take),
                        "at": np.concatenate(starts),
                    }
                )
            return made

        return find

    return map_batches(joined, make, f"h long, h2 long, k {kind}, x long, at int")


def _with_runs(keyed: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    named = runs.select(F.col("k").alias("rk"), F.col("x").alias("rx"), *[c for c in runs.columns if c not in ("k", "x")])
    return keyed.join(named, keyed["k"].eqNullSafe(named["rk"]) & (keyed["x"] == named["rx"]), how).drop("rk", "rx")


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 4
) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, joined by one space) and spans (removed word ranges) of all rows.

    A word goes if a window that covers it has the same words as a window that starts elsewhere, in the same text or
    any other.  Texts go into the index in ``batches`` parts.  Words are runs of characters other than ASCII white
    space, compared unchanged.  Null, empty and short texts (fewer words than a window) lose nothing; a null text has
    no words and an empty kept text.  A repeated row is another place, so texts of window length or more that stand
    in two rows lose all words, whatever their keys.  Extra columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    keyed = _keyed(df, key, text)
    index = FingerprintIndex(spark, window)
    for part in range(batches):
        index.add(keyed.where(F.pmod(F.coalesce("x", F.lit(0)), F.lit(batches)) == part), "k", "t")
    index.compact()
    runs = staged(repeated_runs(keyed, index), "repeated-runs")
    index.close()
    windows = _mixed_windows(keyed, runs, window)
    # A table of its own, so that Spark can split a hot window's places in the join.
    twice = windows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    twice = staged(twice, "repeated-windows")
    hit = windows.join(twice, ["h", "h2"]).groupBy("k", "x").agg(F.collect_set("at").alias("single"))
    whole = runs.select("k", "x", F.filter("runs", lambda r: ~r["mixed"]).alias("whole"))
    both = whole.join(
        hit.select(F.col("k").alias("hk"), F.col("x").alias("hx"), "single"),
        F.col("k").eqNullSafe(F.col("hk")) & (F.col("x") == F.col("hx")),
        "left",
    ).select("k", "x", "whole", "single")
    joined = _with_runs(keyed, both, "left")
    kind = keyed.schema["k"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def cut(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "text": [], "spans": []}
            bodies = texts(batch, "t")
            for body, whole, single in zip(
                bodies, values(batch, "whole").to_pylist(), values(batch, "single").to_pylist(), strict=True
            ):
                words = (body or b"").split()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                for r in whole or ():
                    step[r["first"]] += 1
                    step[r["last"] + window] -= 1
                if single:
                    at = np.asarray(single)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = edges.reshape(-1, 2).tolist()
                kept, last = [], 0
                for first, stop in spans:
                    kept += words[last:first]
                    last = stop
                kept += words[last:]
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["text"].append(b" ".join(kept).decode("utf-8"))
                out["spans"].append([{"first": a, "stop": b} for a, b in spans])
            return {"doc_id": values(batch, "k")} | out

        return cut

    schema = f"doc_id {kind}, n_words long, n_removed long, text string, spans array<struct<first:int,stop:int>>"
    return map_batches(joined, make, schema)
