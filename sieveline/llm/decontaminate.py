"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets that a document must hold whole, so by the prefix filter one token of each window is
enough to find it: its rarest, by counts over all documents.  Documents are joined with the windows on that token;
its place in the window says where the window would lie (the positional bound) and whether it fits into the document
(the length bound); what is left is compared word by word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrow import map_batches, texts, values
from sieveline.session import staged

WINDOW = 8
#: Benchmark text that is indexed and sent to the executors at a time; larger benchmarks go in several blocks.
BLOCK_BYTES = 8 << 20
# What the words are made of; A-Z are lower-cased, all else below 0x80 but 0-9 and a-z parts words.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
HIT_SCHEMA = "n_words long, spans array<struct<first:int,stop:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def item_windows(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Each distinct window with the items it is from; an item without an id adds its windows only."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[i : i + window])].update([] if item is None else [str(item)])
    return dict(found)


class WindowIndex:
    """Windows by their rarest token, its place and the window's length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], counts: dict[bytes, int]) -> None:
        self.by_token: dict[bytes, dict[tuple[int, int], dict[bytes, list[str]]]] = {}
        for words, items in windows.items():
            place = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
            at = self.by_token.setdefault(words[place], {}).setdefault((place, len(words)), {})
            at[b" ".join(words)] = sorted(items)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of the words inside occurring windows, and the items of those windows."""
        tokens = self.by_token
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(words)
        for i in [i for i, w in enumerate(words) if w in tokens]:
            for (place, size), keys in tokens[words[i]].items():
                first = i - place
                if first < 0 or first + size > n:
                    continue
                of = keys.get(b" ".join(words[first : first + size]))
                if of is not None:
                    found.append((first, first + size))
                    items.update(of)
        merged: list[tuple[int, int]] = []
        for first, stop in sorted(found):
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
            else:
                merged.append((first, stop))
        return merged, items


def token_counts(df: DataFrame, tokens: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each of ``tokens`` stands in all texts; each task sums its own before the shuffle."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def count(batch: pa.RecordBatch) -> dict:
            seen: Counter[bytes] = Counter()
            for body in texts(batch, text):
                seen.update(words_of(body))
            own = [(w, n) for w, n in seen.items() if w in tokens]
            return {"token": [w for w, _ in own], "n": [n for _, n in own]}

        return count

    counted = map_batches(df.select(text), make, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in counted.collect()}


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: bool = False,
) -> DataFrame:
    """n_words, spans and items for every row of ``df``, beside its key (or all its columns with ``carry``;
    columns of these three names are then replaced).

    ``spans`` are the merged word ranges inside occurring windows, ``items`` the distinct ids (as strings) of the
    items that the windows are from.  An item of fewer than ``window`` words is one window; items without words have
    none.  Null texts have no words.  The benchmark's windows are sent to the executors ``block_bytes`` of text at a
    time, each block in a pass of its own; with several blocks the rows are written with a number each, by which the
    blocks' hits come together, so every row returns once, equal ones too.  Empty tables give no hits or no rows.
    """
    bench = benchmark.select(F.col(item).alias("i"), F.col(text).cast("binary").alias("t")).where("t IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = [c for c in df.columns if c not in ("n_words", "spans", "items")] if carry else [key]
    number = "_row"
    while number in df.columns:
        number += "_"
    if blocks > 1:
        df = df.select(*dict.fromkeys([*names, text])).withColumn(number, F.monotonically_increasing_id())
        df = staged(df, "leak-rows")

    def block_index(block: int):  # noqa: ANN202
        rows = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        windows = item_windows([(r.i, bytes(r.t)) for r in rows], window)
        counts = token_counts(df, {w for x in windows for w in x}, text)
        return df.sparkSession.sparkContext.broadcast(WindowIndex(windows, counts).by_token)

    if blocks == 1:
        return _scan(df, block_index(0), names, text)
    hits = None
    for block in range(1, blocks):
        part = _scan(df, block_index(block), [number], text).where(F.size("spans") > 0)
        hits = part if hits is None else hits.unionByName(part)
    more = (f"{number}spans", f"{number}items")
    hits = hits.groupBy(number).agg(
        F.flatten(F.collect_list("spans")).alias(more[0]), F.flatten(F.collect_list("items")).alias(more[1])
    )
    found = _scan(df.join(hits, number, "left"), block_index(0), [*names, *more], text)

    def both(name: str, other: str) -> Column:
        return F.concat(name, F.coalesce(other, F.slice(name, 1, 0)))

    return found.select(
        *names,
        "n_words",
        _merged(F.array_sort(both("spans", more[0]))).alias("spans"),
        F.array_distinct(both("items", more[1])).alias("items"),
    )


def _merged(spans):  # noqa: ANN001, ANN202
    """Sorted spans with the touching ones put together."""
    none = F.array().cast("array<struct<first:int,stop:int>>")

    def add(done, s):  # noqa: ANN001, ANN202
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s["first"] <= last["stop"], F.concat(head, F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, add)


def _scan(df: DataFrame, index, names: list[str], text: str) -> DataFrame:  # noqa: ANN001
    read = list(dict.fromkeys([*names, text]))
    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)

    def make() -> Callable[[pa.RecordBatch], dict]:
        own = WindowIndex({}, {})
        own.by_token = index.value

        def scan(batch: pa.RecordBatch) -> dict:
            counts, spans, items = [], [], []
            for body in texts(batch, text):
                words = words_of(body)
                found, of = own.hits(words)
                counts.append(len(words))
                spans.append([{"first": a, "stop": b} for a, b in found])
                items.append(sorted(of))
            return {n: values(batch, n) for n in names} | {"n_words": counts, "spans": spans, "items": items}

        return scan

    return map_batches(df.select(*read), make, f"{kinds}, {HIT_SCHEMA}")
