"""Lexical retrieval packing: windows of related documents by a sharded BM25 index.

Documents are dealt into shards of a bounded number of text bytes by likeness: by the lowest hash of their long words,
hashed once more, as long texts have low ones and would all lie in the first shards.
Two documents share it with the chance that a long word of either is one of both, so related documents mostly meet in
a shard however many shards there are; a word's documents that do not fit into one shard fill several.  Each shard
builds an inverted index over its documents.  A window starts with a seed document; the index returns the unused
documents nearest to it, best first, which fill the window.  The document that does not fit whole is cut; its rest
seeds the next window.  Windows are thus full but for the last one of each shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sieveline.llm.tokens import worker_encoder
from sieveline.session import staged, tasks_for

WINDOW = 2048
#: Text bytes in a shard: its index and ids are held in memory by one task.
SHARD_BYTES = 4 << 20
#: Stored bytes for each task: some shards.
TASK_BYTES = 16 << 20
#: Rows of a batch that Python holds at a time, beside the shard that it gathers.
SLICE_ROWS = 256
#: Words of so many bytes and more tell what a text is about.
LONG_WORD = 8
K1, B = 1.5, 0.75
PIECE_SCHEMA = (
    "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, seed_id {key}"
)


class ShardIndex:
    """BM25 over one shard.  Terms in one document only, or in over half of them (idf at or below 0), weigh nothing."""

    def __init__(self, docs: list[np.ndarray], terms: int) -> None:
        n = len(docs)
        self.n = n
        length = np.asarray([len(d) for d in docs], dtype=float)
        mean = max(length.mean(), 1.0) if n else 1.0
        parts = [np.unique(d, return_counts=True) for d in docs]
        sizes = [len(p[0]) for p in parts]
        term = np.concatenate([p[0] for p in parts]) if n else np.zeros(0, dtype=np.int64)
        tf = np.concatenate([p[1] for p in parts]).astype(float) if n else np.zeros(0)
        doc = np.repeat(np.arange(n), sizes)
        df = np.bincount(term, minlength=terms)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        useful = ((df > 1) & (idf > 0))[term]
        term, tf, doc = term[useful], tf[useful], doc[useful]
        self.terms_of = np.split(term, np.cumsum(np.bincount(doc, minlength=n))[:-1]) if n else []
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])

    def scores(self, query: int) -> np.ndarray:
        """Of all documents for the text of one of them."""
        terms = self.terms_of[query]
        if not len(terms):
            return np.zeros(self.n)
        first, size = self.at[terms], self.at[terms + 1] - self.at[terms]
        steps = np.ones(size.sum(), dtype=np.int64)
        ends = np.cumsum(size)[:-1]
        steps[0] = first[0]
        steps[ends] = first[1:] - first[:-1] - size[:-1] + 1
        rows = np.cumsum(steps)
        return np.bincount(self.doc[rows], weights=self.weight[rows], minlength=self.n)


def fill_windows(index: ShardIndex, lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset, seed) of all documents, each id once."""
    n = len(lengths)
    used = np.zeros(n, dtype=bool)
    pieces: list[tuple[int, int, int, int, int, int]] = []
    sequence, room, low = 0, window, 0
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while low < n and used[low]:
                low += 1
            if low == n:
                break
            rest = (low, 0)
            used[low] = True
        seed, start = rest
        rest = None
        ranked: Iterator[int] | None = None
        at: int | None = seed
        while at is not None:
            take = min(room, lengths[at] - start)
            if take:
                pieces.append((at, start, take, sequence, window - room, seed))
            room -= take
            start += take
            if room == 0:
                sequence, room = sequence + 1, window
                if start < lengths[at]:
                    rest = (at, start)
                break
            if ranked is None:
                ranked = _neighbours(index.scores(seed), used)
            at = next(ranked, None)
            start = 0
            if at is not None:
                used[at] = True
    return pieces


def _neighbours(score: np.ndarray, used: np.ndarray) -> Iterator[int]:
    """Unused documents by falling score, then position; the best few are found without a full sort."""
    free = np.flatnonzero(~used)
    found = score[free]
    if len(free) > 64:
        cut = np.partition(found, len(free) - 32)[len(free) - 32]
        top = found > cut
        head = free[top][np.argsort(-found[top], kind="stable")]
        yield from head.tolist()
        free, found = free[~top], found[~top]
    yield from free[np.argsort(-found, kind="stable")].tolist()


def likeness(text: Column) -> Column:
    """The lowest hash of a text's long words, hashed; of all its words where none is long."""
    words = F.split(text, " ")
    long = F.transform(words, lambda w: F.when(F.octet_length(w) >= LONG_WORD, F.xxhash64(w)))
    return F.xxhash64(F.coalesce(F.array_min(long), F.array_min(F.transform(words, lambda w: F.xxhash64(w)))))


def pack_documents(
    df: DataFrame,
    path: str,
    end_id: int,
    spaced: bool = False,
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the window's seed_id.

    A document's ids are those of its whole text and ``end_id``; a null or empty text is the end id alone.  Rows that
    share a key are packed as documents of their own.  Ties in score go to the lower key.  An empty table gives no
    rows; extra columns are not read.  Padding is below one window for each shard.  The pieces are computed once.
    """
    slim = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = slim.withColumns({"_like": likeness(F.col("text")), "_row": F.xxhash64("doc_id", "text")})
    # The rows of one word spread over tasks by their own hashes.
    dealt = dealt.repartitionByRange(tasks_for(slim, TASK_BYTES), "_like", "_row").sortWithinPartitions("_like", "_row")
    schema = PIECE_SCHEMA.format(key=slim.schema["doc_id"].dataType.simpleString())
    kind = _parse_datatype_string(schema)

    def pack(keys: list, bodies: list[str], shard: int, out: pa.Schema) -> pa.RecordBatch:
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i], bodies[i]))
        keys, bodies = [keys[i] for i in order], [bodies[i] for i in order]
        docs, units = worker_encoder(path, spaced).unit_ids(bodies)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        ids = [b"".join(map(units.__getitem__, d.tolist())) + end for d in docs]
        pieces = fill_windows(ShardIndex(docs, len(units)), [len(x) // 4 for x in ids], window)
        d, s, n, q, o, f = (list(x) for x in zip(*pieces, strict=True))
        columns = {
            "doc_id": [keys[i] for i in d],
            "start": s,
            "length": n,
            "ids_crc32": [zlib.crc32(ids[i][4 * a : 4 * (a + m)]) for i, a, m in zip(d, s, n, strict=True)],
            "doc_tokens": [len(ids[i]) // 4 for i in d],
            "sequence_id": [(shard << 22) + x for x in q],
            "offset": o,
            "seed_id": [keys[i] for i in f],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        shard = TaskContext.get().partitionId() << 20
        keys: list = []
        bodies: list[str] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                key, text = batch.slice(at, SLICE_ROWS).columns
                for k, t, n in zip(key.to_pylist(), text.to_pylist(), pc.binary_length(text).to_pylist(), strict=True):
                    if bodies and size + n + 16 > shard_bytes:
                        yield pack(keys, bodies, shard, out)
                        keys, bodies, size, shard = [], [], 0, shard + 1
                    keys.append(k)
                    bodies.append(t)
                    size += n + 16
        if bodies:
            yield pack(keys, bodies, shard, out)

    return staged(dealt.select("doc_id", "text").mapInArrow(run, schema), "packed")
