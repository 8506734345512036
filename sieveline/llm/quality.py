"""Quality rules, and an isolation forest over the rules' statistics.

Two plain rules reject a text outright.  The rest is judged by an isolation forest (Liu, Ting and Zhou, 2008): random
splits over the statistics of a bounded sample part rare rows from the others in few steps, so a short mean path
marks an anomaly.  An anomaly in a statistic that has nothing to do with quality (a long list of numbers, say) must
not cost a good text its place, so the statistic of a split is drawn with a chance that follows how far apart good and
bad labelled rows lie in it; all statistics stay in the forest.  Labelled rows are parted by a hash of their key: four
fifths give these chances and the score at which a row goes, the last fifth only measures the result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrow import map_batches, texts, values
from sieveline.session import Scratch, staged

# The characters that count as symbols, ASCII white space, ASCII capitals and digits.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
_CONTINUATION = bytes(range(0x80, 0xC0))

MIN_WORDS = 50
#: Rows that the forest is fitted on (those with the lowest hash of their key), trees, and rows in each tree: few, as many
#: bad rows that are alike hide one another in a large one.
SAMPLE_ROWS, TREES, TREE_ROWS = 8192, 128, 32
#: Share of good labelled rows that the threshold may reject.
GOOD_LOSS = 0.002
BINS = 10_000
#: The chance of a statistic is this power of the largest distance between its good and bad distributions.
SHARPNESS = 2
#: One labelled row in so many is held out of the calibration.
HELD_OUT = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits", "n_distinct")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.asarray([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) > n - 3 + 2:
        return 0
    pairs = seq[:-1] * len(ids) + seq[1:]
    if len(ids) < 1 << 20:
        grams = pairs[:-1] * len(ids) + seq[2:]
    else:  # pair numbers first, so that the product stays within 63 bits
        grams = np.unique(pairs[:-1], return_inverse=True)[1] * len(ids) + seq[2:]
    order = np.argsort(grams, kind="stable")
    sorted_ = grams[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for d in range(3):
        covered[d : n - 2 + d] |= again
    return int(covered.sum())


def rule_stats(text: bytes | None) -> tuple[int, ...]:
    """The statistics named in STATS, of a UTF-8 text; a null text has none of anything."""
    if not text:
        return (0,) * len(STATS)
    size = len(text)
    words = text.split()
    chars = len(text.translate(None, _CONTINUATION + SPACES))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        chars,
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        size - len(text.translate(None, CAPITALS)),
        size - len(text.translate(None, DIGITS)),
        len(set(words)),
    )


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > 50 * stats[:, 0])


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: shares that do not depend on the length or the language of a text."""
    words = np.maximum(stats[:, 0], 1).astype(float)
    chars = np.maximum(stats[:, 1], 1).astype(float)
    return np.column_stack(
        [
            stats[:, 2] / words,
            stats[:, 4] / words,
            np.log1p(stats[:, 3]),
            stats[:, 5] / chars,
            stats[:, 6] / chars,
            stats[:, 1] / words,
        ]
    )


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m)


@dataclass
class IsolationForest:
    """Trees as arrays: split feature (-1: a leaf), split value, left child (right is the next), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: float

    @classmethod
    def fit(
        cls, rows: np.ndarray, chances: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7
    ) -> IsolationForest:
        """Grow trees; a node splits on one of the columns that vary in it, drawn by ``chances``."""
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        depth = int(np.ceil(np.log2(max(size, 2))))
        grown = []
        for _ in range(trees):
            part = rows[rng.choice(len(rows), size, replace=False)] if size else rows
            nodes: list[list[float]] = [[-1, 0, 0, 0]]
            todo = [(0, part, 0)]
            while todo:
                at, have, level = todo.pop()
                low, high = (have.min(0), have.max(0)) if len(have) else (np.zeros(1), np.zeros(1))
                open_ = np.flatnonzero((high > low) & (chances > 0)) if len(have) else ()
                if level >= depth or len(have) < 2 or not len(open_):
                    nodes[at] = [-1, 0, at, level + float(_mean_path(len(have)))]
                    continue
                f = int(rng.choice(open_, p=chances[open_] / chances[open_].sum()))
                cut = float(rng.uniform(low[f], high[f]))
                left = have[:, f] < cut
                nodes[at] = [f, cut, len(nodes), 0]
                todo += [(len(nodes), have[left], level + 1), (len(nodes) + 1, have[~left], level + 1)]
                nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            grown.append(nodes)
        width = max(map(len, grown))
        flat = np.asarray([x + [[-1, 0, 0, 0]] * (width - len(x)) for x in grown])
        return cls(
            flat[:, :, 0].astype(int),
            flat[:, :, 1],
            flat[:, :, 2].astype(int),
            flat[:, :, 3],
            float(_mean_path(size)),
        )

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / scale): near 1 for rows that stand alone, below 0.5 for common ones."""
        n, trees = len(rows), len(self.feature)
        total = np.zeros(n)
        every = np.arange(n)
        for t in range(trees):
            feature, value, left = self.feature[t], self.value[t], self.left[t]
            at = np.zeros(n, dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[at] + (rows[every, np.maximum(f, 0)] >= value[at])
                at = np.where(inner, step, at)
            total += self.path[t][at]
        return np.round(2.0 ** (-total / max(trees, 1) / max(self.scale, 1e-9)), 9)


def threshold_from(counts: list[tuple[int, int, int]], good_loss: float = GOOD_LOSS) -> float:
    """The score that rejects, from (bin, quality, rows); above 1 if labels give none.

    Among the bins that reject at most ``good_loss`` of the good rows, the one that rejects most bad ones; of those
    that reject as many, the middle between the lowest and the highest, to stay away from either side.
    """
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for at, quality, n in counts:
        (good if quality else bad)[at] += n
    over_good, over_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    allowed = np.flatnonzero(over_good <= good_loss * good.sum())
    if not bad.sum() or not good.sum() or not over_bad[allowed].max():
        return 2.0
    best = allowed[over_bad[allowed] == over_bad[allowed].max()]
    run = best[: int(np.argmax(np.diff(best, append=best[-1] + 2) > 1)) + 1]
    return float((run[0] + run[-1]) // 2) / BINS


def value_bins(rows: np.ndarray) -> np.ndarray:
    """Features in steps that are fine near 0 and widen with the value: some thousand at most for each."""
    return np.floor(np.arcsinh(rows * 1000) * 100).astype(np.int64)


def chances_from(counts: list[tuple[int, int, int, int]], width: int) -> np.ndarray:
    """Each feature's chance to be split on, from (feature, bin, quality, rows); all equal if labels give none.

    It is the SHARPNESS-th power of the largest distance between the distributions of good and bad rows.
    """
    out = np.zeros(width)
    for f in range(width):
        own = sorted(c[1:] for c in counts if c[0] == f)
        bins = sorted({c[0] for c in own})
        at = {x: i for i, x in enumerate(bins)}
        have = np.zeros((2, max(len(bins), 1)))
        for x, quality, n in own:
            have[int(quality), at[x]] += n
        if have.sum(1).all():
            share = np.cumsum(have, axis=1) / have.sum(1, keepdims=True)
            out[f] = np.abs(share[0] - share[1]).max() ** SHARPNESS
    return out if out.any() else np.ones(width)


@dataclass
class QualityModel:
    """A fitted forest and its threshold; ``verdict`` gives scores and kept for rows of STATS.

    ``held_out`` says what became of the labelled rows that took no part in the calibration: rows of each kind, and
    how many of them the forest rejects.
    """

    forest: IsolationForest | None
    threshold: float
    chances: list[float] | None = None
    held_out: dict[str, int] | None = None

    def verdict(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(stats)
        score = self.forest.score(features(stats)) if self.forest else np.zeros(len(stats))
        return failed, score, ~failed & (score < self.threshold)


def _stats_of(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.asarray([rule_stats(t) for t in texts(batch, text)], dtype=np.int64).reshape(-1, len(STATS))


def stats_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and STATS (long) of every row, from one pass over the whole texts."""
    kind = df.schema[key].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def measure(batch: pa.RecordBatch) -> dict:
            stats = _stats_of(batch, text)
            return {key: values(batch, key)} | {n: stats[:, i] for i, n in enumerate(STATS)}

        return measure

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in STATS)
    return map_batches(df.select(key, text), make, schema)


def _as_stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([values(batch, n).to_numpy(zero_copy_only=False) for n in STATS])


def _sample(passed: DataFrame, key: str, sample_rows: int) -> np.ndarray:
    """About ``sample_rows`` distinct rows of STATS, those with the lowest hashes, in a fixed order.

    Rows are taken by a bound on the hash that follows from their count, so no task and no driver merges more.
    """
    n = passed.count()
    share = min(1.0, sample_rows / max(n, 1))
    hashed = F.xxhash64(F.lit("forest"), F.col(key), *STATS)
    below = passed.where(hashed <= F.lit(int(min(share * 2.0**64 - 2.0**63, 2.0**63 - 1024)))) if share < 1 else passed
    rows = sorted(tuple(r) for r in below.select(F.col(key), *STATS).distinct().select(*STATS).collect())
    return np.asarray(rows, dtype=np.int64).reshape(-1, len(STATS))


def fit_quality(
    stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> QualityModel:
    """Fit a forest on ``sample_rows`` rows that pass the rules, and calibrate it on labelled rows that pass.

    ``labels`` has the key and a label: 1 good, 0 bad; others and nulls are left out.  Without labelled rows of both
    kinds, or rows to fit on, the model rejects by the rules alone.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = stats.where(~failed)
    sample = features(_sample(passed, key, sample_rows))
    if not len(sample):
        return QualityModel(None, 2.0)
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_q"))
    held = F.pmod(F.xxhash64(F.lit("held out"), F.col(key)), F.lit(HELD_OUT)) == 0
    width = sample.shape[1]

    def bins() -> Callable[[pa.RecordBatch], dict]:
        def count(batch: pa.RecordBatch) -> dict:
            found, quality = value_bins(features(_as_stats(batch))), values(batch, "_q").to_numpy(zero_copy_only=False)
            rows = np.column_stack([np.tile(np.arange(width), len(found)), found.ravel(), np.repeat(quality, width)])
            distinct, n = np.unique(rows, axis=0, return_counts=True)
            return {"feature": distinct[:, 0], "bin": distinct[:, 1], "q": distinct[:, 2], "n": n}

        return count

    with Scratch(stats.sparkSession) as kept:
        labelled = passed.join(marked, F.col(key) == F.col("_k")).select("_q", held.alias("_held"), *STATS)
        labelled = kept.table(labelled, "labelled-stats")
        spread = map_batches(labelled.where("NOT _held").drop("_held"), bins, "feature int, bin int, q int, n long")
        spread = spread.groupBy("feature", "bin", "q").agg(F.sum("n").alias("n")).collect()
        chances = chances_from([tuple(r) for r in spread], width)
        forest = IsolationForest.fit(sample, chances)

        def score() -> Callable[[pa.RecordBatch], dict]:
            def rate(batch: pa.RecordBatch) -> dict:
                at = np.floor(forest.score(features(_as_stats(batch))) * BINS).astype(int)
                return {"bin": at, "q": values(batch, "_q"), "held": values(batch, "_held")}

            return rate

        counts = map_batches(labelled, score, "bin int, q int, held boolean").groupBy("bin", "q", "held").count().collect()
    threshold = threshold_from([(r[0], r[1], r[3]) for r in counts if not r[2]])
    tested = {f"{name}{what}": sum(r[3] for r in counts if r[2] and r[1] == q and (not what or r[0] >= threshold * BINS))
              for name, q in (("good", 1), ("bad", 0)) for what in ("", "_rejected")}
    return QualityModel(forest, threshold, chances.tolist(), tested)


def judge_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, STATS, base_failed, score and kept for every row of ``df``.

    Words are runs of characters other than ASCII white space.  A null or empty text has no words and fails the
    rules.  Repeated rows get equal results; extra columns are not read; an empty table gives no rows.
    """
    stats = staged(stats_table(df, key, text), "rule-stats")
    model = fit_quality(stats, labels, key)
    kind = df.schema[key].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def judge(batch: pa.RecordBatch) -> dict:
            failed, score, kept = model.verdict(_as_stats(batch))
            columns = {n: values(batch, n) for n in (key, *STATS)}
            return columns | {"base_failed": failed, "score": score, "kept": kept}

        return judge

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in STATS)
    return map_batches(stats, make, schema + ", base_failed boolean, score double, kept boolean")


def filter_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``judge_quality`` keeps, with all their columns; texts are not shuffled."""
    model = fit_quality(staged(stats_table(df, key, text), "rule-stats"), labels, key)
    names = df.columns

    def make() -> Callable[[pa.RecordBatch], dict]:
        def keep(batch: pa.RecordBatch) -> dict:
            kept = batch.filter(pa.array(model.verdict(_stats_of(batch, text))[2]))
            return {n: kept.column(i) for i, n in enumerate(names)}

        return keep

    return map_batches(df, make, df.schema)


def model_json(model: QualityModel) -> str:
    """The model as text, to keep beside its results."""
    f = model.forest
    parts: dict[str, object] = {} if f is None else {k: getattr(f, k).tolist() for k in ("feature", "value", "left", "path")}
    if f is not None:
        parts |= {"scale": f.scale}
    return json.dumps(parts | {"threshold": model.threshold, "chances": model.chances, "held_out": model.held_out})
