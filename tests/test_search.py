"""The searches against brute force, in small chunks and blocks; what they hold and shuffle."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sieveline.functions import scoring as S
from sieveline.operators import index as I


def test_overlap_in_lower_case(spark):
    rows = [(["SS"], "groß"), (["SS"], "Hass"), (["TGF-B", "X1"], "a tgf b"), (["TGF-B"], "xtgfbx"), (["A-LONG-ENTITY-NAME"], "along entityname"), ([], "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<string>, t string")
    got = [r.v for r in df.select("i", S.entity_overlap(F.col("e"), F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [0.0, 1.0, 0.5, 1.0, 0.0, 0.0]


def test_scan_gives_what_the_postings_give(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghij", [9, 5, 3, 2, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (150, None)], "i long, t string").repartition(3)
    asked = spark.createDataFrame([(q, rng.choices("abcdefghijz", k=rng.randint(0, 5))) for q in range(12)], "q long, terms array<string>")
    x = I.build_sparse(df, "i", "t")
    scores = I.sparse_scores(x, asked, "q", "terms")
    monkeypatch.setattr(I, "CHUNK_VALUES", 50)
    monkeypatch.setattr(I, "BLOCK_TERMS", 20)
    for n in (1, 7, 40):
        want = sorted(map(tuple, I.sparse_topn(x, scores, asked, "q", n).select("query_id", "row_id", "bm25", "bm25_rank").collect()))
        assert sorted(map(tuple, I.sparse_best(x, asked, "q", "terms", n).drop("raw").collect())) == want
    some = I.sparse_best(x, asked, "q", "terms", 200, zeros=False).drop("raw", "bm25_rank")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, scores.collect()))
    pairs = spark.createDataFrame([(q, r) for q in range(12) for r in range(0, 151, 9)], "query_id long, row_id long")
    full = pairs.join(scores, ["query_id", "row_id"], "left").fillna(0.0)
    assert sorted(map(tuple, I.sparse_scores_of(x, asked, "q", "terms", pairs).collect())) == sorted(map(tuple, full.collect()))
    plan = I.sparse_best(x, asked, "q", "terms", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_nearest_rows_in_bounded_memory(spark):
    rng = np.random.default_rng(1)
    asked, rows = rng.integers(-9, 9, (6000, 8)).astype(float), rng.integers(-9, 9, (8000, 8)).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(list(rows))], names=["row_id", "vec"])
    search = I._nearest(pa.array(range(6000)), asked, 3, 9, "query_id long, row_id long, dense double")
    tracemalloc.start()
    got = pa.Table.from_batches(list(search(iter([batch])))).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6  # all scores at once are 384 MB
    scores = asked[:50] @ rows.T
    want = [(q, int(r), scores[q, r]) for q in range(50) for r in np.lexsort((np.arange(8000), -scores[q]))[:3]]
    assert sorted(zip(got["query_id"], got["row_id"], got["dense"]))[:150] == sorted(want)  # noqa: B905
