"""Settings, sources, sinks and providers, without a network."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sieveline import config
from sieveline import lexicon as L
from sieveline.operators.index import DenseIndex, SparseIndex, build_sparse, dense_topn, sparse_scores, sparse_topn
from sieveline.operators.labels import seeded_sample
from sieveline.plans import agent as AG
from sieveline.plans import evaluate as EV
from sieveline.sources import io
from sieveline.sources.http import ArticleSearch
from sieveline.sources.providers import embed_with

YAML = """
models: {embedding: "e-large", generator: "g-mini", generator_temperature: 0}
retrieval:
  top_k: 5
  bm25_div: 10.0
  cancer_absent_strong_penalty: -0.7
  unknown_setting: 1
chunking: {chunk_size_tokens: 100, min_doc_words: 50}
paths: {bm25_file: "somewhere/bm25"}
"""


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)
    c = config.load(str(path))
    assert c.models.embedding == "e-large" and c.models.generator_temperature == 0 and c["paths"]["bm25_file"] == "somewhere/bm25"
    assert set(c) == {"models", "retrieval", "chunking", "paths"} and "agent" not in c
    with pytest.raises(AttributeError, match="nothing"):
        _ = c.retrieval.nothing
    r = config.apply(c.retrieval, L.Retrieval())
    assert (r.top_k, r.bm25_div, r.absent_strong_penalty, r.top_n_dense) == (5, 10.0, -0.7, L.Retrieval().top_n_dense)
    assert config.apply(c.chunking, L.Chunking()).target == 100
    path.write_text("")
    assert list(config.load(str(path))) == []
    path.write_text("- a\n")
    with pytest.raises(ValueError, match="mapping"):
        config.load(str(path))


def test_default_settings():
    r, g, a = L.Retrieval(), L.Generation(), L.Agent()
    assert r.top_k > 0 and r.bm25_div > 0 and 0 < r.rerank_weight < 1 and r.bm25_weight_with_entities >= r.bm25_weight_no_entities
    assert max(r.absent_strong_penalty, r.absent_weak_penalty, r.generic_penalty) < 0
    assert g.max_contexts > 0 and g.min_answer_sentences < g.max_answer_sentences and min(g.entity_weight, g.label_weight, g.intent_weight) > 0
    assert g.clinical_match_bonus > 0 > g.clinical_mismatch_penalty and g.ae_match_bonus > 0 > g.ae_mismatch_penalty
    assert 0 < a.local_score_threshold < 2 and a.local_min_hits > 0 and a.max_external > 0


def test_csv(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    rows = [("one", 'quo"ted, text'), ("two\nlines", "real � sign"), ("é", "")]
    io.write_csv(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "utf8"))
    assert sorted(tuple(x or "" for x in r) for r in io.read_csv(spark, str(tmp_path / "utf8"), schema).collect()) == sorted(rows)
    (tmp_path / "latin.csv").write_bytes("a,b\ncafé,x\n".encode("latin-1"))
    got = io.read_csv(spark, str(tmp_path / "latin.csv"), schema, ["a"])
    assert got.columns == ["a"] and [r.a for r in got.collect()] == ["café"]


def test_jsonl_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "i long, t string")
    io.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert sorted(map(tuple, io.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect())) == [(1, "a\nb"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"i": 1}\n\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), df.schema).collect()
    io.write_report(df, str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    assert json.loads(part.read_text())[0] == {"i": 1, "t": "a\nb"}


XML = "<S><PubmedArticle><PMID>7</PMID><PubDate><Year>2020</Year></PubDate><ArticleTitle>T</ArticleTitle><AbstractText>A <b>b</b></AbstractText></PubmedArticle></S>"


def service(url, seconds):
    assert seconds <= 15
    return json.dumps({"esearchresult": {"idlist": ["7"]}}) if "esearch" in url else XML


def broken(url, seconds):
    raise TimeoutError("slow")


def test_article_search(spark):
    found = ArticleSearch(spark, "https://service.example", get=service).search("lung AND EGFR", 3)
    assert found == [{"pmid": "7", "title": "T", "abstract": "A b", "year": "2020", "source": "PubMed PMID:7 (2020)"}]
    assert ArticleSearch(spark, "https://service.example", get=broken).search("x", 3) == []
    assert ArticleSearch(spark, "https://service.example", get=lambda u, s: "no json").search("x", 3) == []


def test_agent_flow(spark):
    schema = "query_id long, query string, label string, rank int, score double, paper_id string, section string, text string"

    def search(score):
        return lambda q: spark.createDataFrame([(0, q, "Lung_Cancer", i, score, f"p{i}", "RESULTS", "EGFR in lung tissue.") for i in (1, 2)], schema)

    class Echo:
        def complete(self, prompt):
            return prompt

    source = ArticleSearch(spark, "https://service.example", get=service)
    strong = AG.run_agent("EGFR in lung cancer", search(0.9), source, Echo())
    assert not strong.weak and not strong.external and "[LOCAL 2]" in strong.answer
    weak = AG.run_agent("EGFR in lung cancer", search(0.1), source, Echo())
    assert weak.weak and len(weak.external) == 1 and "[PUBMED 1] T (2020)" in weak.answer
    empty = AG.run_agent("EGFR", lambda q: spark.createDataFrame([], schema), ArticleSearch(spark, "https://x.example", get=broken), Echo())
    assert empty.weak and empty.answer == AG.A.NO_SOURCES


def test_judge(spark):
    class Lengths:
        def rate(self, question, answer, contexts):
            return {"faithfulness": len(contexts) / 4.0}

    rows = [("q", "a", ["x", "y"]), ("q", "a", []), ("q", None, None)]
    df = spark.createDataFrame(rows, "question string, answer string, contexts array<string>")
    got = EV.judge_answers(df, Lengths(), ["faithfulness", "answer_relevancy"]).collect()
    assert [r.faithfulness for r in got][0] == 0.5 and all(r.answer_relevancy in (None,) or r.answer_relevancy != r.answer_relevancy for r in got)
    assert all(r.faithfulness is None or r.faithfulness != r.faithfulness for r in got[1:])
    bands = {r.metric: r.band for r in EV.metric_bands(spark.createDataFrame([(0.9, 0.5, 0.1)], "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert bands == {"a": "high", "b": "mid", "c": "low"}


def test_embed_with(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    df = spark.createDataFrame([(i, "t" if i % 2 else None) for i in range(10)], "i long, t string").coalesce(1)
    got = {r.i: [round(x, 3) for x in r.vec] for r in embed_with(df, "t", embed, batch=4).collect()}
    assert got[1] == [0.6, 0.8] and got[0] == [0.0, 0.0] and calls.value == 3


def test_fallbacks(spark):
    hit = F.struct(*[F.col(c) for c in ("text", "text_preview", "title", "content")])
    rows = [(" ", "p", "t", "c"), ("x", "p", "t", "c"), (None, "", "t", "c"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, text_preview string, title string, content string")
    names = df.columns
    assert [r.b for r in df.select(EV.hit_body(hit, names).alias("b")).collect()] == ["p", "x", "t\nc", ""]
    said = df.select(EV.expected_label(F.col("text_preview"), F.col("title")).alias("e")).collect()
    assert [r.e for r in said] == ["p", "p", "t", ""]


def test_indexes_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, ""), (3, None), (4, "d e f g h")], "i long, t string")
    made = build_sparse(df, "i", "t")
    made.save(str(tmp_path / "s"))
    loaded = SparseIndex.load(spark, str(tmp_path / "s"))
    asked = spark.createDataFrame([(9, ["a", "b", "zz"]), (8, [])], "q long, terms array<string>")
    got = [sorted(map(tuple, sparse_topn(x, sparse_scores(x, asked, "q", "terms"), asked, "q", 4).collect())) for x in (made, loaded)]
    assert got[0] == got[1] and [r[1] for r in sorted(got[0], key=lambda r: r[3]) if r[0] == 8] == [4, 3, 2, 1]
    assert [r[1] for r in sorted(got[0], key=lambda r: r[3]) if r[0] == 9] == [0, 1, 4, 3]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "i long, v array<double>")
    index = DenseIndex.build(vectors, "i", "v", str(tmp_path / "d"))
    queries = spark.createDataFrame([(5, [1.0, 0.5]), (6, None)], "q long, v array<double>")
    best = DenseIndex.load(spark, str(tmp_path / "d")).search(queries, "q", "v", 2).collect()
    assert sorted(map(tuple, best)) == [(5, 0, 1.0, 1), (5, 1, 1.0, 2)]
    assert index.search(queries.where("q = 6"), "q", "v", 2).count() == 0
    assert dense_topn(index.vectors.where("row_id < 0"), queries, "q", "v", 2).count() == 0


def test_seeded_sample(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "i long, g int")
    first = sorted(map(tuple, seeded_sample(df, "i", 5, by="g").collect()))
    again = sorted(map(tuple, seeded_sample(df.repartition(7), "i", 5, by="g").collect()))
    assert first == again and len(first) == 15 and seeded_sample(df, "i", 5).count() == 5
    assert first != sorted(map(tuple, seeded_sample(df, "i", 5, seed=8, by="g").collect()))
