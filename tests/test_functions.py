from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline.functions import extract as X
from sieveline.functions import scoring as S
from sieveline.functions import text as T
from sieveline.operators.chunk import chunk_text


def values(spark, rows, column):
    """The column over a one-column table of texts, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_intents(spark):
    cases = {
        "What is the cost-effectiveness of this?": "cost_effectiveness",
        "Cmax and AUC of the drug": "pharmacokinetics",
        "Phase III randomized study": "trial_design",
        "Response rate and hazard ratio": "efficacy_outcomes",
        "Toxicity of grade 3": "adverse_events",
        "KRAS mutation": "mutations",
        "": "general",
    }
    assert values(spark, list(cases), X.infer_intent) == list(cases.values())


def test_labels_and_entities(spark):
    assert values(spark, ["papillary thyroid nodules", "NSCLC patients", "mCRC", "nothing", None], X.detect_label) == [
        "Thyroid_Cancer", "Lung_Cancer", "Colon_Cancer", "", "",
    ]
    found = values(spark, ["PD-L1 and osimertinib in EGFR NSCLC with OS", "", None], X.entities)
    assert "EGFR" in found[0] and "osimertinib" in found[0] and "PD-L1" in found[0] and "OS" in found[0]
    assert found[1] == [] and found[2] == []


def test_body_text(spark):
    rows = ["[ paper_000001 | RESULTS ] --- This is the body text.", "no separator", "", None, "[a] rest [b] more"]
    assert values(spark, rows, T.body_text) == ["This is the body text.", "no separator", "", "", "rest [b] more"]


def test_cleaning(spark):
    assert values(spark, ["a\r\n\r\n\r\nb \t c ", None], T.basic_clean) == ["a\n\nb c", ""]
    assert values(spark, ["lungCancer p53 10mg end.Next ﬁne"], T.fix_spacing_v1) == ["lung Cancer p 53 10 mg end. Next fine"]
    text = "Intro line\nwww.example.com here\nSee Figure 2 for more.\nKept [1, 2] text\nREFERENCES\nAll cut"
    assert "example" not in values(spark, [text], T.basic_clean_fast)[0]
    assert "All cut" not in values(spark, [text], T.basic_clean_fast)[0]
    assert values(spark, ["cafÃ© here", "plain", "Ã alone"], T.fix_mojibake) == ["café here", "plain", "Ã alone"]


def test_overlap_and_penalties(spark):
    df = spark.createDataFrame([(["EGFR", "KRAS"], "EGFR was mutated"), (["EGFR"], "egfr"), ([], "x")], "e array<string>, t string")
    assert [r.v for r in df.select(S.entity_overlap(F.col("e"), F.col("t")).alias("v")).collect()] == [0.5, 1.0, 0.0]
    lab = spark.createDataFrame([("Lung_Cancer", "colon colorectal crc rectal"), ("Lung_Cancer", "lung"), ("", "colon")], "l string, t string")
    assert [r.v for r in lab.select(S.mismatch_penalty(F.col("l"), F.col("t")).alias("v")).collect()] == [0.35, 0.0, 0.0]
    cap = spark.createDataFrame([([f"GENE{i}" for i in range(10)], " ".join(f"GENE{i}" for i in range(10)))], "e array<string>, t string")
    assert cap.select(S.entity_bonus(F.col("e"), F.col("t")).alias("v")).first().v == L.Retrieval().entity_bonus_cap
    ev = S.evidence_scores(F.col("t"))
    adj = lab.select(S.evidence_adjust(F.col("l"), ev).alias("v"), S.label_gate(F.col("l"), ev).alias("g")).collect()
    assert adj[0].v < 0 and adj[1].v > 0 and adj[2].v == 0 and [r.g for r in adj] == [False, True, True]


def test_defaults():
    r = L.Retrieval()
    assert r.bm25_weight_no_entities < r.bm25_weight_with_entities
    assert r.absent_strong_penalty < r.absent_weak_penalty < r.generic_penalty < 0


@pytest.mark.parametrize("words", [0, 5, 1000])
def test_chunks_cover_all_words(words):
    text = " ".join(f"word{i}" for i in range(words))
    rows = chunk_text("p", "l", text)
    assert " ".join(r["raw_text"] for r in rows).split() == text.split()
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    assert all(r["n_tokens"] <= 730 for r in rows)


def test_chunk_sections():
    body = " ".join(["Alpha beta gamma delta."] * 60)
    text = f"ABSTRACT\n{body}\nFUNDING\n{body}\nRESULTS:\n{body}"
    assert [r["section"] for r in chunk_text("p", "l", text)] == ["ABSTRACT", "RESULTS"]
