"""Reports on retrieval runs, and the evidence gates before an answer, over tables of questions and contexts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sieveline import lexicon as L
from sieveline import lexicon_answers as A
from sieveline import rx
from sieveline.functions import extract as X
from sieveline.functions import scoring as S
from sieveline.functions.text import contains_any, empty, normalize


def _label_hit(label: Column, text: Column, terms: dict[str, list[str]]) -> Column:
    found = F.lit(False)
    for name, of in terms.items():
        found = F.when(label == name, contains_any(F.lower(empty(text)), of)).otherwise(found)
    return F.coalesce(found, F.lit(False))


def expected_label(*said: Column) -> Column:
    """The label a run's query expects: the first of its names that says one (expected_cancer, cancer_type, cancer)."""
    return rx.text_or_empty(*said)


def hit_body(hit: Column, names: list[str]) -> Column:
    """A hit's text; else its preview; else what it has of title, snippet, chunk and content, a line each."""

    def said(name: str) -> Column:
        value = hit[name] if name in names else F.lit(None).cast("string")
        return F.when(rx.strip(empty(value)) != "", value)

    rest = F.concat_ws("\n", *[said(n) for n in ("title", "snippet", "chunk", "content")])
    return F.coalesce(said("text"), said("text_preview"), rest)


def health_report(hits: DataFrame, terms: dict[str, list[str]], top_k: int = 10) -> DataFrame:
    """One row: queries, evidence at 1 and in all hits, reference hits, duplicate hashes and papers.

    ``hits`` has query_id, expected_label, rank, text, is_reference_list, content_hash, paper_id and section.
    Shares are null where nothing was counted.
    """
    top = hits.where(F.col("rank") <= top_k)
    top = top.withColumn("ok", _label_hit(F.col("expected_label"), F.col("text"), terms))
    by_query = top.groupBy("query_id").agg(
        F.max(F.coalesce("expected_label", F.lit("")) != "").alias("asked"),
        F.max((F.col("rank") == 1) & F.col("ok")).alias("first_ok"),
        F.min("ok").alias("all_ok"),
        F.count(F.lit(1)).alias("n_hits"),
        F.sum(F.coalesce(F.col("is_reference_list"), F.lit(False)).cast("long")).alias("ref_hits"),
        (F.count(F.nullif("content_hash", F.lit(""))) - F.count_distinct(F.nullif("content_hash", F.lit("")))).alias("dup_hash"),
        (F.count(F.nullif("paper_id", F.lit(""))) - F.count_distinct(F.nullif("paper_id", F.lit("")))).alias("dup_paper"),
    )
    asked = F.col("asked")
    out = by_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum(asked.cast("long")).alias("asked"),
        F.sum((asked & F.col("first_ok")).cast("long")).alias("evidence_at_1"),
        F.sum((asked & F.col("all_ok")).cast("long")).alias("evidence_strict"),
        F.sum("ref_hits").alias("ref_hits"),
        F.sum("n_hits").alias("hits"),
        F.sum("dup_hash").alias("duplicate_hashes"),
        F.sum("dup_paper").alias("duplicate_papers"),
    )
    return out.withColumn("ref_rate", F.try_divide(F.col("ref_hits").cast("double"), F.col("hits").cast("double")))


def section_counts(hits: DataFrame, top_k: int = 10, top: int = 12) -> DataFrame:
    some = hits.where(F.col("rank") <= top_k).groupBy(F.coalesce("section", F.lit("UNKNOWN")).alias("section"))
    return some.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "section").limit(top)


def entity_hit_rate(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 10), by_intent: bool = False) -> DataFrame:
    """For each distinct k (and intent): queries with entities, queries with a hit, entities and those found.

    ``hits`` has query_id, intent, query, rank and text; queries without entities (the evaluation's loose ones) are
    left out.
    """
    cuts = F.array(*[F.lit(k) for k in sorted(set(ks))])
    rows = hits.withColumn("ents", X.loose_entities(F.col("query"))).where(F.size("ents") > 0)
    rows = rows.select("query_id", "intent", "rank", "text", F.explode("ents").alias("ent"))
    rows = rows.withColumn("has", X.entity_in_text(F.col("ent"), F.col("text")))
    rows = rows.select("query_id", "intent", "ent", "rank", "has", F.explode(cuts).alias("k"))
    found = rows.groupBy("query_id", "intent", "ent", "k").agg(F.max((F.col("rank") <= F.col("k")) & F.col("has")).alias("found"))
    by_query = found.groupBy("query_id", "intent", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("found").cast("long")).alias("f")
    )
    keys = ["intent", "k"] if by_intent else ["k"]
    return by_query.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum((F.col("f") > 0).cast("long")).alias("hit_queries"),
        F.sum("n").alias("entities"),
        F.sum("f").alias("entities_found"),
    )


def entity_coverage(hits: DataFrame, top_k: int = 10) -> DataFrame:
    """For each query the share of its entities found in its hits, the lowest first; queries without entities have 0."""
    texts = hits.where(F.col("rank") <= top_k).groupBy("query_id", "intent", "query").agg(
        F.array_join(F.collect_list("text"), "\n").alias("blob")
    )
    ents = X.loose_entities(F.col("query"))
    found = F.filter(ents, lambda e: X.entity_in_text(e, F.col("blob")))
    share = F.when(F.size(ents) > 0, F.size(found) / F.size(ents).cast("double")).otherwise(0.0)
    out = texts.select("query_id", "intent", "query", share.alias("coverage"), found.alias("found"))
    return out.orderBy("coverage", "query_id")


def needs_of(question: Column) -> dict[str, Column]:
    """What a question asks for: entities, label terms, intent family and terms, clinical and adverse-event needs."""
    q = normalize(question)
    labels: Column = F.array().cast("array<string>")
    for of in reversed(A.LABEL_TERMS.values()):
        labels = F.when(contains_any(q, of), F.array(*[F.lit(t) for t in of])).otherwise(labels)
    family = X.first_family(q, A.INTENT_TERMS, "biomarker")
    terms = F.array(*[F.lit(t) for t in A.INTENT_TERMS["biomarker"]])
    loose = F.array(*[F.lit(t) for t in A.DEFAULT_INTENT_TERMS])
    for name, of in reversed(A.INTENT_TERMS.items()):
        own = F.array(*[F.lit(t) for t in of])
        terms = F.when(family == name, own).otherwise(terms)
        loose = F.when(contains_any(F.lower(empty(question)), of), own).otherwise(loose)
    return {
        "entities": X.question_entities(question, 10),
        "label_terms": labels,
        "intent_family": family,
        "intent_terms": terms,
        "gate_terms": loose,
        "need_clinical": contains_any(q, A.CLINICAL_NEED),
        "need_ae": contains_any(q, A.AE_NEED),
        "ae_question": contains_any(q, A.AE_QUESTION),
    }


def score_contexts(df: DataFrame, question: str, context: str, g: L.Generation | None = None) -> DataFrame:
    """Add context_score and evidence_type to rows of a question and a context."""
    needs = needs_of(F.col(question))
    blob = normalize(F.col(context))
    rows = df.withColumns({f"_{k}": v for k, v in needs.items()})
    rows = rows.withColumn("_signals", S.context_signals(blob, F.col("_entities"), F.col("_label_terms"), F.col("_intent_terms")))
    rows = rows.withColumn("evidence_type", S.evidence_type(blob, A.CLINICAL, A.PRECLINICAL))
    score = S.context_score(
        F.col("_signals"), F.col("_entities"), F.col("_label_terms"), F.col("_intent_terms"), F.col("evidence_type"),
        F.col("_need_clinical"), F.col("_need_ae"), contains_any(blob, A.AE_SIGNS), g,
    )
    return rows.withColumn("context_score", score).drop(*[f"_{k}" for k in needs], "_signals")


def filter_contexts(scored: DataFrame, question_id: str, context_id: str, g: L.Generation | None = None) -> DataFrame:
    """Of each question's contexts the best that reach the minimum score, at most ``filter_keep``; if none does, the
    best ``filter_fallback``."""
    from pyspark.sql import Window

    g = g or L.Generation()
    order = Window.partitionBy(question_id).orderBy(F.desc("context_score"), context_id)
    rows = scored.withColumn("context_rank", F.row_number().over(order)).where(F.col("context_rank") <= g.filter_keep)
    passed = F.col("context_score") >= g.filter_min_score
    rows = rows.withColumn("_any", F.max(passed).over(Window.partitionBy(question_id)))
    return rows.where(F.when(F.col("_any"), passed).otherwise(F.col("context_rank") <= g.filter_fallback)).drop("_any")


def numbered(contexts: Column, mark: str = "CTX", n: int = 8) -> Column:
    """The first contexts, each under its number."""
    each = F.transform(F.slice(contexts, 1, n), lambda c, i: F.concat(F.lit(f"[{mark} "), (i + 1).cast("string"), F.lit("]\n"), c))
    return F.array_join(each, "\n\n")


def build_contexts(hits: Column, top_k: int = 6) -> Column:
    """The texts of the first hits, without empty ones."""
    texts = F.transform(F.slice(hits, 1, top_k), lambda h: rx.strip(rx.text_or_empty(h["text_preview"])))
    return F.filter(texts, lambda t: t != "")


def answer_gate(df: DataFrame, question: str, contexts: str, g: L.Generation | None = None) -> DataFrame:
    """Add decision, message and prompt: what may be answered from the contexts.

    Decisions in order: no_context, ae_missing, no_evidence, no_entity, preclinical_only, answer.  Refusals have a
    message; the others a prompt for a generator.
    """
    g = g or L.Generation()
    ctx = F.slice(F.coalesce(F.col(contexts), F.array().cast("array<string>")), 1, g.max_contexts)
    rows = df.withColumns({f"_{k}": v for k, v in needs_of(F.col(question)).items()} | {"_ctx": ctx})
    rows = rows.withColumn("_blob", normalize(F.array_join("_ctx", "\n\n")))
    gate_entities = F.slice("_entities", 1, 8)
    rows = rows.withColumn("_signals", S.context_signals(F.col("_blob"), gate_entities, F.col("_label_terms"), F.col("_gate_terms")))
    entity_ok = (F.size("_entities") == 0) | (F.col("_signals.entities") > 0)
    label_ok = (F.size("_label_terms") == 0) | (F.col("_signals.labels") > 0)
    intent_ok = F.col("_signals.terms") > 0
    enough = S.evidence_pass(F.col("_signals"), gate_entities, F.col("_label_terms"), F.col("_gate_terms"), g.min_signals)
    primary = F.get("_entities", F.lit(0))
    named = F.exists("_ctx", lambda c: F.contains(F.lower(c), F.lower(primary)))
    wants = contains_any(F.lower(empty(F.col(question))), A.CLINICAL_NEED)
    kind = S.evidence_type(F.col("_blob"), A.CLINICAL, A.PRECLINICAL)
    decision = (
        F.when(F.size("_ctx") == 0, "no_context")
        .when(F.col("_ae_question") & ~contains_any(F.col("_blob"), A.AE_SIGNS), "ae_missing")
        .when(~enough, "no_evidence")
        .when((F.size("_entities") > 0) & ~named, "no_entity")
        .when(wants & (kind == "preclinical"), "preclinical_only")
        .otherwise("answer")
    )
    missing = F.filter(
        F.array(
            F.when(~entity_ok, F.lit("the key entity/entities")),
            F.when(~label_ok, F.lit("the expected cancer context")),
            F.when(~intent_ok, F.lit("the key outcome/intent")),
        ),
        lambda x: x.isNotNull(),
    )
    what = F.when(F.size(missing) > 0, F.array_join(missing, "; ")).otherwise(F.lit("the key information needed"))
    rows = rows.withColumn("decision", decision)
    message = (
        F.when(F.col("decision") == "no_context", F.lit(A.NO_PASSAGES))
        .when(F.col("decision") == "no_evidence", F.concat(F.lit("Insufficient context: the retrieved passages do not contain "), what, F.lit(".")))
        .when(
            F.col("decision") == "no_entity",
            F.concat(F.lit("Insufficient context: retrieved passages do not contain specific information about "), primary, F.lit(".")),
        )
    )
    task = (
        F.when(F.col("decision") == "ae_missing", "Say in one sentence, with citations, whether the contexts describe adverse effects.")
        .when(F.col("decision") == "preclinical_only", "In two sentences sum up the preclinical evidence and say that clinical data are missing.")
        .when(F.col("decision") == "answer", f"Answer in {g.min_answer_sentences} to {g.max_answer_sentences} sentences, each with its citations.")
    )
    prompt = F.when(
        task.isNotNull(),
        F.concat_ws("\n\n", task, F.lit("Use only the contexts."), F.concat(F.lit("QUESTION: "), F.col(question)), numbered(F.col("_ctx"), n=g.max_contexts)),
    )
    out = rows.withColumn("message", message).withColumn("prompt", prompt)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def rag_records(hits_table: DataFrame) -> DataFrame:
    """question, contexts and a blank answer for each query of a run."""
    texts = F.filter(F.transform("hits", lambda h: rx.text_or_empty(h["text_preview"])), lambda t: t != "")
    return hits_table.select(F.col("query").alias("question"), texts.alias("contexts"), F.lit("").alias("answer"))


class Judge(Protocol):
    """A model that rates an answer: metric name to value between 0 and 1."""

    def rate(self, question: str, answer: str, contexts: list[str]) -> dict[str, float]: ...


def judge_answers(df: DataFrame, judge: Judge, metrics: list[str], question: str = "question", answer: str = "answer",
                  contexts: str = "contexts") -> DataFrame:
    """``df`` with the judge's metrics as columns; a metric that the judge does not give is null.

    The judge is sent to the tasks and asked once for each row.  Rows without contexts are not judged.
    """
    schema = StructType([*df.schema.fields, *[StructField(m, DoubleType()) for m in metrics]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rated = [
                judge.rate(q or "", a or "", list(c)) if c is not None and len(c) else {}
                for q, a, c in zip(part[question], part[answer], part[contexts], strict=True)
            ]
            yield part.assign(**{m: pd.Series([r.get(m) for r in rated], index=part.index, dtype=float) for m in metrics})

    return df.mapInPandas(run, schema)


def metric_bands(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and colour band of each metric: high from 0.7, mid from 0.5."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m"))
    means = rows.groupBy("m.metric").agg(F.avg("m.v").alias("mean"))
    return means.withColumn("band", F.when(F.col("mean") >= 0.7, "high").when(F.col("mean") >= 0.5, "mid").otherwise("low"))
