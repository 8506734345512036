"""The question flow: local search, an outside source where the corpus falls short, then an answer from contexts.

Outside services are providers given by the caller; without them the flow runs on the corpus alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline import lexicon_answers as A
from sieveline import rx
from sieveline.functions import extract as X
from sieveline.functions.text import body_text, contains_any, empty


class ExternalSource(Protocol):
    def search(self, terms: str, most: int) -> list[dict[str, str]]: ...


class Generator(Protocol):
    def complete(self, prompt: str) -> str: ...


def local_chunks(hits: DataFrame, chars: int = 1000, top_k: int = 8) -> DataFrame:
    """query_id, query, label, rank, score, paper_id, section and the body's beginning of each hit."""
    some = hits.where(F.col("rank") <= top_k)
    body = F.substring(body_text(F.col("text")), 1, chars)
    return some.select("query_id", "query", "label", "rank", F.round("score", 4).alias("score"), "paper_id", "section", body.alias("text"))


def gap_report(chunks: DataFrame, agent: L.Agent | None = None, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """For each query: hits, mean score, strong hits, whether its entities and their label are there, and weak."""
    a, words = agent or L.Agent(), keywords or A.AGENT_KEYWORDS
    ents = F.filter(F.slice(X.entities(F.col("query")), 1, 5), lambda e: F.length(e) >= a.entity_min_len)
    rows = chunks.withColumn("ents", ents).withColumn("low", F.lower(empty(F.col("text"))))
    label = F.lit(False)
    for name, of in words.items():
        label = F.when(F.col("label") == name, contains_any(F.col("low"), of)).otherwise(label)
    rows = rows.withColumns(
        {
            "has_entity": F.exists("ents", lambda e: F.contains(F.col("low"), F.lower(e))),
            "has_both": F.exists("ents", lambda e: X.entity_in_text(e, F.col("low"))) & F.coalesce(label, F.lit(False)),
        }
    )
    out = rows.groupBy("query_id", "query", "label", "ents").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        F.sum((F.col("score") >= a.local_score_threshold).cast("long")).alias("n_strong"),
        F.max("has_entity").alias("any_entity"),
        F.max("has_both").alias("any_both"),
    )
    asked = F.size("ents") > 0
    entity = ~asked | F.col("any_entity")
    both = ~(asked & (F.coalesce("label", F.lit("")) != "")) | F.col("any_both")
    out = out.withColumns({"entity_present": entity, "cooccurrence_ok": both})
    weak = (F.col("n_strong") < a.local_min_hits) | ~F.col("entity_present") | ~F.col("cooccurrence_ok")
    return out.withColumn("weak", weak).drop("any_entity", "any_both", "ents")


def external_queries(queries: DataFrame, question: str) -> DataFrame:
    """Add external_query: search terms for an outside source."""
    q = F.col(question)
    label = X.detect_label(q)
    heading = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in A.SUBJECT_HEADINGS.items() for x in kv]), label), F.lit(""))
    ents = F.array_join(F.slice(X.entities(q), 1, 2), " AND ")
    parts = F.filter(F.array(ents, heading), lambda x: x != "")
    words = F.filter(rx.find_all(empty(q), "[A-Za-z]{3,}"), lambda w: ~F.lower(w).isin(A.QUERY_STOP))
    terms = F.when(F.size(parts) > 0, F.array_join(parts, " AND ")).otherwise(F.array_join(F.slice(words, 1, 6), " "))
    return queries.withColumn("external_query", terms)


def answer_contexts(chunks: DataFrame, most: int = 5) -> DataFrame:
    """query_id and context of every query: its first local passages under their marks (no outside ones)."""
    some = chunks.where(F.col("rank") <= most)
    passage = F.format_string(
        "[LOCAL %d] (paper: %s, section: %s)\n%s", "rank", F.coalesce("paper_id", F.lit("?")), F.coalesce("section", F.lit("?")), "text"
    )
    passages = F.array_sort(F.collect_list(F.struct("rank", passage.alias("p"))))
    return some.groupBy("query_id").agg(F.array_join(F.transform(passages, lambda x: x["p"]), "\n\n").alias("context"))


@dataclass
class State:
    question: str
    messages: list[str] = field(default_factory=list)
    local: list[dict] = field(default_factory=list)
    external: list[dict[str, str]] = field(default_factory=list)
    weak: bool = False
    answer: str = ""


def context_block(local: list[dict], external: list[dict[str, str]]) -> str:
    """At most five local and four outside passages under their marks."""
    parts = [f"[LOCAL {i}] (paper: {c.get('paper_id', '?')}, section: {c.get('section', '?')})\n{c['text']}" for i, c in enumerate(local[:5], 1)]
    parts += [f"[PUBMED {i}] {a['title']} ({a['year']})\n{a['abstract']}" for i, a in enumerate(external[:4], 1)]
    return "\n\n".join(parts)


def run_agent(
    question: str,
    search: Callable[[str], DataFrame],
    source: ExternalSource | None = None,
    generator: Generator | None = None,
    agent: L.Agent | None = None,
) -> State:
    """One question through the flow.  ``search`` returns hits as ``retrieve`` does; a single question has few."""
    a, state = agent or L.Agent(), State(question)
    chunks = local_chunks(search(question))
    state.local = [r.asDict() for r in chunks.orderBy("rank").collect()]
    report = gap_report(chunks, a).collect()
    state.weak = report[0].weak if report else True
    state.messages.append(f"local search: {len(state.local)} chunks, weak={state.weak}")
    if state.weak and source is not None:
        asked = external_queries(chunks.sparkSession.createDataFrame([(question,)], "q string"), "q").first()
        state.external = source.search(asked.external_query, a.max_external)
        state.messages.append(f"outside search: {len(state.external)} abstracts")
    block = context_block(state.local, state.external)
    if not block:
        state.answer = A.NO_SOURCES
    else:
        state.answer = generator.complete(f"QUESTION: {question}\n\n{block}") if generator else block
    return state
