"""Ranked retrieval over the tables, and the reports on its hits, with the SQL that must give the same rows.

The test tables hold invented prose.  So that entities, intents and labels occur in queries and rows alike, each text
gets one of the sample questions at its end, and rows lie in sections in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline.functions import extract as X
from sieveline.operators.index import build_sparse
from sieveline.operators.retrieve import analyse_queries, hits_table, prepare_rows, retrieve
from sieveline.plans import agent as AG
from sieveline.plans import evaluate as EV
from sieveline.plans.queries import (
    _ALL, _HI, BM25, CORPUS, QUESTIONS, STRIP, WORDS, _ents_sql, _points, docs, items, q_cases, query, vectors_of,
)

# The sections that rows lie in, by turns.
SECTIONS = ["UNKNOWN", "RESULTS", "METHODS", "REFERENCES", "DISCUSSION", "ABSTRACT"]
# What a run's queries say of the label they expect, by turns: under three names, or not at all.
EXPECTED = [("en", None, "de"), (None, "de", ""), ("", "", "fr"), (None, None, None)]


def _turn(key: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _turn_sql(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


_ASKED = [t for _, t in QUESTIONS]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """query_id and text of all benchmark items, each with a sample question."""
    b = items(spark, sf)
    return b.select("query_id", F.concat_ws(" ", "text", _turn(F.col("query_id"), _ASKED)).alias("text"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text (with a sample question), lang, source and section of all documents."""
    d, i = docs(spark, sf), F.col("doc_id")
    text = F.concat_ws(" ", "text", _turn(i, _ASKED)).alias("text")
    return d.select("doc_id", text, "lang", "source", _turn(i, SECTIONS).alias("section"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of all questions over the corpus."""
    rows, asked = corpus(spark, sf), questions(spark, sf)
    e = vectors_of(spark, sf)
    qv = e.join(asked, F.col("row_id") == F.col("query_id")).select("query_id", F.col("vec").alias("qv"))
    qs = analyse_queries(asked, "query_id", "text", CORPUS)
    prepared = prepare_rows(rows, "doc_id", "source", "lang", "text", "section")
    return retrieve(prepared, build_sparse(rows, "doc_id", "text"), e, qs, qv, CORPUS)


def _fold(col: str) -> str:
    """Letters beyond ASCII as a word character that no pattern names: the SQL engine's word borders know ASCII only."""
    return f"regexp_replace({col}, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def _pad(col: str) -> str:
    return rf"' ' || regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' '"


def _plus(parts: list[str]) -> str:
    return "(" + " + ".join(f"({p})::INT" for p in parts) + ")"


def _terms(terms: list[str]) -> str:
    return _plus([f"contains(low, '{t}') OR contains(compact, '{t}')" if 2 <= len(t) <= 12 else f"contains(low, '{t}')" for t in terms])


def _by_label(of: dict[str, str], other: str = "0") -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + f" ELSE {other} END"


def _tests(col: str) -> str:
    return f"regexp_matches(lower({col}), '(?i){{p}}')"


def _list(families: list[tuple[str, str]], col: str) -> str:
    """A list in place of the joined entities."""
    return _ents_sql(families).replace("text", col).removeprefix("array_to_string(").removesuffix(", ',')")


_R = L.Retrieval()
_EV = {k: _plus([f"contains(padded, ' {w} ')" for w in v]) for k, v in WORDS.items()}
_KW = {k: _plus([f"contains(low, '{w}')" for w in v]) for k, v in WORDS.items()}
_REQ = {k: _terms(of["must"]) for k, of in CORPUS.terms.items()}
_ANTI = {k: _terms(of["anti"]) for k, of in CORPUS.terms.items()}
_BIAS = " ".join(f"WHEN intent = '{i}' AND section = '{s}' THEN {v}" for i, of in L.SECTION_BIAS.items() for s, v in of.items())
_PEN = " ".join(f"WHEN section = '{s}' THEN {v}" for s, v in L.SECTION_PENALTY.items())
_FOUND = r"""len(list_filter(hi, lambda e: contains(padded, ' ' || regexp_replace(lower(e), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ')
OR (length(regexp_replace(e, '[\s\-_/]+', '', 'g')) BETWEEN 2 AND 12 AND contains(compact, lower(regexp_replace(e, '[\s\-_/]+', '', 'g'))))))"""

#: Common table expressions that end in ``hits``: one row for each hit.
HITS = rf"""corpus AS (SELECT doc_id, text || ' ' || {_turn_sql('doc_id', _ASKED)} AS text, lang, source, {_turn_sql('doc_id', SECTIONS)} AS section FROM documents),
{BM25.replace('FROM documents', 'FROM corpus')},
qs AS (SELECT item_id AS query_id, text || ' ' || {_turn_sql('item_id', _ASKED)} AS query FROM benchmark),
qf AS (SELECT *, {_fold('query')} AS qa FROM qs),
qe AS (SELECT query_id, query, qa, {q_cases(L.INTENTS, 'general', _tests('qa'))} AS intent, {q_cases(CORPUS.patterns, '', _tests('qa'))} AS label, {_list(_ALL, 'qa')} AS ents, {_list(_HI, 'qa')} AS hi FROM qf),
qq AS (SELECT *, regexp_matches(qa, '(?i){L.CITATION_QUERY}') OR intent = 'citations' AS citations, CASE WHEN len(ents) > 0 THEN 0.25 ELSE 0.1 END AS weight,
  regexp_extract_all(lower(query || ' ' || array_to_string(hi, ' ')), '[A-Za-z0-9\-_/]+') AS terms FROM qe),
qt AS (SELECT query_id, unnest(terms) AS term FROM qq), qn AS (SELECT query_id, term, count(*) AS qn FROM qt GROUP BY 1, 2),
sc AS (SELECT query_id, row_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25 FROM qn JOIN idf USING (term) JOIN tf USING (term), st GROUP BY 1, 2),
sz AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25, 0) DESC, row_id DESC) AS r FROM qq CROSS JOIN d LEFT JOIN sc USING (query_id, row_id)),
v AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v FROM embeddings),
dv AS (SELECT q.row_id AS query_id, v.row_id, round(list_dot_product(q.v, v.v), 9) AS dense FROM v q, v WHERE q.row_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, row_id) AS r FROM dv) WHERE r <= {_R.top_n_dense}),
ids AS (SELECT query_id, row_id FROM sz WHERE r <= {_R.top_n_bm25} UNION SELECT query_id, row_id FROM dr),
body AS (SELECT doc_id AS row_id, source AS paper_id, lang AS row_label, section, text, CASE WHEN contains(text, '---') THEN {STRIP.format("regexp_replace(text, '^(?s:.*?)---', '')")} WHEN contains(text, ']') THEN {STRIP.format("substr(text, strpos(text, ']') + 1)")} ELSE {STRIP.format('text')} END AS body,
  md5({STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")}) AS content_hash, {_fold('text')} AS t FROM corpus),
feat AS (SELECT *, lower(body) AS low, regexp_replace(lower(body), '\s+', '', 'g') AS compact, {_pad('body')} AS padded, ({_points()}) >= 6 AS is_ref FROM body),
cand AS (SELECT * EXCLUDE (t), {', '.join(f'{e} AS ev_{k}' for k, e in _EV.items())} FROM ids LEFT JOIN dr USING (query_id, row_id) LEFT JOIN sc USING (query_id, row_id) JOIN feat USING (row_id) JOIN qq USING (query_id)),
gate AS (SELECT *, greatest({', '.join(f'ev_{k}' for k in WORDS)}) AS best, {_by_label({k: f'ev_{k}' for k in WORDS})} AS own FROM cand),
part AS (SELECT *, CASE WHEN len(hi) > 0 THEN {_FOUND} / len(hi)::DOUBLE ELSE 0 END AS overlap, {_by_label(_REQ)} AS req, {_by_label(_ANTI)} AS others, {_by_label(_KW)} AS kw_own,
  greatest({', '.join(f"CASE WHEN label = '{k}' THEN 0 ELSE {e} END" for k, e in _KW.items())}) AS kw_best, len(list_filter(ents, lambda e: contains(low, lower(e)))) AS n_ents,
  section IN ({', '.join(repr(x) for x in L.CONTENT_SECTIONS)}) AS content FROM gate WHERE label = '' OR NOT (own = 0 AND best >= 1)),
bits AS (SELECT *, CASE WHEN content AND label <> '' THEN req ELSE 0 END AS req_hits,
  CASE WHEN NOT content OR label = '' OR req > 0 THEN 0 WHEN others >= 2 THEN {_R.must_strong_other_penalty} WHEN others = 1 THEN {_R.must_weak_other_penalty} ELSE {_R.must_generic_penalty} END AS must_penalty,
  CASE WHEN label = '' OR kw_own > 0 THEN 0 WHEN kw_best >= 4 THEN {_R.mismatch_strong_penalty} WHEN kw_best >= 2 THEN {_R.mismatch_weak_penalty} ELSE 0 END AS mismatch,
  CASE WHEN label = '' THEN 0 WHEN best = 0 THEN {_R.generic_penalty} WHEN own > 0 THEN least({_R.present_cap}, own * {_R.present_per_hit}) WHEN best - own >= 2 THEN {_R.absent_strong_penalty} ELSE {_R.absent_weak_penalty} END AS delta,
  (CASE {_BIAS} ELSE 0 END) + (CASE {_PEN} ELSE 0 END) AS section_bonus, least({_R.entity_bonus_cap}, n_ents * {_R.entity_bonus_per_hit}) AS entity_bonus,
  CASE WHEN len(hi) >= {_R.rerank_min_entities} AND overlap > 0 THEN {_R.rerank_weight} * pow(overlap, 1.5) ELSE 0 END AS rerank,
  CASE WHEN citations THEN 0 ELSE (CASE WHEN section = 'REFERENCES' THEN {_R.reference_section_penalty} ELSE 0 END) + (CASE WHEN is_ref THEN {_R.reference_flag_penalty} ELSE 0 END) END AS cited FROM part),
scored AS (SELECT *, round(coalesce(dense, 0)::DOUBLE + weight::DOUBLE * (coalesce(bm25, 0) / {_R.bm25_div}::DOUBLE) + section_bonus::DOUBLE + entity_bonus::DOUBLE + delta::DOUBLE - mismatch::DOUBLE - must_penalty::DOUBLE
  + least({_R.req_hits_bonus_cap}, req_hits * {_R.req_hits_bonus_per_hit})::DOUBLE + rerank::DOUBLE - cited::DOUBLE, 9) AS score FROM bits),
first_hash AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, row_id) AS rh FROM scored),
first_paper AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, row_id) AS rp FROM first_hash WHERE rh = 1),
hits AS (SELECT * FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM first_paper WHERE rp = 1) WHERE rank <= {_R.top_k})"""


@query(f"WITH {HITS} SELECT query_id, row_id, paper_id, rank, round(score, 6) AS score, intent, label, req_hits::INT AS req_hits, round(coalesce(bm25, 0), 6) AS bm25_score, round(coalesce(dense, 0), 6) AS dense_score, round(overlap, 6) AS entity_overlap, must_penalty::DOUBLE AS must_penalty, mismatch::DOUBLE AS mismatch_penalty, round(delta, 6)::DOUBLE AS label_delta, is_ref AS is_reference_list FROM hits")
def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The full ranked retrieval for all questions, with the parts of each score."""
    six = [F.round(c, 6).alias(c) for c in ("score", "bm25_score", "dense_score", "entity_overlap", "label_delta")]
    names = ("query_id", "row_id", "paper_id", "rank", "intent", "label", "req_hits", "must_penalty", "mismatch_penalty", "is_reference_list")
    return hits(spark, sf).select(*names, *six)


_OK = "CASE expected " + " ".join(f"WHEN '{k}' THEN ({' OR '.join(f'contains(lower(text), {w!r})' for w in v)})" for k, v in WORDS.items()) + " ELSE false END"
_EXPECTED_SQL = "coalesce(" + ", ".join(f"nullif({_turn_sql('query_id', [e[i] for e in EXPECTED])}, '')" for i in range(3)) + ", '')"


@query(f"""WITH {HITS}, h AS (SELECT *, {_EXPECTED_SQL} AS expected FROM hits), o AS (SELECT *, {_OK} AS ok FROM h),
b AS (SELECT query_id, bool_or(expected <> '') AS asked, bool_or(rank = 1 AND ok) AS first_ok, bool_and(ok) AS all_ok, count(*) AS n, sum(is_ref::INT) AS refs, count(content_hash) - count(DISTINCT content_hash) AS dh, count(nullif(paper_id, '')) - count(DISTINCT nullif(paper_id, '')) AS dp FROM o GROUP BY 1)
SELECT count(*) AS queries, sum(asked::INT)::BIGINT AS asked, sum((asked AND first_ok)::INT)::BIGINT AS evidence_at_1, sum((asked AND all_ok)::INT)::BIGINT AS evidence_strict, sum(refs)::BIGINT AS ref_hits, sum(n)::BIGINT AS hits, sum(dh)::BIGINT AS duplicate_hashes, sum(dp)::BIGINT AS duplicate_papers, sum(refs) / sum(n)::DOUBLE AS ref_rate FROM b""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    """The health of the run against the label each query expects."""
    said = [_turn(F.col("query_id"), [e[i] for e in EXPECTED]) for i in range(3)]
    return EV.health_report(hits(spark, sf).withColumn("expected_label", EV.expected_label(*said)), WORDS)


@query(f"WITH {HITS} SELECT section, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, section LIMIT 12")
def hit_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of all hits (a top-12 report)."""
    return EV.section_counts(hits(spark, sf))


def _has(col: str) -> str:
    return rf"contains({_pad(col)}, ' ' || regexp_replace(lower(ent), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ')"


_LOOSE = "list_sort(list_distinct(flatten([" + ", ".join([f"list_transform(regexp_extract_all(qa, '(?i){p}'), lambda x: {c}(x))" for p, c in _HI] + [f"list_filter(regexp_extract_all(upper({_fold("replace(query, 'ß', 'ss')")}), '{L.GENE_LOOSE}'), lambda x: x NOT IN ({', '.join(map(repr, L.GENE_STOP))}))"]) + "])))"
_ENTITY_HITS = f"""WITH {HITS}, e AS (SELECT query_id, intent, rank, text, unnest({_LOOSE}) AS ent FROM hits), o AS (SELECT query_id, intent, rank, ent, {_has('text')} AS has FROM e),
f AS (SELECT query_id, intent, ent, k, bool_or(rank <= k AND has) AS found FROM o CROSS JOIN (SELECT unnest([1, 3, 10])::INT AS k) GROUP BY ALL),
b AS (SELECT query_id, intent, k, count(*) AS n, sum(found::INT) AS f FROM f GROUP BY ALL)
SELECT {{keys}}, count(*) AS queries, sum((f > 0)::INT)::BIGINT AS hit_queries, sum(n)::BIGINT AS entities, sum(f)::BIGINT AS entities_found FROM b GROUP BY {{keys}}"""


@query(_ENTITY_HITS.replace("{keys}", "k"))
def entity_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Queries and entities found among the first 1, 3 and 10 hits."""
    return EV.entity_hit_rate(hits(spark, sf))


@query(_ENTITY_HITS.replace("{keys}", "intent, k"))
def entity_hits_by_intent(spark: SparkSession, sf: str) -> DataFrame:
    return EV.entity_hit_rate(hits(spark, sf), by_intent=True)


@query(f"""WITH {HITS}, e AS (SELECT query_id, unnest({_LOOSE}) AS ent, text FROM hits), o AS (SELECT query_id, ent, bool_or({_has('text')}) AS has FROM e GROUP BY ALL),
c AS (SELECT query_id, sum(has::INT) / count(*)::DOUBLE AS coverage FROM o GROUP BY 1), a AS (SELECT DISTINCT query_id FROM hits)
SELECT query_id, round(coalesce(coverage, 0), 6) AS coverage FROM a LEFT JOIN c USING (query_id)""")
def entity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """For each query the share of its entities that its hits hold, the lowest first."""
    return EV.entity_coverage(hits(spark, sf)).select("query_id", F.round("coverage", 6).alias("coverage"))


_AG_LABEL = "CASE label " + " ".join(f"WHEN '{k}' THEN ({' OR '.join(f'contains(low, {w!r})' for w in v)})" for k, v in WORDS.items()) + " ELSE false END"


@query(rf"""WITH {HITS}, ch AS (SELECT query_id, label, round(score, 4) AS score, list_filter(ents[1:5], lambda e: length(e) >= 3) AS es, lower(substr(body, 1, 1000)) AS low FROM hits WHERE rank <= 8),
o AS (SELECT *, {_AG_LABEL} AS lab, {_pad('low')} AS padded FROM ch),
rr AS (SELECT *, len(list_filter(es, lambda e: contains(low, lower(e)))) > 0 AS has_e, lab AND len(list_filter(es, lambda e: contains(padded, ' ' || regexp_replace(lower(e), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' '))) > 0 AS has_b FROM o),
gg AS (SELECT query_id, label, len(any_value(es)) > 0 AS asked, count(*) AS n_chunks, avg(score) AS mean, sum((score >= 0.55)::INT)::BIGINT AS n_strong, bool_or(has_e) AS any_e, bool_or(has_b) AS any_b FROM rr GROUP BY 1, 2),
pr AS (SELECT *, NOT asked OR any_e AS entity_present, NOT (asked AND label <> '') OR any_b AS cooccurrence_ok FROM gg)
SELECT query_id, label, n_chunks, round(round(mean, 4), 3) AS avg_score, n_strong, entity_present, cooccurrence_ok, n_strong < 2 OR NOT entity_present OR NOT cooccurrence_ok AS weak FROM pr""")
def agent_route(spark: SparkSession, sf: str) -> DataFrame:
    """Where the corpus falls short of a question, so that an outside source is asked."""
    g = AG.gap_report(AG.local_chunks(hits(spark, sf)), keywords=WORDS).drop("query")
    return g.withColumn("avg_score", F.round("avg_score", 3))


@query(f"WITH {HITS} SELECT query_id, label AS expected_label, intent, count(*)::INT AS n_hits, sum((rank <= 6 AND trim(substr(text, 1, 2000)) <> '')::INT)::INT AS n_contexts FROM hits GROUP BY ALL")
def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each query, its hits as an array."""
    t = hits_table(hits(spark, sf))
    return t.select("query_id", "expected_label", "intent", F.size("hits").alias("n_hits"), F.size(EV.build_contexts(F.col("hits"))).alias("n_contexts"))


@query(f"WITH {HITS} SELECT md5(query) AS question_md5, md5(string_agg(substr(text, 1, 2000), chr(10) ORDER BY rank)) AS contexts_md5, count(*)::INT AS n FROM hits GROUP BY query")
def rag_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the texts of their hits as contexts."""
    t = EV.rag_records(hits_table(hits(spark, sf)))
    joined = F.array_join("contexts", "\n")
    return t.select(F.md5(F.col("question").cast("binary")).alias("question_md5"), F.md5(joined.cast("binary")).alias("contexts_md5"), F.size("contexts").alias("n"))


@query(f"WITH {HITS} SELECT query_id, md5(string_agg('[CTX ' || rank || ']' || chr(10) || {STRIP.format('substr(text, 1, 2000)')}, chr(10) || chr(10) ORDER BY rank)) AS contexts_md5 FROM hits WHERE rank <= 6 GROUP BY 1")
def answer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered contexts of each question's answer prompt."""
    t = hits_table(hits(spark, sf))
    return t.select("query_id", F.md5(EV.numbered(EV.build_contexts(F.col("hits"))).cast("binary")).alias("contexts_md5"))


@query(rf"""WITH {HITS} SELECT query_id, md5(string_agg('[LOCAL ' || rank || '] (paper: ' || paper_id || ', section: ' || section || ')' || chr(10) || substr(body, 1, 1000), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM hits WHERE rank <= 5 GROUP BY 1""")
def answer_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The passages that an answer is made from, under their marks; the corpus alone, without an outside source."""
    t = AG.answer_contexts(AG.local_chunks(hits(spark, sf)))
    return t.select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


_HEADING = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AG.A.SUBJECT_HEADINGS.items()) + " ELSE '' END"
_STOP = ", ".join(map(repr, AG.A.QUERY_STOP))


@query(rf"""WITH qs AS (SELECT item_id AS query_id, text || ' ' || {_turn_sql('item_id', _ASKED)} AS query FROM benchmark), qf AS (SELECT *, {_fold('query')} AS qa FROM qs),
qe AS (SELECT query_id, {q_cases(L.LABEL_PATTERNS, '', _tests('qa'))} AS label, array_to_string(({_list(_ALL, 'qa')})[1:2], ' AND ') AS ents, query FROM qf),
p AS (SELECT *, list_filter([ents, {_HEADING}], lambda x: x <> '') AS parts, list_filter(regexp_extract_all(query, '[A-Za-z]{{3,}}'), lambda w: lower(w) NOT IN ({_STOP})) AS words FROM qe)
SELECT query_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' AND ') ELSE array_to_string(words[1:6], ' ') END AS external_query FROM p""")
def outside_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What an outside source is asked for each question."""
    return AG.external_queries(questions(spark, sf), "text").select("query_id", "external_query")


@query("WITH m AS (SELECT unnest(['quality', 'toxic']) AS metric, unnest([quality, toxic])::DOUBLE AS v FROM labels) SELECT metric, round(avg(v), 9) AS mean, CASE WHEN avg(v) >= 0.7 THEN 'high' WHEN avg(v) >= 0.5 THEN 'mid' ELSE 'low' END AS band FROM m GROUP BY 1")
def metric_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and colour band of each judged metric."""
    from sieveline.session import read_table

    m = EV.metric_bands(read_table(spark, sf, "labels"), ["quality", "toxic"])
    return m.withColumn("mean", F.round("mean", 9))


@query(f"SELECT item_id, array_to_string({_LOOSE}, ',') AS ents FROM (SELECT item_id, query, {_fold('query')} AS qa FROM (SELECT item_id, text || ' ' || {_turn_sql('item_id', _ASKED)} AS query FROM benchmark))")
def loose_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation's entities of all questions."""
    return questions(spark, sf).select(F.col("query_id").alias("item_id"), F.array_join(X.loose_entities(F.col("text")), ",").alias("ents"))


_QUESTIONS_SQL = f"(SELECT item_id AS query_id, text || ' ' || {_turn_sql('item_id', _ASKED)} AS query FROM benchmark)"


@query(f"WITH q AS (SELECT query_id, {_fold('query')} AS qa FROM {_QUESTIONS_SQL}), i AS (SELECT query_id, qa, {q_cases(L.INTENTS, 'general', _tests('qa'))} AS intent, {q_cases(L.LABEL_PATTERNS, '', _tests('qa'))} AS label FROM q) SELECT query_id, intent, label, regexp_matches(qa, '(?i){L.CITATION_QUERY}') AS citations FROM i")
def intent_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Intent, label and citation wish of all questions."""
    t = F.col("text")
    return questions(spark, sf).select("query_id", X.infer_intent(t).alias("intent"), X.detect_label(t).alias("label"), X.wants_citations(t, X.infer_intent(t)).alias("citations"))


@query(f"SELECT query_id, array_to_string({_list(_ALL, 'qa')}, ',') AS ents, array_to_string({_list(_HI, 'qa')}, ',') AS hi FROM (SELECT query_id, {_fold('query')} AS qa FROM {_QUESTIONS_SQL})")
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and high-signal entities of all questions."""
    t = F.col("text")
    return questions(spark, sf).select("query_id", F.array_join(X.entities(t), ",").alias("ents"), F.array_join(X.highsignal_entities(t), ",").alias("hi"))
