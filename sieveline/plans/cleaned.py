"""Queries on cleaning, scoring, gates and sources, with the SQL that must give the same rows.

The SQL engine's word borders know ASCII only.  Where a rule uses them, both sides read the text with letters beyond
ASCII written as ``e``; the rules themselves run unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sieveline import lexicon as L
from sieveline import lexicon_answers as A
from sieveline.functions import extract as X
from sieveline.functions import quality as Q
from sieveline.functions import scoring as S
from sieveline.functions import text as T
from sieveline.plans import evaluate as EV
from sieveline.plans.queries import (
    CLEAN, FIX1, FP, MERGED, N_WORDS, PASS1, QUESTIONS, SR, STRIP, UP, WORDS, DR, _turns, docs, query,
)
from sieveline.plans.ranked import _pad, _turn
from sieveline.session import read_table, table_path
from sieveline.sources import io
from sieveline.sources.providers import embedding_cost
from sieveline.streaming.ingest import ingest_stream

# Parts that the cleaning steps look for, put at the end of texts by turns.
PARTS = [
    "\n\nAs shown in Figure 2 the rest holds. The trial (see Table 3b, left) ended [12, 13].",
    "\nContact a.b@example.org for data\nVolume 12 of the series\nlast line (Smith et al., 2020) here",
    "\nDoe et al. (2019) found it; doi: 10.1000/xyz12 (3, 4)\nREFERENCES\n1. Cut this",
    "\n1 2\n3 4\n5 6\n7 8\n9 10\n11 12\n13 14\ntable 4 ends\n",
    "\nSubmit your manuscript today\nSupplementary Table S1 holds all of it\n\nMETHODS We went on. RESULTS It held.",
    "\nfigure 7a: a label\t\twith tabs\nCopyright 2020 by them\n\n\n\nend",
    "\nACKNOWLEDGMENTS\nWe thank all.",
    "\nhttps://example.org/x is a link\nplain",
    "\n10.1234/abc.def in 2021 and [4-6]",
    "", "",
]
GLUED = [
    " ofpatients and thetherapy usedtoday", " osimertinibtreated cellcarcinoma highrisk lungcancer", " poorpatients latescreening doubleB lowGrade",
    " ( spaced ) , out ; ehT end", "",
]

FOLD = "regexp_replace({}, '[À-ÖØ-öø-ɏ]', 'e', 'g')"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _turn_text(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def folded(col: Column) -> Column:
    return F.regexp_replace(col, "[À-ÖØ-öø-ɏ]", "e")


def _with_parts(spark: SparkSession, sf: str, parts: list[str]) -> DataFrame:
    return docs(spark, sf).select("doc_id", "source", F.concat(folded(F.col("text")), _turn(F.col("doc_id"), parts)).alias("text"))


def _sub(t: str, pattern: str, to: str = "", flags: str = "") -> str:
    """All matches replaced; ``(?d)`` line ends are the SQL engine's own."""
    lead = f"(?{flags})" if flags else ""
    return f"regexp_replace({t}, {_q(lead + pattern)}, {_q(to)}, 'g')"


def _any(t: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(p)})" for p in parts) + ")"


def _cut_sql() -> str:
    start = f"greatest(length(t) - {L.TAIL_CHARS}, 0)"
    tail = f"substr(t, {start} + 1)"
    whens = " ".join(
        f"WHEN regexp_matches({tail}, {_q('(?i)' + p)}) THEN {STRIP.format(f'substr(t, 1, {start}::BIGINT + length(regexp_extract({tail}, {_q(f"(?is)^(.*?){p}")}, 1)))')}"
        for p in L.TAIL_CUTS
    )
    return f"CASE {whens} ELSE t END"


_UNFLATTEN = "|".join(sorted(L.UNFLATTEN_HEADINGS, key=lambda h: (-len(h), L.UNFLATTEN_HEADINGS.index(h))))
_CITE_ALL = {
    "bracket": f"CASE WHEN contains(t, '[') THEN {_sub('t', L.CITE_BRACKET)} ELSE t END",
    "paren": f"CASE WHEN contains(t, '(') THEN {_sub('t', L.CITE_PAREN)} ELSE t END",
    "author": f"CASE WHEN contains(t, '(') AND regexp_matches(t, {_q(L.YEAR_HINT)}) THEN {_sub(_sub('t', L.CITE_AUTHOR_PAREN), L.CITE_AUTHOR)} ELSE t END",
    "doi": f"CASE WHEN contains(lower(t), 'doi') OR contains(t, '10.') THEN {_sub('t', L.CITE_DOI, flags='i')} ELSE t END",
}


def _guarded(step: str) -> str:
    """A citation step behind the guard that all of them share; ``g`` tells it."""
    return f"CASE WHEN g THEN {step} ELSE t END"


_FIGURES = _sub(_sub(_sub("t", L.FIGURE_INLINE, flags="i"), L.FIGURE_AS_SHOWN, flags="i"), L.FIGURE_LABEL, flags="i")
_DEEP = f"""WITH f AS (SELECT doc_id, {FOLD.format('text')} || {_turn_text('doc_id', PARTS)} AS t FROM documents),
a AS (SELECT doc_id, t AS raw, {_cut_sql()} AS t FROM f),
b AS (SELECT doc_id, raw, CASE WHEN {_any('upper(substr(t, 1, 4000))', L.DEEP_CLEAN_HEADING_HINTS)} THEN {_sub('t', f'({_UNFLATTEN})', chr(10) + chr(92) + '1' + chr(10), 'i')} ELSE t END AS t FROM a),
c AS (SELECT doc_id, raw, {_sub('t', L.BOILERPLATE_LINE, flags='im')} AS t FROM b),
d AS (SELECT doc_id, raw, lower(t) AS low, CASE WHEN {_any('lower(t)', ['figure', 'fig.', 'table'])} THEN {_FIGURES} ELSE t END AS t FROM c),
e AS (SELECT doc_id, raw, t, (contains(t, '[') OR (contains(t, '(') AND regexp_matches(t, {_q(L.YEAR_HINT)})) OR contains(low, 'doi') OR contains(t, '10.')) AS g FROM d),
e1 AS (SELECT doc_id, raw, g, {_guarded(_CITE_ALL['bracket'])} AS t FROM e), e2 AS (SELECT doc_id, raw, g, {_guarded(_CITE_ALL['paren'])} AS t FROM e1),
e3 AS (SELECT doc_id, raw, g, {_guarded(_CITE_ALL['author'])} AS t FROM e2), e4 AS (SELECT doc_id, raw, g, {_guarded(_CITE_ALL['doi'])} AS t FROM e3),
h AS (SELECT doc_id, raw, CASE WHEN {_any('lower(t)', L.JUNK_TRIGGERS)} THEN {_sub(_sub('t', L.JUNK_LINE, flags='im'), L.SUPPLEMENT_BLOCK, chr(10) + chr(10), 'is')} ELSE t END AS t FROM e4),
k AS (SELECT doc_id, raw, CASE WHEN (contains(lower(t), 'table') OR contains(t, chr(9))) AND contains(t, chr(10)) THEN {_sub('t', L.TABLE_DUMP, chr(10) + '[TABLE_OMITTED]' + chr(10), 'is')} ELSE t END AS t FROM h),
n AS (SELECT doc_id, CASE WHEN {STRIP.format('raw')} = '' THEN '' ELSE {STRIP.format(_sub(_sub(_sub('replace(t, chr(13), chr(10))', '[ ' + chr(92) + 't]+', ' '), chr(92) + 'n[ ' + chr(92) + 't]+', chr(10)), chr(92) + 'n{3,}', chr(10) + chr(10)))} END AS t FROM k)
SELECT doc_id, md5(t) AS clean_md5, length(t)::INT AS n_chars FROM n"""


@query(_DEEP)
def deep_clean(spark: SparkSession, sf: str) -> DataFrame:
    """All cleaning steps on all documents, with parts that reach each of them."""
    t = _with_parts(spark, sf, PARTS).select("doc_id", T.basic_clean_fast(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("clean_md5"), F.length("t").alias("n_chars"))


def _spaced(stopwords: bool) -> str:
    b1, two = chr(92) + "1", chr(92) + "1 " + chr(92) + "2"
    t = _sub(_sub("replace(t, chr(160), ' ')", "[ " + chr(92) + "t]+", " "), chr(92) + "n{3,}", chr(10) + chr(10))
    t = _sub(t, L.OCR_GARBAGE, " ", "i")
    if stopwords:
        t = _sub(t, rf"\b({'|'.join(L.JOINED_AFTER)})([a-z]{{4,}})\b", two, "i")
        t = _sub(t, rf"\b([a-z]{{4,}})({'|'.join(L.JOINED_BEFORE)})\b", two, "i")
    t = _sub(t, L.DRUG_BOUNDARY, two, "i")
    for left, rights in L.SUFFIX_SPLITS.items():
        t = _sub(t, rf"\b({left})({'|'.join(sorted(rights.split(), key=len, reverse=True))})\b", two, "i")
    t = _sub(_sub(t, L.COMMON_SUFFIX, two, "i"), "([a-z])([A-Z])", two)
    t = _sub(t, r"\s+([,.;:!?])", b1)
    t = _sub(_sub(t, r"(\()\s+", b1), r"\s+(\))", b1)
    return STRIP.format(_sub(t, "[ " + chr(92) + "t]{2,}", " "))


@query(f"WITH f AS (SELECT doc_id, {FOLD.format('text')} || {_turn_text('doc_id', GLUED)} AS t FROM documents) SELECT doc_id, md5({_spaced(True)}) AS fixed_md5, md5({_spaced(False)}) AS safe_md5 FROM f")
def fix_spacing_v2(spark: SparkSession, sf: str) -> DataFrame:
    """The second pass's repair, and the mode that leaves words with a stopword inside alone."""
    t = _with_parts(spark, sf, GLUED)
    t = t.select("doc_id", T.fix_spacing_v2(F.col("text")).alias("a"), T.fix_spacing_v2(F.col("text"), False).alias("b"))
    return t.select("doc_id", F.md5(F.col("a").cast("binary")).alias("fixed_md5"), F.md5(F.col("b").cast("binary")).alias("safe_md5"))


@query(f"WITH f AS (SELECT doc_id, {FOLD.format('text')} || {_turn_text('doc_id', GLUED)} AS t FROM documents), s AS (SELECT doc_id, {MERGED} AS score, {SR} AS sr FROM f) SELECT doc_id, score, score >= 6 OR sr < 0.085 AS suspicious, score >= 10 OR sr < 0.07 AS very_bad FROM s")
def merged_word_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Merged-word scores of all documents with both flags."""
    t = F.col("text")
    return _with_parts(spark, sf, GLUED).select("doc_id", Q.merged_word_score(t).alias("score"), Q.suspicious(t).alias("suspicious"), Q.very_bad(t).alias("very_bad"))


@query(f"""WITH f AS (SELECT doc_id, {FOLD.format('text')} AS t, {FOLD.format('text')} AS raw FROM documents), s AS (SELECT doc_id, raw, {MERGED} AS score, {SR} AS sr, md5(regexp_replace({STRIP.format('lower(t)')}, '\\s+', ' ', 'g')) AS fp FROM f),
g AS (SELECT fp, max(score) AS score, min(sr) AS sr, count(*) AS n_dupes, list_sort(list(doc_id))[1:5] AS examples FROM s GROUP BY 1)
SELECT fp, score, n_dupes, array_to_string(examples, ',') AS examples FROM g ORDER BY score DESC, sr, fp LIMIT 25""")
def worst_unique(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 worst distinct texts of all documents with five examples of each (a top-k report)."""
    rows = docs(spark, sf).select("doc_id", folded(F.col("text")).alias("text"))
    g = Q.worst_by_fingerprint(rows, "doc_id", "text")
    return g.select("fp", "score", "n_dupes", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query(rf"WITH f AS (SELECT md5(substr(regexp_replace(lower({STRIP.format(_sub('text', chr(92) + 's+', ' '))}), '[^a-z0-9 ]+', '', 'g'), 1, 400)) AS fp FROM documents), g AS (SELECT fp, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 3) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS n_rows FROM g")
def repeated_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of three and more texts that begin alike, and the rows in them."""
    g = docs(spark, sf).groupBy(T.prefix_fingerprint(F.col("text")).alias("fp")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


_SOUP = rf"""CASE WHEN t = '' THEN 0 WHEN NOT regexp_matches(t, '[A-Za-z]{{3,}}') THEN 5 ELSE
(len(regexp_extract_all(t, '[.!?]')) <= 1)::INT + ({SR} < 0.11)::INT + ({DR} > 0.18)::INT + (len(regexp_extract_all(t, '[,;:/|]')) / greatest(length(t), 1)::DOUBLE > 0.015)::INT END"""
_TABLE_JUNK = f"(({SR} < 0.11 AND {DR} > 0.12) OR ({UP} > 0.85 AND {DR} > 0.10) OR regexp_matches(t, '(?i){L.URL}') OR regexp_matches(t, '(?i){L.TABLE_SIGN}'))"
_GENOTYPE = r"(len(regexp_extract_all(upper(t), '\b[ACGT]{12,}\b')) >= 2 OR regexp_matches(t, '(?i)\brs\d{3,}\b'))"
_TOKENISH = r"len(regexp_extract_all(t, '\w+|[^\w\s]'))"


@query(rf"""WITH f AS (SELECT doc_id, source, {FOLD.format('text')} || {_turn_text('doc_id', PARTS)} AS raw FROM documents),
n AS (SELECT doc_id, source, {STRIP.format(_sub('raw', chr(92) + 's+', ' '))} AS t, raw FROM f), s AS (SELECT *, {_SOUP} AS soup, {_TOKENISH} AS tok FROM n),
r AS (SELECT doc_id, source, soup, tok, t, len(regexp_extract_all(raw, '(?:^|\s)[•\-]\s')) AS bullets, raw FROM s),
j AS (SELECT doc_id, source, soup, tok, t AS norm, raw AS t, bullets FROM r), k AS (SELECT *, {_TABLE_JUNK} AS junk, {_GENOTYPE} AS dna FROM j),
m AS (SELECT doc_id, source, soup, tok, bullets, junk, dna, norm AS t FROM k),
a AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE (tok >= 150)::INT + CASE WHEN tok <= 800 THEN 0.5 ELSE 0 END + (len(regexp_extract_all(t, '[.!?]')) >= 2)::INT - CASE WHEN soup >= 3 THEN 2 ELSE 0 END - CASE WHEN {_TABLE_JUNK} THEN 3 ELSE 0 END END::DOUBLE AS score FROM m)
SELECT source, count(*) AS n, round(avg(score), 9) AS answerability, round(avg(soup), 9) AS soup, round(avg((NOT junk AND NOT dna AND score >= 1.5 AND tok BETWEEN 180 AND 650)::INT), 9) AS good_rate, round(avg(junk::INT), 9) AS junk_rate, round(avg(dna::INT), 9) AS dna_rate, sum(bullets)::BIGINT AS bullets, median(score)::DOUBLE AS median_answerability FROM a GROUP BY 1""")
def answerability_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: rows, good chunks, mean scores and the rate of each flag."""
    t = F.col("text")
    rows = _with_parts(spark, sf, PARTS).select(
        "source", Q.answerability_score(t).alias("a"), Q.keyword_soup_score(t).alias("s"), Q.good_chunk(t).alias("g"),
        Q.is_table_or_header_junk(t).alias("j"), Q.is_dna_or_genotype(t).alias("d"), Q.bullet_count(t).alias("b"),
    )
    rate = [F.round(F.avg(F.col(c).cast("double")), 9).alias(n) for c, n in (("a", "answerability"), ("s", "soup"), ("g", "good_rate"), ("j", "junk_rate"), ("d", "dna_rate"))]
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *rate, F.sum("b").alias("bullets"), F.median("a").alias("median_answerability"))


_RATIO_ENTS = ["TGF-B", "the", "und", "PD-L1"]
_ASKED = [t for _, t in QUESTIONS]


@query(rf"""WITH f AS (SELECT doc_id, text || ' ' || {_turn_text('doc_id', _ASKED)} AS t FROM documents), s AS (SELECT doc_id, {_pad('t')} AS padded, regexp_replace(lower(t), '\s+', '', 'g') AS compact FROM f)
SELECT doc_id, len(list_filter([{', '.join(map(repr, _RATIO_ENTS))}], lambda e: contains(padded, ' ' || regexp_replace(lower(e), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ') OR contains(compact, lower(replace(e, '-', ''))))) / {len(_RATIO_ENTS)}.0::DOUBLE AS ratio FROM s""")
def overlap_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The share of four entities that each document has, as words or without separators."""
    ents = F.array(*[F.lit(e) for e in _RATIO_ENTS])
    text = F.concat_ws(" ", "text", _turn(F.col("doc_id"), _ASKED))
    return docs(spark, sf).select("doc_id", S.entity_overlap(ents, text).alias("ratio"))


# What contexts say beside their prose, by turns.
EVIDENCE = [
    " Overall survival and PFS of patients in a phase III randomized trial.", " A xenograft mouse model in vivo, in vitro and a cell line.",
    " Adverse event of grade 3, pneumonitis and rash.", " KRAS mutation and EGFR in NSCLC; resistance to osimertinib.", " Colorectal cancer screening, crc.", "",
]


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, question and context, each with a sample of what the gates look for."""
    t = _turns(spark, sf)
    question = F.concat_ws(" ", folded(F.col("question")), _turn(F.col("conv_id"), _ASKED))
    context = F.concat(folded(F.col("context")), _turn(F.col("conv_id") + F.col("turn"), EVIDENCE))
    return t.select("conv_id", "turn", question.alias("question"), context.alias("context"))


_TURNS = f"""c AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
asked AS (SELECT conv_id, turn, {FOLD.format('text')} || ' ' || {_turn_text('conv_id', _ASKED)} AS question, {FOLD.format('reply')} || {_turn_text('(conv_id + turn)', EVIDENCE)} AS context FROM c WHERE role = 'user' AND next_role = 'assistant')"""


def _norm(t: str) -> str:
    return STRIP.format(_sub(f"lower({t})", chr(92) + "s+", " "))


def _strings(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


def _first(families: dict[str, list[str]], other: str, t: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(t, of)} THEN {_strings(of)}" for of in families.values()) + f" ELSE {other} END"


_NEEDS = rf"""list_filter(regexp_extract_all(question, '\b[A-Z0-9\-]{{2,}}\b'), lambda x: regexp_matches(x, '[A-Z]')) AS caps, {_first(A.LABEL_TERMS, '[]::VARCHAR[]', 'q')} AS labels,
{_first(A.INTENT_TERMS, _strings(A.INTENT_TERMS['biomarker']), 'q')} AS terms, {_first(A.INTENT_TERMS, _strings(A.DEFAULT_INTENT_TERMS), 'lower(question)')} AS loose"""
_HITS_IN = rf"len(list_filter({{of}}, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]+$') THEN contains(padded, ' ' || lower(x) || ' ') ELSE contains(blob, lower(x)) END))"
_KIND = f"""CASE WHEN cl >= 2 AND cl >= pre THEN 'clinical' WHEN pre >= 2 AND pre > cl THEN 'preclinical' ELSE 'unknown' END"""


def _n_of(parts: list[str], t: str) -> str:
    return "(" + " + ".join(f"contains({t}, {_q(p)})::INT" for p in parts) + ")"


_G = L.Generation()


def _share(n: str, of: str, cap: int, default: float) -> str:
    return f"CASE WHEN len({of}) > 0 THEN least(1.0, {n} / greatest(least(len({of}), {cap}), 1)::DOUBLE) ELSE {default} END"


_SCORED = f"""{_TURNS}, n AS (SELECT *, {_norm('question')} AS q, {_norm('context')} AS blob FROM asked), p AS (SELECT *, {_NEEDS}, {_pad('context')} AS padded FROM n),
e AS (SELECT *, list_filter(caps, lambda x, i: list_position(caps, x) = i)[1:10] AS ents, {_n_of(A.CLINICAL, 'blob')} AS cl, {_n_of(A.PRECLINICAL, 'blob')} AS pre FROM p),
k AS (SELECT *, {_KIND} AS kind, {_HITS_IN.format(of='ents')} AS he, {_HITS_IN.format(of='labels')} AS hl, {_HITS_IN.format(of='terms')} AS ht FROM e),
s AS (SELECT conv_id, turn, kind AS evidence_type, round({_G.entity_weight} * {_share('he', 'ents', 6, _G.entity_default)} + {_G.label_weight} * {_share('hl', 'labels', 4, _G.label_default)} + {_G.intent_weight} * {_share('ht', 'terms', 6, 0)}
 + CASE WHEN {_any('q', A.CLINICAL_NEED)} THEN CASE kind WHEN 'clinical' THEN {_G.clinical_match_bonus} WHEN 'preclinical' THEN {_G.clinical_mismatch_penalty} ELSE {_G.clinical_unknown_penalty} END ELSE 0 END
 + CASE WHEN {_any('q', A.AE_NEED)} THEN CASE WHEN {_any('blob', A.AE_SIGNS)} THEN {_G.ae_match_bonus} ELSE {_G.ae_mismatch_penalty} END ELSE 0 END, 6)::DOUBLE AS context_score FROM k)"""


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY context_score DESC, turn)::INT AS context_rank FROM s),
o AS (SELECT *, bool_or(context_score >= {_G.filter_min_score}) OVER (PARTITION BY conv_id) AS passed FROM r WHERE context_rank <= {_G.filter_keep})
SELECT conv_id, turn, context_score, evidence_type, context_rank FROM o WHERE CASE WHEN passed THEN context_score >= {_G.filter_min_score} ELSE context_rank <= {_G.filter_fallback} END""")
def score_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The contexts of every conversation that are kept, with their scores."""
    s = EV.score_contexts(asked(spark, sf), "question", "context").withColumn("context_score", F.round("context_score", 6))
    return EV.filter_contexts(s, "conv_id", "turn").select("conv_id", "turn", "context_score", "evidence_type", "context_rank")


@query(f"""WITH {_TURNS}, g AS (SELECT conv_id, arg_min(question, turn) AS question, list(context ORDER BY turn)[1:{_G.max_contexts}] AS ctx FROM asked GROUP BY 1),
j AS (SELECT *, array_to_string(ctx, chr(10) || chr(10)) AS context FROM g), n AS (SELECT *, {_norm('question')} AS q, {_norm('context')} AS blob FROM j), p AS (SELECT *, {_NEEDS}, {_pad('context')} AS padded FROM n),
e AS (SELECT *, list_filter(caps, lambda x, i: list_position(caps, x) = i)[1:8] AS ents, {_n_of(A.CLINICAL, 'blob')} AS cl, {_n_of(A.PRECLINICAL, 'blob')} AS pre FROM p),
k AS (SELECT *, {_KIND} AS kind, len(ents) = 0 OR {_HITS_IN.format(of='ents')} > 0 AS eok, len(labels) = 0 OR {_HITS_IN.format(of='labels')} > 0 AS lok, {_HITS_IN.format(of='loose')} > 0 AS iok FROM e),
d AS (SELECT *, CASE WHEN len(ctx) = 0 THEN 'no_context' WHEN {_any('q', A.AE_QUESTION)} AND NOT {_any('blob', A.AE_SIGNS)} THEN 'ae_missing' WHEN eok::INT + lok::INT + iok::INT < {_G.min_signals} THEN 'no_evidence'
 WHEN len(ents) > 0 AND NOT len(list_filter(ctx, lambda x: contains(lower(x), lower(ents[1])))) > 0 THEN 'no_entity' WHEN {_any('lower(question)', A.CLINICAL_NEED)} AND kind = 'preclinical' THEN 'preclinical_only' ELSE 'answer' END AS decision FROM k),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT eok THEN 'the key entity/entities' END, CASE WHEN NOT lok THEN 'the expected cancer context' END, CASE WHEN NOT iok THEN 'the key outcome/intent' END], lambda x: x IS NOT NULL), '; ') AS what FROM d)
SELECT conv_id, decision, CASE decision WHEN 'no_context' THEN {_q(A.NO_PASSAGES)} WHEN 'no_evidence' THEN 'Insufficient context: the retrieved passages do not contain ' || what || '.' WHEN 'no_entity' THEN 'Insufficient context: retrieved passages do not contain specific information about ' || ents[1] || '.' END AS message FROM w""")
def answer_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What may be answered from each conversation's first contexts, in the order of its turns."""
    t = asked(spark, sf).groupBy("conv_id").agg(
        F.min_by("question", "turn").alias("question"), F.array_sort(F.collect_list(F.struct("turn", "context"))).alias("c")
    )
    t = t.withColumn("contexts", F.transform("c", lambda x: x["context"]))
    return EV.answer_gate(t, "question", "contexts").select("conv_id", "decision", "message")


@query(f"""WITH a AS (SELECT doc_id, {CLEAN} AS text FROM (SELECT doc_id, {FOLD.format('text')} AS text FROM documents)), b AS (SELECT doc_id, text, {FIX1} AS t FROM a WHERE length(text) >= 200),
k AS (SELECT doc_id, text, {FP} AS fingerprint FROM b WHERE ({PASS1}) = 'kept')
SELECT fingerprint, arg_min(length(text), doc_id)::INT AS n_chars, min(doc_id) AS doc_id FROM k GROUP BY 1""")
def ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of incremental ingest: clean, filter and drop repeats."""
    rows = docs(spark, sf).select("doc_id", folded(F.col("text")).alias("text"), F.timestamp_seconds("doc_id").alias("at"))
    return ingest_stream(rows, "text", "at").select("fingerprint", F.length("clean_text").alias("n_chars"), "doc_id")


@query(rf"""SELECT doc_id, md5({STRIP.format('text')}) AS body_md5, md5(array_to_string(regexp_extract_all(text, '\S+')[-5:], ' ')) AS last_md5,
md5('CancerType: ' || lang || chr(10) || 'Section: ' || source || chr(10) || text) AS tagged_md5, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN regexp_matches({FOLD.format('text')} || {_turn_text('doc_id', EVIDENCE)}, '(?i){L.RESISTANCE_EVIDENCE}') THEN 0.35 ELSE -0.25 END ELSE 0 END::DOUBLE AS bonus FROM documents""")
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """A body without its header, the last words, the tagged form for embedding and the bonus for an intent's evidence."""
    header = F.format_string("[Cancer: %s | Section: %s | Paper: %d]\nKey idea: it holds\n---\n", "lang", "source", "doc_id")
    intent = F.when(F.col("doc_id") % 2 == 0, "resistance").otherwise("general")
    evidence = F.concat(folded(F.col("text")), _turn(F.col("doc_id"), EVIDENCE))
    return docs(spark, sf).select(
        "doc_id",
        F.md5(T.strip_header(F.concat(header, F.col("text"))).cast("binary")).alias("body_md5"),
        F.md5(T.take_last_tokens(F.col("text"), 5).cast("binary")).alias("last_md5"),
        F.md5(T.tag_injection(F.col("lang"), F.col("source"), F.col("text"), True).cast("binary")).alias("tagged_md5"),
        S.intent_evidence(intent, evidence).alias("bonus"),
    )


@query("SELECT conv_id, bool_and(" + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS["en"]) + ") AS consistent FROM conversations GROUP BY 1")
def consistent_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every turn of a conversation mentions the label."""
    c = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    return c.select("conv_id", X.mentions_all(F.col("texts"), WORDS["en"]).alias("consistent"))


@query(f"SELECT count(*) AS texts, sum({N_WORDS})::BIGINT AS tokens, sum({N_WORDS}) * 0.13 / 1e6 AS cost FROM documents")
def embedding_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What it would cost to embed all documents."""
    return embedding_cost(docs(spark, sf).select(T.count_tokens(F.col("text")).cast("long").alias("n")), "n")


_DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as CSV and read back with two of their columns."""
    path = table_path(spark, "csv")
    io.write_csv(docs(spark, sf).select("doc_id", "text", "lang"), path)
    back = io.require_columns(io.read_csv(spark, path, _DOCUMENT, ["doc_id", "text"]), "doc_id", "text")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as JSON lines and read back."""
    path = table_path(spark, "jsonl")
    io.write_jsonl(docs(spark, sf).select("doc_id", "text", "lang"), path)
    return io.read_jsonl(spark, path, _DOCUMENT).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE doc_id % 7 = 0) AS bad_json, count(*) FILTER (WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR trim(text) = '')) AS empty_text, count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND trim(text) <> '') AS kept FROM documents")
def jsonl_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, unreadable ones, ones without text and the kept ones of a file that has all of them; blank lines between."""
    path = table_path(spark, "jsonl")
    d = docs(spark, sf).withColumn("body", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")))
    line = F.to_json(F.struct("doc_id", F.lit("").alias("text"), F.col("body").alias("content")))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{bad "), line)).otherwise(line)
    d.select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("content", StringType())])
    return io.read_jsonl_counted(spark, path, schema, ["text", "content"])[1]


@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1")
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as one JSON file and read back."""
    path = table_path(spark, "report")
    io.write_report(docs(spark, sf).groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("label string, n long").option("multiLine", True).json(path)
