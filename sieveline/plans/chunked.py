"""Queries on the chunker, with SQL that packs by recursion over numbers.

The SQL knows nothing of the operator's state machine.  It finds the borders of paragraphs, packs and repaired chunks
from token counts alone, and puts the texts together afterwards.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline.operators.chunk import chunk_papers
from sieveline.plans.queries import STRIP, docs, query
from sieveline.session import staged

_C = L.Chunking()
# Headings, tables and a section to be left out, put around texts by turns.
_TURNS = [("", ""), ("ABSTRACT\n", "\n\nResults:\n{}\nFUNDING\nPaid by them.\n\nDISCUSSION -\n{}"), ("Table 3 of it\n", "\n1 2 3 4 5 6 7 8 9 \n| a | b | c |\n------\n\n{}")]


def _with_sections(spark: SparkSession, sf: str) -> DataFrame:
    text, i = F.col("text"), F.pmod(F.col("doc_id"), F.lit(len(_TURNS)))
    made = text
    for k, (head, tail) in enumerate(_TURNS):
        parts: list = [F.lit(head), text]
        for piece in re.split(r"(\{\})", tail):
            parts.append(text if piece == "{}" else F.lit(piece))
        made = F.when(i == k, F.concat(*parts)).otherwise(made)
    return docs(spark, sf).select(F.format_string("paper_%06d", "doc_id").alias("paper_id"), "lang", made.alias("text"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case() -> str:
    whens = []
    for k, (head, tail) in enumerate(_TURNS):
        parts = [_quoted(head), "text"] + ["text" if p == "{}" else _quoted(p) for p in re.split(r"(\{\})", tail)]
        whens.append(f"WHEN {k} THEN {' || '.join(parts)}")
    return f"CASE doc_id % {len(_TURNS)} {' '.join(whens)} END"


def _n(t: str) -> str:
    """Tokens of a text that is not empty."""
    return rf"greatest(1, len(regexp_extract_all({t}, '\S+')))"


_NL, _CUT = "chr(10)", "chr(1)"
_HEADS = "|".join(sorted((re.escape(h).replace(r"\ ", " ") for h in L.CHUNK_HEADINGS), key=len, reverse=True))
_IS_HEAD = rf"regexp_matches(x, '(?i)^(?:{_HEADS})\b[\s:.\-–—]*$')"
_DROPPED = f"regexp_matches({STRIP.format('x')}, {_quoted(L.TABLEISH_LINE)}) OR " + " OR ".join(
    f"regexp_matches(x, {_quoted(p)})" for p in (L.PIPE_TABLE, L.REPEATED_SEPARATOR, L.MANY_NUMBERS)
)


def _listed(source: str, keys: str, order: str, *columns: str) -> str:
    lists = ", ".join(f"list({c} ORDER BY {order}) AS {c}s" for c in columns)
    return f"SELECT {keys}, {lists} FROM {source} GROUP BY {keys}"


#: Common table expressions that end in ``chunks``.
CHUNKS = rf"""RECURSIVE src AS (SELECT doc_id, lang, {_case()} AS t FROM documents),
ln AS (SELECT doc_id, lang, list_transform(list_filter(string_split(t, {_NL}), lambda x: {STRIP.format('x')} = '' OR NOT ({_DROPPED})), lambda x: CASE WHEN {STRIP.format('x')} = '' THEN '' ELSE x END) AS lines FROM src),
free AS (SELECT doc_id, lang, {STRIP.format(f"regexp_replace(array_to_string(lines, {_NL}), chr(10) || '{{3,}}', {_NL} || {_NL}, 'g')")} AS t FROM ln),
fl AS (SELECT doc_id, unnest(string_split(t, {_NL})) AS x, generate_subscripts(string_split(t, {_NL}), 1) AS i FROM free),
mk AS (SELECT *, {_IS_HEAD} AS head, sum(({_IS_HEAD})::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s, sum(({_IS_HEAD})::INT) OVER (PARTITION BY doc_id) AS heads FROM fl),
sb AS (SELECT doc_id, s, any_value(upper({STRIP.format(r"regexp_replace(x, '[\s:.\-–—]+$', '')")})) FILTER (WHERE head) AS name, {STRIP.format(f"coalesce(string_agg(x, {_NL} ORDER BY i) FILTER (WHERE NOT head), '')")} AS body FROM mk WHERE heads >= 2 AND s >= 1 GROUP BY 1, 2),
sk AS (SELECT * FROM sb WHERE name NOT IN ({', '.join(map(_quoted, L.SKIP_SECTIONS))}) AND body <> '' AND {_n('body')} >= {_C.min_section}),
sec AS (SELECT doc_id, s, name AS section, body FROM sk UNION ALL SELECT doc_id, 0, 'UNKNOWN', t FROM free WHERE doc_id NOT IN (SELECT doc_id FROM sk)),
px AS (SELECT doc_id, s, section, list_filter(list_transform(string_split(regexp_replace(body, '\n\s*\n+', {_CUT}, 'g'), {_CUT}), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ps FROM sec),
pm AS (SELECT doc_id, s, section, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM px),
pn AS (SELECT *, {_n('p')} AS n FROM pm),
pl AS ({_listed('pn', 'doc_id, s', 'i', 'n')}),
pr AS (SELECT doc_id, s, ns, 1 AS i, ns[1] AS held, 1 AS fresh FROM pl UNION ALL
  SELECT doc_id, s, ns, i + 1, CASE WHEN held >= {_C.min_paragraph} THEN ns[i + 1] ELSE held + ns[i + 1] END, (held >= {_C.min_paragraph})::INT FROM pr WHERE i < len(ns)),
pg AS (SELECT doc_id, s, i, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY i) AS u FROM pr),
un AS (SELECT doc_id, s, section, u, string_agg(p, {_NL} ORDER BY i) AS t FROM pn JOIN pg USING (doc_id, s, i) GROUP BY ALL),
ut AS (SELECT *, {_n('t')} AS n FROM un),
st AS (SELECT doc_id, s, section, u, list_filter(list_transform(string_split(regexp_replace(t, '([.?!])\s+([A-Z0-9])', '\1' || {_CUT} || '\2', 'g'), {_CUT}), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ts FROM ut WHERE n > {_C.target}),
su AS (SELECT doc_id, s, section, u, unnest(ts) AS t, generate_subscripts(ts, 1) AS v FROM st),
sx AS (SELECT *, {_n('t')} AS n, regexp_extract_all(t, '\S+') AS w FROM su),
wx AS (SELECT doc_id, s, section, u, v, k, array_to_string(w[k * {_C.target} + 1:(k + 1) * {_C.target}], ' ') AS t FROM (SELECT *, unnest(range((n + {_C.target - 1}) // {_C.target})) AS k FROM sx WHERE n > {_C.target})),
atoms AS (SELECT doc_id, s, section, u, 0 AS v, 0 AS k, t, n, 0 AS kind FROM ut WHERE n <= {_C.target} UNION ALL SELECT doc_id, s, section, u, v, 0, t, n, 1 FROM sx WHERE n <= {_C.target}
  UNION ALL SELECT doc_id, s, section, u, v, k, t, {_n('t')}, 2 FROM wx),
an AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, u, v, k) AS i FROM atoms),
al AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR kind = 2 OR lag(kind) OVER w <> kind OR lag(s) OVER w <> s OR (kind = 1 AND lag(u) OVER w <> u) THEN 1 ELSE 0 END AS brk FROM an WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
aa AS ({_listed('al', 'doc_id', 'i', 'n', 'brk')}),
ar AS (SELECT doc_id, ns, brks, 1 AS i, ns[1] AS cur, 1 AS fresh FROM aa UNION ALL
  SELECT doc_id, ns, brks, i + 1, CASE WHEN brks[i + 1] = 1 OR cur + ns[i + 1] > {_C.target} THEN ns[i + 1] ELSE cur + ns[i + 1] END, (brks[i + 1] = 1 OR cur + ns[i + 1] > {_C.target})::INT FROM ar WHERE i < len(ns)),
ag AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ar),
em AS (SELECT doc_id, s, section, e, string_agg(t, {_NL} || {_NL} ORDER BY i) AS t FROM al JOIN ag USING (doc_id, i) GROUP BY ALL),
en AS (SELECT *, {_n('t')} AS n, CASE WHEN lag(section) OVER w = section AND {_n('t')} < {_C.min_chunk} THEN 0 ELSE 1 END AS fresh FROM em WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
eg AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY e) - 1 AS c FROM en),
pc AS (SELECT doc_id, c, any_value(section) AS section, string_agg(t, {_NL} || {_NL} ORDER BY e) AS raw FROM eg GROUP BY 1, 2),
pv AS (SELECT *, regexp_extract_all(lag(raw) OVER (PARTITION BY doc_id ORDER BY c), '\S+')[-{_C.overlap}:] AS tw FROM pc),
pt AS (SELECT *, array_to_string(tw, ' ') AS tail FROM pv),
pj AS (SELECT *, {STRIP.format(f"tail || {_NL} || {_NL} || raw")} AS joined FROM pt),
po AS (SELECT *, tail IS NOT NULL AND tail <> '' AND NOT regexp_matches(joined, '^[,;:)\]]|^[a-z]|^’|^"') AND joined <> raw AS lap FROM pj),
pp AS (SELECT doc_id, c, section, raw, coalesce(lap, false) AS lap, CASE WHEN lap THEN joined ELSE raw END AS t, {_n('raw')} AS nr FROM po),
pq AS (SELECT *, {_n('t')} AS n FROM pp),
rl AS ({_listed('pq', 'doc_id', 'c', 'n', 'section')}),
rr AS (SELECT doc_id, ns, sections, 0 AS i, 0 AS carry, -1 AS own, 0 AS own_n, '' AS own_s, '' AS act FROM rl UNION ALL
  SELECT doc_id, ns, sections, i + 1, CASE WHEN act2 = 'forward' THEN m ELSE 0 END, CASE WHEN act2 = 'stand' THEN i ELSE own END, CASE act2 WHEN 'stand' THEN m WHEN 'back' THEN own_n + m ELSE own_n END, CASE WHEN act2 = 'stand' THEN sections[i + 1] ELSE own_s END, act2
  FROM (SELECT *, carry + ns[i + 1] AS m, CASE WHEN carry + ns[i + 1] >= {_C.min_final} THEN 'stand' WHEN own >= 0 AND own_s = sections[i + 1] AND own_n + carry + ns[i + 1] <= {_C.max_final + _C.slack} THEN 'back'
    WHEN i + 2 <= len(ns) AND carry + ns[i + 1] + ns[i + 2] <= {_C.max_final + _C.slack} THEN 'forward' ELSE 'stand' END AS act2 FROM rr WHERE i < len(ns))),
rg AS (SELECT doc_id, i - 1 AS c, act, own, min(CASE WHEN act <> 'forward' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at FROM rr WHERE i > 0),
ro AS (SELECT a.doc_id, a.c, b.own FROM rg a JOIN rg b ON a.doc_id = b.doc_id AND b.c = a.at - 1),
ch AS (SELECT doc_id, own AS c, string_agg(t, {_NL} || {_NL} ORDER BY c) AS t FROM pq JOIN ro USING (doc_id, c) GROUP BY ALL),
chunks AS (SELECT doc_id, c, ch.t, {_n('ch.t')} AS n, section, lap, nr FROM ch JOIN pq USING (doc_id, c))"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_papers(_with_sections(spark, sf), "paper_id", "lang", "text")


@query(rf"""WITH {CHUNKS} SELECT printf('paper_%06d::c%04d', doc_id, c::BIGINT) AS chunk_id, printf('paper_%06d', doc_id) AS paper_id, section, c::INT AS chunk_index, n::INT AS n_tokens, nr::INT AS n_tokens_raw,
CASE WHEN lap THEN {_C.overlap} ELSE 0 END AS overlap_tokens, md5(t) AS text_md5 FROM chunks""")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of all documents, with sections and tables in two thirds of them."""
    names = ("chunk_id", "paper_id", "section", "chunk_index", "n_tokens", "n_tokens_raw", "overlap_tokens")
    return _chunks(spark, sf).select(*names, F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {CHUNKS}, per AS (SELECT doc_id, count(*) AS m, sum(n) AS t FROM chunks GROUP BY 1), a AS (SELECT count(*) AS papers, sum(m)::BIGINT AS chunks, round(avg(m), 9) AS mean_chunks, max(m) AS most_chunks FROM per),
b AS (SELECT round(avg(n), 9) AS mean_tokens, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.99)::DOUBLE AS p99 FROM chunks) SELECT * FROM a, b""")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks for each document and their sizes."""
    c = staged(_chunks(spark, sf).select("paper_id", "n_tokens"), "chunk-sizes")
    p = [F.percentile("n_tokens", q).alias(a) for q, a in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    per = c.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).agg(
        F.count(F.lit(1)).alias("papers"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 9).alias("mean_chunks"), F.max("n").alias("most_chunks")
    )
    return per.crossJoin(F.broadcast(c.agg(F.round(F.avg("n_tokens"), 9).alias("mean_tokens"), *p)))  # one row each

