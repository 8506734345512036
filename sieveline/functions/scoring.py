"""Evidence, penalties and the fused score of ranked retrieval, as Column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline import rx
from sieveline.functions.text import contains_any, empty, normalize, normalize_for_match

R = L.Retrieval()


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def text_forms(text: Column) -> Column:
    """What the evidence of a text is read from: in lower case, the same without white space, and with ``/`` and ``-`` as
    spaces."""
    raw = empty(text)
    return F.struct(F.lower(raw).alias("low"), rx.squeeze(F.lower(raw), "").alias("compact"), normalize_for_match(raw).alias("norm"))


def entity_bonus(ents: Column, text: Column, r: L.Retrieval = R) -> Column:
    return entity_bonus_in(ents, F.lower(empty(text)), r)


def entity_bonus_in(ents: Column, low: Column, r: L.Retrieval = R) -> Column:
    hits = F.size(F.filter(ents, lambda e: F.contains(low, F.lower(e))))
    return F.when(low == "", 0.0).otherwise(F.least(F.lit(r.entity_bonus_cap), hits * r.entity_bonus_per_hit))


def mismatch_penalty(label: Column, text: Column, keywords: dict[str, list[str]] | None = None, r: L.Retrieval = R) -> Column:
    """For a text without the label's keywords and with several of another label's."""
    return rx.let(F.lower(empty(text)), lambda low: mismatch_in(label, low, keywords, r))


def mismatch_in(label: Column, low: Column, keywords: dict[str, list[str]] | None = None, r: L.Retrieval = R) -> Column:
    words = keywords or L.LABEL_KEYWORDS
    hits = {k: _sum([F.contains(low, F.lit(w)).cast("int") for w in v]) for k, v in words.items()}
    own = reduce(lambda a, kv: F.when(label == kv[0], kv[1]).otherwise(a), hits.items(), F.lit(0))
    best = F.greatest(F.lit(0), F.lit(0), *[F.when(label == k, 0).otherwise(n) for k, n in hits.items()])
    found = F.when(best >= 4, r.mismatch_strong_penalty).when(best >= 2, r.mismatch_weak_penalty).otherwise(0.0)
    return F.when((empty(label) == "") | (low == "") | (own > 0), 0.0).otherwise(found)


def count_terms(text: Column, terms: list[str]) -> Column:
    """Terms that are substrings, with or (for short ones) without white space."""
    both = rx.let(F.lower(empty(text)), lambda t: F.struct(t.alias("low"), rx.squeeze(t, "").alias("compact")))
    return rx.let(both, lambda s: _terms_in(s["low"], s["compact"], terms))


def _terms_in(low: Column, compact: Column, terms: list[str]) -> Column:
    parts = []
    for term in terms:
        hit = F.contains(low, F.lit(term.lower()))
        tight = re.sub(r"\s+", "", term.lower())
        if 2 <= len(tight) <= 12:
            hit = hit | F.contains(compact, F.lit(tight))
        parts.append(hit.cast("int"))
    return _sum(parts)


def must_mention(label: Column, text: Column, terms: dict | None = None, r: L.Retrieval = R) -> Column:
    """Struct of penalty, reason and req_hits; it penalises and never drops."""
    return rx.let(text_forms(text), lambda forms: must_mention_in(label, forms, terms, r))


def must_mention_in(label: Column, forms: Column, terms: dict | None = None, r: L.Retrieval = R) -> Column:
    spec = terms or L.LABEL_TERMS
    none = F.struct(F.lit(0.0).alias("penalty"), F.lit("no requested label").alias("reason"), F.lit(0).alias("req_hits"))
    out = none
    for name, of in spec.items():
        counts = F.struct(*[_terms_in(forms["low"], forms["compact"], of[k]).alias(a) for k, a in (("must", "req"), ("anti", "anti"))])
        out = F.when(label == name, rx.let(counts, lambda c: _must(c["req"], c["anti"], r))).otherwise(out)
    return out


def _must(req: Column, anti: Column, r: L.Retrieval) -> Column:
    penalty = (
        F.when(req > 0, 0.0)
        .when(anti >= 2, r.must_strong_other_penalty)
        .when(anti == 1, r.must_weak_other_penalty)
        .otherwise(r.must_generic_penalty)
    )
    reason = F.when(req > 0, "own").when(anti >= 2, "strong other").when(anti == 1, "weak other").otherwise("generic")
    return F.struct(penalty.alias("penalty"), reason.alias("reason"), req.alias("req_hits"))


def count_terms_nonoverlap(text: Column, terms: list[str]) -> Column:
    """Whole terms, longest first; a term's first place is blanked before the next is looked for."""
    wanted = {" ".join(t.lower().split()) for t in terms if t}
    ordered = F.array(*[F.lit(t) for t in sorted(wanted, key=lambda x: (-len(x), x))])
    start = F.struct(normalize(text).alias("t"), F.lit(0).alias("n"))

    def step(s: Column, term: Column) -> Column:
        pattern = F.concat(F.lit(r"(?sU)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)(.*)"))
        hit = F.regexp_like(s["t"], pattern)
        blank = F.regexp_replace(s["t"], pattern, F.concat(F.repeat(F.lit(" "), F.length(term)), F.lit("$1")))
        return F.when(hit, F.struct(blank.alias("t"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.aggregate(ordered, start, step, lambda s: s["n"])


def evidence_scores(text: Column, terms: dict | None = None) -> Column:
    """Map from label to its terms' count."""
    spec = terms or L.LABEL_TERMS
    return F.create_map(*[x for k, of in spec.items() for x in (F.lit(k), count_terms_nonoverlap(text, of["must"]))])


def evidence_adjust(label: Column, scores: Column, r: L.Retrieval = R) -> Column:
    """The bonus or penalty for the requested label's evidence."""
    best = F.coalesce(F.array_max(F.map_values(scores)), F.lit(0))
    own = F.coalesce(F.try_element_at(scores, label), F.lit(0))
    found = (
        F.when(best == 0, r.generic_penalty)
        .when(own > 0, F.least(F.lit(r.present_cap), own * r.present_per_hit))
        .when(best - own >= 2, r.absent_strong_penalty)
        .otherwise(r.absent_weak_penalty)
    )
    return F.when(empty(label) == "", 0.0).otherwise(found)


def label_gate(label: Column, scores: Column) -> Column:
    """False for a text with no evidence of the requested label and some of another."""
    best = F.coalesce(F.array_max(F.map_values(scores)), F.lit(0))
    own = F.coalesce(F.try_element_at(scores, label), F.lit(0))
    return (empty(label) == "") | ~((own == 0) & (best >= 1))


def entity_overlap(ents: Column, text: Column) -> Column:
    """Share of the entities that the text has, as words or (short ones) without separators.

    Both are compared in lower case, letter by letter: ``ss`` is not found in ``ß``, whose capital form has two letters.
    """
    return rx.let(text_forms(text), lambda forms: overlap_in(ents, forms))


def overlap_in(ents: Column, forms: Column) -> Column:
    def found(e: Column) -> Column:
        # The words are looked for as they are first: few texts have them, and a pattern made for each row is slow.
        name = normalize_for_match(e)
        word = F.regexp_like(forms["norm"], F.concat(F.lit(r"(?iuU)\b\Q"), name, F.lit(r"\E\b")))
        short = F.regexp_replace(F.lower(e), r"[\s\-_/]+", "")
        compact = F.length(short).between(2, 12) & F.contains(forms["compact"], short)
        return compact | (F.contains(forms["norm"], name) & word)

    n = F.size(ents)
    return F.when(n > 0, F.size(F.filter(ents, found)) / n.cast("double")).otherwise(0.0)


def intent_evidence(intent: Column, text: Column) -> Column:
    found = F.when(rx.has(empty(text), L.RESISTANCE_EVIDENCE, "i"), 0.35).otherwise(-0.25)
    return F.when(intent == "resistance", found).otherwise(0.0)


def bm25_weight(ents: Column, r: L.Retrieval = R) -> Column:
    return F.when(F.size(ents) > 0, r.bm25_weight_with_entities).otherwise(r.bm25_weight_no_entities)


def fused_score(
    dense: Column, bm25: Column, weight: Column, section: Column, bonus: Column, delta: Column, mismatch: Column,
    must: Column, overlap: Column, n_entities: Column, is_reference: Column, citations: Column, in_references: Column,
    r: L.Retrieval = R,
) -> Column:
    """The sum of all parts: dense + sparse + section + entities + label evidence - penalties."""
    rerank = F.when(
        (n_entities >= r.rerank_min_entities) & (overlap > 0), r.rerank_weight * F.pow(overlap, F.lit(1.5))
    ).otherwise(0.0)
    own = F.least(F.lit(r.req_hits_bonus_cap), must["req_hits"] * r.req_hits_bonus_per_hit)
    cited = F.when(in_references, r.reference_section_penalty).otherwise(0.0) + F.when(
        is_reference, r.reference_flag_penalty
    ).otherwise(0.0)
    return (
        dense + weight * (bm25 / r.bm25_div) + section + bonus + delta - mismatch - must["penalty"] + own + rerank
        - F.when(citations, 0.0).otherwise(cited)
    )


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rx.let(norm, lambda n: F.transform(vector, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def inner_product(a: Column, b: Column) -> Column:
    """Summed as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def context_signals(text: Column, ents: Column, labels: Column, terms: Column) -> Column:
    """Struct of hit counts of entities, label terms and intent terms in a context."""
    low = F.lower(empty(text))

    def hits(of: Column) -> Column:
        def one(t: Column) -> Column:
            word = F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), F.lower(t), F.lit(r"\E\b")))
            return F.when(t.rlike("^[A-Za-z]+$"), word).otherwise(F.contains(low, F.lower(t)))

        return F.size(F.filter(of, one))

    return F.struct(hits(ents).alias("entities"), hits(labels).alias("labels"), hits(terms).alias("terms"))


def evidence_type(text: Column, clinical: list[str], preclinical: list[str]) -> Column:
    low = F.lower(empty(text))
    c = _sum([F.contains(low, F.lit(x)).cast("int") for x in clinical])
    p = _sum([F.contains(low, F.lit(x)).cast("int") for x in preclinical])
    return F.when((c >= 2) & (c >= p), "clinical").when((p >= 2) & (p > c), "preclinical").otherwise("unknown")


def context_score(
    signals: Column, ents: Column, labels: Column, terms: Column, kind: Column, wants_clinical: Column, wants_ae: Column,
    has_ae: Column, g: L.Generation | None = None,
) -> Column:
    g = g or L.Generation()

    def share(n: Column, of: Column, cap: int, default: float | None) -> Column:
        size = F.least(F.size(of), F.lit(cap)).cast("double")
        part = F.least(F.lit(1.0), n / F.greatest(size, F.lit(1.0)))
        return F.when(F.size(of) > 0, part).otherwise(0.0 if default is None else default)

    clinical = F.when(
        wants_clinical,
        F.when(kind == "clinical", g.clinical_match_bonus)
        .when(kind == "preclinical", g.clinical_mismatch_penalty)
        .otherwise(g.clinical_unknown_penalty),
    ).otherwise(0.0)
    ae = F.when(wants_ae, F.when(has_ae, g.ae_match_bonus).otherwise(g.ae_mismatch_penalty)).otherwise(0.0)
    return (
        g.entity_weight * share(signals["entities"], ents, 6, g.entity_default)
        + g.label_weight * share(signals["labels"], labels, 4, g.label_default)
        + g.intent_weight * share(signals["terms"], terms, 6, None)
        + clinical
        + ae
    )


def evidence_pass(signals: Column, ents: Column, labels: Column, terms: Column, min_signals: int = 2) -> Column:
    """At least ``min_signals`` of entity, label and intent evidence; an absent criterion counts as met."""
    met = [
        ((F.size(of) == 0) | (signals[name] > 0)).cast("int")
        for name, of in (("entities", ents), ("labels", labels), ("terms", terms))
    ]
    return _sum(met) >= min_signals


