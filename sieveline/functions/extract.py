"""Entities, labels, intents and needs read off a query or a text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import lexicon as L
from sieveline import rx
from sieveline.functions.text import contains_any, empty


def _genes(col: Column, pattern: str = L.GENE) -> Column:
    stop = F.array(*[F.lit(x) for x in L.GENE_STOP])
    return F.filter(rx.find_all(col, pattern), lambda g: ~F.array_contains(stop, g) & (F.length(g) >= 2))


def _family(col: Column, pattern: str, case) -> Column:  # noqa: ANN001
    return F.transform(rx.find_all(col, pattern, "i"), case)


def entities(col: Column) -> Column:
    """Sorted distinct entities of all families; drugs in lower case, the rest in capitals."""
    t = empty(col)
    upper = (L.ENDPOINT, L.CHECKPOINT, L.PATHWAY, L.CELL_LINE, L.DIAGNOSTIC, L.IMAGING)
    parts = [_family(t, p, F.upper) for p in upper]
    return F.array_sort(F.array_distinct(F.concat(*parts, _family(t, L.DRUG, F.lower), _genes(t))))


def highsignal_entities(col: Column) -> Column:
    t = empty(col)
    parts = [_family(t, L.CHECKPOINT, F.upper), _family(t, L.PATHWAY, F.upper), _family(t, L.DRUG, F.lower)]
    return F.array_sort(F.array_distinct(F.concat(*parts, _genes(t))))


def loose_entities(col: Column) -> Column:
    """The evaluation's variant: genes are looked for in the upper-cased text, so most short words count."""
    t = empty(col)
    parts = [_family(t, L.CHECKPOINT, F.upper), _family(t, L.PATHWAY, F.upper), _family(t, L.DRUG, F.lower)]
    return F.array_sort(F.array_distinct(F.concat(*parts, _genes(F.upper(t), L.GENE_LOOSE))))


def detect_label(col: Column, patterns: dict[str, str] | None = None) -> Column:
    """The first label, in the lexicon's order, of which a pattern is found; else empty."""
    found = F.lit("")
    for label, pattern in reversed((patterns or L.LABEL_PATTERNS).items()):
        found = F.when(rx.has(empty(col), pattern, "i"), F.lit(label)).otherwise(found)
    return found


def infer_intent(col: Column) -> Column:
    """The first intent whose pattern is found; ``general`` if none is."""
    found = F.lit("general")
    for intent, pattern in reversed(L.INTENTS.items()):
        found = F.when(rx.has(F.lower(empty(col)), pattern, "i"), F.lit(intent)).otherwise(found)
    return found


def section_bonus(intent: Column, section: Column) -> Column:
    name = F.upper(rx.text_or_empty(section, F.lit("UNKNOWN")))
    pairs = {f"{i}|{s}": v for i, of in L.SECTION_BIAS.items() for s, v in of.items()}
    bias = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    penalty = F.create_map(*[F.lit(x) for kv in L.SECTION_PENALTY.items() for x in kv])
    plus = F.coalesce(F.try_element_at(bias, F.concat_ws("|", intent, name)), F.lit(0.0))
    return plus + F.coalesce(F.try_element_at(penalty, name), F.lit(0.0))


def wants_citations(query: Column, intent: Column) -> Column:
    return rx.has(empty(query), L.CITATION_QUERY, "i") | (intent == "citations")


def question_entities(col: Column, n: int = 8) -> Column:
    """Capital tokens with a letter, the first ``n`` distinct ones."""
    found = F.filter(rx.find_all(empty(col), r"\b[A-Z0-9\-]{2,}\b"), lambda x: x.rlike("[A-Z]"))
    return F.slice(F.array_distinct(found), 1, n)


def needs(col: Column, parts: list[str]) -> Column:
    """Whether any of the substrings stands in the lower-cased text."""
    return contains_any(F.lower(empty(col)), parts)


def mentions_all(texts: Column, keywords: list[str]) -> Column:
    """Whether every text of an array mentions one of the keywords."""
    return F.forall(texts, lambda t: contains_any(F.lower(empty(t)), keywords))


def first_family(col: Column, families: dict[str, list[str]], default: str) -> Column:
    """The first family of which a term is a substring."""
    low = F.lower(empty(col))
    found = F.lit(default)
    for name, terms in reversed(families.items()):
        found = F.when(contains_any(low, terms), F.lit(name)).otherwise(found)
    return found


def entity_in_text(entity: Column, text: Column) -> Column:
    """Whether the entity stands in the text between word borders, whatever its case."""
    return F.regexp_like(empty(text), F.concat(F.lit(r"(?iuU)\b\Q"), entity, F.lit(r"\E\b")))
