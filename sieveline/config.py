"""Settings from a YAML file, with dot access; sections override the defaults of ``lexicon``'s parameter classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, replace
from typing import Any, TypeVar

from sieveline import lexicon as L

Settings = TypeVar("Settings", L.Retrieval, L.Chunking, L.Agent, L.Generation)

# Names of settings in files that differ from the parameter classes' own.
ALIASES = {
    "cancer_generic_penalty": "generic_penalty", "cancer_present_per_hit": "present_per_hit", "cancer_present_cap": "present_cap",
    "cancer_absent_strong_penalty": "absent_strong_penalty", "cancer_absent_weak_penalty": "absent_weak_penalty",
    "chunk_size_tokens": "target", "chunk_overlap_tokens": "overlap", "pubmed_max_results": "max_external",
    "pubmed_abstract_chars": "abstract_chars", "primary_entity_min_len": "entity_min_len", "entity_score_weight": "entity_weight",
    "cancer_score_weight": "label_weight", "intent_score_weight": "intent_weight", "entity_score_default": "entity_default",
    "cancer_score_default": "label_default", "context_filter_min_score": "filter_min_score", "context_filter_keep_k": "filter_keep",
    "context_filter_fallback_k": "filter_fallback", "evidence_min_signals": "min_signals",
}


class Section:
    """A mapping read by attribute or by key; inner mappings are sections too."""

    def __init__(self, values: dict[str, Any]) -> None:
        self._values = values

    def __getitem__(self, key: str) -> Any:
        found = self._values[key]
        return Section(found) if isinstance(found, dict) else found

    def __getattr__(self, key: str) -> Any:
        if key.startswith("__") or key not in self._values:
            raise AttributeError(f"no setting {key!r}; there are: {', '.join(self._values)}")
        return self[key]

    def __contains__(self, key: object) -> bool:
        return key in self._values

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)


def load(path: str) -> Section:
    """The settings of a YAML file; an empty file has none."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path}: settings are a mapping, not {type(found).__name__}")
    return Section(found or {})


def apply(section: Section, default: Settings) -> Settings:
    """``default`` with the section's settings in place of its own; settings that it does not know are left out."""
    known = {f.name for f in fields(default)}
    named = {ALIASES.get(k, k): section[k] for k in section}
    return replace(default, **{k: v for k, v in named.items() if k in known})
