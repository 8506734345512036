"""All named queries and their SQL: importing a module of queries registers them."""

from __future__ import annotations

from sieveline.plans import chunked, cleaned, ranked
from sieveline.plans.queries import QUERIES, SQL, hybrid_minimum

__all__ = ["QUERIES", "SQL", "chunked", "cleaned", "hybrid_minimum", "ranked"]
