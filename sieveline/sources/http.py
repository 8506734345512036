"""A literature search service over HTTP, as an outside source of the question flow.

A failed or slow call gives no articles, so that a question is still answered from the corpus.
"""

from __future__ import annotations

import json
import logging
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession

from sieveline.sources.articles import articles

SEARCH_SECONDS, FETCH_SECONDS = 10, 15
_log = logging.getLogger(__name__)


def fetch(url: str, seconds: float) -> str:
    """The body of a URL as text; certificates are checked."""
    with urllib.request.urlopen(url, timeout=seconds) as reply:
        return reply.read().decode("utf-8", errors="replace")


class ArticleSearch:
    """Ids by relevance from a search call, then their records as XML from a fetch call.

    ``base`` is the address of a service with ``esearch`` and ``efetch`` calls; ``get`` makes a call, so that it can be
    replaced where there is no network.
    """

    def __init__(self, spark: SparkSession, base: str, database: str = "pubmed", get: Callable[[str, float], str] = fetch) -> None:
        self.spark, self.base, self.database, self.get = spark, base.rstrip("/"), database, get

    def _call(self, name: str, seconds: float, **said: str | int) -> str | None:
        asked = urllib.parse.urlencode({"db": self.database, **said})
        try:
            return self.get(f"{self.base}/{name}.fcgi?{asked}", seconds)
        except OSError as e:
            _log.warning("%s failed: %s", name, e)
            return None

    def ids(self, terms: str, most: int) -> list[str]:
        found = self._call("esearch", SEARCH_SECONDS, term=terms, retmax=most, retmode="json", sort="relevance")
        try:
            return list(json.loads(found or "{}").get("esearchresult", {}).get("idlist", []))
        except ValueError:
            return []

    def search(self, terms: str, most: int) -> list[dict[str, str]]:
        ids = self.ids(terms, most)
        found = self._call("efetch", FETCH_SECONDS, id=",".join(ids), rettype="abstract", retmode="xml") if ids else None
        if not found:
            return []
        rows = articles(self.spark.createDataFrame([(found,)], "x string"), "x")
        return [r.asDict() for r in rows.collect()]  # one reply: at most ``most`` articles
