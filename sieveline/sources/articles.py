"""Article records out of a search service's XML, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import rx
from sieveline.functions.text import empty, strip_tags


def articles(df: DataFrame, xml: str, chars: int = 1200) -> DataFrame:
    """A row for each article: pmid, title, abstract, year and source; parts that are missing have their marks."""
    parts = F.regexp_extract_all(empty(F.col(xml)), F.lit(r"(?s)<PubmedArticle>(.*?)</PubmedArticle>"), F.lit(1))
    rows = df.select(F.explode(parts).alias("x"))

    def part(pattern: str, default: str) -> Column:
        found = F.regexp_extract("x", pattern, 1)
        return F.when(F.col("x").rlike(pattern), found).otherwise(F.lit(default))

    pmid = part(r"<PMID[^>]*>(\d+)</PMID>", "?")
    title = part(r"(?s)<ArticleTitle>(.*?)</ArticleTitle>", "No title")
    abstract = part(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>", "No abstract")
    year = part(r"(?s)<PubDate>.*?<Year>(\d{4})</Year>", "?")
    return rows.select(
        pmid.alias("pmid"),
        rx.strip(strip_tags(title)).alias("title"),
        F.substring(rx.strip(strip_tags(abstract)), 1, chars).alias("abstract"),
        year.alias("year"),
        F.format_string("PubMed PMID:%s (%s)", pmid, year).alias("source"),
    )
