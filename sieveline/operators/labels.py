"""Label confidence: keyword rules, the strict cascade and their reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from sieveline import lexicon_labels as S
from sieveline import rx
from sieveline.functions.text import empty


def keyword_hit(label: Column, text: Column, keywords: dict[str, list[str]]) -> Column:
    """Whether the text has a whole-word keyword of its own label; unknown labels never have."""
    found = F.lit(False)
    for name, terms in keywords.items():
        found = F.when(label == name, rx.has(empty(text), rx.words(terms), "i")).otherwise(found)
    return F.coalesce(found, F.lit(False))


def keyword_rates(df: DataFrame, label: str, text: str, keywords: dict[str, list[str]], top: int = 8) -> DataFrame:
    """For each label its ``top`` keywords by the share of its texts that have them."""
    pairs = [(k, t) for k, of in keywords.items() for t in of]
    hits = F.array(
        *[
            F.struct(F.lit(t).alias("keyword"), ((F.col(label) == k) & rx.has(empty(F.col(text)), rx.words([t]), "i")).alias("hit"))
            for k, t in pairs
        ]
    )
    rows = df.where(F.col(label).isin(list(keywords))).select(F.col(label).alias("label"), F.explode(hits).alias("h"))
    rates = rows.groupBy("label", F.col("h.keyword").alias("keyword")).agg(F.avg(F.col("h.hit").cast("double")).alias("rate"))
    order = Window.partitionBy("label").orderBy(F.desc("rate"), "keyword")
    return rates.where("rate > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def near(
    df: DataFrame, label: str, text: str, sites: dict[str, list[str]], other: str, name: str, window: int = 320, most: int = 30
) -> DataFrame:
    """Add ``name``: whether one of the first ``most`` matches of a site pattern of the row's own label has a match of
    ``other`` within ``window`` characters.

    Spark has no list of match places, and a border inside the window changes what counts as a word, so the snippets
    are cut in Python, a batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {k: [re.compile(p, re.I) for p in v] for k, v in sites.items()}
        to = re.compile(other, re.I)

        def check(kind: object, t: object) -> bool:
            if not isinstance(t, str) or not to.search(t):
                return False
            for site in at.get(kind, ()):
                for n, m in enumerate(site.finditer(t)):
                    if n >= most:
                        break
                    if to.search(t[max(0, m.start() - window) : m.end() + window]):
                        return True
            return False

        for batch in batches:
            found = [check(k, t) for k, t in zip(batch[label], batch[text], strict=True)]
            yield batch.assign(**{name: found})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(name, BooleanType())]))


def strict_cascade(df: DataFrame, label: str, text: str) -> DataFrame:
    """Add is_highconf and conf_reason by the ordered rules; the first that fires gives the reason."""
    t = empty(F.col(text))
    kind = F.col(label)

    def own(patterns: dict[str, str]) -> Column:
        found = F.lit(False)
        for name, p in patterns.items():
            found = F.when(kind == name, rx.has(t, p, "i")).otherwise(found)
        return F.coalesce(found, F.lit(False))

    sites = {k: [S.CORE[k], S.SECONDARY[k]] for k in S.LABELS}
    base = near(df, label, text, sites, S.CANCER, "_near")
    core, second, strong, cross = own(S.CORE), own(S.SECONDARY), own(S.STRONG), own(S.CROSS)
    core_hits = F.lit(0)
    for name, p in S.CORE.items():
        core_hits = F.when(kind == name, rx.count(t, p, "i")).otherwise(core_hits)
    onco = rx.has(t, S.ONCO_CONTEXT, "i")
    short = F.regexp_replace(F.lower(F.split(kind, "_")[0]), " ", "_")
    reason = (
        F.when(rx.strip(t) == "", "empty")
        .when(~F.coalesce(kind.isin(S.LABELS), F.lit(False)), "unknown_label")
        .when(~rx.has(t, S.CANCER, "i"), "no_cancer_signal_anywhere")
        .when(own(S.NEGATIVE), "negative_filter_hit")
        .when(rx.has(t, S.NEURO_DISEASE, "i") & ~onco, "negative_neuro_wrong_topic")
        .when(~core & ~second, "no_site_signal_anywhere")
        .when(cross & ~core, "cross_site_mismatch")
        .when(~core, "weak_site_presence")
        .when(rx.has(t, S.OTHER_PRIMARY, "i") & (core_hits <= 2), "dominant_other_site")
        .when(~(strong | onco), F.concat(F.lit("weak_"), short, F.lit("_context")))
        .when(~onco & ~F.col("_near"), "weak_onco_context_no_proximity")
        .otherwise("ok")
    )
    out = base.withColumn("conf_reason", reason).withColumn("is_highconf", F.col("conf_reason") == "ok")
    return out.drop("_near")


def confidence_report(df: DataFrame, label: str, top: int = 10) -> DataFrame:
    """For each label: total, kept_highconf, dropped_lowconf, kept_pct and its ``top`` drop reasons as a map."""
    reasons = df.where("NOT is_highconf").groupBy(label, "conf_reason").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(label).orderBy(F.desc("n"), "conf_reason")
    reasons = reasons.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    maps = reasons.groupBy(F.col(label).alias("_l")).agg(
        F.map_from_entries(F.collect_list(F.struct("conf_reason", "n"))).alias("top_drop_reasons")
    )
    kept = F.sum(F.col("is_highconf").cast("long"))
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("total"), kept.alias("kept_highconf"))
    joined = totals.join(maps, totals[label].eqNullSafe(maps["_l"]), "left").drop("_l")
    return joined.withColumn("dropped_lowconf", F.col("total") - F.col("kept_highconf")).withColumn(
        "kept_pct", F.round(100.0 * F.col("kept_highconf") / F.col("total"), 2)
    )


def misses_sample(df: DataFrame, label: str, text: str, row_id: str, n: int = 80, chars: int = 500) -> DataFrame:
    """The first ``n`` dropped rows of each label with the beginning of their text."""
    order = Window.partitionBy(label).orderBy(row_id)
    missed = df.where("NOT is_highconf").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    return missed.select(row_id, label, "conf_reason", F.substring(text, 1, chars).alias("snippet"))


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int = 7, by: str | None = None) -> DataFrame:
    """``n`` rows (of each value of ``by``) that a seed picks: those with the lowest digests of seed and id.

    The same rows at any partitioning, unlike a random order; a sampling report, so the limit is its purpose.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")).cast("binary"))
    if by is None:
        return df.withColumn("_d", digest).orderBy("_d", row_id).limit(n).drop("_d")
    order = Window.partitionBy(by).orderBy(digest, row_id)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
