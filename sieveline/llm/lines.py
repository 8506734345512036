"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is a window, known by two 64-bit hashes.  A window that stands more than once in
the corpus keeps its first occurrence, in the order of document and line; all later ones are covered, and a line
goes if any covered window holds it.  The first copy of a line in a repeated window therefore always stays.

Windows are counted with map-side partial sums, so a window that fills a third of the corpus is one row for each task.
The join back to the occurrences has one row for each window on one side; Spark splits its large partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import staged

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, _x, _pos, _h1, _h2: a row for each window; _x tells rows apart that share a key."""
    lined = df.select(F.col(key), F.xxhash64(F.col(text)).alias("_x"), _lines(F.col(text)).alias("_l"))
    lined = lined.where(F.size("_l") >= WINDOW)

    def window(i: Column) -> Column:
        part = [F.get(F.col("_l"), i + d) for d in range(WINDOW)]
        return F.struct(
            i.cast("int").alias("pos"),
            F.xxhash64(*part).alias("h1"),
            F.xxhash64(F.lit("second"), *reversed(part)).alias("h2"),
        )

    all_of = F.transform(F.sequence(F.lit(0), F.size("_l") - WINDOW), window)
    rows = lined.select(key, "_x", F.explode(all_of).alias("w"))
    return rows.select(key, "_x", F.col("w.pos").alias("_pos"), F.col("w.h1").alias("_h1"), F.col("w.h2").alias("_h2"))


def _kept(lines: Column, pos: Column) -> Column:
    """The lines outside of the windows at ``pos`` (sorted): covered runs are merged, then cut out by slices."""
    starts = F.filter(pos, lambda p, i: (i == 0) | (p > F.get(pos, i - 1) + WINDOW))
    ends = F.filter(pos, lambda p, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) > p + WINDOW))

    def between(s: Column) -> Column:
        def piece(i: Column) -> Column:
            first = F.when(i == 0, 0).otherwise(F.get(s["ends"], i - 1) + WINDOW)
            stop = F.when(i == F.size(s["starts"]), F.size(s["lines"])).otherwise(F.get(s["starts"], i))
            return F.slice(s["lines"], first + 1, stop - first)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["starts"])), piece))

    # The runs are bound to a one-element array, so that the lambda reads them instead of computing them again.
    bound = F.array(F.struct(lines.alias("lines"), starts.alias("starts"), ends.alias("ends")))
    return F.get(F.transform(bound, between), F.lit(0))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``text`` without the repeated lines, and ``n_lines`` and ``n_removed`` (long) added.

    Lines are split at ``\\n`` and compared as they are.  A null text has no lines and stays null; an empty text has
    one empty line.  A text of fewer than three lines has no window and stays as it is.  A text of which all lines
    go becomes empty.  Rows equal in key and text are one document: they get the same result.  Extra columns stay;
    a column named ``n_lines`` or ``n_removed`` is replaced.  An empty table stays empty.
    """
    # What is beside the text is carried as a struct, so that no column of it can clash with those made here.
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    beside = [F.col(f"`{c}`") for c in keep if c != text]
    packed = df.select(
        F.struct(*beside, F.lit(0).alias("_")).alias("row"), F.col(key).alias("k"), F.col(text).alias("t")
    ).withColumn("x", F.xxhash64("t"))
    windows = _windows(packed.select("k", "t"), "k", "t")
    place = F.struct(F.col("k"), F.col("_x").alias("x"), F.col("_pos").alias("p"))
    repeated = windows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    repeated = staged(repeated.where("_n > 1").drop("_n"), "line-windows")
    later = windows.join(repeated, ["_h1", "_h2"]).where(~place.eqNullSafe(F.col("_first")))
    covered = later.groupBy(F.col("k").alias("_k"), F.col("_x").alias("_kx")).agg(
        F.array_sort(F.collect_set("_pos")).alias("_at")
    )
    joined = packed.join(covered, F.col("k").eqNullSafe(F.col("_k")) & (F.col("x") == F.col("_kx")), "left")
    lines = _lines(F.col("t"))
    joined = joined.withColumn("_n", F.size(lines))
    joined = joined.withColumn("_left", F.when(F.col("_at").isNotNull(), _kept(lines, F.col("_at"))))
    new_text = F.when(F.col("_left").isNull(), F.col("t")).otherwise(F.array_join("_left", "\n"))
    names = [new_text.alias(text) if c == text else F.col("row")[c].alias(c) for c in keep]
    gone = F.when(F.col("_left").isNull(), 0).otherwise(F.col("_n") - F.size("_left"))
    return joined.select(*names, F.col("_n").cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))


LINE_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS pos FROM d
), h AS (
  SELECT doc_id, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM w
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM h
), gone AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS line FROM r WHERE n > 1
), lines AS (
  SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS t FROM d
), marked AS (
  SELECT x.doc_id, x.line, x.t, g.line IS NOT NULL AS removed
  FROM lines x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.line = x.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
    coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT removed), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT o.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents o LEFT JOIN kept k ON k.doc_id = o.doc_id
"""
