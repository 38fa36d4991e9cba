"""Line dedup by site-relative frequency: lines on too large a share of a host's pages go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed, work_folder, written

#: A line is boilerplate on more than this share of a host's pages, and on at least MIN_PAGES of them.
RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines (8 bytes each) of all hosts up to this number are broadcast; beyond it the join is shuffled.
BROADCAST_LINES = 50_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """_host and _drop: the hashes of its boilerplate lines, sorted. A host has at most (lines a page / ratio) of them."""
    own = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("_host"), F.col(text).alias("t"))
    pages = own.groupBy("_host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(_lines("t"), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    with_line = own.select("_host", F.explode(lines).alias("line")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    found = with_line.join(pages, "_host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("_host").agg(F.sort_array(F.collect_list("line")).alias("_drop"))


def cleaned(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Every row of docs with its columns, and _text: without boilerplate lines, _lines and _dropped: their numbers.

    Lines are split at \\n and compared as they are; blank ones stay. A page counts once for a line that it repeats,
    and loses all its copies. Null text stays null (without lines); rows without a host and hosts of few pages stay as
    they are; a page may become empty and is kept. Repeated rows count as pages of their own.
    """
    folder = work_folder(docs.sparkSession)
    rows = boxed(docs, h=F.col(host), t=F.col(text))
    drop = written(boilerplate(rows, "h", "t", ratio, min_pages), folder, "boilerplate")
    n = drop.agg(F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(drop) if n <= BROADCAST_LINES else drop, F.col("h") == F.col("_host"), "left")
    lines = _lines("t")
    left = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("_drop"), F.xxhash64(x)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(left)
    return unboxed(
        joined.withColumn("_kept", kept),
        _text=F.array_join("_kept", "\n"),
        _lines=F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        _dropped=F.when(F.col("t").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by source: the text without boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return cleaned(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_text").alias("text"))


SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
own AS (
  SELECT source, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line
  FROM d WHERE source IS NOT NULL
),
drops AS (
  SELECT source, list(line) AS bad FROM (
    SELECT source, line FROM (SELECT source, line, count(*) AS n FROM own GROUP BY source, line) JOIN pages USING (source)
    WHERE n >= 5 AND n > 0.05::DOUBLE * pages
  ) GROUP BY source
),
kept AS (
  SELECT doc_id, text, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
  FROM d LEFT JOIN drops USING (source)
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM kept
"""
