"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed

#: (verdict, host, path) of the query's rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
RULES_SCHEMA = "verdict string, rule_host string, rule_path string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast, at about 150 bytes each; more are shuffled.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the join is on.
PREFIX = 8


def parts(url) -> tuple:
    """(host, path) columns of a url column; both are empty for null or where "://" is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def _clean(rules: DataFrame) -> DataFrame:
    return rules.where("verdict is not null and rule_host is not null and rule_path is not null").select(
        "verdict", F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path"
    )


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Every row of pages (its other columns as they are) with _host, _path, _rule and _verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule string wins;
    among equally long ones the longer host, then block. Without a fitting rule: _rule null, _verdict default.
    Null and malformed urls have an empty host and path, which no rule with a host fits. Repeated rows each keep
    their verdict. An empty rules table gives every row the default.

    A url is expanded only at the numbers of host labels and the path lengths that rules have, so that long hosts
    and paths cost no more than short ones. Each expression is hashed; the join is on the first 8 hex digits, and a
    match counts if the whole digest agrees.
    """
    rules = _clean(rules)
    at = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    rows = boxed(pages, u=F.col(url))
    host, path = parts(F.col("u"))
    if at["n"] == 0:
        return unboxed(rows, _host=host, _path=path, _rule=F.lit(None).cast("string"), _verdict=F.lit(default))
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    rule = rules.select(
        F.substring(digest, 1, PREFIX).alias("k"), digest.alias("digest"), F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("hl"), "verdict"
    )
    if at["n"] <= BROADCAST_RULES:
        rule = F.broadcast(rule)
    labels, lengths = (F.array(*map(F.lit, sorted(x))) for x in (at["labels"], at["lengths"]))
    parsed = rows.select("u").where("u is not null").distinct().select("u", host_of("u")[0].alias("host"), host_of("u")[1].alias("path"))
    names = parsed.withColumn("names", F.split("host", r"\.", -1))
    suffixes = F.transform(
        F.filter(labels, lambda k: k <= F.size("names")), lambda k: F.array_join(F.slice("names", F.size("names") - k + 1, k), ".")
    )
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    told = (
        names.select("u", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))).alias("d"))
        .withColumn("k", F.substring("d", 1, PREFIX))
        .join(rule, "k")
        .where("d = digest")
        .groupBy("u")
        .agg(F.max(F.struct(F.length("rule").alias("l"), "hl", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), "rule", "verdict")).alias("best"))
        .select(F.col("u").alias("_u"), F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_said"))
    )
    return unboxed(rows.join(told, F.col("u") == F.col("_u"), "left"), _host=host, _path=path, _rule=F.col("_rule"), _verdict=F.coalesce("_said", F.lit(default)))


def host_of(name: str) -> tuple:
    return parts(F.col(name))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the five rules on every url of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, spark.createDataFrame(RULES, RULES_SCHEMA)).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")
    )


SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT q.*, r.*,
    coalesce((q.host = r.rule_host OR ends_with(q.host, '.' || r.rule_host)) AND starts_with(q.path, r.rule_path), false) AS fits
  FROM q CROSS JOIN r
)
SELECT page_id, host, path,
  arg_max(rule_host || rule_path, length(rule_host || rule_path)) FILTER (fits) AS rule,
  coalesce(arg_max(verdict, length(rule_host || rule_path)) FILTER (fits), 'allow') AS verdict
FROM fit GROUP BY page_id, host, path
"""
