"""Mixing to target weights: budgets flow down a domain-language-source tree, leaves give token prefixes of epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, table, unboxed, work_folder, written

#: Weights are whole numbers, so that budgets are exact; names that are missing have DEFAULT.
DEFAULT = 100
DOMAINS = {"web": 500, "reference": 300, "forum": 200}
LANGUAGES = {"en": 600, "de": 150, "fr": 150, "es": 100}
#: The mixture's tokens as a share of all tokens, in percent, and how often a document may be read at most.
PERCENT, EPOCHS = 80, 2
SEED = "mix-1"
#: Leaves are cut into so many ranges of the shuffled order (three hex digits of the key).
DIGITS = 3
#: Rows of the table of ranges that are broadcast at most, at about 100 bytes each; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def domain_of(source: Column) -> Column:
    """The domain of a source by its number: web, reference or forum."""
    k = F.pmod(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long"), F.lit(10))
    return F.when(k < 5, "web").when(k < 8, "reference").otherwise("forum")


def n_tokens(text: str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    parts = F.split(F.col(text), r"[\x20\x09-\x0D]+", -1)
    empty = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(F.col(text).isNull(), 0).otherwise(F.size(parts) - empty).cast("long")


def weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parent: list[str], child: str, budget: str, cap: str, weights: Column) -> DataFrame:
    """nodes with _share: what each child gets of its parent's budget.

    Children get budget in proportion to weight; those whose cap is smaller get their cap, and what they leave is dealt
    among their siblings in the same way. Sorted by cap / weight, a child is full as long as its cap is within its
    proportion of what the ones before it leave.
    """
    rows = nodes.withColumn("_w", weights)
    by = W.partitionBy(*parent).orderBy(F.col(cap) / F.col("_w"), child)
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumns({"_used": F.coalesce(F.sum(cap).over(before), F.lit(0)), "_rest": F.sum("_w").over(after)})
    full = F.col(cap) * F.col("_rest") <= F.col("_w") * (F.col(budget) - F.col("_used"))
    rows = rows.withColumn("_full", full)
    all_ = W.partitionBy(*parent)
    rows = rows.withColumns(
        {
            "_left": F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col(cap))).over(all_), F.lit(0)),
            "_open": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_),
        }
    )
    share = F.when(F.col("_full"), F.col(cap)).otherwise(F.expr("_w * _left div _open"))
    return rows.withColumn("_share", share).drop("_w", "_used", "_rest", "_full", "_left", "_open")


def budgets(leaves: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, domains: dict | None = None, languages: dict | None = None) -> DataFrame:
    """leaves (_domain, _lang, _source, tokens) with budget, whole (epochs taken whole) and rest (tokens of the next)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("lang_cap"))
    tops = langs.groupBy("_domain").agg(F.sum("lang_cap").alias("domain_cap"))
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {percent} div 100").alias("total"))
    tops = tops.withColumn("_root", F.lit(0)).join(total.withColumn("_root", F.lit(0)), "_root")
    tops = shared_out(tops, ["_root"], "_domain", "total", "domain_cap", weight("_domain", DOMAINS if domains is None else domains))
    langs = langs.join(tops.select("_domain", F.col("_share").alias("domain_budget")), "_domain")
    langs = shared_out(langs, ["_domain"], "_lang", "domain_budget", "lang_cap", weight("_lang", LANGUAGES if languages is None else languages))
    leaves = leaves.join(langs.select("_domain", "_lang", F.col("_share").alias("lang_budget")), ["_domain", "_lang"])
    leaves = shared_out(leaves, ["_domain", "_lang"], "_source", "lang_budget", "cap", F.lit(DEFAULT).cast("long"))
    whole = F.when(F.col("tokens") > 0, F.expr("_share div tokens")).otherwise(0).cast("long")
    return leaves.select("_domain", "_lang", "_source", "tokens", F.col("_share").alias("budget"), whole.alias("whole"), (F.col("_share") - whole * F.col("tokens")).alias("rest"))


def mixed(docs: DataFrame, tokens: str | None = None, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, domains: dict | None = None, languages: dict | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source and any other columns) that the mixture reads, one for each epoch,
    with _domain, _lang, _source (null: 'none'), _tokens and _epoch from 0. Tokens are the words of text, counted once
    into a written copy of the rows, or those in the column that tokens names (text is not needed then).

    A leaf's budget takes whole epochs first and then the longest prefix of the next one, in the order of that epoch's
    md5 of seed, epoch and doc_id, whose tokens fit. Texts without words cost nothing. A leaf without tokens has budget
    0. The sum over a leaf comes from sums over ranges of the order; only rows of the range in which the budget ends
    are sorted, so that a leaf with most of the rows is no task of its own.
    """
    folder = work_folder(docs.sparkSession)
    counted = n_tokens("text") if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    source = F.coalesce("source", F.lit("none"))
    rows = boxed(docs, _id=F.col("doc_id"), _domain=domain_of(F.col("source")), _lang=F.coalesce("lang", F.lit("none")), _source=source, _tokens=counted)
    rows = written(rows, folder, "counted")
    leaf = ["_domain", "_lang", "_source"]
    leaves = written(rows.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens")), folder, "leaves")
    plan = written(budgets(leaves, percent, epochs, domains, languages), folder, "plan")
    small = plan.count() <= BROADCAST_ROWS
    own = plan.select(*leaf, "whole", "rest")
    rows = rows.join(F.broadcast(own) if small else own, leaf)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, DIGITS))
    sums = written(rows.groupBy(*leaf, "_range").agg(F.sum("_tokens").alias("n"), F.max("rest").alias("r")), folder, "ranges")
    upto = F.sum("n").over(W.partitionBy(*leaf).orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
    ranges = sums.withColumn("_upto", upto).select(*leaf, "_range", (F.col("_upto") - F.col("n")).alias("_before"), "_upto").where(F.col("_upto") - F.col("n") <= F.col("r"))
    ranges = written(ranges, folder, "upto")
    hinted = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    placed = rows.join(hinted, [*leaf, "_range"], "left")
    inside = F.coalesce(F.col("_upto") <= F.col("rest"), F.lit(False))
    edge = F.col("_before").isNotNull() & ~inside
    done = placed.where(~edge).withColumn("_copies", F.col("whole") + F.when(inside, 1).otherwise(0))
    seen = F.sum("_tokens").over(W.partitionBy(*leaf, "_range").orderBy("_key", "_id", "_tokens").rowsBetween(W.unboundedPreceding, 0))
    cut = placed.where(edge).withColumn("_seen", F.col("_before") + seen).withColumn("_copies", F.col("whole") + F.when(F.col("_seen") <= F.col("rest"), 1).otherwise(0)).drop("_seen")
    out = done.unionByName(cut).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return unboxed(out, **{k: F.col(k) for k in ("_domain", "_lang", "_source", "_tokens", "_epoch")})


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture reads of documents: a row for each document and epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", n_tokens("text").alias("n"))
    return mixed(docs, "n").select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"))


def mix_sql(documents: str = "documents", columns: str = "doc_id, domain, lang_ AS lang, source_ AS source, epoch, n_tokens") -> str:
    """DuckDB SQL of mixed() with the parameters of this module."""

    def level(name: str, rows: str, parent: str, child: str, budget: str, cap: str, w: str) -> str:
        return f"""{name}_w AS (SELECT *, {w} AS w FROM {rows}),
{name}_o AS (SELECT *, coalesce(sum({cap}) OVER (PARTITION BY {parent} ORDER BY {cap}::DOUBLE / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
  sum(w) OVER (PARTITION BY {parent} ORDER BY {cap}::DOUBLE / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS ahead FROM {name}_w),
{name}_f AS (SELECT *, {cap} * ahead <= w * ({budget} - used) AS isfull FROM {name}_o),
{name}_s AS (SELECT *, CASE WHEN isfull THEN {cap} ELSE w * ({budget} - coalesce(sum(CASE WHEN isfull THEN {cap} END) OVER (PARTITION BY {parent}), 0)::BIGINT)
  // (sum(CASE WHEN NOT isfull THEN w END) OVER (PARTITION BY {parent}))::BIGINT END AS share FROM {name}_f)"""

    def case(col: str, weights: dict[str, int]) -> str:
        return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT} END::BIGINT"

    return f"""
WITH d AS (
  SELECT *, CASE WHEN k < 5 THEN 'web' WHEN k < 8 THEN 'reference' ELSE 'forum' END AS domain FROM (
    SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 10 AS k, coalesce(lang, 'none') AS lang_, coalesce(source, 'none') AS source_,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {documents})),
leaves AS (SELECT domain, lang_, source_, sum(n_tokens)::BIGINT AS tokens, ({EPOCHS} * sum(n_tokens))::BIGINT AS cap FROM d GROUP BY ALL),
langs0 AS (SELECT domain, lang_, sum(cap)::BIGINT AS lang_cap FROM leaves GROUP BY ALL),
tops0 AS (SELECT domain, sum(lang_cap)::BIGINT AS domain_cap, 0 AS root, (SELECT coalesce(sum(tokens), 0)::BIGINT * {PERCENT} // 100 FROM leaves) AS total FROM langs0 GROUP BY ALL),
{level("tops", "tops0", "root", "domain", "total", "domain_cap", case("domain", DOMAINS))},
langs1 AS (SELECT l.*, t.share AS domain_budget FROM langs0 l JOIN tops_s t USING (domain)),
{level("langs", "langs1", "domain", "lang_", "domain_budget", "lang_cap", case("lang_", LANGUAGES))},
leaves1 AS (SELECT l.*, t.share AS lang_budget FROM leaves l JOIN langs_s t USING (domain, lang_)),
{level("leaf", "leaves1", "domain, lang_", "source_", "lang_budget", "cap", f"{DEFAULT}::BIGINT")},
plan AS (SELECT domain, lang_, source_, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole, share, tokens FROM leaf_s),
keyed AS (SELECT d.*, p.whole, p.share - p.whole * p.tokens AS rest,
  md5('{SEED}:' || p.whole::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')) AS key_ FROM d JOIN plan p USING (domain, lang_, source_)),
seen AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang_, source_ ORDER BY key_, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
mixed AS (SELECT *, unnest(range(0, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM seen)
SELECT {columns} FROM mixed
"""


SQL = mix_sql()
