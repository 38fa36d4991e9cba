"""count and stats: a row for each input, or one for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import quality_features, sequence_features
from ..scratch import kept

PERCENTILES = (10, 25, 50, 75, 90, 99)
TOTAL = "total"
_KEYS = ["input_idx", "file"]


def _inputs(df: DataFrame, inputs: DataFrame | None) -> DataFrame:
    return df.select(*_KEYS, "format").distinct() if inputs is None else inputs.select(*_KEYS, "format")


def _combined(df: DataFrame) -> DataFrame:
    return df.withColumns({"input_idx": F.lit(0), "file": F.lit(TOTAL)})


def count_reads(df: DataFrame, inputs: DataFrame | None = None, combine: bool = False) -> DataFrame:
    """input_idx, file, reads, bases; inputs (input_idx, file, format) adds rows for inputs without reads."""
    known = _inputs(df, inputs).drop("format")
    if combine:
        df, known = _combined(df), _combined(known).limit(1)
    found = df.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq").cast("long")).alias("bases"))
    return known.join(found, _KEYS, "left").select(*_KEYS, F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("bases", F.lit(0)).alias("bases"))


def _length_figures(lengths: DataFrame, keys: list[str], *more: Column, xs: tuple[int, ...] = (50, 90), ps: tuple[int, ...] = ()) -> DataFrame:
    """keys, n<x> for each x, l<p> for each percentile p (linear between the two nearest ranks) and more aggregates, from
    rows (keys, len, reads: how many have this length, ...) that differ in keys and len. Only distinct lengths are sorted."""
    by = W.partitionBy(*keys)
    up, down = by.orderBy("len").rowsBetween(W.unboundedPreceding, 0), by.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)
    part = F.col("len") * F.col("reads")
    rows = lengths.withColumns({"_down": F.sum(part).over(down), "_span": F.sum(part).over(by), "_upto": F.sum("reads").over(up), "_reads": F.sum("reads").over(by)})
    goal = lambda x: F.floor(F.col("_span") * F.lit(float(x)) / 100)
    out = [F.max(F.when(F.col("_down") >= goal(x), F.col("len"))).alias(f"n{x}") for x in xs]
    for p in ps:
        rank = F.lit(p / 100) * (F.col("_reads") - 1)
        low, high = (F.min(F.when(F.col("_upto") > r, F.col("len"))) for r in (F.floor(rank), F.ceil(rank)))
        out.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"l{p}"))
    return rows.groupBy(*keys).agg(*out, *more)


def nx_by(lengths: DataFrame, keys: list[str], *xs: int) -> DataFrame:
    """keys and n<x> for each x, from rows (keys, len)."""
    return _length_figures(lengths.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("reads")), keys, xs=xs)


def length_percentiles(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys and l<p> for each of PERCENTILES, from rows (keys, len)."""
    return _length_figures(lengths.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("reads")), keys, xs=(), ps=PERCENTILES)


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, ps: tuple[int, ...] = PERCENTILES, width: float = 1 / 64, weight: Column | None = None) -> DataFrame:
    """keys and p<p>: linear between the two nearest ranks, exact; weight says how often a row counts.

    Equal values are counted first, then they are counted by ranges of the given width, and only those of the ranges that
    hold a wanted rank are sorted, so that neither a sort of all values nor a table of the distinct ones meets in one task.
    """
    own = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_w"))
    own = own.withColumn("_r", F.floor(F.col("_v") / width))
    sums = own.groupBy(*keys, "_r").agg(F.sum("_w").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.withColumns({"_from": upto - F.col("_n"), "_all": F.sum("_n").over(W.partitionBy(*keys))})
    rank = F.col("_p") / 100 * (F.col("_all") - 1)
    wanted = sums.withColumn("_p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_rank", rank)
    wanted = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank")))))
    wanted = wanted.where((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_from") + F.col("_n")))
    # a range with wanted ranks knows them all, so that its values find theirs without another join
    ranges = wanted.groupBy(*keys, "_r", "_from").agg(F.collect_set(F.struct("_p", "_rank", "_place")).alias("_wanted"))
    held = own.join(ranges, [*keys, "_r"])
    held = held.withColumn("_to", F.col("_from") + F.sum("_w").over(W.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    here = F.filter("_wanted", lambda x: (x["_place"] < F.col("_to")) & (x["_place"] >= F.col("_to") - F.col("_w")))
    found = held.select(*keys, "_v", F.explode(here).alias("x")).select(*keys, "_v", "x.*")
    low, high = F.min(F.struct("_place", "_v"))["_v"], F.max(F.struct("_place", "_v"))["_v"]
    each = found.groupBy(*keys, "_p", "_rank").agg(low.alias("_low"), high.alias("_high"))
    each = each.withColumn("_x", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_rank") - F.floor("_rank")))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("_p") == p, F.col("_x"))).alias(f"p{p}") for p in ps))


def _share(part: Column, of: Column) -> Column:
    return F.when(of > 0, 100.0 * part / of).otherwise(F.lit(0.0))


def stats_reads(df: DataFrame, inputs: DataFrame | None = None, combine: bool = False, extended: bool = False) -> DataFrame:
    """The statistics of each input, in its place on the list; of all of them as file 'total' with combine.

    extended adds length_percentiles and quality_percentiles, structs of p10 to p99; the second is null without
    quality. The mean quality and the shares of high qualities are over all bases, those without quality included.
    """
    kinds = lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) <= 0, "-").when(F.size(x) == 1, F.element_at(x, 1)).otherwise("mixed")
    if combine:
        df = _combined(df)
        if inputs is not None:
            inputs = _combined(inputs.agg(kinds(F.collect_set("format")).alias("format")))
    reads = df.select(
        *_KEYS, "format", F.length("seq").cast("long").alias("len"), F.length("qual").alias("_ql"), sequence_features("seq").alias("s"), quality_features("qual").alias("q")
    )
    mean = F.when(F.col("_ql") == 0, 0.0).otherwise(F.when(F.col("q.err") <= 0, 60.0).otherwise(-10.0 * F.log10(F.col("q.err") / F.col("_ql"))))
    sums = ["err", *(f"q{t}" for t in (10, 20, 30)), "gc", "bases", "n"]
    flags, kind_sets = ["protein", "u", "t"], F.array_distinct(F.flatten(F.collect_set("_formats")))
    # one look at the reads: what they have in common with others of their length (and mean quality) is summed up
    each = reads.groupBy(*_KEYS, "len", *([mean.alias("mq")] if extended else [])).agg(
        F.count(F.lit(1)).alias("reads"), F.collect_set("format").alias("_formats"), *(F.sum(f"q.{c}" if c[0] in "eq" else f"s.{c}").alias(f"_{c}") for c in sums),
        *(F.bool_or(f"s.{x}").alias(f"_{x}") for x in flags),
    )
    again = [F.sum(f"_{c}").alias(f"_{c}") for c in sums] + [F.bool_or(f"_{x}").alias(f"_{x}") for x in flags]
    lengths = each
    if extended:  # it is looked at several times: written, so that the files are read once
        each = kept(each)
        lengths = each.groupBy(*_KEYS, "len").agg(F.sum("reads").alias("reads"), kind_sets.alias("_formats"), *again)
    base = _length_figures(
        lengths, _KEYS, F.sum("reads").alias("read_count"), F.sum(F.col("len") * F.col("reads")).alias("total_bases"), F.min("len").alias("min_length"),
        F.max("len").alias("max_length"), kinds(kind_sets).alias("_format"), *again, ps=PERCENTILES if extended else (50,),
    )
    if inputs is not None:
        all_ = inputs.select(*_KEYS, "format").join(base.drop("_format"), _KEYS, "left")
    elif combine:
        none = _combined(df.sparkSession.range(1)).select(*_KEYS)
        all_ = none.join(base, _KEYS, "left").withColumn("format", F.coalesce("_format", F.lit("-")))
    else:
        all_ = base.withColumnRenamed("_format", "format")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bases = zero("total_bases")
    quality = F.when((bases > 0) & (F.coalesce("_err", F.lit(0.0)) > 0), -10.0 * F.log10(F.col("_err") / bases)).otherwise(F.lit(0.0))
    kind = F.when(F.coalesce("_protein", F.lit(False)), "Protein").when(F.coalesce(F.col("_u") & ~F.col("_t"), F.lit(False)), "RNA").otherwise("DNA")
    out = [
        *map(F.col, _KEYS), F.col("format"), kind.alias("seq_type"), zero("read_count").alias("read_count"), bases.alias("total_bases"),
        zero("min_length").alias("min_length"), zero("max_length").alias("max_length"),
        F.when(zero("read_count") > 0, bases / F.col("read_count")).otherwise(F.lit(0.0)).alias("mean_length"),
        F.coalesce("l50", F.lit(0.0)).alias("median_length"), zero("n50").alias("n50"), zero("n90").alias("n90"), quality.alias("mean_quality"),
        *(_share(zero(f"_q{t}"), bases).alias(f"bases_above_q{t}_pct") for t in (10, 20, 30)),
        _share(zero("_gc"), zero("_bases")).alias("gc_content_pct"), zero("_n").alias("ambiguous_bases"),
    ]
    if not extended:
        return all_.select(*out)
    by_length = F.struct(*(F.coalesce(f"l{p}", F.lit(0.0)).alias(f"p{p}") for p in PERCENTILES))
    by_quality = exact_percentiles(each, _KEYS, "mq", weight=F.col("reads"))
    qualities = F.when(F.col("_has"), F.struct(*(f"p{p}" for p in PERCENTILES)))
    joined = all_.join(by_quality.withColumn("_has", F.lit(True)), _KEYS, "left")
    return joined.select(*out, by_length.alias("length_percentiles"), qualities.alias("quality_percentiles"))
