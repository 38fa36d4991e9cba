"""head and tail, by reads or by bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import BadArgument

#: Reads whose ord has the same quotient by this make a block: 64 MB of uncompressed text.
BLOCK = 1 << 26


def head_reads(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n reads in file order. A scan with limit=n stops early by itself."""
    return df.orderBy("input_idx", "ord").limit(n)


def tail_reads(df: DataFrame, n: int = 10) -> DataFrame:
    """The last n reads, in file order."""
    return df.orderBy(F.desc("input_idx"), F.desc("ord")).limit(n).orderBy("input_idx", "ord")


def prefix(df: DataFrame, weight: Column, budget: int, block: list[Column], order: list[Column], last: bool = False) -> DataFrame:
    """The rows before which, in order (or after which, if last), the weights sum up to less than budget.

    block must be non-decreasing along order. Sums are taken by block; whole blocks are kept or dropped by their place,
    and only the rows of the block in which the budget ends are sorted, so that no task sees all rows.
    """
    names = [f"_b{k}" for k in range(len(block))]
    rows = df.withColumns({**dict(zip(names, block, strict=True)), "_w": weight.cast("long")})
    turn = F.desc if last else F.asc
    before = W.orderBy(*(turn(c) for c in names)).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*names).agg(F.sum("_w").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.where(F.col("_before") < budget)
    placed = rows.join(sums, names)
    whole = placed.where(F.col("_before") + F.col("_n") <= budget)
    within = W.partitionBy(*names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    cut = placed.where(F.col("_before") + F.col("_n") > budget)
    cut = cut.withColumn("_seen", F.col("_before") + F.coalesce(F.sum("_w").over(within), F.lit(0))).where(F.col("_seen") < budget).drop("_seen")
    return whole.unionByName(cut).drop(*names, "_w", "_n", "_before")


def _by_bases(df: DataFrame, bases: int, last: bool, block: int) -> DataFrame:
    if bases < 0:
        raise BadArgument("bases must not be negative")
    turn = F.desc if last else F.asc
    blocks = [F.col("input_idx"), F.floor(F.col("ord") / block)]
    return prefix(df, F.length("seq"), bases, blocks, [turn("input_idx"), turn("ord")], last).orderBy("input_idx", "ord")


def head_bases(df: DataFrame, bases: int, block: int = BLOCK) -> DataFrame:
    """The first reads up to the one that reaches so many bases."""
    return _by_bases(df, bases, False, block)


def tail_bases(df: DataFrame, bases: int, block: int = BLOCK) -> DataFrame:
    """The fewest last reads that have so many bases; all if there are fewer."""
    return _by_bases(df, bases, True, block)
