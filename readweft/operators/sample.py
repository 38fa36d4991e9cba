"""sample: by number, share, bases or coverage; reproducible by seed and the same for every partitioning."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadArgument
from ..functions.size import parse_size
from .limits import prefix

#: Up to this number the sample is a top-k; beyond it the cut is found by ranges of the hash.
TOP_K = 10_000


def _hash(seed: str | int | None, *key: str) -> Column:
    seed = secrets.token_hex(8) if seed is None else seed
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def sample_count(df: DataFrame, n: int, seed: str | int | None = None, key: tuple[str, ...] = ("input_idx", "ord")) -> DataFrame:
    """n reads (all, if there are fewer) of the smallest hashes: uniform and without replacement."""
    if n < 0:
        raise BadArgument("a sample has no negative size")
    rows = df.withColumn("_h", _hash(seed, *key))
    if n <= TOP_K:
        return rows.orderBy("_h", *key).limit(n).drop("_h")
    return prefix(rows, F.lit(1), n, [F.substring("_h", 1, 4)], [F.col("_h"), *map(F.col, key)]).drop("_h")


def sample_proportion(df: DataFrame, share: float | Column, seed: str | int | None = None, key: tuple[str, ...] = ("input_idx", "ord")) -> DataFrame:
    """Each read with probability share."""
    if not isinstance(share, Column):
        if not 0 <= share <= 1:
            raise BadArgument("a proportion is from 0 to 1")
        share = F.lit(float(share))
    draw = F.conv(F.substring(_hash(seed, *key), 1, 8), 16, 10).cast("double")
    return df.where(draw < share * F.lit(4294967296.0))


def total_bases(df: DataFrame) -> int:
    return int(df.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0))).first()[0])


def sample_bases(df: DataFrame, target: int, seed: str | int | None = None, key: tuple[str, ...] = ("input_idx", "ord")) -> DataFrame:
    """About target bases: a first pass sums the bases, then each read has probability target / sum."""
    total = total_bases(df)
    return sample_proportion(df, min(target / total, 1.0) if total else 0.0, seed, key)


def sample_coverage(df: DataFrame, coverage: float, genome_size: int | str, seed: str | int | None = None, key: tuple[str, ...] = ("input_idx", "ord")) -> DataFrame:
    return sample_bases(df, coverage_target(coverage, genome_size), seed, key)


def coverage_target(coverage: float, genome_size: int | str) -> int:
    if coverage <= 0:
        raise BadArgument("coverage must be above 0")
    size = parse_size(genome_size) if isinstance(genome_size, str) else genome_size
    return int(coverage * size + 0.5)


def sample_reads(
    df: DataFrame, count: int | None = None, proportion: float | None = None, bases: int | str | None = None, coverage: float | None = None,
    genome_size: int | str | None = None, seed: str | int | None = None, stdin: bool = False,
) -> DataFrame:
    """One of the four ways, and only one."""
    given = [x is not None for x in (count, proportion, bases, coverage)]
    if sum(given) > 1:
        raise BadArgument("give only one of count, proportion, bases and coverage")
    if not any(given):
        raise BadArgument("specify one of count, proportion, bases, coverage with genome_size")
    if coverage is not None and genome_size is None:
        raise BadArgument("coverage needs genome_size")
    if count is not None:
        return sample_count(df, count, seed)
    if proportion is not None:
        return sample_proportion(df, proportion, seed)
    if stdin:
        raise BadArgument("bases and coverage read the input twice and need a file")
    target = coverage_target(coverage, genome_size) if coverage is not None else parse_size(bases) if isinstance(bases, str) else bases
    return sample_bases(df, target, seed)
