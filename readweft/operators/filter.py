"""filter: crop, trim by quality, drop what is empty, then all bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import gc_content, n_fraction
from ..functions.quality import mean_quality
from ..functions.trim import mott_segment


def _cut(df: DataFrame, start: Column, length: Column) -> DataFrame:
    return df.withColumns({"seq": F.substring("seq", start + 1, length), "qual": F.substring("qual", start + 1, length)})


def crop(df: DataFrame, head: int = 0, tail: int = 0) -> DataFrame:
    """Reads without their first head and last tail bases; head + tail >= length empties a read."""
    if not head and not tail:
        return df
    return _cut(df, F.lit(head), F.greatest(F.length("seq") - head - tail, F.lit(0)))


def trim_quality(df: DataFrame, cutoff: float) -> DataFrame:
    """The best segment of each read; reads without quality stay."""
    found = df.withColumn("_cut", mott_segment("qual", float(cutoff)))
    start, stop = F.coalesce(F.col("_cut.start"), F.lit(0)), F.coalesce(F.col("_cut.stop"), F.length("seq"))
    return _cut(found, start, stop - start).drop("_cut")


def _quality_from(least: float) -> Column:
    """Reads without quality, and those of at least this mean quality."""
    return F.coalesce(mean_quality("qual") >= float(least), F.lit(True))


def predicate(
    min_length: int | None = None, max_length: int | None = None, min_quality: float | None = None, min_gc: float | None = None, max_gc: float | None = None, max_n: float | None = None
) -> Column:
    """All bounds, inclusive; empty reads never pass, reads without quality pass min_quality."""
    n, tests = F.length("seq"), [F.length("seq") > 0]
    if min_length is not None:
        tests.append(n >= min_length)
    if max_length is not None:
        tests.append(n <= max_length)
    if max_n is not None:
        tests.append(n_fraction("seq") <= max_n)
    if min_gc is not None:
        tests.append(gc_content("seq") >= min_gc)
    if max_gc is not None:
        tests.append(gc_content("seq") <= max_gc)
    if min_quality is not None:
        tests.append(_quality_from(min_quality))
    return reduce(lambda a, b: a & b, tests)


def filter_reads(
    df: DataFrame, min_length: int | None = None, max_length: int | None = None, min_quality: float | None = None, min_gc: float | None = None, max_gc: float | None = None,
    max_n: float | None = None, headcrop: int = 0, tailcrop: int = 0, trim: float | None = None,
) -> DataFrame:
    """The reads that pass, cropped and trimmed. Cheap tests come in a filter of their own, below the one that needs
    qualities, so that Python sees only reads of fitting length and composition."""
    df = crop(df, headcrop, tailcrop)
    if trim is not None:
        df = trim_quality(df.where(F.length("seq") > 0), trim)
    df = df.where(predicate(min_length, max_length, None, min_gc, max_gc, max_n))
    return df if min_quality is None else df.where(_quality_from(min_quality))
