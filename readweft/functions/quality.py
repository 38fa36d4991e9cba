"""Phred+33 qualities: scalar expressions, and Arrow functions where every character counts.

Sums over characters go through Arrow: one table look-up over the flat buffer of a batch. The expression without
Python needs a pass over the string for each distinct quality.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ERR = np.array([10.0 ** (-max(c - 33, 0) / 10.0) for c in range(256)])


def phred_to_prob(c: int) -> float:
    return float(_ERR[c])


def prob_to_phred(p: float) -> float:
    return 60.0 if p <= 0 else -10.0 * math.log10(p)


def flat_bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, characters as latin-1 codes) of a string array; nulls are empty."""
    x = x.fill_null("")
    offsets = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_string(x.type) else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    data = x.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    if (raw > 127).any():
        parts = [s.encode("latin-1", "replace") for s in x.to_pylist()]
        return np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)
    return offsets - offsets[0], raw


def summed(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each range, added up in order within the range."""
    out, n = np.zeros(len(offsets) - 1, values.dtype), np.diff(offsets)
    if len(values):
        out[n > 0] = np.add.reduceat(values, offsets[:-1][n > 0])
    return out


def _err_sum(q: pa.Array) -> pa.Array:
    offsets, raw = flat_bytes(q)
    return pa.array(summed(offsets, _ERR[raw]), pa.float64(), mask=np.asarray(q.is_null()))


def err_sum(qual: Column | str) -> Column:
    """The sum of the error probabilities of a read; null without quality."""

    @F.arrow_udf("double")
    def err_sum(q: pa.Array) -> pa.Array:
        return _err_sum(q)

    return err_sum(qual)


def err_sum_native(qual: Column | str, top: int = 93) -> Column:
    """err_sum() without Python: a replace() for each quality; for cross-checks and short reads."""
    total = F.lit(0.0)
    for k in range(top + 1):
        total = total + (F.length(qual) - F.length(F.replace(qual, F.lit(chr(33 + k)), F.lit("")))) * F.lit(float(_ERR[33 + k]))
    return total


def mean_quality(qual: Column | str) -> Column:
    """Phred of the mean error probability; 0 for empty quality, null without. qual is looked at once, so that a column that
    is costly to make is made once."""

    @F.arrow_udf("double")
    def mean_err(q: pa.Array) -> pa.Array:
        offsets, raw = flat_bytes(q)
        n = np.diff(offsets)
        return pa.array(np.where(n > 0, summed(offsets, _ERR[raw]) / np.maximum(n, 1), -1.0), pa.float64(), mask=np.asarray(q.is_null()))

    p = mean_err(qual)
    return F.when(p < 0, F.lit(0.0)).otherwise(phred_of(p))


def phred_of(p: Column) -> Column:
    return F.when(p <= 0, F.lit(60.0)).otherwise(-10.0 * F.log10(p))


def arithmetic_mean_quality(qual: Column | str) -> Column:
    """The plain mean of the qualities; for comparison only."""

    @F.arrow_udf("double")
    def plain(q: pa.Array) -> pa.Array:
        offsets, raw = flat_bytes(q)
        n = np.diff(offsets)
        total = summed(offsets, np.maximum(raw.astype(np.int64) - 33, 0))
        return pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), pa.float64(), mask=np.asarray(q.is_null()))

    return plain(qual)


def count_above(qual: Column | str, least: int) -> Column:
    """How many qualities are at least so high."""
    return F.length(F.translate(qual, "".join(map(chr, range(33, 33 + least))), "")).cast("long")
