"""Quality trimming: the best segment of a read (Mott)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import _ERR, flat_bytes


def best_segments(offsets: np.ndarray, raw: np.ndarray, cutoff: float) -> np.ndarray:
    """A row [start, end) for each read: the segment with the largest sum of 10 ** (-cutoff / 10) - p; the longer, then the
    earlier of equal ones; (0, 0) for empty quality.

    The best segment up to an end starts at the earliest least prefix sum before it. Prefix sums of all reads are taken at
    once, as whole numbers, each read moved below the ones before it, so that one running minimum serves all. Ends that
    are as good but for rounding are told apart by the sums of their segments as they add up from the left."""
    gain = 10.0 ** (-cutoff / 10.0) - _ERR
    size = np.diff(offsets)
    out = np.zeros((len(size), 2), np.int64)
    own = np.flatnonzero(size)
    if not len(own):
        return out
    first, size = offsets[:-1][own] - offsets[0], size[own]
    scale = 1 << max(16, 58 - int(len(raw)).bit_length())
    g = np.rint(gain * scale).astype(np.int64)[raw]
    before = np.cumsum(g) - g
    shift = before[first] + np.cumsum(size + np.append(0, size[:-1])) * scale + np.arange(len(own))
    before -= np.repeat(shift, size)
    least = np.minimum.accumulate(before)
    index = np.arange(len(raw))
    begun = np.maximum.accumulate(np.where(np.append(True, before[1:] < least[:-1]), index, 0))
    total = before + g - least
    bound = np.maximum.reduceat(total, first) - size
    good = np.flatnonzero(total >= np.repeat(bound, size))
    read = np.searchsorted(first, good, "right") - 1
    edges = np.searchsorted(read, np.arange(len(own) + 1))
    out[own] = np.stack([begun[good[edges[:-1]]] - first, good[edges[:-1]] + 1 - first], 1)
    for k in np.flatnonzero(np.diff(edges) > 1).tolist():
        ends, best = good[edges[k] : edges[k + 1]], None
        starts, at = np.unique(begun[ends], return_index=True)
        single = np.append(at[1:], len(ends)) - at == 1
        short = ends[at[single & (starts == ends[at])]]
        if len(short):
            e = int(short[gain[raw[short]].argmax()])
            best = (gain[raw[e]], 1, -e)
        for s, i, j in zip(starts.tolist(), at.tolist(), np.append(at[1:], len(ends)).tolist(), strict=True):
            if j - i == 1 and s == ends[i]:
                continue
            sums = np.add.accumulate(gain[raw[s : ends[j - 1] + 1]])
            for e in ends[i:j].tolist():
                found = (sums[e - s], e + 1 - s, -e)
                best = found if best is None or found > best else best
        e = -best[2]
        out[own[k]] = (e + 1 - best[1] - first[k], e + 1 - first[k])
    return out


def best_segment(qual: bytes, cutoff: float) -> tuple[int, int]:
    """best_segments() of one read."""
    found = best_segments(np.array([0, len(qual)]), np.frombuffer(qual, np.uint8), cutoff)
    return int(found[0, 0]), int(found[0, 1])


def mott_segment(qual: Column | str, cutoff: float) -> Column:
    """struct(start, stop) of best_segment(); null without quality."""

    @F.arrow_udf("struct<start int, stop int>")
    def segment(q: pa.Array) -> pa.Array:
        offsets, raw = flat_bytes(q)
        ends = best_segments(offsets, raw, cutoff).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["start", "stop"], mask=q.is_null())

    # else a filter on the trimmed read would be pushed below and run the function a second time
    return segment.asNondeterministic()(qual)
