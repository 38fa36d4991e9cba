"""Statistics of small Python lists; the reports compute the same ones as DataFrame aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def nx(lengths: Sequence[int], x: float) -> int:
    """The length at which lengths from the longest down reach x percent of their sum."""
    if not len(lengths) or not 0 < x <= 100:
        return 0
    down = -np.sort(-np.asarray(lengths, np.int64))
    sums = down.cumsum()
    return int(down[np.searchsorted(sums, int(sums[-1] * x / 100.0))])


def n50(lengths: Sequence[int]) -> int:
    return nx(lengths, 50)


def percentile(values: Sequence[float], p: float) -> float:
    """Linear between the two nearest ranks; 0 for nothing."""
    if not values:
        return 0.0
    own, rank = sorted(values), p / 100 * (len(values) - 1)
    low, high = math.floor(rank), math.ceil(rank)
    return own[low] + (own[high] - own[low]) * (rank - low)


def median(values: Sequence[float]) -> float:
    return percentile(values, 50)


def mean(values: Sequence[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def min_max(values: Sequence[int]) -> tuple[int, int]:
    return (min(values), max(values)) if values else (0, 0)
