"""Everything that reports need of a read, from one look at its sequence and one at its quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import _ERR, flat_bytes, summed


def _is(letters: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[np.frombuffer((letters + letters.lower()).encode(), np.uint8)] = 1
    return table


_GC, _BASES, _N, _PROTEIN, _U, _T = map(_is, ("GC", "ACGTU", "N", "EFIJLOPQZ", "U", "T"))
_ABOVE = {t: (np.arange(256) >= t + 33).astype(np.int64) for t in (10, 20, 30)}


def sequence_features(seq: Column | str) -> Column:
    """struct(gc, bases, n: counts; protein, u, t: whether such letters occur), case-insensitive."""

    @F.arrow_udf("struct<gc bigint, bases bigint, n bigint, protein boolean, u boolean, t boolean>")
    def features(s: pa.Array) -> pa.Array:
        at, raw = flat_bytes(s)
        counts = [summed(at, table[raw]) for table in (_GC, _BASES, _N, _PROTEIN, _U, _T)]
        return pa.StructArray.from_arrays([pa.array(c if k < 3 else c > 0) for k, c in enumerate(counts)], ["gc", "bases", "n", "protein", "u", "t"])

    return features(seq)


def quality_features(qual: Column | str) -> Column:
    """struct(err: sum of error probabilities; q10, q20, q30: qualities at least so high); null without quality."""

    @F.arrow_udf("struct<err double, q10 bigint, q20 bigint, q30 bigint>")
    def features(q: pa.Array) -> pa.Array:
        at, raw = flat_bytes(q)
        own = [pa.array(summed(at, _ERR[raw])), *(pa.array(summed(at, _ABOVE[t][raw])) for t in _ABOVE)]
        return pa.StructArray.from_arrays(own, ["err", "q10", "q20", "q30"], mask=q.is_null())

    return features(qual)
