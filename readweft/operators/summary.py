"""Counts of a run without a second pass over the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df that counts its rows while an action runs; the observation's get has reads."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("reads")), o


def summary_line(verb: str, kept: int, total: int | None = None) -> str:
    """The line for standard error: filter shows a share, sample and grep do not, the others count what they wrote."""
    if verb == "filter":
        return f"kept {kept} / {total} reads ({100 * kept / total if total else 0.0:.1f}%)"
    if verb in ("sample", "grep"):
        return f"kept {kept} / {total} reads"
    return f"wrote {kept} records"
