"""Reads as FASTQ or FASTA text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadArgument, UnsupportedCompression
from ..schema import FASTA, FASTQ


def _header(mark: str) -> Column:
    return F.concat(F.lit(mark), F.col("id"), F.when(F.coalesce(F.length("desc"), F.lit(0)) > 0, F.concat(F.lit(" "), F.col("desc"))).otherwise(""))


def fastq_lines() -> Column:
    """The four lines of a record, without the last end of line; a read without quality ends the run."""
    qual = F.coalesce(F.col("qual"), F.raise_error(F.concat(F.lit("no quality, so that it can't be FASTQ: "), F.col("id"))).cast("string"))
    return F.concat_ws("\n", _header("@"), F.col("seq"), F.lit("+"), qual)


def fasta_lines() -> Column:
    return F.concat_ws("\n", _header(">"), F.col("seq"))


def output_format(source: str) -> str:
    """FASTA stays FASTA; FASTQ and BAM become FASTQ."""
    return FASTA if source == FASTA else FASTQ


def check_sink(path: str) -> str | None:
    """The codec of an output path."""
    low = path.lower()
    for ending in (".bz2", ".xz", ".zst"):
        if low.endswith(ending):
            raise UnsupportedCompression(f"writing {ending} is not supported yet")
    return "gzip" if low.endswith(".gz") else None


def write_reads(df: DataFrame, path: str, fmt: str, ordered: bool = True, mode: str = "errorifexists") -> None:
    """A folder of text parts in file order (parts sort by name); gzip where the path ends in .gz.

    Parts of a gzip folder may be concatenated: several members are one stream.
    """
    if fmt not in (FASTQ, FASTA):
        raise BadArgument(f"cannot write {fmt}")
    codec = check_sink(path)
    rows = df.orderBy("input_idx", "ord") if ordered else df
    out = rows.select((fastq_lines() if fmt == FASTQ else fasta_lines()).alias("value")).write.mode(mode)
    (out.option("compression", codec) if codec else out).text(path)
