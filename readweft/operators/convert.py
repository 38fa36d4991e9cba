"""convert: FASTQ or FASTA out of any input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadArgument, UnknownFormat
from ..schema import BAM, FASTA, FASTQ
from ..sources.formats import detect_format
from ..sources.sinks import check_sink, fasta_lines, fastq_lines


def target_format(to: str | None, output: str | None) -> str:
    """to if given, else by the extension of output."""
    if to is not None:
        if to.upper() not in (FASTQ, FASTA):
            raise BadArgument(f"cannot convert to {to}")
        return to.upper()
    if output is None:
        raise BadArgument("give a target format, or an output whose name has one")
    check_sink(output)
    try:
        found = detect_format(output)
    except UnknownFormat:
        found = BAM
    if found == BAM:
        raise BadArgument(f"cannot tell a target format from {output!r}")
    return found


def convert_reads(df: DataFrame, to: str, fake_quality: int | None = None, source: str | None = None) -> DataFrame:
    """Reads for the target format: to FASTQ, reads without quality get fake_quality throughout.

    Without it a FASTA source is refused at once, and single reads without quality end the run when written.
    """
    if to == FASTA:
        return df.withColumn("qual", F.lit(None).cast("string"))
    if fake_quality is None:
        if source == FASTA:
            raise BadArgument("FASTA has no quality: give a fake quality to write FASTQ")
        return df
    if not 0 <= fake_quality <= 255:
        raise BadArgument("a fake quality is from 0 to 255")
    return df.withColumn("qual", F.coalesce("qual", F.repeat(F.lit(chr(min(fake_quality + 33, 255))), F.length("seq"))))


def converted(df: DataFrame, to: str, fake_quality: int | None = None, source: str | None = None) -> DataFrame:
    """input_idx, ord and the text of each record."""
    rows = convert_reads(df, to, fake_quality, source)
    return rows.select("input_idx", "ord", (fasta_lines() if to == FASTA else fastq_lines()).alias("value"))
