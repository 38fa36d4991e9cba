"""The operators that look at one read at a time, over a stream of reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schema import READS


def appended_reads(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """A stream of the Parquet files of reads that arrive in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", max_files).parquet(folder)


def streamed(reads: DataFrame, folder: str, checkpoint: str, *steps: Callable[[DataFrame], DataFrame]):
    """Starts filter, grep, convert or proportional sampling (DataFrame -> DataFrame, without order or groups) on a
    stream and appends what comes out to a folder of Parquet files, each read once. Ends when all files are done."""
    for step in steps:
        reads = step(reads)
    return reads.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
