"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing and tokens, stage by stage.

Each stage works on all that the one before it kept, is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweft.llm import op1_mixing, op4_quality, op6_bpe, op7_near_dedup, op9_line_dedup
from readweft.llm.common import boxed, small_batches, table, unboxed, work_folder, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules and the isolation forest keep, with all their columns.

    Null, empty and short texts fail the rules; long ones are read whole; repeated rows are judged alike and each stay;
    a score equal to the threshold is kept; null ids count as unlabelled. An empty table gives an empty one."""
    return op4_quality.kept(docs, op4_quality.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row without the boilerplate lines of its source; n_chars follows a text that changed, all else stays.

    Null texts and rows of null sources stay as they are; long texts are read whole; repeated rows count as pages of their
    own; a line at the ratio itself stays. Columns of any name are kept; an empty table gives an empty one."""
    found = op9_line_dedup.cleaned(boxed(docs), "_row.source", "_row.text")
    n = F.when(F.col("_dropped") > 0, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))
    return unboxed(found, text=F.col("_text"), n_chars=n).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near-duplicates, with all its columns.

    Null texts, and texts without words, are linked with nothing and stay; short texts are linked if they have the same
    words, long ones by all of theirs; one of several rows with one id stays. An empty table gives an empty one."""
    return op7_near_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture reads, with all columns; a row that is read in two epochs comes twice.

    Null languages and sources are leaves of their own; null and empty texts cost nothing and are read with their leaf;
    long texts count all their words; ties of the order go by id and tokens; repeated rows are rows of their own. Columns
    of any name are kept; an empty table gives an empty one."""
    rows = boxed(docs, doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"), n=op1_mixing.n_tokens("text"))
    return op1_mixing.mixed(rows, "n").select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row: doc_id, lang, source, n_tokens, ids and digests.

    Null texts count as empty, long ones are encoded whole, repeated rows each have theirs; other columns are dropped,
    whatever their names. An empty table gives an empty one."""
    return op6_bpe.tokenised(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("bpe", tokens)]

#: The forest, the confirmed components and the tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
