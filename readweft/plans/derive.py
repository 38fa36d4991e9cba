"""Reads derived from the documents table: its source is the file and its doc_id the place, so that every operator has
a relation that both Spark and SQL can make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder
from ..sources import write_reads

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What letters become as bases and as qualities.
BASES, MARKS = "ACGTACGTACGTACGTGCATGCATNA", "!5?+#/:DBF%<@;=EHC>8I9G6AJ"


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents become RNA, Spanish ones lower case, French ones have no quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a small table in one row group is one task: deal its rows out before the work
        docs = docs.repartition(cores, "doc_id")
    t = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    bases = F.translate(t, LETTERS, BASES)
    seq = F.when(F.col("lang") == "de", F.translate(bases, "T", "U")).when(F.col("lang") == "es", F.lower(bases)).otherwise(bases)
    qual = F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.translate(F.reverse(t), LETTERS, MARKS))
    return docs.select(
        F.lit(0).alias("input_idx"), F.col("source").alias("file"), F.when(F.col("lang") == "fr", "FASTA").otherwise("FASTQ").alias("format"),
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("desc"), seq.alias("seq"), qual.alias("qual"),
    )


def stored(df: DataFrame, fmt: str, zipped: bool) -> list[str]:
    """The files of reads that are written as text to a new folder."""
    sc = df.sparkSession.sparkContext
    folder = new_folder(df.sparkSession, "reads") + (".gz" if zipped else "")
    write_reads(df, folder, fmt, ordered=False)
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = (x.getPath() for x in path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path))
    own = [f.toUri() for f in files if f.getName().startswith("part-")]
    return sorted(u.getPath() if u.getScheme() in (None, "file") else u.toString() for u in own)


READS_SQL = f"""
t AS (SELECT doc_id, lang, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM documents),
s AS (SELECT *, translate(t, '{LETTERS}', '{BASES}') AS s FROM t),
reads AS (
  SELECT source AS file, CASE WHEN lang = 'fr' THEN 'FASTA' ELSE 'FASTQ' END AS format, doc_id AS ord, 'doc' || doc_id::VARCHAR AS id,
    CASE lang WHEN 'de' THEN translate(s, 'T', 'U') WHEN 'es' THEN lower(s) ELSE s END AS seq,
    CASE WHEN lang = 'fr' THEN NULL ELSE translate(reverse(t), '{LETTERS}', '{MARKS}') END AS qual
  FROM s)
"""
