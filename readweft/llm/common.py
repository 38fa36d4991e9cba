"""What the operators share: tables, written intermediate results, components, streams of groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and \x09 to \x0D.
WHITE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary one only where it is unset and driver
    and executors are one process."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="readweft-"))
        top = sc.getCheckpointDir()
    return f"{top.rstrip('/')}/readweft-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(conf).delete(to, True)


def boxed(df: DataFrame, **columns) -> DataFrame:
    """_row with all columns of df, and columns of an operator's own: whatever names df has, they do not clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(c.alias(k) for k, c in columns.items()))


def unboxed(df: DataFrame, **columns) -> DataFrame:
    """The columns in _row, then the given ones; these take the place of equal names."""
    names = [c for c in df.schema["_row"].dataType.names if c.lower() not in {k.lower() for k in columns}]
    return df.select(*(F.col("_row").getField(c).alias(c) for c in names), *(c.alias(k) for k, c in columns.items()))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most so many rows, so that batches of long texts stay small on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def one_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with one row a key: the least value of keys that repeat. Where none does, which a look at the keys alone
    tells, the rows are as they are and nothing else is shuffled."""
    df = df.select(key, value)
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return df
    return df.groupBy(key).agg(F.min(value).alias(value))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b: long); component is the smallest node that can be reached.

    Alternates large-star and small-star (Kiveris et al., 2014). Every step is an aggregate to one minimum a
    node and an equi-join with it, so that a node with very many edges is no group that one task must hold.
    """
    now = written(
        edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), folder, "edges"
    )  # u < v
    sums = (F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    was = now.agg(*sums).first()
    for _ in range(rounds):
        if was["n"] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), "v").unionByName(joined.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")))
        old, now = now, written(small.distinct(), folder, "edges")
        removed(old)
        got = now.agg(*sums).first()
        if got == was:
            break
        was = got
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
