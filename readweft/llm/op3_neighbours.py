"""Approximate nearest neighbours: an HNSW graph for each shard, flat neighbour arrays in a table, merged results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_per_id, shuffle_partitions, table, work_folder, written
from .hnsw import EF_SEARCH, Graph

#: Vectors of a shard (2 KB each while it is built), queries of a block, and blocks that share a copy of a shard.
SHARD_ROWS, BLOCK_ROWS, BLOCKS = 8192, 512, 32
K, EVERY = 5, 50
#: Classes of equal vectors that a shard's search returns for each query before the exact scores decide.
SPARE = 8

_INDEX = "dim int, shard int, sizes array<int>, ids array<long>, x binary, links array<binary>"
_FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: no null, non-finite component, zero or empty vector, null id."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)


def _matrix(lists: pa.Array) -> np.ndarray:
    """float64 rows of a list array whose lists are equally long."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products along the last axis, added one after another, so that scores do not depend on the machine."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("first", "ascending")])
    members = rows.column("ids").combine_chunks()
    x = _matrix(rows.column("embedding").combine_chunks())
    links = Graph(_unit(x)).flat()
    return pa.table(
        {
            "dim": pa.array([x.shape[1]], pa.int32()),
            "shard": pa.array(rows.column("shard").slice(0, 1).to_pylist(), pa.int32()),
            "sizes": pa.array([members.value_lengths().to_pylist()], pa.list_(pa.int32())),
            "ids": pa.array([members.flatten().to_pylist()], pa.list_(pa.int64())),
            "x": pa.array([x.astype(np.float64 if pa.types.is_float64(rows.schema.field("embedding").type.value_type) else np.float32).tobytes()], pa.binary()),
            "links": pa.array([[a.tobytes() for a in links]], pa.list_(pa.binary())),
        }
    )


def index(vectors: DataFrame, folder: str, shard_rows: int = SHARD_ROWS, members: int = K + 1) -> DataFrame:
    """A row for each shard of the valid vectors: the ids of each distinct vector, the vectors and the neighbour arrays.

    Equal vectors are one node with its smallest ids, as many as a result can hold: more copies of a vector change no
    result and would fill the graph with ties.
    """
    by = W.partitionBy("embedding").orderBy("vec_id")
    nodes = vectors.withColumn("k", F.row_number().over(by)).where(F.col("k") <= members)
    nodes = nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumn("first", F.element_at("ids", 1)).withColumn("dim", F.size("embedding")), folder, "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int")).drop("shards")
    dealt = dealt.repartition(shuffle_partitions(vectors.sparkSession), "dim", "shard")  # a graph costs more than its bytes tell
    return written(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX), folder, "index")


def _search(k: int, ef: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = graph = None
        for b in batches:
            for row in range(b.num_rows):
                at = lambda c: b.column(c)[row]  # noqa: E731, B023
                if at("kind").as_py() == 0:
                    key = (at("dim").as_py(), at("shard").as_py())
                    sizes, raw = np.array(at("sizes").as_py()), at("x").as_py()
                    kind = np.float32 if len(raw) == 4 * len(sizes) * key[0] else np.float64
                    x = np.frombuffer(raw, kind).reshape(-1, key[0]).astype(np.float64)
                    ids, ends = np.array(at("ids").as_py()), np.cumsum(sizes)
                    links = [np.frombuffer(z, np.int32).reshape(len(x), -1) for z in at("links").as_py()]
                    graph = Graph.of(_unit(x), links)
                    norm = np.sqrt(_dot(x, x))
                    continue
                q_ids, q = np.array(at("q_ids").as_py()), _matrix(at("qs").values)
                near = graph.search(_unit(q), k + 1 + SPARE, ef)
                exact = _dot(x[np.maximum(near, 0)], q[:, None]) / (norm[np.maximum(near, 0)] * np.sqrt(_dot(q, q))[:, None])
                out = []
                for own, nodes, scores in zip(q_ids.tolist(), near.tolist(), exact.tolist(), strict=True):
                    found = [(-s, v) for n, s in zip(nodes, scores, strict=True) if n >= 0 for v in ids[ends[n] - sizes[n] : ends[n]].tolist() if v != own]
                    out += [(own, v, -s) for s, v in sorted(found)[:k]]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH * 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors found nearest to each row of queries, but itself.

    vectors and queries have vec_id and embedding; rows that valid() drops take no part, and vectors of another length
    are no candidates. The score is the cosine in double precision on the original vectors; ties go to smaller ids.
    Each shard is walked by blocks of queries; a shard with many blocks is read by several tasks. An id that repeats has
    one vector, the least of its valid ones by the order of arrays. Other columns are not read; no valid vectors or
    queries give no rows.
    """
    folder = work_folder(vectors.sparkSession)
    n = shuffle_partitions(vectors.sparkSession)
    own = index(one_per_id(valid(vectors), "vec_id", "embedding"), folder, shard_rows, k + 1)
    asked = one_per_id(valid(queries), "vec_id", "embedding").withColumn("dim", F.size("embedding"))
    asked = written(asked, folder, "queries")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    salts = F.ceil(F.col("blocks") / BLOCKS).cast("int")
    packs = (
        asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        .groupBy("dim", "block", salts.alias("salts")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
        .select("dim", F.pmod("block", "salts").cast("int").alias("salt"), F.col("q.vec_id").alias("q_ids"), F.col("q.embedding").alias("qs"))
        .join(own.select("dim", "shard"), "dim")
        .select("dim", "shard", "salt", F.lit(1).alias("kind"), "q_ids", "qs")
    )
    heads = own.join(blocks, "dim").select(*own.columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).withColumn("kind", F.lit(0))
    walked = (
        heads.unionByName(packs, allowMissingColumns=True)
        .repartition(n, "dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "kind")
        .mapInArrow(_search(k, ef), _FOUND)
    )
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return walked.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all other embeddings for every embedding whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


#: The exact answer. The query gives it wherever its graphs find all of the 5 nearest.
SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
  GROUP BY ALL
), x AS (SELECT vec_id, e::DOUBLE[] AS e, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS norm FROM v),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.e AS q, c.e AS c, q.norm * c.norm AS norms FROM x q JOIN x c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), scores AS (SELECT query_id, vec_id, list_dot_product(q, c) / norms AS score FROM pairs),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
