"""Sharding by size-tiered compaction: arrivals become small immutable shards, runs of similar sizes are merged into
files of a target size, and every state is a versioned manifest that is committed atomically."""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import boxed, table, unboxed, work_folder

#: Bytes of text of a full shard; runs whose shards have half of it on average are never merged again.
TARGET = 64 << 20
#: A tier is merged once it has so many shards; the shards of tiers differ by this factor in size.
FAN = 4
#: Bytes up to which shards are of the lowest tier, and bytes that one merge takes.
LEAST, MOST = 1 << 20, 4 << 30
#: Merges that run at the same time.
AT_ONCE = 8
#: Names of runs that are broadcast at most, at about 100 bytes each; with more, rows are joined with them by a shuffle.
BROADCAST_RUNS = 100_000
#: Sizes of the query's arrivals, in 64ths of the table.
WEIGHTS = (16, 4, 1, 1, 4, 1, 1, 16, 4, 4, 4, 4, 4)


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """A folder with data/ (immutable shards) and manifests/ (one JSON file a version).

    A run is what one append or merge wrote: one or more shards. A version is committed by writing its manifest under a
    name of its own and giving the file the version's name in one step that fails if the version exists (a hard link on
    local file systems, FileContext.rename without overwriting elsewhere). Readers see a version whole or not at all, and
    files of jobs that failed belong to none. Every version can be read until expire() takes it away.
    """

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fan: int = FAN, least: int = LEAST, most: int = MOST):
        self.spark, self.folder, self.target, self.fan, self.least, self.most = spark, folder, target, fan, least, most
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        top = self.path(f"{self.folder}/manifests")
        if not self.fs.exists(top):
            return []
        names = (x.getPath().getName() for x in self.fs.listStatus(top))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, runs: [{name, bytes, rows, shards}]}; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self.fs.open(self.path(f"{self.folder}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> dict:
        """Publishes manifest as the version after the one that it was made from."""
        new = manifest | {"version": manifest["version"] + 1}
        own = self.path(f"{self.folder}/manifests/_{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        to = self.path(f"{self.folder}/manifests/v{new['version']:010d}.json")
        try:
            self._name(own, to)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {new['version']} exists") from None
        finally:
            self.fs.delete(own, False)
        return new

    def _name(self, own, to) -> None:
        """Gives the file own the name to, in one step that fails if it exists."""
        own, to = self.fs.makeQualified(own), self.fs.makeQualified(to)
        if to.toUri().getScheme() == "file":
            paths = self.jvm.java.nio.file.Paths
            self.jvm.java.nio.file.Files.createLink(paths.get(to.toUri()), paths.get(own.toUri()))
            return
        hadoop = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(own, to, none)

    def expire(self, keep: int = 1) -> None:
        """Takes away all versions but the newest keep ones, and the data that only they have. Readers of these must be done."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        needed = {r["name"] for v in new for r in self.manifest(v)["runs"]}
        gone = {r["name"] for v in old for r in self.manifest(v)["runs"]} - needed
        for v in old:
            self.fs.delete(self.path(f"{self.folder}/manifests/v{v:010d}.json"), False)
        for name in sorted(gone):
            self.fs.delete(self.path(f"{self.folder}/data/{name}"), True)

    # runs

    def shards(self, name: str) -> int:
        """The number of shards that a job wrote as a run."""
        return sum(x.getPath().getName().startswith("part-") for x in self.fs.listStatus(self.path(f"{self.folder}/data/{name}")))

    def tier(self, run: dict) -> int | None:
        """By the mean size of the run's shards: 0 up to LEAST bytes, one more for each factor of fan; None if full."""
        mean = run["bytes"] / max(run["shards"], 1)
        if 2 * mean >= self.target:
            return None
        return 0 if mean <= self.least else 1 + int(math.log(mean / self.least, self.fan))

    def staged(self, rows: DataFrame, arrival: str) -> dict[int, str]:
        """Writes the rows of several arrivals in one job, as small shards: arrival -> name of its run.

        Nothing is committed: append() publishes one run after another."""
        batch = uuid.uuid4().hex
        rows.write.partitionBy(arrival).parquet(f"{self.folder}/data/{batch}")
        found = (x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.folder}/data/{batch}")))
        return {int(n.rpartition("=")[2]): f"{batch}/{n}" for n in found if n.startswith(f"{arrival}=")}

    def append(self, manifest: dict, name: str, n_bytes: int, n_rows: int, schema) -> dict:
        """A manifest with one more run; not committed yet."""
        run = {"name": name, "bytes": n_bytes, "rows": n_rows, "shards": self.shards(name)}
        return manifest | {"schema": schema.json(), "runs": [*manifest["runs"], run]}

    def picks(self, manifest: dict) -> list[list[dict]]:
        """The runs to merge next, in groups that share no run: those of one tier, the oldest first, with fan shards at least
        and up to MOST bytes a group."""
        by: dict[int, list[dict]] = {}
        for r in manifest["runs"]:
            if (t := self.tier(r)) is not None:
                by.setdefault(t, []).append(r)
        groups: list[list[dict]] = []
        for t in sorted(by):
            made: list[list[dict]] = [[]]
            for r in by[t]:
                if made[-1] and sum(x["bytes"] for x in made[-1]) + r["bytes"] > self.most:
                    made.append([])
                made[-1].append(r)
            groups += [g for g in made if sum(r["shards"] for r in g) >= self.fan]
        return groups

    def merge(self, runs: list[dict], manifest: dict) -> dict:
        """The run of target-sized shards that can replace runs; not committed yet.

        Small files are put together without a shuffle: the scan packs them into partitions, and these are put
        together into as many tasks as there will be shards, so that TARGET is the size of shards in the mean. A merge
        always leaves fewer shards, so that merging ends.
        """
        n_bytes, name = sum(r["bytes"] for r in runs), uuid.uuid4().hex
        rows = self.spark.read.schema(self._schema(manifest)).parquet(*(f"{self.folder}/data/{r['name']}" for r in runs))
        rows.coalesce(max(1, math.ceil(n_bytes / self.target))).write.option("maxRecordsPerFile", 0).parquet(f"{self.folder}/data/{name}")
        return {"name": name, "bytes": n_bytes, "rows": sum(r["rows"] for r in runs), "shards": self.shards(name)}

    def compact(self) -> dict:
        """Merges until no tier has fan shards; the merges of a round run side by side and are committed as one version."""
        now = self.manifest()
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while groups := self.picks(now):
                made = list(pool.map(lambda g, now=now: self.merge(g, now), groups))
                gone = {r["name"] for g in groups for r in g}
                now = self.commit(now | {"runs": [*(r for r in now["runs"] if r["name"] not in gone), *made]})
        return now

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType([])

    def rows(self, version: int | None = None, run: str = "_run", shard: str = "_shard") -> DataFrame:
        """The rows of a version with run (its place in the manifest) and shard (the first part of the file's name); these
        take the place of columns of their names, all other columns are as they were appended."""
        m = self.manifest(version)
        names = self.spark.createDataFrame([(r["name"], k) for k, r in enumerate(m["runs"])], "name string, place int")
        if not m["runs"]:
            rows = boxed(self.spark.createDataFrame([], self._schema(m)), path=F.lit("")) if self._schema(m).fields else names.select(F.struct().alias("_row"), F.lit("").alias("path"))
        else:
            read = self.spark.read.schema(self._schema(m)).parquet(*(f"{self.folder}/data/{r['name']}" for r in m["runs"]))
            rows = boxed(read, path=read.metadataColumn("_metadata")["file_path"])
        names = F.broadcast(names) if len(m["runs"]) <= BROADCAST_RUNS else names
        own = F.regexp_extract("path", "/data/([^/]+(?:/[^/]+=[^/]*)?)/[^/]*$", 1)
        return unboxed(rows.withColumn("name", own).join(names, "name"), **{run: F.col("place"), shard: F.regexp_extract("path", "/(part-[0-9]+)[^/]*$", 1)})


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as arrivals of several sizes, appended and compacted one after another: every row of the last version
    with its run and its shard.

    Null and empty texts count no bytes, long ones all of theirs; null ids are one arrival; repeated rows are kept; an empty
    table makes no run and no rows. Runs, shards and sizes are the same each time, file names are not.
    """
    docs = table(spark, sf_dir, "documents")
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(sum(WEIGHTS)))
    arrival = F.coalesce(*(F.when(share < sum(WEIGHTS[: k + 1]), k) for k in range(len(WEIGHTS))))
    name = f"arrival_{uuid.uuid4().hex}"
    rows = docs.withColumn(name, arrival)
    store = Store(spark, work_folder(spark))
    sums = rows.groupBy(name).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    names = store.staged(rows, name)
    for r in sorted(sums):
        store.commit(store.append(store.manifest(), names[r[name]], int(r["b"]), int(r["n"]), docs.schema))
        store.compact()
        store.expire()
    m = store.manifest()
    if not m["runs"]:
        return docs.select("doc_id", F.lit(0).alias("run"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("n_bytes")).limit(0)
    return store.rows().select("doc_id", F.col("_run").alias("run"), F.col("_shard").alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
