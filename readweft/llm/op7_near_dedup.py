"""MinHash near-dedup: band candidates, estimates from b-bit signatures, links confirmed on the full shingle sets, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, components, shuffle_partitions, small_batches, table, unboxed, work_folder, written
from .op4_quality import slices, words_of

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 32 bands of 4 minima: a pair at a similarity of 0.75 is missed by all bands with a probability of 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signatures, of texts that share a band only: so many minima, of which BITS low bits are kept.
SIGNED, BITS = 2048, 2
#: Candidates whose corrected estimate is this far below the bound are dropped: 4.6 standard errors (0.0115 each).
MARGIN = 0.053
#: Members that share a copy of their group's centre, and rows of a bucket that are compared with others at once.
PER_TASK, BLOCK = 256, 512

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, HASHES + SIGNED, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES + SIGNED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct 64-bit hashes of the shingles of each whole text, A-Z lower-cased.

    Shorter texts have their whole sequence of words as the one shingle, those without words have none.
    """
    at, flat = words_of(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    own = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    word = np.array(own, np.uint64)[coded.indices.to_numpy()] if own else np.zeros(0, np.uint64)
    n = np.diff(at)
    h = word[: max(0, len(word) - words + 1)].copy()
    for k in range(1, words):
        h = h * _P + word[k : k + len(h)]
    h = _mixed(h)
    sets = []
    for start, count in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if count >= words:
            x = np.sort(h[start : start + count - words + 1])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif count:
            v = np.array([count], np.uint64)
            for k in range(start, start + count):
                v = v * _P + word[k]
            x = _mixed(v)
        else:
            x = h[:0]
        sets.append(x)
    offsets = np.cumsum([0, *map(len, sets)])
    return offsets, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def minima(offsets: np.ndarray, hashes: np.ndarray, first: int = 0, count: int = HASHES) -> np.ndarray:
    """A row of minima under count hash functions, from number first on, for each set; sets must not be empty."""
    x, out = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((count, len(offsets) - 1), np.uint32)
    v = np.empty_like(x)
    for k in range(count):
        np.bitwise_xor(x, _XOR[first + k], out=v)
        np.multiply(v, _MUL[first + k], out=v)
        out[k] = np.minimum.reduceat(v, offsets[:-1])
    return out.T


def packed(low: np.ndarray) -> np.ndarray:
    """The BITS low bits of (mixed) minima as bit planes: SIGNED / 64 words a plane."""
    low = low ^ (low >> np.uint32(16))
    planes = [np.packbits(np.ascontiguousarray((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1).view("<u8") for b in range(BITS)]
    return np.concatenate(planes, 1)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarities of rows of signatures (which broadcast), corrected for minima that differ and share their low bits."""
    words = SIGNED // 64
    differ = a[..., :words] ^ b[..., :words]
    for p in range(1, BITS):
        differ |= a[..., p * words : (p + 1) * words] ^ b[..., p * words : (p + 1) * words]
    equal = 1 - np.bitwise_count(differ).sum(-1, dtype=np.int64) / SIGNED
    return (equal - 0.5**BITS) / (1 - 0.5**BITS)


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def band_keys(m: np.ndarray) -> np.ndarray:
    pairs = np.ascontiguousarray(m).view("<u8").reshape(len(m), BANDS, ROWS // 2)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _P
    for k in range(ROWS // 2):
        key = _mixed((key ^ pairs[:, :, k]) * _P)
    return key.view(np.int64)


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, ids = b.column("text"), b.column("doc_id")
        for i, j in slices(texts):
            offsets, hashes = shingle_sets(texts.slice(i, j - i))
            n = np.diff(offsets)
            full, keys = np.flatnonzero(n), np.zeros((0, BANDS), np.int64)
            if len(full):
                keys = band_keys(minima(np.concatenate([offsets[:-1][full], offsets[-1:]]), hashes))
            own = ids.slice(i, j - i)
            digest = [
                hashlib.blake2b(hashes[a:z].tobytes(), digest_size=16).digest() if z > a else b"empty %s" % str(k).encode()
                for a, z, k in zip(offsets[:-1], offsets[1:], own.to_pylist(), strict=True)
            ]
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(digest, pa.binary()), bands], ["doc_id", "n", "digest", "bands"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, ids = b.column("text"), b.column("id")
        for i, j in slices(texts):
            offsets, hashes = shingle_sets(texts.slice(i, j - i))
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            if len(full):
                ends = np.concatenate([offsets[:-1][full], offsets[-1:]])
                both = [packed(minima(ends, hashes, HASHES, SIGNED)), band_keys(minima(ends, hashes))]
                own = ids.slice(i, j - i).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([own, pa.array(n[full]), *(pa.array([x.tobytes() for x in rows], pa.binary()) for rows in both)], ["id", "n", "sig", "bands"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of along(): the pairs whose sizes and estimate allow a link, with the estimate."""
    held = key = None
    for batch in batches:
        sig, n = _signatures(batch.column("sig")), batch.column("n").to_pylist()
        out = []
        for k, (a, salt, member, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "b")), strict=True)):
            if member == 0:
                held, key = (sig[k].copy(), n[k]), (a, salt)
            elif key == (a, salt) and _sizes_fit(n[k], held[1]):
                near = float(estimates(held[0], sig[k]))
                if near >= PERCENT / 100 - MARGIN:
                    out.append((a, b, near))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "near"])


def _compare(best: bool):
    """Rows (key, block, query, rep, comp, major, n, sig, bands) in order: those of a block (query 0), then the queries
    that are compared with it. Yields the pairs of different components that may be linked: with best, the best one of
    each query; else all, each in the first band that both have, and once if both are queries."""

    def pairs(key: int, block: list[np.ndarray], query: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        b_rep, b_comp, b_n, b_major, b_sig, b_bands = block
        for k in range(0, len(query[0]), 64):
            rep, comp, n, _, sig, bands = (c[k : k + 64] for c in query)
            fit = (comp[:, None] != b_comp) & _sizes_fit(n[:, None], b_n)
            if not best:
                fit &= (b_comp == b_major) | (rep[:, None] < b_rep)
            x, y = np.nonzero(fit)
            if not len(x):
                continue
            near = np.concatenate([estimates(sig[x[i : i + 4096]], b_sig[y[i : i + 4096]]) for i in range(0, len(x), 4096)])
            good = near >= PERCENT / 100 - MARGIN
            x, y, near = x[good], y[good], near[good]
            if best and len(x):
                order = np.lexsort((-near, x))
                first = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])]
                x, y, near = x[first], y[first], near[first]
            elif len(x):
                same = bands[x] == b_bands[y]
                here = bands[x, same.argmax(1)].view(np.int64) == key
                x, y, near = x[here], y[here], near[here]
            if len(x):
                yield rep[x], b_rep[y], near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            place = np.stack([batch.column("key").to_numpy(), batch.column("block").to_numpy(), batch.column("query").to_numpy()], 1)
            cols = [batch.column(c).to_numpy() for c in ("rep", "comp", "n", "major")] + [_signatures(batch.column(c)) for c in ("sig", "bands")]
            edges = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            found = []
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(place)], strict=True):
                if a == z:
                    continue
                own, is_query = tuple(place[a, :2]), place[a, 2]
                part = [c[a:z] for c in cols]
                if not is_query:
                    block = [np.concatenate([x, y]) for x, y in zip(block, part, strict=True)] if key == own else [c.copy() for c in part]
                    key = own
                elif key == own:
                    found += pairs(int(own[0]), block, part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["a", "b", "near"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, member, b, text) in order: the row with member 0 has a's own text, those after it are compared."""
    held, key = None, None
    for batch in batches:
        texts = batch.column("text")
        out_a, out_b = [], []
        for i, j in slices(texts):
            offsets, hashes = shingle_sets(texts.slice(i, j - i))
            part = batch.slice(i, j - i)
            for k, (a, salt, member, b) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "salt", "member", "b")), strict=True)):
                own = hashes[offsets[k] : offsets[k + 1]]
                if member == 0:
                    held, key = own.copy(), (a, salt)
                elif key == (a, salt) and len(own) and len(held):
                    at = np.searchsorted(held, own)
                    at[at == len(held)] = 0
                    both = int((held[at] == own).sum())
                    if 100 * both >= PERCENT * (len(held) + len(own) - both):
                        out_a.append(a)
                        out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def along(pairs: DataFrame, items: DataFrame, *payload: str) -> DataFrame:
    """For each a of pairs (a, b), in order: a row with the payload of item a (member 0), then one for each b.

    Pairs of one a share a copy of it for each PER_TASK of them; more go to other tasks by salt."""
    groups = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / PER_TASK).cast("int").alias("salts"))
    items = items.select("id", *payload)
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(items, F.col("a") == F.col("id"))
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(items, F.col("b") == F.col("id"))
    rows = heads.select("a", "salt", F.lit(0).alias("member"), F.col("a").alias("b"), *payload).unionByName(members.select("a", "salt", F.lit(1).alias("member"), "b", *payload))
    return rows.repartition(shuffle_partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    return along(pairs, texts, "text").mapInArrow(_confirm, "a long, b long")


def compared(buckets: DataFrame, part: DataFrame, sig: DataFrame, folder: str, best: bool) -> DataFrame:
    """(a, b, near): pairs of one bucket and of different components that may be linked.

    Every class outside the largest component of its bucket is compared with the whole bucket, in blocks; pairs within
    a component and within the largest one are not looked at. No rows are made for pairs that the estimate excludes.
    """
    placed = buckets.join(part, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    counts = written(placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")), folder, "counts")
    mixed = counts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by("comp", F.struct("m", "comp")).alias("major"), F.sum("m").alias("all"))
    mixed = written(mixed.where("k > 1").select("key", "major", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")), folder, "mixed")
    rows = written(placed.join(mixed, "key"), folder, "open").join(sig, F.col("rep") == F.col("id"))
    whole = rows.withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "query": F.lit(0)})
    queries = rows.where("comp <> major").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "query": F.lit(1)})
    names = ["key", "block", "query", "rep", "comp", "major", "n", "sig", "bands"]
    dealt = whole.select(*names).unionByName(queries.select(*names)).repartition(shuffle_partitions(buckets.sparkSession), "key", "block")
    return dealt.sortWithinPartitions("key", "block", "query").mapInArrow(_compare(best), "a long, b long, near double")


def united(part: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """part (node, component) after more links (a, b)."""
    of_a, of_b = (part.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_c")) for x in "ab")
    lifted = links.join(of_a, F.col("a") == F.col("a_node"), "left").join(of_b, F.col("b") == F.col("b_node"), "left")
    top = written(components(lifted.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")), folder), folder, "top")
    moved = part.join(top.withColumnsRenamed({"node": "t", "component": "top"}), F.col("component") == F.col("t"), "left")
    moved = moved.select("node", F.coalesce("top", "component").alias("component"))
    new = top.join(part.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
    return written(moved.unionByName(new), folder, "part")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs (doc_id, text).

    1. Texts with equal sets are one class, represented by its smallest doc_id; only classes go on.
    2. In each band bucket the class of the smallest id is a star's centre; each class confirms its best estimated
       centre on the full sets. Components of the links are found.
    3. In buckets that hold several components, each class outside the bucket's largest one confirms its best
       estimated candidate of other components; components are found again.
    4. What then still may be linked across components is confirmed pair by pair. Pairs within a component are never
       made: they cannot change the result. So each band candidate is confirmed, refuted by its estimate or sets, or
       within one component, however large the bucket.

    Null and empty texts have n_shingles 0 and are linked with nothing. Repeated rows get equal rows; rows that share
    a doc_id count as one node. A null doc_id is linked by equal sets only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    banded = written(docs.mapInArrow(_band, "doc_id long, n long, digest binary, bands array<long>"), folder, "banded")
    classes = written(banded.groupBy("digest").agg(F.min("doc_id").alias("rep")), folder, "classes")
    rows = banded.where("n > 0").join(classes, "digest").where("doc_id = rep").select("rep", F.explode("bands").alias("key"))
    shared = written(rows.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("other")).where("lead < other").drop("other"), folder, "shared")
    buckets = written(rows.join(shared, "key").distinct(), folder, "buckets")
    wanted = buckets.select("rep").distinct()
    texts = docs.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "id")
    texts = written(texts, folder, "texts")
    sig = written(texts.mapInArrow(_sign, "id long, n long, sig binary, bands binary"), folder, "signatures")
    stars = written(buckets.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), folder, "stars")

    def best(near: DataFrame, of: str, other: str, name: str) -> DataFrame:
        chosen = near.groupBy(F.col(of).alias("b")).agg(F.max_by(other, F.struct("near", -F.col(other))).alias("a"))
        return written(chosen.select("a", "b"), folder, name)

    first = best(along(stars, sig, "n", "sig").mapInArrow(_estimate, "a long, b long, near double"), "b", "a", "first")
    part = written(components(confirmed(first, texts), folder), folder, "part")
    second = best(compared(buckets.where(F.pmod("key", F.lit(2)) == 0), part, sig, folder, True), "a", "b", "second")
    part = united(part, confirmed(second, texts), folder)
    tested = first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = compared(buckets, part, sig, folder, False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = written(left.join(tested, ["a", "b"], "left_anti"), folder, "left")
    part = united(part, confirmed(left, texts), folder)
    # classes are placed first, so that the rows, of which very many may be copies of one text, are shuffled once
    placed = classes.join(part, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        banded.select("doc_id", "n", "digest")
        .join(placed, "digest")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row for each component of docs, the one of its smallest doc_id, with all its columns as they are.

    Rows that repeat a doc_id leave one row. Rows with a null doc_id can't be told apart and all stay.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("g")).distinct()
    rows = boxed(docs, i=F.col("doc_id").cast("long"))
    left = rows.where("i is not null").join(gone, F.col("i") == F.col("g"), "left_anti").dropDuplicates(["i"])
    return unboxed(left.unionByName(rows.where("i is null")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component, w.doc_id) AS component_id, coalesce(least.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.node = w.doc_id
"""
