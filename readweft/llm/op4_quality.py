"""Quality rules: base rules and an isolation forest on rule statistics, its threshold calibrated on labelled rows."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, small_batches, table

#: Columns of stats(), in this order.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: At most so many labelled rows, those of the smallest hashes, fit the forest and calibrate its threshold.
SAMPLE = 6000
TREES, SUBSAMPLE, DEPTH = 100, 256, 16
#: Share of the labelled good rows that the threshold may reject at most.
GOOD_LOST = 0.003
MIN_WORDS, MAX_REPEAT = 50, 50
#: Words are coded per slice of so many bytes of text.
SLICE_BYTES = 4_000_000
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!?#*$%&|<>{}[]~^"


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


_IS = np.stack([_kind(x) for x in (WHITE.encode(), _SYMBOLS, bytes(range(65, 91)), b"0123456789", _MARKS, bytes(range(128, 192)))], 1)


def _repeats(codes: np.ndarray) -> int:
    """Positions covered by windows of three words that occur at least twice; codes are under 2 ** 21."""
    if len(codes) < 4:
        return 0
    c = codes.astype(np.uint64)
    key = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(c), bool)
    for k in range(3):
        covered[k : len(key) + k] |= twice
    return int(covered.sum())


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words) of a string array: words `[^\\x20\\x09-\\x0D]+`; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, full = lists.flatten(), None
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return before[offsets], flat.filter(pa.array(full))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most SLICE_BYTES of text, or of one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(size):
        if k > start and held + n > SLICE_BYTES:
            yield start, k
            start, held = k, 0
        held += int(n)
    if start < len(size):
        yield start, len(size)


def stats(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    for i, j in slices(texts):
        part = texts.slice(i, j - i)
        at, words = words_of(part)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        wide = len(coded.dictionary) >= 1 << 21
        for k, text in enumerate(part.to_pylist()):
            row = out[i + k]
            if not text:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            n_white, n_symbols, n_upper, n_digits, n_marks, n_tail = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _IS
            own = codes[at[k] : at[k + 1]]
            lines = [x for x in text.split("\n") if x.strip(WHITE)]
            distinct = len(np.unique(own))
            if wide:  # one very long text: codes of its own, and windows as pairs of pairs
                own = np.unique(own, return_inverse=True)[1]
                repeats = _repeats(own) if distinct < 1 << 21 else _repeats_wide(own)
            else:
                repeats = _repeats(own)
            row[:] = (len(own), len(raw) - n_tail - n_white, n_symbols, len(lines) - len(set(lines)), repeats, len(lines), n_upper, n_digits, n_marks, distinct)
    return out


def _repeats_wide(codes: np.ndarray) -> int:
    """_repeats() for any codes."""
    n = int(codes.max()) + 1
    pair = np.unique(codes[:-1].astype(np.int64) * n + codes[1:], return_inverse=True)[1]
    three = np.unique(pair[:-1].astype(np.int64) * n + codes[2:], return_inverse=True, return_counts=True)
    twice = three[2][three[1]] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : len(twice) + k] |= twice
    return int(covered.sum())


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT * s[:, 0])


def features(s: np.ndarray) -> np.ndarray:
    """What the forest sees: shares, so that a long text is no anomaly as such."""
    n_words, chars, symbols, dup, _, lines, upper, _, marks, distinct = s.astype(np.float64).T
    words, chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    return np.log1p(100 * np.stack([symbols / words, marks / words, upper / chars, dup / np.maximum(lines, 1), 1 - distinct / words], 1))


@dataclass
class Forest:
    """Isolation trees as flat arrays: feature (-1 at leaves), cut, left child (the right one follows it) and path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float
    depth: int
    threshold: float = math.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / c(n)): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, cut, left, length in zip(self.feature, self.cut, self.left, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = f[at]
                inner = k >= 0
                at = np.where(inner, left[at] + (x[rows, np.maximum(k, 0)] >= cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.norm)


def _c(n: float) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, top: np.ndarray, seed: int = 7) -> Forest | None:
    """Isolation trees (Liu, Ting and Zhou, 2008) over random subsamples of x; features run from 0 to top.

    A node splits its cell, not the range of its rows, at a random place: rows of a kind that x lacks fall into empty
    cells after a few splits, however far from x they are.
    """
    if len(x) < 2:
        return None
    rng, n = np.random.default_rng(seed), min(SUBSAMPLE, len(x))
    made = []
    for _ in range(TREES):
        feature, cut, left, length = [], [], [], []

        def node(f: int, c: float, n_path: float, lists=(feature, cut, left, length)) -> None:
            for to, v in zip(lists, (f, c, 0, n_path), strict=True):
                to.append(v)

        node(-1, 0.0, 0.0)
        todo = [(0, x[rng.choice(len(x), n, replace=False)], np.zeros(x.shape[1]), top.astype(float), 0)]
        while todo:
            at, own, low, high, d = todo.pop()
            if len(own) < 2 or d == DEPTH:
                length[at] = d + _c(len(own))
                continue
            k = int(rng.integers(x.shape[1]))
            c = rng.uniform(low[k], high[k])
            right = own[:, k] >= c
            feature[at], cut[at], left[at] = k, c, len(feature)
            below, above = high.copy(), low.copy()
            below[k] = above[k] = c
            todo += [(len(feature), own[~right], low, below, d + 1), (len(feature) + 1, own[right], above, high, d + 1)]
            node(-1, 0.0, 0.0)
            node(-1, 0.0, 0.0)
        made.append([np.array(v) for v in (feature, cut, left, length)])
    size = max(len(t[0]) for t in made)
    flat = [np.stack([np.pad(t[k], (0, size - len(t[k]))) for t in made]) for k in range(4)]
    return Forest(*flat, norm=_c(n), depth=DEPTH)


def calibrated(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Forest | None:
    """A forest fitted on the good rows (on all where none is), and the threshold of the best balanced accuracy that
    rejects at most GOOD_LOST of the good rows; half of the rows fit it and the other half calibrate it."""
    if not good.any():
        return None
    half = np.arange(len(x)) % 2 == 0
    forest = fit_forest(x[good & half] if (good & half).sum() >= 2 else x[good], x.max(0), seed)
    if forest is None:
        return None
    score = forest.scores(x)
    own, bad = np.sort(score[good]), score[~good]
    cuts = np.unique(score)
    lost = 1 - np.searchsorted(own, cuts, side="right") / len(own)
    cuts, lost = cuts[lost <= GOOD_LOST], lost[lost <= GOOD_LOST]
    caught = 1 - np.searchsorted(np.sort(bad), cuts, side="right") / max(len(bad), 1)
    best = np.flatnonzero(caught - lost == (caught - lost).max())[-1]
    above = cuts[best]
    # half way to the next score above it, so that what equals a labelled good row is not on the edge
    after = np.concatenate([cuts[best + 1 :], np.sort(score[score > above])])
    forest.threshold = float((above + after.min()) / 2) if len(after) else math.inf
    return forest


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, quality): the labelled rows of the limit labels of docs with the smallest hashes of their ids.

    Labels without a quality or a document do not count, those that repeat count once; the bound is on labels that have
    a document. Only ids are shuffled to find them, and at most limit rows are broadcast."""
    fine = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").distinct()
    picked = fine.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")


def _with_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = stats(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(list(s), pa.list_(pa.int64()))], ["doc_id", "quality", "s"]
        )


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Forest | None:
    """The forest of the labelled rows among docs; None, with a warning, without two good ones that the base rules keep:
    these rules alone judge then. At most limit rows of ten numbers reach the driver: of documents that repeat an id those
    with the least numbers."""
    small_batches(docs.sparkSession)
    found = labelled(docs, labels, limit).mapInArrow(_with_stats, "doc_id long, quality int, s array<long>")
    rows = found.groupBy("doc_id", "quality").agg(F.min("s").alias("s")).orderBy("doc_id", "quality").collect()
    forest = None
    if rows:
        s, good = np.array([r["s"] for r in rows], np.int64), np.array([r["quality"] > 0 for r in rows])
        passed = ~base_failed(s)
        forest = calibrated(features(s[passed]), good[passed])
    if forest is None:
        warnings.warn("too few labelled documents for a forest: the base rules alone judge", stacklevel=2)
    return forest


def verdicts(s: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) for rows of stats()."""
    failed = base_failed(s)
    keep = ~failed
    if forest is not None and keep.any():
        keep[keep] = forest.scores(features(s[keep])) <= forest.threshold
    return failed, keep


def judged(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id and its statistics and verdict, a row for each row of docs, repeated ones too. Null and empty texts have no
    words and fail; long texts are read whole; null ids stay; a score that ties with the threshold is kept. Other columns
    are not read, and an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = stats(b.column("text"))
            failed, keep = verdicts(s, forest)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(s[:, k]) for k in range(5)), pa.array(failed), pa.array(keep)], ["doc_id", *STATS[:5], "base_failed", "kept"]
            )

    small_batches(docs.sparkSession)
    kinds = ", ".join(f"{x} long" for x in STATS[:5])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, kept boolean")


def kept(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """The rows of docs that pass, all their columns as they are, whatever their names; nulls, ties, repeated rows and long
    texts as for judged()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdicts(stats(b.column(text)), forest)[1]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
