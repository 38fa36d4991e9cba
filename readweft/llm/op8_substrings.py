"""Substring dedup by collinear chaining: shared k-mer seeds, chains with gap costs, alignment of chains.

1. Each text gives its minimizers: k-mers of words whose hash is the least of a window. A seed that stands in several
   places is tied to the first of them (by doc_id, then place), found by an aggregate and an equi-join.
2. Ties of one pair of documents are chained in order of both texts: the best chain up to each tie comes from a
   Fenwick tree of prefix maxima.
3. The words between a chain's seeds are aligned and its ends extended; the alignment is cut where it falls too far, and
   each part that is long and alike is a result.
4. Exact runs are complete: where all inner seeds of MIN_WORDS words are shared, the run of MIN_WORDS words itself is a
   seed, tied to its first place in the table in the same way. Such ties side by side are chains without gaps.
5. A seed's place that no passage found so far links with the seed's first place is tied to all other places of the seed,
   and these ties are chained and aligned like the first ones. Two places that are linked with the same place are linked
   with each other and need no tie. Seeds of very many places are tied where another seed beside them is shared too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, one_per_id, shuffle_partitions, small_batches, table, work_folder, written
from .op4_quality import slices

KMER, WINDOW = 6, 6
#: A seed that comes again within so many words is no seed for chains.
NEARBY = 64
#: A chain's gain for a seed, and its cost for a word of either text between two seeds.
SEED_GAIN, GAP_COST = 8.0, 0.1
#: Passages have so many words in the document, and this share of them is equal.
MIN_WORDS, MIN_ALIKE = 50, 0.8
MIN_SEEDS = 2
#: Words beyond a chain that an extension may reach, and how far the score of a passage may fall within it.
REACH, DROP = 64, 50
#: Chains that one task aligns with one copy of the first document.
PER_TASK = 256
#: Seeds of more places are tied by pairs of seeds; rows of one such pair that one task holds.
COMMON, BLOCK = 64, 2048
#: Two ties that begin a chain are less than so many words apart, those of both texts together.
LINK = int(SEED_GAIN / GAP_COST)

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Kinds of a seed, in the low two bits of its place: the first of its hash in the document, a later one, one that comes
#: again within NEARBY words; and the whole text, with its number of words as its place.
FIRST, LATER, AGAIN, WHOLE = range(4)
_CHAIN = "doc long, ref long, start int, stop int, ref_start int, ref_stop int, at array<int>, ref_at array<int>"
_PASSAGE = "doc_id long, start_word int, end_word int, ref_doc_id long, ref_start_word int, ref_end_word int, n_equal int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[np.frombuffer(WHITE.encode(), np.uint8)] = False


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hashes) of the words of each text, A-Z lower-cased: polynomials of their bytes, summed over flat arrays."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    inside = _IS_WORD[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    opens[edges] = inside[edges]
    letters = _LOWER[raw[inside]].astype(np.uint64)
    first = np.flatnonzero(opens[inside])
    offsets = np.concatenate([[0], np.cumsum(opens)])[ends]
    if not len(first):
        return offsets, np.zeros(0, np.uint64)
    size = np.diff(np.append(first, len(letters)))
    power = np.full(int(size.max()), _P)
    power[0] = 1
    power = np.cumprod(power)
    value = (letters + np.uint64(1)) * power[np.arange(len(letters)) - np.repeat(first, size)]
    return offsets, _mixed(np.add.reduceat(value, first) + size.astype(np.uint64))


def _runs_of(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on (not mixed), by doubling."""
    made, size = {1: word}, 1
    while 2 * size <= k:
        own = made[size]
        made[2 * size] = own[: max(0, len(own) - size)] * _P ** np.uint64(size) + own[size:]
        size *= 2
    out, done, n = made[size], size, max(0, len(word) - k + 1)
    while done < k:
        size //= 2
        if done + size <= k:
            out = out[: max(0, len(made[size]) - done)] * _P ** np.uint64(size) + made[size][done:][: len(out)]
            done += size
    return out[:n]


def _least(h: np.ndarray, ok: np.ndarray, window: int) -> np.ndarray:
    """Where h is the least of a window that ok says may be looked at; ok: by the first place of a window."""

    def over(x: np.ndarray, pick) -> np.ndarray:
        size = 1
        while 2 * size <= window:
            x, size = pick(x[: max(0, len(x) - size)], x[size:]), 2 * size
        rest = window - size  # two windows of a power of two, overlapping
        return pick(x[: max(0, len(x) - rest)], x[rest:]) if rest else x

    if len(h) < window:
        return np.zeros(len(h), bool)
    least = np.where(ok[: len(h) - window + 1], over(h, np.minimum), np.uint64(0))
    wide = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return (over(wide, np.maximum) == h) & (h > 0)


def minimizers(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in word, hashes) of all texts' seeds: the k-mers that are the least of a window within their text.

    In runs of one k-mer only every WINDOW-th place is a seed."""
    h = _mixed(_runs_of(word, KMER))
    long = at[1:] - at[:-1] >= KMER + WINDOW - 1
    step = np.zeros(len(word) + 1, np.int32)
    np.add.at(step, at[:-1][long], 1)
    np.add.at(step, at[1:][long] - (KMER + WINDOW - 2), -1)
    place = np.flatnonzero(_least(h, np.cumsum(step)[: len(h)] > 0, WINDOW))
    got = h[place]
    goes_on = np.concatenate([[False], (got[1:] == got[:-1]) & (place[1:] == place[:-1] + 1)])[: len(got)]
    if goes_on.any():
        index = np.arange(len(got))
        thin = (index - np.maximum.accumulate(np.where(goes_on, 0, index))) % WINDOW == 0
        place, got = place[thin], got[thin]
    return place, got


def _kinds(text: np.ndarray, place: np.ndarray, got: np.ndarray) -> np.ndarray:
    """FIRST, LATER or AGAIN of each seed."""
    mixed = got ^ _mixed(text.astype(np.uint64) * _P)
    order = np.argsort(mixed, kind="stable")
    same = np.concatenate([[False], mixed[order[1:]] == mixed[order[:-1]]])[: len(order)]
    near = np.concatenate([[False], np.diff(place[order]) <= NEARBY])[: len(order)]
    out = np.empty(len(order), np.int32)
    out[order] = np.where(same, np.where(near, AGAIN, LATER), FIRST)
    return out


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, document, 4 * place + kind)."""
    for b in batches:
        texts, ids = b.column("text"), b.column("doc_id")
        for i, j in slices(texts):
            at, word = hashed_words(texts.slice(i, j - i))
            place, got = minimizers(word, at)
            text = np.searchsorted(at, place, "right") - 1
            size = np.diff(at)
            fine = size >= MIN_ALIKE * MIN_WORDS
            at_kind = (place - at[text]).astype(np.int32) * 4 + _kinds(text, place, got)
            keep = fine[text]
            whole = np.flatnonzero(size >= MIN_WORDS)
            turn = np.arange(len(word), dtype=np.uint64) - np.repeat(at[:-1], size).astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed((word + turn * _P) * _Q))])
            digest = _mixed(sums[at[whole + 1]] - sums[at[whole]] + np.uint64(WHOLE))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([got[keep], digest]).view(np.int64)),
                    ids.slice(i, j - i).take(pa.array(np.concatenate([text[keep], whole]))),
                    pa.array(np.concatenate([at_kind[keep], size[whole].astype(np.int32) * 4 + WHOLE])),
                ],
                ["h", "doc", "at"],
            )


def _long_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, doc_id, marks: the places of its shared seeds): (hash, document, 4 * place + kind) of the runs of MIN_WORDS words
    whose inner seeds are all shared. The seeds that any text with such a run has are those from WINDOW - 1 words after
    its start to KMER + WINDOW - 2 words before its end."""
    low, high = WINDOW - 1, MIN_WORDS - KMER - WINDOW + 2
    for b in batches:
        texts, ids, marks = b.column("text"), b.column("doc_id"), b.column("marks")
        for i, j in slices(texts):
            at, word = hashed_words(texts.slice(i, j - i))
            own = marks.slice(i, j - i)
            shared = np.zeros(len(word) + 1, bool)
            shared[own.flatten().to_numpy() + np.repeat(at[:-1], pc.list_value_length(own).to_numpy())] = True
            place, _ = minimizers(word, at)
            alone = np.zeros(len(word) + 1, np.int64)
            alone[place[~shared[place]] + 1] = 1
            alone = np.cumsum(alone)
            start = np.arange(max(0, len(word) - MIN_WORDS + 1))
            text = np.searchsorted(at, start, "right") - 1
            good = (start + MIN_WORDS <= at[text + 1]) & (alone[start + high] == alone[start + low])
            start, text = start[good], text[good]
            got = _mixed(_runs_of(word, MIN_WORDS)[good])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(got.view(np.int64)), ids.slice(i, j - i).take(pa.array(text)),
                    pa.array((start - at[text]).astype(np.int32) * 4 + np.minimum(_kinds(text, start, got), LATER)),
                ],
                ["h", "doc", "at"],
            )


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many or more, for steps that have a fixed cost a batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, at) in this order: those whose h comes again, each with the first row of its h as (ref, ref_at)."""
    held: tuple[int, int, int] | None = None  # the first row of the last h
    alone = False  # it is the only one so far
    for b in _joined(batches):
        cols = h, doc, at = [b.column(c).to_numpy() for c in ("h", "doc", "at")]
        if held is not None and (alone or held[0] == h[0]):
            goes_on = held[0] == h[0]
            if goes_on:  # its first row is set before the others again, and left out if it was a row before
                h, doc, at = (np.append(np.array([x], c.dtype), c) for x, c in zip(held, cols, strict=True))
        else:
            goes_on = False
        new = np.append(True, h[1:] != h[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        first = np.repeat(start, size)
        keep = np.repeat(size > 1, size)
        if goes_on and not alone:
            keep[0] = False
        last = int(start[-1])
        held, alone = (int(h[last]), int(doc[last]), int(at[last])), size[-1] == 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, doc, at, doc[first], at[first])], ["h", "doc", "at", "ref", "ref_at"])


def tied(seeds: DataFrame) -> DataFrame:
    """(h, doc, at, ref, ref_at) of each seed (h, doc, at) that stands in several places: where it stands first.

    The rows of a hash pass in order of their places, so that a seed that very many documents have is no group that one
    task must hold. The first one is of kind FIRST or WHOLE."""
    n = shuffle_partitions(seeds.sparkSession)
    return seeds.repartition(n, "h").sortWithinPartitions("h", "doc", "at").mapInArrow(_first_places, "h long, doc long, at int, ref long, ref_at int")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, in pieces that end where the first two change."""
    held = None
    for b in _joined(batches):
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        before = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = int(before[-1]) + 1 if len(before) else 0
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, ref, at, ref_at) of ties of runs of MIN_WORDS words, sorted by (doc, ref, at - ref_at, at): passages.

    Ties that touch on one diagonal are one passage. Of passages of a pair that overlap in the document, as in texts that
    go round in circles, the fewest that cover the same words are kept."""
    for doc, ref, at, ref_at in _groups(batches, ("doc", "ref", "at", "ref_at")):
        new = np.append(True, (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (at[1:] - ref_at[1:] != at[:-1] - ref_at[:-1]) | (np.diff(at) > MIN_WORDS))
        i = np.flatnonzero(new)
        k = np.append(i[1:], len(doc)) - 1
        size = at[k] + MIN_WORDS - at[i]
        order = np.lexsort((-size, at[i], ref[i], doc[i]))
        take: list[int] = []
        key, covered, best = None, 0, -1

        rows = list(zip(doc[i[order]].tolist(), ref[i[order]].tolist(), at[i[order]].tolist(), (at[i[order]] + size[order]).tolist(), strict=True))
        for place, (d, r, start, stop) in enumerate(rows):
            if (d, r) != key or start > covered:
                if best >= 0 and (d, r) == key:  # the farthest that starts within what is covered comes first
                    take.append(best)
                    covered, best = rows[best][3], -1
                if (d, r) != key or start > covered:
                    if best >= 0:
                        take.append(best)
                    take.append(place)
                    key, covered, best = (d, r), stop, -1
                    continue
            if stop > covered and (best < 0 or stop > rows[best][3]):
                best = place
        if best >= 0:
            take.append(best)
        t = order[np.array(take, np.int64)]
        cols = (doc[i[t]], at[i[t]], at[i[t]] + size[t], ref[i[t]], ref_at[i[t]], ref_at[i[t]] + size[t], size[t])
        yield _passages(cols)


def _passages(cols) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _PASSAGE.split(", ")])


class Fenwick:
    """Prefix maxima of (score, index) over ranks 1..n."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, rank: int, score: float, index: int) -> None:
        new, best = (score, index), self.best
        while rank < len(best):
            if new > best[rank]:
                best[rank] = new
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        out, best = (-1e18, -1), self.best
        while rank > 0:
            if best[rank] > out:
                out = best[rank]
            rank -= rank & -rank
        return out


def chains(at: np.ndarray, ref_at: np.ndarray) -> list[np.ndarray]:
    """Index arrays of the chains of ties (sorted by at, then ref_at): ordered in both texts, best first, disjoint."""
    n = len(at)
    step = np.diff(ref_at - at)
    if n and not step.any() and (np.diff(at) <= SEED_GAIN / (2 * GAP_COST)).all() and (np.diff(at) > 0).all():
        return [np.arange(n)]  # one diagonal without wide gaps: the only best chain
    ranks = np.unique(ref_at, return_inverse=True)[1] + 1
    tree, score, before = Fenwick(int(ranks.max()) if n else 0), [0.0] * n, [-1] * n
    x, y, r = at.tolist(), ref_at.tolist(), ranks.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            gain, prior = tree.upto(r[j] - 1)
            gain -= GAP_COST * (x[j] + y[j])
            score[j] = SEED_GAIN
            if prior >= 0 and gain > 0:
                score[j], before[j] = SEED_GAIN + gain, prior
            j += 1
        for k in range(i, j):
            tree.put(r[k], score[k] + GAP_COST * (x[k] + y[k]), k)
        i = j
    used, out = [False] * n, []
    for k in sorted(range(n), key=lambda k: -score[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = before[k]
        if len(chain) >= MIN_SEEDS:
            out.append(np.array(chain[::-1]))
    return out


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, ref, at, ref_at), sorted: the chains of each pair (doc, ref)."""
    for cols in _groups(batches, ("doc", "ref", "at", "ref_at")):
        edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        starts, stops = np.append(0, edge), np.append(edge, len(cols[0]))
        wide = stops - starts >= MIN_SEEDS
        rows = []
        for a, z in zip(starts[wide].tolist(), stops[wide].tolist(), strict=True):
            for chain in chains(cols[2][a:z], cols[3][a:z]):
                x, y = cols[2][a:z][chain], cols[3][a:z][chain]
                rows.append((int(cols[0][a]), int(cols[1][a]), int(x[0]), int(x[-1]) + KMER, int(y[0]), int(y[-1]) + KMER, x.tolist(), y.tolist()))
        if rows:
            c = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds, strict=True)], ["doc", "ref", "start", "stop", "ref_start", "ref_stop", "at", "ref_at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc: its text (member 0), then its chains; adds to each chain the hashes of the words that an
    alignment can reach."""
    own, key = None, None
    for b in batches:
        texts = b.column("text")
        parts = []
        for i, j in slices(texts):
            offsets, word = hashed_words(texts.slice(i, j - i))
            word = (word >> np.uint64(33)).astype(np.int32)
            doc, member = b.column("doc").slice(i, j - i).to_pylist(), b.column("member").slice(i, j - i).to_pylist()
            start, stop = b.column("start").slice(i, j - i).to_pylist(), b.column("stop").slice(i, j - i).to_pylist()
            take, cuts = [], []
            for k in range(j - i):
                if member[k] == 0:
                    own, key = word[offsets[k] : offsets[k + 1]].copy(), doc[k]
                elif key == doc[k]:
                    take.append(k)
                    cuts.append(own[max(0, start[k] - REACH) : stop[k] + REACH].tobytes())
            if take:
                rows = b.slice(i, j - i).take(pa.array(take))
                parts.append([*(rows.column(c) for c in ("doc", "ref", "start", "stop", "ref_start", "ref_stop", "at", "ref_at")), pa.array(cuts, pa.binary())])
        for p in parts:
            yield pa.RecordBatch.from_arrays(p, ["doc", "ref", "start", "stop", "ref_start", "ref_stop", "at", "ref_at", "cut"])


def _diagonal(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (words of a, words of b, equal words) of a and b side by side, as far as both go."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    edge = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), n] if n else [0]
    return [(z - i, z - i, z - i if same[i] else 0) for i, z in zip(edge[:-1], edge[1:], strict=True)]


def _paired(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of an alignment with the most equal words. What both have at their ends is paired first. Where both are longer
    than 2 * REACH (without any seed), their first and last REACH words are aligned and the middle is not."""
    n = min(len(a), len(b))
    same = np.append(a[:n] == b[:n], False)
    head = int(same.argmin())
    same = np.append((a[len(a) - n + head :] == b[len(b) - n + head :])[::-1], False)
    tail = int(same.argmin())
    front, back = [(head, head, head)] * (head > 0), [(tail, tail, tail)] * (tail > 0)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        return front + [(len(a), len(b), 0)] * (len(a) + len(b) > 0) + back
    if min(len(a), len(b)) > 2 * REACH:
        between = (len(a) - 2 * REACH, len(b) - 2 * REACH, 0)
        return [*front, *_paired(a[:REACH], b[:REACH]), between, *_paired(a[-REACH:], b[-REACH:]), *back]
    flip = len(a) > len(b)
    u, v = (b, a) if flip else (a, b)
    best = np.zeros((len(u) + 1, len(v) + 1), np.int32)
    for i, w in enumerate(u):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (v == w)), out=best[i + 1, 1:])
    if len(a) == len(b) and best[-1, -1] == int((a == b).sum()):
        return front + _diagonal(a, b) + back
    i, j, runs, off = len(u), len(v), [], [0, 0]

    def close() -> None:
        if off != [0, 0]:
            runs.append((*(off[::-1] if flip else off), 0))
            off[:] = 0, 0

    while i and j:
        if u[i - 1] == v[j - 1]:
            close()
            runs.append((1, 1, 1))
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i, off[0] = i - 1, off[0] + 1
        else:
            j, off[1] = j - 1, off[1] + 1
    off[0], off[1] = off[0] + i, off[1] + j
    close()
    return front + runs[::-1] + back


def segments(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, ref start, stop, ref stop, equal words) of the passages in an alignment's runs, from its start.

    First the maximal segments (Ruzzo and Tompa) by a score of 1 for an equal word and -2 for any other, cut where it
    falls by DROP; of what they leave, the longest stretches that are long and alike, so that each such stretch of the
    alignment is, or shares words with, a passage."""
    x = y = total = 0
    score = 0
    n: list[tuple[int, int, int, int, int, int, int]] = []  # equal runs: start, ref start, stop, ref stop, equal before and after, score before
    for a, b, same in runs:
        if same and n and n[-1][2] == x and n[-1][3] == y:
            last = n[-1]
            n[-1] = (last[0], last[1], x + a, y + b, last[4], total + same, last[6])
        elif same:
            n.append((x, y, x + a, y + b, total, total + same, score))
        x, y, total, score = x + a, y + b, total + same, score + (same or -2 * max(a, b))
    stack: list[tuple[int, int, int, int]] = []  # score before and after, first and last run
    for k, r in enumerate(n):
        now = (r[6], r[6] + r[5] - r[4], k, k)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= now[0]:
                j -= 1
            if j < 0 or stack[j][1] >= now[1] or now[0] < stack[j][1] - DROP:
                stack.append(now)
                break
            now = (stack[j][0], now[1], stack[j][2], now[3])
            del stack[j:]

    def fine(i: int, k: int) -> bool:
        long, ref = n[k][2] - n[i][0], n[k][3] - n[i][1]
        return long >= MIN_WORDS and n[k][5] - n[i][4] >= MIN_ALIKE * max(long, ref)

    found = [(i, k) for _, _, i, k in stack if fine(i, k)]
    edges = [-1, *(e for pair in found for e in pair), len(n)]
    open_ = [(i + 1, k - 1) for i, k in zip(edges[::2], edges[1::2], strict=True)]
    if any(i <= k and n[k][2] - n[i][0] >= MIN_WORDS for i, k in open_):
        c = np.array(n, np.int64)
    while open_:
        i, k = open_.pop()
        if i > k or n[k][2] - n[i][0] < MIN_WORDS:
            continue
        best = (0, 0, 0)
        for f in range(i, k + 1):
            if n[k][2] - n[f][0] < max(MIN_WORDS, best[0] + 1):
                break
            long, ref = c[f : k + 1, 2] - c[f, 0], c[f : k + 1, 3] - c[f, 1]
            good = np.flatnonzero((long >= MIN_WORDS) & (c[f : k + 1, 5] - c[f, 4] >= MIN_ALIKE * np.maximum(long, ref)))
            if len(good) and long[good[-1]] > best[0]:
                best = (int(long[good[-1]]), f, f + int(good[-1]))
        if best[0]:
            found.append(best[1:])
            open_ += [(i, best[1] - 1), (best[2] + 1, k)]
    return [(n[i][0], n[i][1], n[k][2], n[k][3], n[k][5] - n[i][4]) for i, k in sorted(found)]


def aligned(start: int, ref_start: int, at: list[int], ref_at: list[int], cut: np.ndarray, ref: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, ref start, ref stop, equal words) of a chain's passages; cut are the words from max(0, start - REACH) on.

    Where only the ref has other words inside, an unequal word beside the passage is taken in, if the text has one: equal
    words are as many as the passage has words where the two are the same."""
    base = max(0, start - REACH)
    doc = lambda i, j: cut[max(0, i - base) : max(0, j - base)]
    left = _diagonal(doc(base, start)[::-1], ref[max(0, ref_start - REACH) : ref_start][::-1])[::-1]
    runs, x, y = [*left, (KMER, KMER, KMER)], at[0] + KMER, ref_at[0] + KMER
    for p, q in zip(at[1:], ref_at[1:], strict=True):
        over = max(x - p, y - q, 0)
        if over >= KMER:
            continue
        runs += _paired(doc(x, p + over), ref[y : q + over])
        runs.append((KMER - over,) * 3)
        x, y = p + KMER, q + KMER
    runs += _diagonal(doc(x, x + REACH), ref[y : y + REACH])
    n = sum(r[0] for r in left)
    out = []
    for s, rs, e, re, equal in segments(runs):
        s, e, rs, re = start - n + s, start - n + e, ref_start - n + rs, ref_start - n + re
        if equal == e - s < re - rs and equal >= MIN_ALIKE * (re - rs + 1):
            if e - base < len(cut) and (re == len(ref) or cut[e - base] != ref[re]):
                e, re = e + 1, min(re + 1, len(ref))
            elif s > base and (not rs or cut[s - 1 - base] != ref[rs - 1]):
                s, rs = s - 1, max(rs - 1, 0)
        out.append((s, e, rs, re, equal))
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (ref, salt): the first document's text (member 0), then the chains tied to it."""
    own, key = None, None
    for b in batches:
        texts = b.column("text")
        for i, j in slices(texts):
            offsets, word = hashed_words(texts.slice(i, j - i))
            word = (word >> np.uint64(33)).astype(np.int32)
            rows = b.slice(i, j - i).drop_columns(["text"]).to_pylist()
            out = []
            for k, r in enumerate(rows):
                if r["member"] == 0:
                    own, key = word[offsets[k] : offsets[k + 1]].copy(), (r["ref"], r["salt"])
                elif key == (r["ref"], r["salt"]):
                    for s, e, rs, re, equal in aligned(r["start"], r["ref_start"], r["at"], r["ref_at"], np.frombuffer(r["cut"], np.int32), own):
                        out.append((r["doc"], s, e, r["ref"], rs, re, equal))
            if out:
                yield _passages(list(zip(*out, strict=True)))


def _aligned(found: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """The passages of chains: the document's words join a chain first, then the chains of a ref meet its text."""
    n = shuffle_partitions(found.sparkSession)
    heads = texts.join(found.select("doc").distinct(), F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("doc"), "text", F.lit(0).alias("member"))
    body = found.withColumn("member", F.lit(1))
    cut = (
        heads.unionByName(body, allowMissingColumns=True).repartition(n, "doc").sortWithinPartitions("doc", "member")
        .mapInArrow(_cut, f"{_CHAIN}, cut binary")
    )
    cut = written(cut, folder, "cut")
    groups = written(cut.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("salts")), folder, "groups")
    heads = (
        groups.select("ref", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .join(texts, F.col("ref") == F.col("doc_id")).select("ref", "salt", "text", F.lit(0).alias("member"))
    )
    body = cut.join(groups, "ref").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")).drop("salts").withColumn("member", F.lit(1))
    return (
        heads.unionByName(body, allowMissingColumns=True).repartition(n, "ref", "salt").sortWithinPartitions("ref", "salt", "member")
        .mapInArrow(_align, _PASSAGE)
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, marks: (at, h, label, common) in order): the pairs of marks that a chain can begin with, one of them common."""
    kinds = [*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    for b in batches:
        marks = b.column("marks")
        text = np.repeat(b.column("doc").to_numpy(), pc.list_value_length(marks).to_numpy())
        at, h, label, common = (c.to_numpy(zero_copy_only=False) for c in marks.flatten().flatten())
        pairs, step, a = [], 1, np.arange(len(at))
        while len(a):
            a = a[a + step < len(at)]
            a = a[(text[a] == text[a + step]) & (at[a + step] - at[a] < LINK)]
            x = a[(common[a] | common[a + step]) > 0]
            pairs.append((x, x + step))
            step += 1
        x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
        cols = (h[x], h[y], text[x], at[x], at[y], label[x], label[y], common[x] & common[y])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], ["h", "g", "doc", "at", "next", "u", "v", "both"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc: its text (member 0), then its pairs of seeds; adds to each pair 16 bits of each word from REACH
    words before to REACH words after it, 0 where the text has none."""
    names = ["h", "g", "doc", "at", "next", "u", "v", "blocks"]
    own, key = None, None
    for b in batches:
        texts = b.column("text")
        for i, j in slices(texts):
            offsets, word = hashed_words(texts.slice(i, j - i))
            word = np.maximum(word >> np.uint64(48), np.uint64(1)).astype(np.uint16)
            part = b.slice(i, j - i)
            doc, member, at, after = (part.column(c).to_pylist() for c in ("doc", "member", "at", "next"))
            take, cuts = [], []
            for k in range(j - i):
                if member[k] == 0:
                    own, key = np.pad(word[offsets[k] : offsets[k + 1]], (REACH, REACH + KMER)), doc[k]
                elif key == doc[k]:
                    take.append(k)
                    cuts.append(own[at[k] : after[k] + 2 * REACH + KMER].tobytes())
            if take:
                rows = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(cuts, pa.binary())], [*names, "around"])


def may_be_alike(a: np.ndarray, b: np.ndarray, gap: np.ndarray, ref_gap: np.ndarray) -> np.ndarray:
    """Whether rows of words around two ties each can hold a passage; a and b begin REACH words before the first tie.

    A passage has a stretch of MIN_WORDS to 2 * MIN_WORDS - 1 words with MIN_ALIKE of them equal, each of them on a diagonal
    that is no farther from that of a tie than the stretch has words that are not."""
    wide = 2 * MIN_WORDS - 1
    drift = int((1 - MIN_ALIKE) * wide) + 1
    low, high = np.minimum(ref_gap - gap, 0) - drift, np.maximum(ref_gap - gap, 0) + drift
    equal = np.zeros(a.shape, bool)
    n = a.shape[1]
    for shift in range(int(low.min()), int(high.max()) + 1) if len(a) else ():
        rows = np.flatnonzero((low <= shift) & (shift <= high))
        if len(rows) and abs(shift) < n:
            here, there = slice(max(0, -shift), n - max(0, shift)), slice(max(0, shift), n + min(0, shift))
            equal[rows, here] |= a[rows, here] == b[rows, there]
    equal &= a > 0
    total = np.concatenate([np.zeros((len(a), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32)], axis=1)
    return (total[:, min(wide, n) :] - total[:, : n + 1 - min(wide, n)]).max(axis=1) >= MIN_ALIKE * MIN_WORDS


def _compared(block: np.ndarray, doc: np.ndarray, at: np.ndarray, after: np.ndarray, u: np.ndarray, v: np.ndarray, around: list[bytes], across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(later, earlier) indexes of rows with one pair of seeds, in order of their places, whose words around may hold a passage.

    Where the seeds are equally far apart in both, the words of a chain on one diagonal are counted first."""
    gap, least = after - at, int(np.ceil(MIN_ALIKE * MIN_WORDS))
    words = np.zeros((len(doc), 2 * REACH + KMER + LINK), np.uint16)
    for k, raw in enumerate(around):
        words[k, : len(raw) // 2] = np.frombuffer(raw, np.uint16)
    out = np.concatenate([words[:, :REACH], words[np.arange(len(doc))[:, None], REACH + KMER + gap[:, None] + np.arange(REACH)]], axis=1)
    rows = max(1, (1 << 24) // (out.shape[1] * max(1, len(doc))))
    for i in range(0, len(doc), rows):
        x, y = np.nonzero((u[i : i + rows, None] != u[None, :]) & (v[i : i + rows, None] != v[None, :]) & (gap[i : i + rows, None] + gap[None, :] < LINK) & (np.arange(i, min(i + rows, len(doc)))[:, None] > np.arange(len(doc))[None, :]))
        x += i
        if across:
            apart = block[x] != block[y]
            x, y = x[apart], y[apart]
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            on_one = gap[p] == gap[q]
            there = out[q]
            few = on_one & (((out[p] == there) & (there > 0)).sum(axis=1) + gap[p] + KMER < least)
            p, q = p[~few], q[~few]
            for m in range(0, len(p), 4096):
                c, d = p[m : m + 4096], q[m : m + 4096]
                good = may_be_alike(words[c], words[d], gap[c], gap[d])
                if good.any():
                    yield c[good], d[good]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (h, g, low, high, doc, at): the pairs of documents whose words around these seeds may hold a passage."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, doc, at, after, u, v = (rows.column(c).to_numpy() for c in ("block", "doc", "at", "next", "u", "v"))
        across = bool(rows.column("low")[0] != rows.column("high")[0])
        for x, y in _compared(block, doc, at, after, u, v, rows.column("around").to_pylist(), across):
            fine = (doc[x] > doc[y]) | (at[x] > at[y]) & (after[x] > after[y])
            yield pa.RecordBatch.from_arrays([pa.array(doc[x[fine]]), pa.array(doc[y[fine]])], ["doc", "ref"])

    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("h", "g", "low", "high")], axis=1)
        start = np.append(0, np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1)
        for i, j in zip(start.tolist(), np.append(start[1:], len(ids)).tolist(), strict=True):
            now = tuple(ids[i])
            if now != key and held:
                yield from found(pa.Table.from_batches(held))
                held = []
            key = now
            held.append(b.slice(i, j - i))
    if held:
        yield from found(pa.Table.from_batches(held))


def _few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """ids, broadcast up to a bound, so that what is joined with them is not shuffled."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def open_ties(places: DataFrame, found: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """(doc, ref, at, ref_at) of pairs of places (h, doc, at, ref, ref_at) of one seed, the later one first, without those
    that found (passages) links with the same place: the seed's first, or one that both are copies of.

    Of seeds of more than COMMON places only those pairs are made that a chain can begin with: where a second seed less than
    LINK words away is shared too, and if that is common too, the words around may hold a passage; and then all others of
    these two documents."""
    n = shuffle_partitions(places.sparkSession)
    start, stop, ref_start, ref_stop = (F.col(c) for c in ("start_word", "end_word", "ref_start_word", "ref_end_word"))
    inside = (start <= F.col("at")) & (F.col("at") + KMER <= stop)
    rows = found.select(F.col("doc_id").alias("doc"), F.col("ref_doc_id").alias("ref"), start, stop, ref_start, ref_stop, "n_equal")
    apart = places.where((F.col("doc") != F.col("ref")) | (F.col("at") != F.col("ref_at"))).alias("p")
    same = (F.col("p.doc") == F.col("r.doc")) & (F.col("p.ref") == F.col("r.ref")) & (ref_start <= F.col("ref_at")) & (F.col("ref_at") + KMER <= ref_stop)
    unmet = written(apart.join(rows.alias("r"), same & inside, "left_anti").select("h", "doc", "at"), folder, "unmet")

    # each place is linked with a place of its seed, which label is a hash of: with the first, with that of an exact copy, or none but itself
    name = lambda d, a: F.xxhash64(F.col(d).cast("long"), F.col(a).cast("int"))
    copied = rows.where((F.col("n_equal") == stop - start) & (F.col("n_equal") == ref_stop - ref_start))
    met = places.join(_few(unmet.select("h").distinct()), "h", "left_semi").join(unmet, ["h", "doc", "at"], "left_anti")
    met = written(met.select("h", "doc", "at", name("ref", "ref_at").alias("label")), folder, "met")
    to = (
        unmet.join(copied.withColumnRenamed("doc", "own"), (F.col("doc") == F.col("own")) & inside)
        .groupBy("h", "doc", "at").agg(F.min(F.struct(F.col("ref").alias("to"), (F.col("at") - start + ref_start).alias("to_at"))).alias("t")).select("h", "doc", "at", "t.*")
    )
    to = to.join(met.select("h", F.col("doc").alias("to"), F.col("at").alias("to_at"), "label"), ["h", "to", "to_at"], "left").select("h", "doc", "at", F.coalesce("label", name("to", "to_at")).alias("label"))
    alone = unmet.join(to, ["h", "doc", "at"], "left").select("h", "doc", "at", F.coalesce("label", name("doc", "at")).alias("label"))
    pool = written(met.unionByName(alone), folder, "pool")
    common = written(pool.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("h"), folder, "common")

    rare = pool.join(common, "h", "left_anti")
    later = (F.col("a.doc") > F.col("b.doc")) | (F.col("a.doc") == F.col("b.doc")) & (F.col("a.at") > F.col("b.at"))
    doc, ref = F.col("a.doc").alias("doc"), F.col("b.doc").alias("ref")
    ties = rare.alias("a").join(rare.alias("b"), "h").where(later & (F.col("a.label") != F.col("b.label")))
    ties = written(ties.select(doc, ref, F.col("a.at").alias("at"), F.col("b.at").alias("ref_at")), folder, "ties")

    marked = pool.join(common.withColumn("common", F.lit(1)), "h", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    busy = marked.where("common = 1").select("doc").distinct()
    lists = marked.join(busy, "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "h", "label", "common"))).alias("marks"))
    near = written(lists.mapInArrow(_near, "h long, g long, doc long, at int, next int, u long, v long, both int"), folder, "near")
    keys = near.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1")).where("u0 < u1 and v0 < v1")
    near = written(near.join(keys.select("h", "g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["h", "g"]), folder, "near")

    some = near.where("both = 0")
    linked = later & (F.col("a.u") != F.col("b.u")) & (F.col("a.v") != F.col("b.v")) & (F.col("a.next") - F.col("a.at") + F.col("b.next") - F.col("b.at") < LINK)
    in_order = (F.col("a.doc") != F.col("b.doc")) | (F.col("a.next") > F.col("b.next"))
    beside = some.alias("a").join(some.alias("b"), ["h", "g"]).where(linked & in_order).select(doc, ref)

    both = near.where("both = 1").drop("both")
    heads = docs.join(_few(both.select("doc").distinct()), F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("doc"), "text", F.lit(0).alias("member"))
    blocks = F.col("blocks")
    around = (
        heads.unionByName(both.withColumn("member", F.lit(1)), allowMissingColumns=True).repartition(n, "doc").sortWithinPartitions("doc", "member")
        .mapInArrow(_around, "h long, g long, doc long, at int, next int, u long, v long, blocks int, around binary")
        .withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    )
    alike = around.repartition(n, "h", "g", "low", "high").sortWithinPartitions("h", "g", "low", "high", "doc", "at").mapInArrow(_pairs, "doc long, ref long")
    pairs = ties.groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").unionByName(beside).unionByName(alike)
    pairs = written(pairs.distinct(), folder, "pairs")  # they can have a chain, and get all ties of common seeds
    often = pool.join(common, "h", "left_semi")
    one, other = (often.select("h", F.col("doc").alias(d), F.col("at").alias(a), F.col("label").alias(x)) for d, a, x in (("doc", "at", "x"), ("ref", "ref_at", "y")))
    rest = pairs.join(one, "doc").join(other, ["ref", "h"]).where("x <> y and (doc > ref or at > ref_at)").select("doc", "ref", "at", "ref_at")
    return ties.unionByName(rest)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row for each passage of a document that stands in an earlier place too: words start_word to end_word (exclusive)
    of doc_id, those of ref_doc_id, and how many are equal.

    Exact: of every run of MIN_WORDS words that stands in several places of the table, in one document or in several,
    each place but the first (by doc_id, then place) is covered by rows of its document, and each of these rows leads to
    an earlier place, so that rows link all documents with the run. Fuzzy: two documents that share two seeds in a passage
    have a row, or rows link both with the first place of one of these seeds; README has the measured recall. A document
    with the words of an earlier one has one row, for the whole text.

    Texts without MIN_WORDS words, null texts and null ids have none. Of rows that repeat an id the least text counts.
    Texts of any length are read whole. An empty table gives no rows; columns other than doc_id and text are not read.
    Work grows with the number of shared seeds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, n = work_folder(spark), shuffle_partitions(spark)
    docs = one_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"), "doc_id", "text")
    place, ref_place, kind = F.shiftright("at", 2).alias("at"), F.shiftright("ref_at", 2).alias("ref_at"), F.pmod("at", F.lit(4))
    shared = written(tied(docs.mapInArrow(_seeds, "h long, doc long, at int")), folder, "shared")
    copies = shared.where((kind == WHOLE) & (F.col("doc") != F.col("ref")) & (F.col("at") == F.col("ref_at")))
    live = shared.where(kind != WHOLE).join(copies.select("doc"), "doc", "left_anti")
    elsewhere = (F.col("doc") != F.col("ref")) | (F.col("at") != F.col("ref_at"))

    places = live.where(kind != AGAIN).select("h", "doc", place, "ref", ref_place)

    def chained(ties: DataFrame) -> DataFrame:
        return written(ties.repartition(n, "doc", "ref").sortWithinPartitions("doc", "ref", "at", "ref_at").mapInArrow(_chain, _CHAIN), folder, "chains")

    found = chained(live.where(elsewhere & (kind != AGAIN)).select("doc", "ref", place, ref_place))
    # a run of MIN_WORDS words has so many inner seeds at least
    inner = (MIN_WORDS - KMER - 2 * WINDOW + 3) // WINDOW
    marks = written(live.groupBy("doc").agg(F.collect_list(place).alias("marks")).where(F.size("marks") >= inner), folder, "marks")
    wanted = found.select("doc").union(found.select("ref")).union(marks.select("doc")).distinct()
    texts = written(docs.join(wanted, F.col("doc_id") == F.col("doc"), "left_semi"), folder, "texts")

    long = texts.join(marks, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "marks").mapInArrow(_long_seeds, "h long, doc long, at int")
    ties = tied(long).where(elsewhere).select("doc", "ref", place, ref_place)
    exact = ties.repartition(n, "doc", "ref").sortWithinPartitions("doc", "ref", F.col("at") - F.col("ref_at"), "at").mapInArrow(_runs, _PASSAGE)

    passages = written(exact.unionByName(_aligned(found, texts, folder)), folder, "passages")
    found = chained(open_ties(places, passages, docs, folder))
    texts = written(docs.join(_few(found.select("doc").union(found.select("ref")).distinct()), F.col("doc_id") == F.col("doc"), "left_semi"), folder, "texts")
    passages = passages.unionByName(_aligned(found, texts, folder))

    by = W.partitionBy("doc_id", "ref_doc_id").orderBy("start_word", F.desc("end_word"), "ref_start_word", F.desc("n_equal")).rowsBetween(W.unboundedPreceding, -1)
    passages = passages.withColumn("covered", F.max("end_word").over(by)).where("covered is null or covered < end_word").drop("covered")
    size, none = F.shiftright("at", 2), F.lit(0)
    whole = copies.select(F.col("doc").alias("doc_id"), none.alias("start_word"), size.alias("end_word"), F.col("ref").alias("ref_doc_id"), none.alias("ref_start_word"), size.alias("ref_end_word"), size.alias("n_equal"))
    return passages.unionByName(whole)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of documents that other documents have too."""
    return repeated_passages(table(spark, sf_dir, "documents"))
