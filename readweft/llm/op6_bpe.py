"""BPE encoding and decoding through a token automaton that is built merge gadget by merge gadget.

The automaton reads tokens. Its states are the last token read (and the start); at first it has the 256 byte tokens,
every one allowed after every other. The gadget of a merge (u, v) -> w takes the v arc from the state of u, so that
"u v" can no longer be read; it adds a w arc to every state that has the u arc at that time, leading to a new state
that is a copy of the state of v at that time. A merge whose u has no v arc any more changes nothing. After the last
merge the automaton accepts exactly the token sequences that BPE makes (Berglund, Martens and van der Merwe, 2024), and
each word has one accepted path.

Its table is compiled as a row for each state: the row that it was copied from, at which merge, and the arcs taken from
it since (explicit rows would have 50,000 x 50,000 arcs). Which arcs spell the bytes just read is a second table, of
moves from byte to byte (Aho and Corasick, 1975). A word is encoded in one pass over its bytes by these two tables: the
state reached after each byte is the one arc that ends there and that the state at its start has. No byte is read twice.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import small_batches, table

#: White space of the pre-tokenizer (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Words that a Python worker keeps the ids of before it starts anew.
CACHE = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled merges: token ids are arcs and states."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], base: dict[int, int]):
        """labels: bytes of each id; merges: (u, v, w) in order; base: byte -> id."""
        self.n = n = len(labels)
        # the rows: the state copied and the merge that did it, the arcs taken since and the merge that did it
        self.copied, self.born = [-1] * n, [0] * n
        self.taken: dict[int, int] = {}
        self.left = [-1] * n  # an arc is added to the states that have the arc of its left part
        self.start: dict[bytes, int] = {bytes([b]): t for b, t in base.items()}  # the start's row: no arc is ever taken from it
        idle = []
        for when, (u, v, w) in enumerate(merges, 1):
            if labels[u] in self.start and labels[v] in self.start and labels[w] not in self.start and self.has(u, v, when - 1):
                self.taken[u * n + v] = when
                self.left[w], self.copied[w], self.born[w] = u, v, when
                self.start[labels[w]] = w
            else:
                idle.append((when, u, v))
        if any(max(self.born[u], self.born[v]) > when for when, u, v in idle):
            raise ValueError("merges are out of order: one uses a token that a later one makes")
        self.merges = len(merges)
        self._known: dict[int, bool] = {}
        self._compile_moves()

    def has(self, state: int, arc: int, when: int) -> bool:
        """Whether the state's row has the arc right after the merge number when."""
        while True:
            if self.taken.get(state * self.n + arc, when + 1) <= when:
                return False
            of_state, of_arc = self.born[state], self.born[arc]
            if of_arc > when:
                return False
            if of_state == 0 and of_arc == 0:
                return True
            if of_arc >= of_state:  # added to the states that kept the arc of its left part ("a aa" is taken with "a a")
                when, arc = of_arc, self.left[arc]
            else:  # as it was when the state was copied
                when, state = of_state - 1, self.copied[state]

    def _compile_moves(self) -> None:
        """Nodes are the prefixes of arc labels. moves: node * 256 + byte -> node of the longest suffix that is a prefix of
        a label; ends: the longest arc that a node ends with; shorter: the next shorter one that an arc ends with."""
        child: dict[int, int] = {}
        back, arc_at, order = [0], [-1], [(0, 0, 0)]
        for label, arc in self.start.items():
            node = 0
            for b in label:
                key = node << 8 | b
                if (to := child.get(key)) is None:
                    to = child[key] = len(back)
                    back.append(0)
                    arc_at.append(-1)
                    order.append((node, b, to))
                node = to
            arc_at[node] = arc
        depth = [0] * len(back)
        for parent, _, node in order[1:]:
            depth[node] = depth[parent] + 1
        self.ends, self.shorter = arc_at[:], {}
        for parent, b, node in sorted(order[1:], key=lambda x: depth[x[2]]):
            at = back[parent]
            while parent and (at << 8 | b) not in child and at:
                at = back[at]
            back[node] = child.get(at << 8 | b, 0) if parent else 0
            if arc_at[node] >= 0:
                self.shorter[arc_at[node]] = self.ends[back[node]]
            else:
                self.ends[node] = self.ends[back[node]]
        self.moves, self._back = child, back
        self.lengths = {arc: len(label) for label, arc in self.start.items()}

    def move(self, node: int, byte: int) -> int:
        """The move, entered into the table where the trie has none."""
        at = node
        while at and (at << 8 | byte) not in self.moves:
            at = self._back[at]
        to = self.moves.get(at << 8 | byte, 0)
        if len(self.moves) < 2 * CACHE:
            self.moves[node << 8 | byte] = to
        return to

    def step(self, state: int, arc: int) -> bool:
        """Whether the state has the arc, entered into the table of known ones."""
        if len(self._known) > 2 * CACHE:
            self._known.clear()
        known = self._known[state * self.n + arc] = self.has(state, arc, self.merges)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The arcs of the only accepted path that spells the word."""
        if (whole := self.start.get(word)) is not None:  # an arc of the start
            return [whole]
        moves, ends, shorter, lengths, known, width = self.moves, self.ends, self.shorter, self.lengths, self._known, self.n
        reached, node = [-1], 0
        for i, b in enumerate(word, 1):
            to = moves.get(node << 8 | b)
            node = self.move(node, b) if to is None else to
            arc = ends[node]
            while (at := i - lengths[arc]) > 0:
                state = reached[at]
                has = known.get(state * width + arc)
                if has or has is None and self.step(state, arc):
                    break
                arc = shorter[arc]
            reached.append(arc)
        path, at = [], len(word)
        while at:
            path.append(reached[at])
            at -= lengths[reached[at]]
        return path[::-1]


def _class(major: str) -> str:
    """A character class of the letters (L) or numbers (N) of Unicode, as ranges."""
    out, first, last = [], None, None
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == major:
            if first is None:
                first = c
            last = c
        elif first is not None:
            out.append(f"\\U{first:08x}-\\U{last:08x}")
            first = None
    return "".join(out)


class Tokenizer:
    """Reads a byte-level BPE tokenizer.json; encode() and decode() work as the tokenizers library does, without
    truncation, padding or templates. Strings of added tokens in a text become these tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        n = max([*vocab.values(), *added.values()]) + 1
        labels = [b""] * n
        for token, k in vocab.items():
            labels[k] = bytes(alphabet[c] for c in token)
        base = {alphabet[c]: vocab[c] for c in alphabet if c in vocab}
        merges = []
        for m in model["merges"]:
            u, v = m if isinstance(m, list) else m.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        for token, k in added.items():
            labels[k] = token.encode()
        self.automaton = Automaton(labels, merges, base)
        self.labels = labels
        self.added = {s: struct.pack("<I", k) for s, k in added.items()}
        self.split_added = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        # A run without white space, with a space before it, holds whole words of the pre-tokenizer; so does white space.
        self.runs = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        letters, numbers = _class("L"), _class("N")
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        ).findall
        outer = self

        class Runs(dict):
            def __missing__(self, run: str) -> bytes:
                if run.isalpha() or run[0] == " " and run[1:].isalpha() or len(words := outer.words(run)) == 1:
                    got = b"".join(map(four, encode(run.encode("utf-8", "replace"))))
                else:
                    got = b"".join(map(self.__getitem__, words))
                if len(run) < 100:
                    if len(self) > CACHE:
                        self.clear()
                    self[run] = got
                return got

        four, encode = [struct.pack("<I", k) for k in range(n)].__getitem__, self.automaton.encode
        self.of_run = Runs()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        of_run = self.of_run.__getitem__
        if self.split_added is None or not any(s in text for s in self.added):
            return b"".join(map(of_run, self.runs(text)))
        return b"".join(self.added[x] if k % 2 else b"".join(map(of_run, self.runs(x))) for k, x in enumerate(self.split_added.split(text)))

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_bytes(self, ids) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join(map(self.labels.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """Compiled once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "_ids") -> DataFrame:
    """Every row of docs with its columns and into: array<int>, which takes the place of a column of that name.

    A null text counts as empty and has no ids; texts of any length are read whole; repeated rows stay; an empty table
    gives an empty one."""
    path, own = path or default_path(), [c for c in docs.columns if c.lower() != into.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                packed = [t.encode_packed(x or "") for x in part.column(text).to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), ids], [*own, into])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in own), T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, ids: str = "_ids", path: str | None = None, into: str = "_decoded") -> DataFrame:
    """Every row with its columns and into: string, which takes the place of a column of that name. Null ids count as none;
    bytes that are no UTF-8 become U+FFFD."""
    path, own = path or default_path(), [c for c in rows.columns if c.lower() != into.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = pa.array([t.decode(x or ()) for x in part.column(ids).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), texts], [*own, into])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in own), T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded and decoded in the worker, so that
    ids and texts are never shuffled or kept. A null text counts as empty; long texts are read whole; repeated rows each
    have theirs; other columns are not read."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            n, ids, texts = [], [], []
            for x in b.column("text"):
                packed = t.encode_packed(x.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                raw = t.decode_bytes(np.frombuffer(packed, "<u4").tolist())
                texts.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256 of each row: the last stage of a pipeline. Nulls, long
    texts and repeated rows as for digests(); columns of docs other than these and text are dropped, whatever their names."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                packed = [t.encode_packed(x or "") for x in part.column("text").to_pylist()]
                flat = np.frombuffer(b"".join(packed), np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                back = [t.decode_bytes(np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace").encode() for x in packed]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "lang", "source")), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                        *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (packed, back)),
                    ],
                    ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    small_batches(docs.sparkSession)
    kinds = "doc_id long, lang string, source string, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, kinds)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
