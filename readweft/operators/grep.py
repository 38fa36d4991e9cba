"""grep: reads whose sequence or id matches a pattern."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadArgument
from ..functions.dna import IUPAC, escaped, reverse_complement
from ..functions.quality import flat_bytes

#: Beyond so many alternatives a search runs over Arrow batches instead of one regular expression, with the same results.
ALTERNATIVES = 200
#: Bytes of text that are searched at once.
PIECE = 4 << 20
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _folded(text: str) -> str:
    return text.translate(str.maketrans(_LOWER, _UPPER))


def wildcards(pattern: str, k: int, one=escaped) -> list[str]:
    """Regular expressions that match what differs from pattern in at most k places."""
    parts = [one(c) for c in pattern]
    if k >= len(parts):
        return ["." * len(parts)]
    return ["".join("." if i in places else p for i, p in enumerate(parts)) for places in combinations(range(len(parts)), k)]


def _any_of(patterns: list[str], fold: bool):
    """An Arrow function: whether any of many literals occurs."""

    @F.arrow_udf("boolean")
    def found(x: pa.Array) -> pa.Array:
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in patterns:
                automaton.add_word(p, True)
            automaton.make_automaton()
            hit = lambda s: next(automaton.iter(s), None) is not None
        except ImportError:
            search = re.compile("|".join(map(re.escape, patterns))).search
            hit = lambda s: search(s) is not None
        return pa.array([None if s is None else hit(_folded(s) if fold else s) for s in x.to_pylist()], pa.bool_())

    return found


def accepted(c: str, degenerate: bool, fold: bool) -> str:
    """The characters that match c of a pattern; only A-Z and a-z have a case."""
    if degenerate and c.upper() in IUPAC:
        own = IUPAC[c.upper()].replace("T", "TU")
        return own + own.lower()
    if (degenerate or fold) and (c in _LOWER or c in _UPPER):
        return c.upper() + c.lower()
    return c


def fuzzy_table(pattern: str, degenerate: bool, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet, miss): the sorted code points that match somewhere, and miss[i, k]: whether the k-th of them (or, last, any
    other character) does not match at place i."""
    own = [accepted(c, degenerate, fold) for c in pattern]
    alphabet = sorted({c for x in own for c in x})
    miss = np.ones((len(own), len(alphabet) + 1), bool)
    for i, x in enumerate(own):
        miss[i, [alphabet.index(c) for c in x]] = False
    return np.array([ord(c) for c in alphabet], np.uint32), miss


def fuzzy_found(offsets: np.ndarray, points: np.ndarray, alphabet: np.ndarray, miss: np.ndarray, k: int) -> np.ndarray:
    """For each text (code points between offsets) whether some window differs from the pattern in at most k places."""
    out, n = np.zeros(len(offsets) - 1, bool), len(points) - len(miss) + 1
    if n <= 0:
        return out
    if points.itemsize == 1:
        table = np.full(256, len(alphabet), np.int16)
        table[alphabet[alphabet < 256]] = np.flatnonzero(alphabet < 256)
        codes = table[points]
    else:
        at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
        codes = np.where(alphabet[at] == points, at, len(alphabet))
    count = np.zeros(n, np.int32)
    for i in range(len(miss)):
        count += miss[i, codes[i : i + n]]
    hits = np.flatnonzero(count <= k)
    text = np.searchsorted(offsets, hits, "right") - 1
    out[text[hits + len(miss) <= offsets[text + 1]]] = True
    return out


def _pieces(x: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(offsets, code points) of some MB of texts each; ASCII is looked at where it is."""
    size = pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).cumsum() // PIECE
    edge = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(x)]
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        part = x.slice(a, z - a)
        if pc.all(pc.string_is_ascii(part), min_count=0).as_py():
            yield flat_bytes(part)
        else:
            texts = [s or "" for s in part.to_pylist()]
            yield np.cumsum([0, *map(len, texts)]), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _fuzzy(patterns: list[str], k: int, degenerate: bool, fold: bool):
    tables = [fuzzy_table(p, degenerate, fold) for p in patterns]

    @F.arrow_udf("boolean")
    def found(x: pa.Array) -> pa.Array:
        parts = [np.logical_or.reduce([fuzzy_found(*piece, *t, k) for t in tables]) for piece in _pieces(x)] if len(x) else [np.zeros(0, bool)]
        return pa.array(np.concatenate(parts), pa.bool_(), mask=x.is_null().to_numpy(zero_copy_only=False))

    return found


def matcher(patterns: list[str], regex: bool = False, mismatches: int = 0, degenerate: bool = False, case_sensitive: bool = False):
    """A function Column -> Column of booleans: whether any pattern matches.

    Literals match anywhere; letters A-Z of either case are equal unless case_sensitive. regex takes Java's
    expressions. mismatches allows so many differing characters. degenerate reads IUPAC codes, in any case; N stands
    for a base and not for N. degenerate and mismatches go together, regex with neither.
    """
    if not patterns or any(not p for p in patterns):
        raise BadArgument("a pattern is empty")
    if regex and (mismatches or degenerate):
        raise BadArgument("regex goes neither with mismatches nor with degenerate")
    if mismatches < 0:
        raise BadArgument("mismatches must not be negative")
    if regex:
        for p in patterns:
            _check_regex(p)
        flags = "" if case_sensitive else "(?iu)"
        return lambda x: reduce(lambda a, b: a | b, (x.rlike(flags + p) for p in patterns))
    fold = not case_sensitive
    if mismatches or degenerate:
        one = lambda c: _class(accepted(c, degenerate, fold))
        if len(patterns) * max(math.comb(len(p), min(mismatches, len(p))) for p in patterns) <= ALTERNATIVES:
            return lambda x: x.rlike("(?s)" + "|".join(w for p in patterns for w in wildcards(p, mismatches, one)))
        return _fuzzy(patterns, mismatches, degenerate, fold)
    own = [_folded(p) if fold else p for p in patterns]
    if len(own) > ALTERNATIVES:
        return _any_of(own, fold)
    text = (lambda x: F.translate(x, _LOWER, _UPPER)) if fold else (lambda x: x)
    if len(own) == 1:
        return lambda x: F.contains(text(x), F.lit(own[0]))
    return lambda x: x.rlike("(?s)" + "|".join("".join(map(_either_case if fold else escaped, p)) for p in own))


def _class(chars: str) -> str:
    return escaped(chars) if len(chars) == 1 else "[" + "".join(map(escaped, chars)) + "]"


def _either_case(c: str) -> str:
    return f"[{c.upper()}{c.lower()}]" if c in _LOWER or c in _UPPER else escaped(c)


def _check_regex(pattern: str) -> None:
    """Refuses what finite automata can't do, and what is no expression at all."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise BadArgument(f"invalid regex, look-around and back references are not supported: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        if not re.search(r"\\[pPhHvVRXQEzZA]|\(\?<\w|&&|\[\[|[*+?}]\+|\\x\{", pattern):
            raise BadArgument(f"invalid regex: {pattern}") from e


def grep_reads(
    df: DataFrame, patterns: str | list[str], regex: bool = False, mismatches: int = 0, degenerate: bool = False, in_name: bool = False, both_strands: bool = False,
    invert: bool = False, case_sensitive: bool = False,
) -> DataFrame:
    """The reads that match (or, inverted, do not): by sequence, or by id with in_name; both_strands also searches the
    reverse complement of the sequence."""
    if in_name and both_strands:
        raise BadArgument("names have no strands")
    test = matcher([patterns] if isinstance(patterns, str) else list(patterns), regex, mismatches, degenerate, case_sensitive)
    found: Column = test(F.col("id" if in_name else "seq"))
    if both_strands:
        found = found | test(reverse_complement("seq"))
    return df.where(~found if invert else found)
