import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readweft import functions as X
from readweft.errors import BadArgument, UnknownFormat
from readweft.functions.quality import err_sum_native
from readweft.functions.trim import best_segments
from readweft.sources.formats import detect_format, pattern_lines, sniff


def test_lists():
    assert X.n50([2, 2, 2, 3, 3, 4, 8, 8]) == 8
    assert X.nx([], 50) == 0 and X.nx([5], 0) == 0 and X.nx([5], 101) == 0
    assert X.median([1, 2, 3, 10]) == 2.5 and X.median([]) == 0 and X.mean([]) == 0
    assert X.min_max([]) == (0, 0) and X.min_max([3, 1]) == (1, 3)
    assert X.percentile([40, 32, 24, 100, 10], 10) == pytest.approx(15.6)


def test_sizes():
    assert [X.parse_size(x) for x in ("5", " 2k ", "1.5g", "3M", "0.0005k", "1e3", "2.5E-1k", "1e2 m")] == [5, 2000, 1_500_000_000, 3_000_000, 1, 1000, 250, 100_000_000]
    for bad in ("", "-1", "1x", "k", "1.2.3", "e3", "1e", "1e999", "nan", "inf"):
        with pytest.raises(BadArgument):
            X.parse_size(bad)


def test_formats():
    for path, kind in (("a/B.FASTQ.gz", "FASTQ"), ("x.fq.zst", "FASTQ"), ("x.fna", "FASTA"), ("x.fa.xz", "FASTA"), ("y.bam", "BAM"), ("y.cram", "BAM")):
        assert detect_format(path) == kind
    for path in ("x.txt", "x.fastq.gz.gz", "fastq"):
        with pytest.raises(UnknownFormat):
            detect_format(path)
    assert sniff(b" \n@r") == "FASTQ" and sniff(b">a") == "FASTA" and sniff(b"") == "FASTQ" and sniff(b"BAM\x01") == "BAM"
    with pytest.raises(UnknownFormat):
        sniff(b"hello")
    assert pattern_lines("# x\n ACGT \n\nTT\n") == ["ACGT", "TT"]
    with pytest.raises(BadArgument):
        pattern_lines("#\n\n")


def test_phred():
    assert X.phred_to_prob(ord("I")) == pytest.approx(1e-4) and X.phred_to_prob(10) == 1
    assert X.prob_to_phred(0) == 60 and X.prob_to_phred(0.001) == pytest.approx(30)


def test_iupac():
    assert X.iupac_matches("R", "a") and not X.iupac_matches("R", "C") and X.iupac_matches("T", "U") and X.iupac_matches("u", "t")
    assert not X.iupac_matches("N", "N") and X.iupac_matches("x", "X") and not X.iupac_matches("X", "A")


def test_segments():
    assert X.best_segment(b"!!IIII!!", 20) == (2, 6)
    assert X.best_segment(b"!!!!", 20) == (0, 1) and X.best_segment(b"", 20) == (0, 0)
    assert X.best_segment(b"5" * 100, 20) == (0, 100)


@given(st.text(alphabet="!+5?I", min_size=1, max_size=25), st.integers(1, 39))
def test_segments_are_best(qual, cutoff):
    gain = [10.0 ** (-cutoff / 10.0) - X.phred_to_prob(ord(c)) for c in qual]
    start, stop = X.best_segment(qual.encode(), cutoff)
    sums = [sum(gain[i:j]) for i in range(len(gain)) for j in range(i + 1, len(gain) + 1)]
    assert sum(gain[start:stop]) == pytest.approx(max(sums))


@given(st.lists(st.text(alphabet="!+-?I", max_size=30), max_size=8), st.sampled_from([0.0, 10.0, 12.0, 20.0, 30.5]))
def test_segments_of_a_batch(quals, cutoff):
    """Against a fold from the left that gives a segment up when its sum falls below 0."""

    def fold(qual):
        best, at, run, begun = 0.0, (0, 0), 0.0, 0
        for k, c in enumerate(qual):
            if run < 0:
                run, begun = 0.0, k
            run += 10.0 ** (-cutoff / 10.0) - X.phred_to_prob(ord(c))
            if at == (0, 0) or run > best or (run == best and k + 1 - begun > at[1] - at[0]):
                best, at = run, (begun, k + 1)
        return at

    offsets = np.cumsum([0, *map(len, quals)])
    got = best_segments(offsets, np.frombuffer("".join(quals).encode(), np.uint8), cutoff)
    assert [tuple(x) for x in got.tolist()] == [fold(q) for q in quals]


def test_columns(spark):
    rows = [("ACGTNacgu", "IIII55555"), ("", ""), ("GGC", None), ("EFI", "!!!"), ("acgtn", " !I~+")]
    df = spark.createDataFrame(rows, "seq string, qual string")
    got = df.select(
        X.base_counts("seq").alias("c"), X.gc_content("seq").alias("gc"), X.n_fraction("seq").alias("n"), X.reverse_complement("seq").alias("rc"), X.protein_signal("seq").alias("p"),
        X.err_sum("qual").alias("e"), err_sum_native("qual").alias("e2"), X.mean_quality("qual").alias("mq"), X.arithmetic_mean_quality("qual").alias("aq"), X.count_above("qual", 20).alias("q20"),
    ).collect()
    assert tuple(got[0].c) == (2, 2, 2, 1, 1, 1) and got[0].gc == pytest.approx(4 / 7) and got[0].n == pytest.approx(1 / 9)
    assert got[0].rc == "ucgtNACGT" and got[3].p and not got[0].p
    assert got[0].e == pytest.approx(4e-4 + 0.05) and got[0].mq == pytest.approx(-10 * math.log10((4e-4 + 0.05) / 9)) and got[0].q20 == 9
    assert got[1].mq == 0 and got[1].gc == 0 and got[1].aq == 0
    assert got[2].e is None and got[2].mq is None and got[2].aq is None and got[2].q20 is None
    assert got[3].mq == pytest.approx(0) and got[4].e == pytest.approx(1 + 1 + 1e-4 + 10**-9.3 + 0.1)
    for r, (_, q) in zip(got, rows, strict=True):
        if q is not None and " " not in q:
            assert r.e == pytest.approx(r.e2)
            assert r.aq == pytest.approx(sum(ord(c) - 33 for c in q) / len(q) if q else 0)


@given(st.text(alphabet="ACGTUNacgtnRYK", max_size=40))
def test_reverse_complement_is_its_own_inverse(seq):
    rc = lambda s: "".join(map(X.complement_char, reversed(s)))
    assert rc(rc(seq)) == seq


def test_segment_column(spark):
    df = spark.createDataFrame([("!!IIII!!",), (None,), ("",), ("5" * 9,)], "qual string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(X.mott_segment("qual", 20.0)).collect()]
    assert got == [(2, 6), None, (0, 0), (0, 9)]
    assert df.where(F.col("qual").isNull()).count() == 1
