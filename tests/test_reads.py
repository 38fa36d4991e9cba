import io
import json

import pytest
from fixtures import BAM_READS, FASTA, FASTQ, READS, bam, write

from pyspark.sql import functions as F

from readweft import operators as O
from readweft.cli import one_file, run
from readweft.errors import BadArgument, ReadweftError, UnsupportedCompression
from readweft.render import render
from readweft.sources import fasta_lines, fastq_lines, inputs_frame, read_reads, read_stdin, write_reads


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("reads")
    return {
        "fq": write(top, "small.fastq", FASTQ), "fa": write(top, "small.fasta", FASTA), "gz": write(top, "small.fastq.gz", FASTQ),
        "bam": write(top, "small.bam", bam()), "plain_gz": write(top, "named.fq", __import__("gzip").compress(FASTQ.encode())), "none": write(top, "none.fq", ""), "top": top,
    }


def rows(df):
    return [(r.id, r.desc, r.seq, r.qual) for r in df.orderBy("input_idx", "ord").collect()]


EXPECTED = [(n, None, s, q * len(s)) for n, s, q in READS]


@pytest.mark.parametrize("name", ["fq", "gz", "plain_gz"])
def test_fastq(spark, files, name):
    assert rows(read_reads(spark, files[name])) == EXPECTED


@pytest.mark.parametrize("size", [7, 50, 64, 101])
def test_splits_lose_and_double_nothing(spark, files, size):
    tricky = "".join(f"@r{k}\nACGT{'A' * (k % 5)}\n+\n@@+@{'@' * (k % 5)}\n" for k in range(30))
    path = write(files["top"], "tricky.fq", tricky)
    got = rows(read_reads(spark, path, split_bytes=size))
    assert [g[0] for g in got] == [f"r{k}" for k in range(30)]
    assert rows(read_reads(spark, files["fq"], split_bytes=size)) == EXPECTED
    assert rows(read_reads(spark, files["fa"], split_bytes=size)) == rows(read_reads(spark, files["fa"]))


def test_fastq_blocks(spark, files, monkeypatch):
    """Records across blocks, odd line ends and descriptions come out as they do line by line."""
    import random

    from readweft.sources import reader

    rng = random.Random(1)
    for ends, extra in (("\n", ""), ("\r\n", ""), ("\n", " a  b"), ("\n", "\tx y"), ("\n", " é")):
        parts = []
        for k in range(60):
            n = rng.randrange(0, 30)
            parts.append(f"@r{k}{extra}{ends}{'ACGT' * n}{ends}+r{k}{ends}{'@+I~' * n}{ends}")
        text = "".join(parts)
        for last in (text, text.rstrip("\r\n") if not text.endswith("\n\n") else text, text + "\n\n"):
            path = write(files["top"], "blocks.fq", last.encode("latin-1"))
            want = [("r%d" % k, p) for k, p in enumerate(parts)]
            found = []
            for size in (64, 1 << 20):
                monkeypatch.setattr(reader, "BATCH_BYTES", size)
                for split in (97, 1 << 30):
                    got = []
                    cuts = list(range(0, len(last.encode("latin-1")), split))
                    for a, z in zip(cuts, [*cuts[1:], None], strict=True):
                        r = reader._Range(0, path, "x", "FASTQ", a, z, False)
                        for batch in reader.ReadsReader({"inputs": "[]"}).read(r):
                            got += batch.to_pylist()
                    found.append([(g["ord"], g["id"], g["desc"], g["seq"], g["qual"]) for g in got])
            assert all(f == found[0] for f in found) and [f[1] for f in found[0]] == [w[0] for w in want]
            assert all(f[2] == (extra.strip() or None) for f in found[0])


def test_fasta_and_bam(spark, files):
    assert rows(read_reads(spark, files["fa"])) == [("seq1", "first sequence", "ACGTACGTACGT", None), ("seq2", None, "GGGGCCCCAAAATTTT", None), ("seq3", None, "ACGTNNNNACGT", None)]
    assert rows(read_reads(spark, files["bam"])) == [(n, None, s, chr(q + 33) * len(s)) for n, s, q in BAM_READS]
    odd = write(files["top"], "odd.bam", bam([("", "ACG", None), ("x", "", 3)]))
    assert rows(read_reads(spark, odd)) == [("", None, "ACG", None), ("x", None, "", None)]


@pytest.mark.parametrize("text", [60, 700, 0xFF00])
def test_splits_of_blocks(files, text):
    """Every range of a BGZF file owns what it should, wherever blocks and records are cut."""
    import random

    from readweft.sources import blocks, reader

    rng = random.Random(text)
    reads = [(f"r{k}", "".join(rng.choices("ACGT", k=rng.choice([1, 2, 5, 80, 900]))), rng.choice([None, "@", "!", "~"])) for k in range(300)]
    reads[150] = ("long", "ACGT" * 8000, "I")
    reads[7] = ("ff", "A" * 5000, None)
    sequences = [(n, s) for n, s, _ in reads]
    whole = {
        "b.bam": blocks.BAM_HEADER + b"".join(blocks.bam_record(n, s, q and q * len(s)) for n, s, q in reads),
        "b.fq.gz": "".join(f"@{n}\n{s}\n+\n{(q or '+') * len(s)}\n" for n, s, q in reads).encode(),
        "b.fa.gz": "".join(f">{n}\n{s[:40]}\n{s[40:]}\n" for n, s, _ in reads).encode(),
    }
    for name, data in whole.items():
        path = write(files["top"], name[:2] + "raw", b"".join(blocks.block(data[k : k + text]) for k in range(0, len(data), text)) + blocks.block(b""))
        kind = {"b.bam": "BAM", "b.fq.gz": "FASTQ", "b.fa.gz": "FASTA"}[name]
        for split in (3000, 20000, 1 << 30):
            found = []
            r = reader.ReadsReader({"inputs": json.dumps([{"idx": 0, "path": path, "label": "x", "format": kind}]), "splitbytes": str(split)})
            ranges = r.partitions()
            for part in ranges:
                for batch in r.read(part):
                    found += batch.to_pylist()
            assert [(x["id"], x["seq"]) for x in found] == sequences, (name, split)
            assert all(a["ord"] < b["ord"] for a, b in zip(found, found[1:], strict=False))
            assert kind != "BAM" or [x["qual"] for x in found] == [q and q * len(s) for _, s, q in reads]
            assert len(ranges) > 3 or split > 3000
        few = reader.ReadsReader({"inputs": json.dumps([{"idx": 0, "path": path, "label": "x", "format": kind}]), "limit": "5"})
        (part,) = few.partitions()
        assert [x["id"] for batch in few.read(part) for x in batch.to_pylist()] == [n for n, _ in sequences[:5]]


def test_blocks_written(spark, files, tmp_path):
    from readweft.sources import write_blocks

    fq = read_reads(spark, files["fq"])
    for kind in ("BAM", "FASTQ", "FASTA"):
        paths = write_blocks(fq, str(tmp_path / kind), kind)
        got = rows(read_reads(spark, paths))
        assert [(a, c) for a, _, c, _ in got] == [(a, c) for a, _, c, _ in EXPECTED] and (kind == "FASTA" or got == EXPECTED)
        assert spark.read.format("binaryFile").load(paths).count() == len(paths)
    odd = spark.createDataFrame([("x", "acgu-", None), (None, "", None), ("\u00e9", "ACG", "!I~")], "id string, seq string, qual string").coalesce(1)
    assert rows(read_reads(spark, write_blocks(odd, str(tmp_path / "odd"), "BAM"))) == [("x", None, "ACGNN", None), ("", None, "", None), ("\u00e9", None, "ACG", "!I~")]
    none = write_blocks(fq.where("false").coalesce(1), str(tmp_path / "none"), "BAM")
    assert rows(read_reads(spark, none)) == []
    with pytest.raises(BadArgument):
        write_blocks(fq, str(tmp_path / "x"), "SAM")


def test_malformed(spark, files):
    for name, text in (("a.fq", "@r\nACGT\n+\nII\n"), ("b.fq", "r\nA\n+\nI\n"), ("c.fq", "@r\nACGT\n"), ("d.bam", "BAM"), ("e.sam", "@HD\tVN:1\n")):
        with pytest.raises(Exception):
            read_reads(spark, write(files["top"], name, text)).collect()
    with pytest.raises(Exception, match="bzip2|not supported"):
        read_reads(spark, write(files["top"], "x.fastq.bz2", b"BZh91AY")).collect()
    with pytest.raises(ReadweftError):
        read_reads(spark, "x.txt")


GOLDEN = {
    "fq": {"read_count": 5, "total_bases": 206, "min_length": 10, "max_length": 100, "mean_length": 41.2, "median_length": 32, "n50": 40, "n90": 24, "mean_quality": 21.5849,
           "bases_above_q10_pct": 100, "bases_above_q20_pct": 95.145631, "bases_above_q30_pct": 46.601942, "gc_content_pct": 27.272727, "ambiguous_bases": 8},
    "fa": {"read_count": 3, "total_bases": 40, "min_length": 12, "max_length": 16, "mean_length": 13.333333, "median_length": 12, "n50": 12, "n90": 12, "mean_quality": 0,
           "bases_above_q10_pct": 0, "bases_above_q20_pct": 0, "bases_above_q30_pct": 0, "gc_content_pct": 50, "ambiguous_bases": 4},
    "bam": {"read_count": 3, "total_bases": 24, "min_length": 8, "max_length": 8, "mean_length": 8, "median_length": 8, "n50": 8, "n90": 8, "mean_quality": 24.317983,
            "bases_above_q10_pct": 100, "bases_above_q20_pct": 100, "bases_above_q30_pct": 66.666667, "gc_content_pct": 70, "ambiguous_bases": 4},
    "none": {"read_count": 0, "total_bases": 0, "min_length": 0, "max_length": 0, "mean_length": 0, "median_length": 0, "n50": 0, "n90": 0, "mean_quality": 0,
             "bases_above_q10_pct": 0, "bases_above_q20_pct": 0, "bases_above_q30_pct": 0, "gc_content_pct": 0, "ambiguous_bases": 0},
}


def test_stats(spark, files):
    paths = [files[k] for k in GOLDEN]
    got = O.stats_reads(read_reads(spark, paths), inputs_frame(spark, paths), extended=True).orderBy("input_idx").collect()
    for r, (name, want) in zip(got, GOLDEN.items(), strict=True):
        for key, value in want.items():
            assert r[key] == pytest.approx(value, abs=1e-5), (name, key)
        assert r.seq_type == "DNA"
    assert [r.format for r in got] == ["FASTQ", "FASTA", "BAM", "FASTQ"]
    assert tuple(got[0].length_percentiles) == pytest.approx((15.6, 24, 32, 40, 76, 97.6))
    assert tuple(got[0].quality_percentiles) == pytest.approx((16.4, 20, 30, 39, 39.6, 39.96))
    assert got[1].quality_percentiles is None and tuple(got[3].length_percentiles) == (0,) * 6


def test_combined(spark, files):
    paths = [files["fq"], files["fa"]]
    r = O.stats_reads(read_reads(spark, paths), inputs_frame(spark, paths), combine=True).first()
    assert (r.file, r.format, r.read_count, r.total_bases, r.n50, r.n90, r.ambiguous_bases) == ("total", "mixed", 8, 246, 40, 12, 12)
    assert r.mean_quality == pytest.approx(22.355578, abs=1e-5) and r.bases_above_q30_pct == pytest.approx(39.02439, abs=1e-5) and r.gc_content_pct == pytest.approx(30.769231, abs=1e-5)
    twice = [files["fq"], files["fq"]]
    assert O.count_reads(read_reads(spark, twice), inputs_frame(spark, twice), combine=True).first()["bases"] == 412
    assert [r.bases for r in O.count_reads(read_reads(spark, twice), inputs_frame(spark, twice)).collect()] == [206, 206]


@pytest.mark.parametrize(("seqs", "kind"), [(["ACGU", "AC"], "RNA"), (["ACGU", "ACGT"], "DNA"), (["MKLF"], "Protein"), (["NNX*"], "DNA")])
def test_types(spark, files, seqs, kind):
    path = write(files["top"], "t.fa", "".join(f">a\n{s}\n" for s in seqs))
    assert O.stats_reads(read_reads(spark, path)).first()["seq_type"] == kind


def ids(df):
    return [r.id for r in df.orderBy("input_idx", "ord").collect()]


def test_filter(spark, files):
    df = read_reads(spark, files["fq"])
    assert ids(O.filter_reads(df, min_length=50)) == ["read4"] and len(ids(O.filter_reads(df))) == 5
    assert ids(O.filter_reads(df, max_n=0.2)) == ["read1", "read2", "read4", "read5"]
    assert ids(O.filter_reads(df, min_quality=20.1)) == ["read1", "read2", "read3"] and ids(O.filter_reads(df, min_quality=19.9))[-1] == "read4"
    assert ids(O.filter_reads(df, min_gc=0.5, max_gc=0.9)) == ["read1", "read2", "read3"]
    assert O.total_bases(O.filter_reads(df, trim=20)) == 197
    assert ids(O.filter_reads(df, headcrop=6, tailcrop=4)) == ["read1", "read2", "read3", "read4"]
    assert rows(O.filter_reads(df, headcrop=2, tailcrop=5))[4] == ("read5", None, "GCG", "///")
    assert ids(O.filter_reads(df, min_length=50, max_length=10)) == []
    fa = read_reads(spark, files["fa"])
    assert ids(O.filter_reads(fa, min_quality=40, trim=30)) == ["seq1", "seq2", "seq3"]
    empty = write(files["top"], "empty.fa", ">a\n>b\nAC\n")
    assert ids(O.filter_reads(read_reads(spark, empty))) == ["b"] and ids(O.head_reads(read_reads(spark, empty), 5)) == ["a", "b"]


def test_limits(spark, files):
    df = read_reads(spark, files["fq"])
    for block in (1, 100, 1 << 26):
        assert ids(O.head_bases(df, 1, block)) == ["read1"] and ids(O.head_bases(df, 41, block)) == ["read1", "read2"] and ids(O.head_bases(df, 0, block)) == []
        assert ids(O.tail_bases(df, 11, block)) == ["read4", "read5"] and ids(O.tail_bases(df, 10, block)) == ["read5"] and ids(O.tail_bases(df, 0, block)) == []
        assert len(ids(O.tail_bases(df, 10**6, block))) == 5
    for kind in ("gz", "fa", "bam"):  # places are bytes in every kind, so that blocks are small in each
        own = read_reads(spark, files[kind])
        places = [r.ord for r in own.orderBy("ord").collect()]
        assert places[0] < 100 and all(b - a > 10 for a, b in zip(places, places[1:], strict=False))
        assert [ids(O.head_bases(own, 10**6, block)) for block in (1, 1 << 26)] == [ids(own)] * 2
    assert [r.ord for r in read_reads(spark, files["gz"]).orderBy("ord").collect()] == [r.ord for r in df.orderBy("ord").collect()]
    assert ids(O.head_reads(df, 2)) == ["read1", "read2"] and ids(O.tail_reads(df, 2)) == ["read4", "read5"] and len(ids(O.tail_reads(df, 99))) == 5
    assert ids(read_reads(spark, files["fq"], limit=2)) == ["read1", "read2"]
    both = read_reads(spark, [files["fa"], files["fq"]])
    assert ids(O.head_reads(both, 3)) + ids(O.tail_reads(both, 5)) == ids(both)


def test_grep(spark, files):
    df = read_reads(spark, files["fq"])
    find = lambda *a, **k: ids(O.grep_reads(df, *a, **k))
    assert find("ggggcccc") == ["read2"] and find("ggggcccc", case_sensitive=True) == [] and find("TTTTTTTT") == []
    assert find("GGNNCCCC", degenerate=True) == ["read2"] and len(find("NNNN", degenerate=True)) == 5 and find("NNNN") == ["read3"]
    assert find("TTTT") == ["read2"] and find("TTTT", both_strands=True) == ["read2", "read4"]
    assert find("A", invert=True) == ["read5"] and find("READ1", in_name=True) == ["read1"] and find(["CCCCAAAA", "GCGC"]) == ["read2", "read5"]
    assert find("G{4}C{4}", regex=True) == ["read2"] and find("GGGGCCCT", mismatches=1) == ["read2"] and find("GGGGCCTT", mismatches=1) == []
    assert find("A" * 101, mismatches=200) == [] and find("TTTTTTTTTTT", mismatches=11) == ["read1", "read2", "read3", "read4"]
    for bad in ({"patterns": ""}, {"patterns": "A", "regex": True, "mismatches": 1}, {"patterns": "A", "in_name": True, "both_strands": True}, {"patterns": "(?=A)", "regex": True}, {"patterns": "(", "regex": True}):
        with pytest.raises(BadArgument):
            O.grep_reads(df, **bad)


def test_grep_kernels_agree(spark, files):
    """The regular expressions and the Arrow functions give the same reads."""
    df = read_reads(spark, [files["fq"], files["fa"]])
    for p, k, d in (("ACGTAC", 1, False), ("GGCCNN", 2, True), ("ccaa", 1, False), ("TTNGG", 0, True)):
        want = ids(O.grep_reads(df, p, mismatches=k, degenerate=d))
        assert ids(df.where(O.grep._fuzzy([p], k, d, True)("seq"))) == want
    odd = spark.createDataFrame([(t,) for t in ("x\u0141bd", "x\u0141bc", "x?bc", "\u00e9AB", "\u00c9ab", "\U0001f642ab", "ab\U0001f642", "", None, "a.b")], "seq string")
    for p, k, d, fold in (("x\u0141bd", 1, False, True), ("\u00e9ab", 0, True, True), ("\u00e9ab", 1, False, False), ("\U0001f642AB", 1, False, True), ("a.b", 1, False, True), ("[-", 1, True, True)):
        old = [O.grep.matcher([p] * n, mismatches=k, degenerate=d, case_sensitive=not fold) for n in (1, 201)]
        one, other = ([r[0] for r in odd.where(m(F.col("seq"))).collect()] for m in old)
        assert one == other, p
    many = ["GATTACA"] * 250 + ["CCCAAAA"]
    assert ids(O.grep_reads(df, many)) == ids(O.grep_reads(df, "CCCAAAA"))


def test_sample(spark, files):
    df = read_reads(spark, files["fq"])
    assert len(ids(O.sample_count(df, 2, 1))) == 2 and len(ids(O.sample_count(df, 9, 1))) == 5 and ids(O.sample_count(df, 0, 1)) == []
    assert ids(O.sample_proportion(df, 0, 1)) == [] and len(ids(O.sample_proportion(df, 1, 1))) == 5
    big = spark.range(20000).selectExpr("0 input_idx", "id ord", "'A' seq")
    a = {r.ord for r in O.sample_proportion(big, 0.3, 5).collect()}
    assert a == {r.ord for r in O.sample_proportion(big.repartition(7), 0.3, 5).collect()} and 5700 < len(a) < 6300
    assert a != {r.ord for r in O.sample_proportion(big, 0.3, 6).collect()}
    ranged = {r.ord for r in O.sample_count(big, 10_001, 5).collect()}
    assert len(ranged) == 10_001 and {r.ord for r in O.sample_count(big, 10_000, 5).collect()} < ranged
    assert 1700 < O.sample_bases(big, 2000, 5).count() < 2300 and O.sample_coverage(big, 30, "5M").count() == 20000
    assert O.sample.coverage_target(30, "5M") == 150_000_000
    for bad in ({}, {"count": 1, "bases": 5}, {"coverage": 3}, {"genome_size": 5}, {"proportion": 1.5}, {"coverage": 0, "genome_size": 5}, {"bases": 5, "stdin": True}):
        with pytest.raises(BadArgument):
            O.sample_reads(df, **bad)


def test_convert_and_write(spark, files, tmp_path):
    fa, fq = read_reads(spark, files["fa"]), read_reads(spark, files["fq"])
    with pytest.raises(BadArgument):
        O.convert_reads(fa, "FASTQ", source="FASTA")
    with pytest.raises(Exception, match="no quality"):
        fa.select(fastq_lines()).collect()
    assert {r.qual for r in O.convert_reads(fa, "FASTQ", 30).collect()} == {"?" * 12, "?" * 16}
    assert O.converted(fq, "FASTA").orderBy("ord").first()["value"] == ">read1\n" + "ACGT" * 10
    assert fa.orderBy("ord").select(fasta_lines()).first()[0] == ">seq1 first sequence\nACGTACGTACGT"
    for path, kind in ((tmp_path / "x.fq", "FASTQ"), (tmp_path / "x.fa.gz", "FASTA"), (tmp_path / "y.fastq.gz", "FASTQ")):
        one_file(fq, str(path), kind)
        assert [(a, c) for a, _, c, _ in rows(read_reads(spark, str(path)))] == [(a, c) for a, _, c, _ in EXPECTED]
    assert (tmp_path / "x.fq").read_text() == FASTQ
    for bad in ("x.fq.bz2", "x.fq.xz", "x.fq.zst"):
        with pytest.raises(UnsupportedCompression):
            write_reads(fq, str(tmp_path / bad), "FASTQ")
    assert O.target_format(None, "a.fa.gz") == "FASTA" and O.target_format("fastq", "a.fa") == "FASTQ"
    for to, out in ((None, None), (None, "x.txt"), (None, "x.bam")):
        with pytest.raises(BadArgument):
            O.target_format(to, out)


def test_stdin(spark):
    for data, kind in ((FASTQ.encode(), "FASTQ"), (FASTA.encode(), "FASTA"), (bam(), "BAM"), (b"", "FASTQ"), (__import__("gzip").compress(FASTQ.encode()), "FASTQ")):
        df, path = read_stdin(spark, io.BytesIO(data))
        n = df.count()
        assert n == {b"": 0}.get(data, 3 if kind != "FASTQ" else 5) and (not n or df.first()["format"] == kind)


def test_render(spark, files):
    paths = [files["fq"], files["fa"]]
    report = O.stats_reads(read_reads(spark, paths, True), inputs_frame(spark, paths, True), extended=True)
    lines = render(report, "tsv").splitlines()
    assert lines[0].startswith("file\tformat\ttype\treads\ttotal_bases") and lines[0].endswith("qual_p90\tqual_p99") and len(lines) == 3
    assert lines[1].split("\t")[:6] == ["small.fastq", "FASTQ", "DNA", "5", "206", "10"] and lines[1].split("\t")[14] == "46.60"
    assert lines[2].split("\t")[-6:] == ["-"] * 6
    told = json.loads(render(report, "json"))
    assert [x["read_count"] for x in told] == [5, 3] and "quality_percentiles" not in told[1] and told[0]["length_percentiles"]["p90"] == 76
    human = render(report, "human").splitlines()
    assert "46.60%" in human[1] and human[0].split()[:4] == ["file", "format", "type", "reads"]
    one = O.count_reads(read_reads(spark, files["fq"]), inputs_frame(spark, [files["fq"]]))
    assert json.loads(render(one, "json")) == {"file": files["fq"], "reads": 5, "bases": 206}


def test_cli(spark, files, capsys, tmp_path):
    def said(*argv):
        assert run(spark, list(argv)) == 0
        return capsys.readouterr()

    assert json.loads(said("stats", files["gz"], "--json").out)["n50"] == 40
    assert len(said("count", files["fq"], files["fa"], "--tsv").out.splitlines()) == 3
    got = said("filter", "-l", "50", files["fq"])
    assert got.out.startswith("@read4\n") and got.err == "kept 1 / 5 reads (20.0%)\n"
    for quiet in (("--quiet", "head"), ("head", "--quiet")):
        assert tuple(said(*quiet, "-n", "2", files["fa"])) == (">seq1 first sequence\nACGTACGTACGT\n>seq2\nGGGGCCCCAAAATTTT\n", "")
    assert said("--verbose", "count", files["fq"], "--no-log").err == f"count: reading {files['fq']}\n"
    assert said("tail", "--bases", "11", files["fq"]).err == "wrote 2 records\n"
    assert said("grep", "-p", "TTTT", "--both-strands", files["fq"]).err == "kept 2 / 5 reads\n"
    assert said("sample", "-n", "3", "--seed", "4", files["fq"]).err == "kept 3 / 5 reads\n"
    out = str(tmp_path / "o.fa")
    assert said("convert", files["bam"], "-o", out).err == "wrote 3 records\n" and open(out).read().startswith(">read1\nACGTACGT\n")
    assert said("convert", files["bam"], "--to", "fastq").out.startswith("@read1\nACGTACGT\n+\nIIIIIIII\n")
    patterns = write(tmp_path, "p.txt", "# two\n GCGCG \n")
    assert said("grep", "-f", patterns, files["fq"]).out.startswith("@read5\n")
    assert said("head", "--bases", "0.04K", files["fq"]).out.startswith("@read1\n")
    for shell in ("bash", "zsh", "fish"):
        script = said("completions", shell).out
        assert "readweft" in script and "grep" in script and "both-strands" in script
    shown = said()
    assert shown.out == "" and "Version:" in shown.err and "Build date:" in shown.err
    for verb in ("qc", "logs"):
        with pytest.raises(NotImplementedError):
            run(spark, [verb])
    for bad in (["grep", files["fq"]], ["head", "-n", "1", "--bases", "2", files["fq"]], ["stats", "--json", "--tsv", files["fq"]]):
        with pytest.raises(SystemExit):
            run(spark, bad)


def test_prompt(capsys, tmp_path):
    """A line of the prompt is split as a shell does; errors end no session."""
    from readweft.cli import parser
    from readweft.shell import candidates, one_line

    ran = []
    assert one_line(parser(), " count 'a b.fq' --tsv ", ran.append) and ran == [["count", "a b.fq", "--tsv"]]
    assert one_line(parser(), "", ran.append) and one_line(parser(), "help", ran.append) and "grep " in capsys.readouterr().out
    assert one_line(parser(), "nothing", ran.append) and one_line(parser(), "count --json --tsv x", ran.append) and len(ran) == 1
    assert one_line(parser(), "count 'x", ran.append) and "error: " in capsys.readouterr().err
    assert one_line(parser(), "stats x", lambda argv: 1 / 0) and "error: division" in capsys.readouterr().err
    assert not one_line(parser(), "exit", ran.append) and not one_line(parser(), " quit", ran.append)
    write(tmp_path, "some.fq", "")
    assert candidates(parser(), "he", "he") == ["head "] and candidates(parser(), "head --b", "--b") == ["--bases "]
    assert candidates(parser(), f"head {tmp_path}/so", f"{tmp_path}/so") == [f"{tmp_path}/some.fq "] and candidates(parser(), "what --x", "--x") == []


def test_stream(spark, files, tmp_path):
    from readweft.streaming import appended_reads, streamed

    read_reads(spark, files["fq"]).write.parquet(str(tmp_path / "in"))
    steps = (lambda df: O.filter_reads(df, min_length=20), lambda df: O.grep_reads(df, "ACGT"))
    query = streamed(appended_reads(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), *steps)
    query.awaitTermination(60)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ["read1", "read3"]
