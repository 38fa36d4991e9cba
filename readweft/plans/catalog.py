"""One query for each operator over the derived reads, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from .. import operators as O
from ..functions.dna import count_of
from ..render import render
from ..scratch import new_folder
from ..sources import read_reads, write_blocks
from ..sources.sinks import output_format
from .derive import READS_SQL, reads_of, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# SQL fragments
_LEN = "length(seq)::BIGINT"
_ERR = "list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, -greatest(ascii(c) - 33, 0) / 10.0)))"
_MQ = f"CASE WHEN qual IS NULL THEN NULL WHEN qual = '' THEN 0.0 ELSE -10.0 * log10({_ERR} / length(qual)) END"


def _n(letters: str) -> str:
    return f"(length(seq) - length(regexp_replace(seq, '[{letters}]', '', 'g')))::BIGINT"


_GC = f"coalesce({_n('GCgc')}::DOUBLE / nullif({_n('ACGTacgt')}, 0), 0.0)"
_NFRAC = f"coalesce({_n('Nn')}::DOUBLE / nullif(length(seq), 0), 0.0)"
_RC = "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"


def _query(name: str, sql: str, with_: str = ""):
    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(reads_of(spark, sf_dir))
        SQL[name] = f"WITH {READS_SQL}{', ' + with_ if with_ else ''} {sql}"
        return f

    return put


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("ord", "id")


def _cut(df: DataFrame) -> DataFrame:
    return df.select("ord", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("seq_md5"), F.md5(F.coalesce("qual", F.lit(""))).alias("qual_md5"))


# reports

_count_sql = f"SELECT file, count(*) AS reads, sum({_LEN})::BIGINT AS bases FROM reads GROUP BY file"


@_query("count_per_file", _count_sql)
def _(df):
    return O.count_reads(df.withColumn("format", F.lit("FASTQ"))).drop("input_idx")


@_query("count_combined", f"SELECT 'total' AS file, count(*) AS reads, sum({_LEN})::BIGINT AS bases FROM reads")
def _(df):
    return O.count_reads(df, combine=True).drop("input_idx")


def _stats_sql(key: str, format_: str, extended: bool = False) -> tuple[str, str]:
    parts = f"""f AS (SELECT {key} AS file, format, {_LEN} AS len, qual, {_ERR} AS err, {_MQ} AS mq,
  {', '.join(f"len(list_filter(string_split(qual, ''), lambda c: ascii(c) >= {t + 33}))::BIGINT AS q{t}" for t in (10, 20, 30))},
  {_n('GCgc')} AS gc, {_n('ACGTUacgtu')} AS bases, {_n('Nn')} AS n, regexp_matches(seq, '[EFIJLOPQZefijlopqz]') AS p, regexp_matches(seq, '[Uu]') AS u, regexp_matches(seq, '[Tt]') AS t FROM reads),
h AS (SELECT file, len, sum(len) AS part FROM f GROUP BY file, len),
c AS (SELECT file, len, sum(part) OVER (PARTITION BY file ORDER BY len DESC) AS upto, sum(part) OVER (PARTITION BY file) AS all_ FROM h),
nx AS (SELECT file, max(len) FILTER (upto >= floor(all_ * 50.0 / 100)) AS n50, max(len) FILTER (upto >= floor(all_ * 90.0 / 100)) AS n90 FROM c GROUP BY file)"""
    pct = lambda x, of: f"round(coalesce(100.0 * {x} / nullif({of}, 0), 0.0), 6)"
    more = ""
    if extended:
        more = "".join(f", round(quantile_cont(len, {p / 100}), 6) AS len_p{p}, round(quantile_cont(mq, {p / 100}), 6) AS qual_p{p}" for p in O.report.PERCENTILES)
    sql = f"""SELECT file, {format_} AS format, CASE WHEN bool_or(p) THEN 'Protein' WHEN bool_or(u) AND NOT bool_or(t) THEN 'RNA' ELSE 'DNA' END AS seq_type,
  count(*) AS read_count, sum(len)::BIGINT AS total_bases, min(len) AS min_length, max(len) AS max_length, round(avg(len), 6) AS mean_length, round(median(len), 6) AS median_length,
  any_value(n50)::BIGINT AS n50, any_value(n90)::BIGINT AS n90, round(coalesce(-10.0 * log10(sum(err) / sum(len)), 0.0), 6) AS mean_quality,
  {', '.join(f"{pct(f'coalesce(sum(q{t}), 0)', 'sum(len)')} AS bases_above_q{t}_pct" for t in (10, 20, 30))}, {pct('sum(gc)', 'sum(bases)')} AS gc_content_pct, sum(n)::BIGINT AS ambiguous_bases{more}
FROM f JOIN nx USING (file) GROUP BY file"""
    return sql, parts


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "input_idx"))


_one = lambda df: df.withColumn("format", F.lit("FASTQ"))


@_query("stats_per_file", *_stats_sql("file", "'FASTQ'"))
def _(df):
    return _rounded(O.stats_reads(_one(df)))


@_query("stats_combined", *_stats_sql("'total'", "CASE WHEN count(DISTINCT format) > 1 THEN 'mixed' ELSE any_value(format) END"))
def _(df):
    return _rounded(O.stats_reads(df, combine=True))


@_query("stats_extended", *_stats_sql("file", "'FASTQ'", True))
def _(df):
    out = O.stats_reads(_one(df), extended=True)
    flat = [F.col(f"{key}.p{p}").alias(f"{name}_p{p}") for name, key in (("len", "length_percentiles"), ("qual", "quality_percentiles")) for p in O.report.PERCENTILES]
    return _rounded(out.select("*", *flat).drop("length_percentiles", "quality_percentiles"))


_stats, _parts = _stats_sql("file", "'FASTQ'", True)


def _some(columns: str) -> str:
    return f"SELECT {columns} FROM ({_stats})"


@_query("n50_n90", _some("file, n50, n90"), _parts)
def _(df):
    return O.report.nx_by(df.select("file", F.length("seq").cast("long").alias("len")), ["file"], 50, 90)


@_query("len_percentiles", _some("file, " + ", ".join(f"len_p{p}" for p in (10, 25, 50, 75, 90, 99))), _parts)
def _(df):
    got = O.report.length_percentiles(df.select("file", F.length("seq").cast("long").alias("len")), ["file"])
    return got.select("file", *(_r(f"l{p}").alias(f"len_p{p}") for p in O.report.PERCENTILES))


@_query("qual_percentiles", _some("file, " + ", ".join(f"qual_p{p}" for p in (10, 25, 50, 75, 90, 99))), _parts)
def _(df):
    got = O.report.exact_percentiles(df.select("file", X.mean_quality("qual").alias("x")), ["file"], "x")
    return got.select("file", *(_r(f"p{p}").alias(f"qual_p{p}") for p in O.report.PERCENTILES))


@_query("qpct", _some("file, bases_above_q10_pct, bases_above_q20_pct, bases_above_q30_pct"), _parts)
def _(df):
    shares = [_r(100.0 * F.sum(F.coalesce(X.count_above("qual", t), F.lit(0))) / F.sum(F.length("seq"))).alias(f"bases_above_q{t}_pct") for t in (10, 20, 30)]
    return df.groupBy("file").agg(*shares)


@_query("gc_content", f"SELECT ord, round({_GC}, 6) AS gc FROM reads")
def _(df):
    return df.select("ord", _r(X.gc_content("seq")).alias("gc"))


@_query("base_counts", "SELECT ord, " + ", ".join(f"{_n(x + x.lower())} AS {x.lower()}" for x in "ACGTN") + f", ({_LEN} - {_n('ACGTNacgtn')})::BIGINT AS other FROM reads")
def _(df):
    return df.select("ord", X.base_counts("seq").alias("c")).select("ord", "c.*")


@_query("seq_type", _some("file, seq_type"), _parts)
def _(df):
    has = lambda letters: F.bool_or(count_of("seq", letters) > 0)
    kind = F.when(F.bool_or(X.protein_signal("seq")), "Protein").when(has("Uu") & ~has("Tt"), "RNA").otherwise("DNA")
    return df.groupBy("file").agg(kind.alias("seq_type"))


@_query("mean_quality_per_read", f"SELECT ord, round({_MQ}, 6) AS mean_quality FROM reads")
def _(df):
    return df.select("ord", _r(X.mean_quality("qual")).alias("mean_quality"))


@_query("arithmetic_mean_quality", "SELECT ord, round(CASE WHEN qual IS NULL THEN NULL ELSE coalesce(list_avg(list_transform(string_split(qual, ''), lambda c: greatest(ascii(c) - 33, 0))), 0.0) END, 6) AS mean_quality FROM reads WHERE length(seq) > 0")
def _(df):
    return df.where(F.length("seq") > 0).select("ord", _r(X.arithmetic_mean_quality("qual")).alias("mean_quality"))


# filter


def _filter(name: str, where: str, **bounds) -> None:
    @_query(name, f"SELECT ord, id FROM reads WHERE length(seq) > 0 AND {where}")
    def _(df):
        return _ids(O.filter_reads(df, **bounds))


_filter("filter_default", "true")
_filter("filter_min_len", "length(seq) >= 1000", min_length=1000)
_filter("filter_max_len", "length(seq) <= 1000", max_length=1000)
_filter("filter_min_quality", f"(qual IS NULL OR {_MQ} >= 8.123)", min_quality=8.123)
_filter("filter_gc", f"{_GC} >= 0.5 AND {_GC} <= 0.55", min_gc=0.5, max_gc=0.55)
_filter("filter_max_n", f"{_NFRAC} <= 0.004", max_n=0.004)
_filter("filter_combined", f"length(seq) >= 300 AND length(seq) <= 5000 AND {_GC} >= 0.45 AND {_NFRAC} <= 0.02 AND (qual IS NULL OR {_MQ} >= 7.9)", min_length=300, max_length=5000, min_gc=0.45, max_n=0.02, min_quality=7.9)


@_query("crop", "SELECT ord, length(x)::BIGINT AS len, md5(x) AS seq_md5, md5(coalesce(y, '')) AS qual_md5 FROM (SELECT ord, substr(seq, 11, length(seq) - 30) AS x, substr(qual, 11, length(seq) - 30) AS y FROM reads WHERE length(seq) > 30)")
def _(df):
    return _cut(O.filter_reads(df, headcrop=10, tailcrop=20))


# The best segment as a fold: k places seen, best [bs, be) with sum b, the open one from cs with sum c; g is a place's gain.
_STATE = "{'k': 0, 'bs': 0, 'be': 0, 'b': 0.0::DOUBLE, 'cs': 0, 'c': 0.0::DOUBLE, 'g': %s}"
_GAINS = f"list_transform(string_split(q, ''), lambda ch: {_STATE % 'pow(10.0, -12.0 / 10.0) - pow(10.0, -greatest(ascii(ch) - 33, 0) / 10.0)'})"
_CS, _C = "(CASE WHEN acc.c < 0 THEN acc.k ELSE acc.cs END)", "((CASE WHEN acc.c < 0 THEN 0.0 ELSE acc.c END) + el.g)"
_BEST = f"(acc.be = 0 OR {_C} > acc.b OR ({_C} = acc.b AND acc.k + 1 - {_CS} > acc.be - acc.bs))"
_FOLD = f"""list_reduce({_GAINS}, lambda acc, el: {{'k': acc.k + 1, 'bs': CASE WHEN {_BEST} THEN {_CS} ELSE acc.bs END, 'be': CASE WHEN {_BEST} THEN acc.k + 1 ELSE acc.be END,
  'b': CASE WHEN {_BEST} THEN {_C} ELSE acc.b END, 'cs': {_CS}, 'c': {_C}, 'g': el.g}}, {_STATE % '0.0::DOUBLE'})"""
_trimmed = f"""SELECT ord, length(y)::BIGINT AS len, md5(y) AS seq_md5, md5(coalesce(z, '')) AS qual_md5 FROM (
  SELECT ord, CASE WHEN q IS NULL THEN x ELSE substr(x, f.bs + 1, f.be - f.bs) END AS y, CASE WHEN q IS NULL THEN NULL ELSE substr(q, f.bs + 1, f.be - f.bs) END AS z FROM (
    SELECT ord, x, q, CASE WHEN q IS NULL THEN NULL ELSE {_FOLD} END AS f FROM (SELECT ord, substr(seq, 6) AS x, substr(qual, 6) AS q FROM reads WHERE length(seq) > 5))) WHERE length(y) > 0"""


@_query("trim_quality", _trimmed)
def _(df):
    return _cut(O.filter_reads(df, trim=12.0, headcrop=5))


# grep


def _grep(name: str, where: str, patterns, **how) -> None:
    @_query(name, f"SELECT ord, id FROM reads WHERE {where}")
    def _(df):
        return _ids(O.grep_reads(df, patterns, **how))


_any = lambda ps: "|".join(ps)
_near = O.grep.wildcards("GATTACATG", 1)
_grep("grep_exact", "contains(upper(seq), 'GATTACAT')", "gattacat")
_grep("grep_case_sensitive", "contains(seq, 'GATTACAT')", "GATTACAT", case_sensitive=True)
_grep("grep_multi", "regexp_matches(seq, 'GATTACATG|CCCGTTAA|TTGACATA', 'i')", ["GATTACATG", "CCCGTTAA", "TTGACATA"])
_grep("grep_regex", "regexp_matches(seq, 'GAT{2,3}A[CG]A.{2}G', 'i')", "GAT{2,3}A[CG]A.{2}G", regex=True)
_grep("grep_mismatch1", f"regexp_matches(seq, '{_any(_near)}', 'is')", "GATTACATG", mismatches=1)
_grep("grep_iupac", "regexp_matches(seq, '[AG][TU][TU]A[CG][ACGTU][TU]G[AC]A', 'i')", "RTTASNTGMA", degenerate=True)
_grep("grep_iupac_mismatch", f"regexp_matches(seq, '{_any(O.grep.wildcards('RTTASNTGMAAC', 1, X.iupac_class))}', 's')", "RTTASNTGMAAC", degenerate=True, mismatches=1)
_grep("grep_both_strands", f"contains(upper(seq), 'GATTACATC') OR contains(upper({_RC}), 'GATTACATC')", "GATTACATC", both_strands=True)
_grep("grep_invert", "NOT contains(upper(seq), 'GATTA')", "GATTA", invert=True)
_grep("grep_name", "contains(upper(id), 'DOC12')", "Doc12", in_name=True)
_many = [f"{a}{b}{c}{d}TA" for a in ("GAT", "CCA", "TTG", "AAC", "CGT") for b in "ACGT" for c in "ACGT" for d in ("CA", "GG", "TT")]
_grep("grep_many", f"regexp_matches(seq, '{_any(_many)}', 'i')", _many)


@_query("revcomp", f"SELECT ord, md5({_RC}) AS seq_md5 FROM reads")
def _(df):
    return df.select("ord", F.md5(X.reverse_complement("seq")).alias("seq_md5"))


# sample, head and tail

_h = "md5('7:0:' || ord::VARCHAR)"
_draw = f"('0x' || substr({_h}, 1, 8))::BIGINT"
_bernoulli = lambda share: f"SELECT ord, id FROM reads WHERE {_draw} < ({share}) * 4294967296.0::DOUBLE"


@_query("sample_count", f"SELECT ord, id FROM reads ORDER BY {_h}, ord LIMIT 100")
def _(df):
    return _ids(O.sample_count(df, 100, 7))


@_query("sample_proportion", _bernoulli("0.3::DOUBLE"))
def _(df):
    return _ids(O.sample_proportion(df, 0.3, 7))


@_query("sample_bases", _bernoulli(f"(SELECT least(500000::DOUBLE / sum({_LEN})::DOUBLE, 1.0) FROM reads)"))
def _(df):
    return _ids(O.sample_bases(df, 500_000, 7))


@_query("sample_coverage", _bernoulli(f"(SELECT least(250000::DOUBLE / sum({_LEN})::DOUBLE, 1.0) FROM reads)"))
def _(df):
    return _ids(O.sample_coverage(df, 2.5, "100K", 7))


_sums = f"r AS (SELECT *, coalesce(sum({_LEN}) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum({_LEN}) OVER (ORDER BY ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM reads)"


@_query("head_n", "SELECT ord, id FROM reads ORDER BY ord LIMIT 25")
def _(df):
    return _ids(O.head_reads(df, 25))


@_query("tail_n", "SELECT ord, id FROM reads ORDER BY ord DESC LIMIT 25")
def _(df):
    return _ids(O.tail_reads(df, 25))


@_query("head_bases", "SELECT ord, id FROM r WHERE before < 400000", _sums)
def _(df):
    return _ids(O.head_bases(df, 400_000, block=256))


@_query("tail_bases", "SELECT ord, id FROM r WHERE after < 400000", _sums)
def _(df):
    return _ids(O.tail_bases(df, 400_000, block=256))


# convert

_fastq = r"'@' || id || chr(10) || seq || chr(10) || '+' || chr(10) || "


@_query("convert_fasta_text", "SELECT ord, md5('>' || id || chr(10) || seq) AS record_md5 FROM reads")
def _(df):
    return O.converted(df, "FASTA").select("ord", F.md5("value").alias("record_md5"))


@_query("convert_fastq_text", f"SELECT ord, md5({_fastq} qual) AS record_md5 FROM reads WHERE qual IS NOT NULL")
def _(df):
    return O.converted(df.where("qual is not null"), "FASTQ").select("ord", F.md5("value").alias("record_md5"))


@_query("convert_fake_quality", f"SELECT ord, md5({_fastq} coalesce(qual, repeat('?', length(seq)))) AS record_md5 FROM reads")
def _(df):
    return O.converted(df, "FASTQ", fake_quality=30).select("ord", F.md5("value").alias("record_md5"))


@_query("convert_keep_format", f"SELECT ord, md5(CASE WHEN qual IS NULL THEN '>' || id || chr(10) || seq ELSE {_fastq} qual END) AS record_md5 FROM reads")
def _(df):
    kept = [O.converted(df.where(F.col("format") == kind), output_format(kind)) for kind in ("FASTA", "FASTQ")]
    return kept[0].unionByName(kept[1]).select("ord", F.md5("value").alias("record_md5"))


# files: the reads are written as text and read again

_whole = f"id, {_LEN} AS len, md5(seq) AS seq_md5, md5(coalesce(qual, '')) AS qual_md5"


def _whole_reads(df: DataFrame) -> DataFrame:
    return df.select("id", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("seq_md5"), F.md5(F.coalesce("qual", F.lit(""))).alias("qual_md5"))


_DNA = "qual is not null and seq rlike '^[ACGTN]+$'"


def _scan_blocks(name: str, fmt: str, **how) -> None:
    where, sql = (_DNA, "qual IS NOT NULL AND regexp_matches(seq, '^[ACGTN]+$')") if fmt == "BAM" else ("qual is not null", "qual IS NOT NULL")

    @_query(name, f"SELECT {_whole} FROM reads WHERE {sql}")
    def _(df):
        files = write_blocks(df.where(where), new_folder(df.sparkSession, "blocks"), fmt)
        return _whole_reads(read_reads(df.sparkSession, files, **how))


def _scan(name: str, fmt: str, zipped: bool = False, **how) -> None:
    where = "qual is not null" if fmt == "FASTQ" else "true"
    columns = _whole if fmt == "FASTQ" else _whole.replace("md5(coalesce(qual, ''))", "md5('')")

    @_query(name, f"SELECT {columns} FROM reads WHERE {where}")
    def _(df):
        return _whole_reads(read_reads(df.sparkSession, stored(df.where(where), fmt, zipped), fmt=fmt, **how))


_scan("scan_fastq", "FASTQ")
_scan("scan_fastq_splits", "FASTQ", split_bytes=50_000)
_scan("scan_fastq_gzip", "FASTQ", zipped=True)
_scan("scan_fasta", "FASTA")
_scan("scan_fasta_splits", "FASTA", split_bytes=50_000)
_scan("scan_fasta_gzip", "FASTA", zipped=True)


@_query("scan_head_gzip", "SELECT count(*) AS reads, sum(length(seq))::BIGINT AS bases FROM reads WHERE qual IS NOT NULL")
def _(df):
    """Every base of several gzip files, in blocks of their text."""
    back = read_reads(df.sparkSession, stored(df.where("qual is not null"), "FASTQ", True), fmt="FASTQ")
    return O.head_bases(back, 10**12, block=1 << 16).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).cast("long").alias("bases"))


_scan_blocks("scan_bam", "BAM")
_scan_blocks("scan_bam_splits", "BAM", split_bytes=20_000)
_scan_blocks("scan_bgzf_splits", "FASTQ", split_bytes=20_000)


@_query("scan_twice", f"SELECT id, 2::BIGINT AS times, 2 * {_LEN} AS bases FROM reads")
def _(df):
    """A list of files in which each is named twice."""
    files = stored(df, "FASTA", False)
    return read_reads(df.sparkSession, files * 2, fmt="FASTA").groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.sum(F.length("seq")).cast("long").alias("bases"))


# reports as text: their rows are one an input

_counts = "c AS (SELECT file, count(*) AS reads, sum(length(seq))::BIGINT AS bases FROM reads GROUP BY file)"


def _lines(df: DataFrame, fmt: str) -> list[str]:
    return render(O.count_reads(_one(df)), fmt).splitlines()


def _told(df: DataFrame, lines: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in lines], "line string")


@_query("report_tsv", r"SELECT concat_ws(chr(9), file, reads, bases) AS line FROM c UNION ALL SELECT concat_ws(chr(9), 'file', 'reads', 'bases')", _counts)
def _(df):
    return _told(df, _lines(df, "tsv"))


@_query("report_table", "SELECT concat_ws('|', file, format('{:,}', reads), format('{:,}', bases)) AS line FROM c UNION ALL SELECT 'file|reads|bases'", _counts)
def _(df):
    """The table for people; the spaces between its columns depend on all rows and are taken as one bar."""
    return _told(df, ["|".join(x.split()) for x in _lines(df, "human")])


@_query("report_json", """SELECT '"file": "' || file || '", "reads": ' || reads || ', "bases": ' || bases AS line FROM c""", _counts)
def _(df):
    text = " ".join(x.strip() for x in _lines(df, "json"))
    return _told(df, [x.strip(" {}") for x in text.strip("[] ").split("}, {")])
