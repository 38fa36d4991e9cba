"""python -m readweft VERB ...: the operators on files, from a shell. Reports and records go to standard output,
what was done to standard error."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import operators as O
from .errors import BadArgument, ReadweftError
from .functions.size import parse_size
from .render import output_format as report_format
from .render import render
from .schema import FASTA
from .shell import SHELLS, banner, completions, interactive
from .sources import check_sink, detect_format, inputs_frame, output_format, read_reads, read_stdin, write_reads
from .sources.formats import pattern_lines

NOT_BUILT = ("qc", "logs")


def parser() -> argparse.ArgumentParser:
    top, common = argparse.ArgumentParser(prog="readweft"), argparse.ArgumentParser(add_help=False)
    for flag, about in (("--no-log", "accepted; no log is kept"), ("--quiet", "nothing on standard error"), ("--verbose", "say what is read")):
        top.add_argument(flag, action="store_true", help=about)
        # a default here would overwrite what stands before the verb
        common.add_argument(flag, action="store_true", default=argparse.SUPPRESS, help=about)
    verbs = top.add_subparsers(dest="verb")

    def verb(name: str, about: str, many: bool = False) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=about, parents=[common])
        p.add_argument("input", nargs="*" if many else "?", default=[] if many else "-")
        return p

    for name, about in (("stats", "lengths, N50, qualities and composition"), ("count", "reads and bases")):
        p = verb(name, about, many=True)
        shown = p.add_mutually_exclusive_group()
        shown.add_argument("--json", action="store_true")
        shown.add_argument("--tsv", action="store_true")
        p.add_argument("--combine", action="store_true")
        p.add_argument("-b", "--basename", action="store_true")
        if name == "stats":
            p.add_argument("-e", "--extended", action="store_true")
    p = verb("filter", "reads by length, quality, GC and N")
    p.add_argument("-l", "--min-length", type=int)
    p.add_argument("-m", "--max-length", type=int)
    p.add_argument("-q", "--min-quality", type=float)
    for name in ("--max-n", "--min-gc", "--max-gc", "--trim-quality"):
        p.add_argument(name, type=float)
    p.add_argument("--headcrop", type=int, default=0)
    p.add_argument("--tailcrop", type=int, default=0)
    p = verb("convert", "FASTQ or FASTA out of any input")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("--to", choices=["fastq", "fasta"])
    p.add_argument("--fake-quality", type=int)
    p = verb("sample", "a random part")
    one = p.add_mutually_exclusive_group()
    one.add_argument("-n", "--count", type=int)
    one.add_argument("-p", "--proportion", type=float)
    one.add_argument("--bases")
    one.add_argument("--coverage", type=float)
    p.add_argument("--genome-size")
    p.add_argument("--seed", type=int)
    p = verb("grep", "reads that match a pattern")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("-p", "--pattern")
    source.add_argument("-f", "--patterns-file")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--mismatches", type=int, default=0)
    p.add_argument("-d", "--degenerate", action="store_true")
    p.add_argument("-n", "--in-name", action="store_true")
    p.add_argument("--both-strands", action="store_true")
    p.add_argument("-v", "--invert", action="store_true")
    p.add_argument("--case-sensitive", action="store_true")
    for name in ("head", "tail"):
        p = verb(name, f"the {'first' if name == 'head' else 'last'} reads")
        one = p.add_mutually_exclusive_group()
        one.add_argument("-n", "--reads", type=int, default=None)
        one.add_argument("--bases", type=_size)
    for name in NOT_BUILT:
        verbs.add_parser(name, help="not available", parents=[common])
    verbs.add_parser("completions", help="a script that completes commands in a shell", parents=[common]).add_argument("shell", choices=SHELLS)
    return top


def _size(text: str) -> int:
    try:
        return parse_size(text)
    except BadArgument as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def _input(spark: SparkSession, path: str, limit: int = 0) -> tuple[DataFrame, str]:
    """The reads of a file or of standard input, and their format."""
    if path == "-":
        df, spooled = read_stdin(spark)
        return df, detect_format(spooled)
    return read_reads(spark, path, limit=limit), detect_format(path)


def _print(df: DataFrame, fmt: str, ordered: bool) -> int:
    """Writes records to standard output and says how many."""
    lines = 0
    with tempfile.TemporaryDirectory() as folder:
        one_file(df, f"{folder}/records", fmt, ordered)
        with open(f"{folder}/records", encoding="utf-8") as f:
            for line in f:
                sys.stdout.write(line)
                lines += 1
    return lines // (2 if fmt == FASTA else 4)


def one_file(df: DataFrame, path: str, fmt: str, ordered: bool = True) -> None:
    """Records in a single local file: parts are written by Spark and put together (gzip allows several members)."""
    zipped = check_sink(path) is not None
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(path))) as folder:
        write_reads(df, f"{folder}/out{'.gz' if zipped else ''}", fmt, ordered)
        own = f"{folder}/out{'.gz' if zipped else ''}"
        with open(path, "wb") as out:
            for part in sorted(x for x in os.listdir(own) if x.startswith("part-")):
                with open(f"{own}/{part}", "rb") as f:
                    shutil.copyfileobj(f, out)


def run(spark: SparkSession, argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.verb is None or args.verb == "completions":
        return _without_reads(args, lambda: spark)
    if args.verb in NOT_BUILT:
        raise NotImplementedError(f"{args.verb} is not available")
    tell = (lambda *a: None) if args.quiet else (lambda *a: print(*a, file=sys.stderr))
    if args.verbose:
        tell(f"{args.verb}: reading {', '.join(args.input if isinstance(args.input, list) else [args.input]) or '-'}")
    if args.verb in ("stats", "count"):
        paths = list(args.input)
        if not paths or paths == ["-"]:
            df, spooled = read_stdin(spark)
            paths = [spooled]
            inputs = inputs_frame(spark, paths).replace(spooled, "-", "file")
            df = df.replace(spooled, "-", "file")
        else:
            df, inputs = read_reads(spark, paths, args.basename), inputs_frame(spark, paths, args.basename)
        report = O.count_reads(df, inputs, args.combine) if args.verb == "count" else O.stats_reads(df, inputs, args.combine, args.extended)
        sys.stdout.write(render(report, report_format(args.json, args.tsv)))
        return 0
    limit = (10 if args.reads is None else args.reads) if args.verb == "head" and args.bases is None else 0
    df, kind = _input(spark, args.input, limit)
    # What looks at one read at a time keeps the order of the scan's partitions, and its input is counted on the way; a
    # sort would run the scan twice, once for its sample.
    narrow = args.verb in ("filter", "grep", "convert") or args.verb == "sample" and args.count is None
    reads = df
    df, seen = O.observed(df, args.verb) if narrow else (df, None)
    fmt, total = output_format(kind), lambda: seen.get["reads"] if narrow else reads.count()
    if args.verb == "convert":
        fmt = O.target_format(args.to, None if args.output == "-" else args.output)
        if args.output != "-":
            check_sink(args.output)
        out = O.convert_reads(df, fmt, args.fake_quality, kind)
        if args.output != "-":
            one_file(out, args.output, fmt, ordered=False)
            tell(O.summary_line("convert", total()))
        else:
            tell(O.summary_line("convert", _print(out, fmt, ordered=False)))
        return 0
    if args.verb == "filter":
        out = O.filter_reads(df, args.min_length, args.max_length, args.min_quality, args.min_gc, args.max_gc, args.max_n, args.headcrop, args.tailcrop, args.trim_quality)
    elif args.verb == "grep":
        if args.patterns_file:
            with open(args.patterns_file) as f:
                patterns = pattern_lines(f.read())
        else:
            patterns = [args.pattern]
        out = O.grep_reads(df, patterns, args.regex, args.mismatches, args.degenerate, args.in_name, args.both_strands, args.invert, args.case_sensitive)
    elif args.verb == "sample":
        out = O.sample_reads(df, args.count, args.proportion, args.bases, args.coverage, args.genome_size, args.seed, args.input == "-")
    elif args.bases is not None:
        out = (O.head_bases if args.verb == "head" else O.tail_bases)(df, args.bases)
    else:
        out = (O.head_reads if args.verb == "head" else O.tail_reads)(df, 10 if args.reads is None else args.reads)
    n = _print(out, fmt, ordered=not narrow)
    tell(O.summary_line(args.verb, n, total() if args.verb in ("filter", "grep", "sample") else None))
    return 0


def _without_reads(args: argparse.Namespace, session: Callable[[], SparkSession]) -> int:
    """What reads nothing: completions, and the prompt (on a terminal) below the banner."""
    if args.verb == "completions":
        sys.stdout.write(completions(parser(), args.shell))
        return 0
    sys.stderr.write(banner())
    if sys.stdin.isatty():
        interactive(parser(), lambda argv: run(session(), argv))
    return 0


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("readweft").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    try:
        args = parser().parse_args()
        if args.verb is None or args.verb == "completions":
            return _without_reads(args, _session)
        return run(_session(), sys.argv[1:])
    except (ReadweftError, BadArgument, NotImplementedError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
