"""Reports as TSV, JSON or a table for people; rows are few (one an input) and come to the driver."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators.report import PERCENTILES


@dataclass(frozen=True)
class Cell:
    """A value and how it is shown: kind is text, int, float or percent."""

    value: object
    kind: str = "text"
    digits: int = 2

    def shown(self, human: bool) -> str:
        if self.value is None:
            return "-"
        if self.kind == "int":
            return fmt_commas(self.value) if human else str(self.value)
        if self.kind == "text":
            return str(self.value)
        return f"{self.value:.{self.digits}f}" + "%" * (human and self.kind == "percent")


def fmt_commas(n: int) -> str:
    return f"{n:,}"


def output_format(as_json: bool = False, as_tsv: bool = False, stream=None) -> str:
    """json before tsv; else human on a terminal and tsv in a pipe."""
    if as_json or as_tsv:
        return "json" if as_json else "tsv"
    return "human" if (stream or sys.stdout).isatty() else "tsv"


#: The column heads of stats, the keys they show and the kinds of their cells.
STATS = [
    ("file", "file", "text", 0), ("format", "format", "text", 0), ("type", "seq_type", "text", 0), ("reads", "read_count", "int", 0),
    ("total_bases", "total_bases", "int", 0), ("min_length", "min_length", "int", 0), ("max_length", "max_length", "int", 0),
    ("mean_length", "mean_length", "float", 1), ("median_length", "median_length", "float", 1), ("n50", "n50", "int", 0), ("n90", "n90", "int", 0),
    ("mean_quality", "mean_quality", "float", 2), *((f"q{t}_pct", f"bases_above_q{t}_pct", "percent", 2) for t in (10, 20, 30)),
    ("gc_pct", "gc_content_pct", "percent", 2), ("sum_n", "ambiguous_bases", "int", 0),
]
COUNT = [("file", "file", "text", 0), ("reads", "reads", "int", 0), ("bases", "bases", "int", 0)]


def table_of(rows: Sequence[dict], columns: list[tuple], extended: bool = False) -> tuple[list[str], list[list[Cell]]]:
    heads = [c[0] for c in columns]
    body = [[Cell(r[key], kind, digits) for _, key, kind, digits in columns] for r in rows]
    if extended:
        for name, key, digits in (("len", "length_percentiles", 1), ("qual", "quality_percentiles", 2)):
            heads += [f"{name}_p{p}" for p in PERCENTILES]
            for cells, r in zip(body, rows, strict=True):
                cells += [Cell(r[key][f"p{p}"], "float", digits) if r[key] else Cell("-") for p in PERCENTILES]
    return heads, body


def render_tsv(heads: list[str], body: list[list[Cell]]) -> str:
    return "".join("\t".join(x) + "\n" for x in [heads, *([c.shown(False) for c in r] for r in body)]) if body else ""


def render_human(heads: list[str], body: list[list[Cell]], left: Sequence[str] = ("file", "format", "type")) -> str:
    if not body:
        return ""
    shown = [[c.shown(True) for c in r] for r in body]
    widths = [max(map(len, col)) for col in zip(heads, *shown, strict=True)]
    to_right = [h not in left for h in heads]
    line = lambda xs, right: "  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(xs, widths, right, strict=True)).rstrip() + "\n"
    numbers = [c.kind != "text" or r for c, r in zip(body[0], to_right, strict=True)]
    return line(heads, to_right) + "".join(line(r, numbers) for r in shown)


def render_json(rows: Sequence[dict]) -> str:
    """One row as an object, any other number as an array; percentiles that are absent are left out."""
    own = [{k: v for k, v in r.items() if not (k.endswith("_percentiles") and v is None)} for r in rows]
    return json.dumps(own[0] if len(own) == 1 else own, indent=2) + "\n"


def render(report: DataFrame, fmt: str = "tsv") -> str:
    """The text of count_reads() or stats_reads(), in the order of the inputs."""
    rows = [r.asDict(recursive=True) for r in report.orderBy("input_idx").collect()]
    for r in rows:
        r.pop("input_idx")
    if fmt == "json":
        return render_json(rows)
    columns = STATS if "seq_type" in report.columns else COUNT
    heads, body = table_of(rows, columns, "length_percentiles" in report.columns)
    return render_tsv(heads, body) if fmt == "tsv" else render_human(heads, body)
