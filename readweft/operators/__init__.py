from .convert import convert_reads, converted, target_format
from .filter import crop, filter_reads, predicate, trim_quality
from .grep import grep_reads, matcher
from .limits import head_bases, head_reads, prefix, tail_bases, tail_reads
from .report import count_reads, stats_reads
from .sample import sample_bases, sample_count, sample_coverage, sample_proportion, sample_reads, total_bases
from .summary import observed, summary_line

__all__ = [
    "convert_reads", "converted", "count_reads", "crop", "filter_reads", "grep_reads", "head_bases", "head_reads", "matcher", "observed", "predicate", "prefix",
    "sample_bases", "sample_count", "sample_coverage", "sample_proportion", "sample_reads", "stats_reads", "summary_line", "tail_bases", "tail_reads",
    "target_format", "total_bases", "trim_quality",
]
