from .blocks import write_blocks
from .reader import ReadsSource, inputs_frame, read_reads, read_stdin
from .formats import detect_format, sniff
from .sinks import check_sink, fasta_lines, fastq_lines, output_format, write_reads

__all__ = ["ReadsSource", "check_sink", "detect_format", "fasta_lines", "fastq_lines", "inputs_frame", "output_format", "read_reads", "read_stdin", "sniff", "write_blocks", "write_reads"]
