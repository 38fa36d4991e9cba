"""Formats by file name, or by the first bytes of a stream."""

from __future__ import annotations

import zlib

from ..errors import BadArgument, UnknownFormat
from ..schema import BAM, FASTA, FASTQ

#: The extensions of each format and of compressed files.
EXTENSIONS = {
    FASTQ: (".fastq", ".fq"),
    FASTA: (".fasta", ".fa", ".fna"),
    BAM: (".bam", ".sam", ".cram"),
}
COMPRESSED = (".gz", ".bz2", ".xz", ".zst")


def detect_format(path: str) -> str:
    """FASTQ, FASTA or BAM by extension, after at most one compression suffix; case does not matter."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in COMPRESSED:
        if name.endswith(suffix):
            name = name[: -len(suffix)]
            break
    for kind, endings in EXTENSIONS.items():
        if name.endswith(endings):
            return kind
    raise UnknownFormat(f"cannot tell the format of {path!r} from its name")


def sniff(head: bytes) -> str:
    """The format of a stream by its first bytes; an empty or blank one counts as FASTQ without records."""
    if head[:2] == b"\x1f\x8b":
        try:
            head = zlib.decompressobj(31).decompress(head, 16)
        except zlib.error as e:
            raise UnknownFormat("a broken gzip stream") from e
    if head[:4] == b"BAM\x01":
        return BAM
    first = head.lstrip()[:1]
    if first in (b"@", b""):
        return FASTQ
    if first == b">":
        return FASTA
    raise UnknownFormat("the input is neither FASTQ, FASTA nor BAM")


def pattern_lines(text: str) -> list[str]:
    """Patterns of a pattern file: trimmed lines, without blank ones and those that start with #."""
    found = [x.strip() for x in text.splitlines()]
    found = [x for x in found if x and not x.startswith("#")]
    if not found:
        raise BadArgument("the pattern file has no patterns")
    return found


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1] or path
