"""Reads as BAM or as FASTQ and FASTA text in BGZF blocks, which scans can split."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..errors import BadArgument
from ..schema import BAM, FASTA, FASTQ
from .reader import NIBBLES
from .sinks import fasta_lines, fastq_lines

#: Text of a block: what it becomes must not be longer than 64 KB, even where it does not shrink.
TEXT_BYTES = 0xFF00
_CODES = np.full(256, 15, np.uint8)
_CODES[NIBBLES] = np.arange(16, dtype=np.uint8)
_CODES[np.frombuffer(bytes(NIBBLES).lower(), np.uint8)] = np.arange(16, dtype=np.uint8)


def block(text: bytes) -> bytes:
    """One BGZF block; that of an empty text ends a file."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return struct.pack("<4B4x2BH2BHH", 31, 139, 8, 4, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(text), len(text))


def blocks(texts: Iterable[bytes]) -> Iterator[bytes]:
    held = bytearray()
    for text in texts:
        held += text
        while len(held) >= TEXT_BYTES:
            yield block(bytes(held[:TEXT_BYTES]))
            del held[:TEXT_BYTES]
    if held:
        yield block(bytes(held))
    yield block(b"")


BAM_HEADER = b"BAM\x01" + struct.pack("<2i", 0, 0)


def bam_record(name: str, seq: str, qual: str | None) -> bytes:
    """An unaligned read. Letters that BAM lacks become N; a missing quality is 255 throughout."""
    own = (name or "*").encode("latin-1")[:254] + b"\0"
    codes = _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    codes = np.append(codes, np.zeros(len(codes) % 2, np.uint8))
    marks = b"\xff" * len(seq) if qual is None else (np.frombuffer(qual.encode("latin-1"), np.uint8) - 33).tobytes()
    body = struct.pack("<2i2B3H4i", -1, -1, len(own), 0, 4680, 0, 4, len(seq), -1, -1, 0) + own + (codes[::2] << 4 | codes[1::2]).tobytes() + marks
    return struct.pack("<i", len(body)) + body


def _created(path: str):
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")  # noqa: SIM115


def write_blocks(df: DataFrame, folder: str, fmt: str) -> list[str]:
    """The files, one a partition in their order, of reads written to a folder that all executors share.

    A task that is run again writes a file of another name; what is returned are those of the tasks that came through.
    """
    if fmt not in (BAM, FASTQ, FASTA):
        raise BadArgument(f"cannot write {fmt}")
    folder, ending = folder.rstrip("/"), ".bam" if fmt == BAM else f".{fmt.lower()}.gz"
    rows = df.select("id", "seq", "qual") if fmt == BAM else df.select((fastq_lines() if fmt == FASTQ else fasta_lines()).alias("value"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        if fmt == BAM:
            yield BAM_HEADER
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield bam_record(*values) if fmt == BAM else values[0].encode() + b"\n"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}{ending}"
        with _created(path) as f:
            for part in blocks(texts(batches)):
                f.write(part)
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path]})

    return [r.path for r in sorted(rows.mapInArrow(write, "part int, path string").collect())]  # a sort in Spark would write twice
