"""Scans of FASTQ, FASTA and BAM files as a Python data source that yields Arrow batches.

Plain text is split into byte ranges: a range owns the records that start in it. Files of BGZF blocks (BAM, and text that
bgzip wrote) are split at blocks; other gzip, told by its magic bytes, is read by one task a file. ord grows along a file
and counts bytes of the uncompressed text, with gaps between the splits of BGZF files, so that blocks of equal ranges of
ord are bounded in size for every kind. Files are opened through pyarrow's file systems, so that URIs work on executors.
"""

from __future__ import annotations

import gzip
import io
import json
import sys
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import MalformedRecord, UnsupportedCompression
from ..schema import BAM, FASTA, FASTQ, READS
from .formats import base_name, detect_format, sniff

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: How a BGZF block begins, the largest one, and how much deflate can shrink a text at most.
_BLOCK_MAGIC, _BLOCK_BYTES, _DEFLATE = b"\x1f\x8b\x08\x04", 1 << 16, 1032
_ARROW = pa.schema(
    [("input_idx", pa.int32()), ("file", pa.string()), ("format", pa.string()), ("ord", pa.int64()), ("id", pa.string()), ("desc", pa.string()), ("seq", pa.string()), ("qual", pa.string())]
)


def open_bytes(path: str):
    """A seekable binary file, local or by URI."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")  # noqa: SIM115


def _size_and_magic(path: str) -> tuple[int, bytes]:
    with open_bytes(path) as f:
        head = f.read(_BLOCK_BYTES)
        f.seek(0, io.SEEK_END)
        return f.tell(), head


def _header(line: bytes) -> tuple[str, str | None]:
    """Name and description of a header line without its mark."""
    name, _, rest = line.decode("latin-1").partition(" ")
    if "\t" in name:
        name, _, more = name.partition("\t")
        rest = f"{more} {rest}" if rest else more
    return name, rest.strip() or None


class _Lines:
    """Lines with their offsets; ends of lines are removed."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at
        f.seek(at) if at else None

    def next(self) -> tuple[int, bytes] | None:
        line = self.f.readline()
        if not line:
            return None
        at, self.at = self.at, self.at + len(line)
        return at, line.rstrip(b"\r\n")


def _fastq(f, at: int, end: int | None) -> Iterator[tuple]:
    """The records from the one at byte at on, line by line."""
    f.seek(at)
    lines = _Lines(f, at)
    while True:
        got = lines.next()
        while got is not None and not got[1]:
            got = lines.next()
        if got is None or (end is not None and got[0] >= end):
            return
        at, head = got
        if head[:1] != b"@":
            raise MalformedRecord(f"a FASTQ record that does not start with @ at {at}")
        seq, plus, qual = lines.next(), lines.next(), lines.next()
        if seq is None or plus is None or plus[1][:1] != b"+":
            raise MalformedRecord(f"an incomplete FASTQ record at {at}")
        letters, marks = seq[1], qual[1] if qual else b""
        if len(letters) != len(marks):
            raise MalformedRecord(f"sequence and quality differ in length at {at}: {len(letters)} and {len(marks)}")
        name, desc = _header(head[1:])
        yield at, name, desc, letters.decode("latin-1"), marks.decode("latin-1")


def _fastq_columns(f, start: int, end: int | None) -> Iterator[tuple]:
    """Lists (ord, id, desc, seq, qual) of the records that start in the range, block by block.

    Blocks of plain four-line records are cut up at once; what is anything else (white space in odd places, carriage
    returns, other than ASCII, errors) goes line by line from there on.
    """
    at, rest = _fastq_start(f, start) if start else 0, b""
    f.seek(at)
    while True:
        chunk = f.read(BATCH_BYTES)
        data = rest + chunk
        lines = data.split(b"\n")
        tail = lines.pop()
        if not chunk and tail:
            lines.append(tail)
        n = len(lines) // 4 * 4
        heads, seqs, marks, quals = (lines[j:n:4] for j in range(4))
        fine = data.isascii() and b"\r" not in data and b"\t" not in data and all(h[:1] == b"@" for h in heads) and all(m[:1] == b"+" for m in marks)
        sizes = list(map(len, seqs))
        if not fine or sizes != list(map(len, quals)) or not chunk and any(lines[n:]):
            if rows := list(_fastq(f, at, end)):
                yield tuple(map(list, zip(*rows, strict=True)))
            return
        if n:
            whole = np.array([len(h) + len(m) for h, m in zip(heads, marks, strict=True)], np.int64) + 2 * np.array(sizes, np.int64) + 4
            places = at + np.cumsum(whole) - whole
            take = len(places) if end is None else int(np.searchsorted(places, end))
            parts = [h[1:].partition(b" ") for h in heads[:take]]
            if take:
                yield places[:take].tolist(), [p[0] for p in parts], [p[2].strip() or None for p in parts], seqs[:take], quals[:take]
            if take < len(places):
                return
            at += int(whole.sum())
        if not chunk:
            return
        rest = b"\n".join([*lines[n:], tail])


def _fastq_start(f, start: int) -> int:
    """The first record that starts at or after start. @ may also begin a quality line, so that the line after next
    must start with + and the lengths of the lines around it must agree."""
    f.seek(start - 1)
    skipped = f.readline()
    at = start - 1 + len(skipped)
    window: list[tuple[int, bytes]] = []
    lines = _Lines(f, at)
    while True:
        while len(window) < 4 and (got := lines.next()) is not None:
            window.append(got)
        if not window:
            return lines.at
        if len(window) == 4 and window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and len(window[1][1]) == len(window[3][1]):
            return window[0][0]
        window.pop(0)


def _fasta(f, start: int, end: int | None) -> Iterator[tuple]:
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    lines, now, parts = _Lines(f, at), None, []
    while (got := lines.next()) is not None:
        at, line = got
        if line[:1] == b">":
            if now:
                yield (*now, b"".join(parts).decode("latin-1"), None)
            if end is not None and at >= end:
                return
            now, parts = (at, *_header(line[1:])), []
        elif now:
            parts.append(line)
        elif line and not start:
            raise MalformedRecord("FASTA text before the first header")
    if now:
        yield (*now, b"".join(parts).decode("latin-1"), None)


class _Bgzf(io.RawIOBase):
    """Reads a file of gzip members one after another."""

    def __init__(self, f):
        self.f, self.held, self.z = f, b"", None

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            chunk = self.f.read(1 << 16)
            if not chunk:
                break
            while chunk:
                self.z = self.z or zlib.decompressobj(31)
                out = self.z.decompress(chunk)
                chunk = b""
                if self.z.eof:
                    chunk, self.z = self.z.unused_data, None
                parts.append(out)
                have += len(out)
        all_ = b"".join(parts)
        self.held = all_[n:]
        return all_[:n]


def _block_size(data: bytes, at: int = 0) -> int:
    """The size of the BGZF block whose header is at a place; 0 if none is there."""
    if data[at : at + 4] != _BLOCK_MAGIC:
        return 0
    k, end = at + 12, at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    while k + 6 <= min(end, len(data)):
        n = int.from_bytes(data[k + 2 : k + 4], "little")
        if data[k : k + 2] == b"BC" and n == 2:
            return int.from_bytes(data[k + 4 : k + 6], "little") + 1
        k += 4 + n
    return 0


class _Blocks(io.RawIOBase):
    """The text of a BGZF file from the first block that begins in the bytes [start, end) on, as a file of its own.

    owned is the length of the text in the blocks that begin there (0 if none does), None if there is no end. Reading goes
    on beyond it.
    """

    def __init__(self, f, start: int, end: int | None):
        self.f, self.start, self.at, self.k, self.text = f, start, 0, -1, b""
        f.seek(start)
        self.data = f.read((end or start) - start + 2 * _BLOCK_BYTES)
        self.first = self._first(len(self.data) if end is None else end - start)
        #: Where blocks begin, in the file and in the text; the last entries are those of a block not yet looked at.
        self.places, self.texts = [self.first or 0], [0]
        while end is not None and self.first is not None and self.places[-1] < end and self._known(len(self.places) - 1):
            pass
        self.owned = None if end is None else self.texts[-1]

    def _first(self, end: int) -> int | None:
        at = self.data.find(_BLOCK_MAGIC)
        while 0 <= at < end:
            n = _block_size(self.data, at)
            if n and (at + n == len(self.data) or _block_size(self.data, at + n)):
                return self.start + at
            at = self.data.find(_BLOCK_MAGIC, at + 1)
        return None

    def _bytes(self, place: int, n: int) -> bytes:
        at = place - self.start
        if at + n <= len(self.data):
            return self.data[at : at + n]
        self.f.seek(place)
        return self.f.read(n)

    def _known(self, k: int) -> bool:
        """Whether block k is there; its end is known then."""
        while len(self.places) <= k + 1:
            place = self.places[-1]
            data = self._bytes(place, _BLOCK_BYTES)
            if not data:
                return False
            n = _block_size(data)
            if not n or n > len(data):
                raise MalformedRecord(f"a broken BGZF block at {place}")
            self.places.append(place + n)
            self.texts.append(self.texts[-1] + int.from_bytes(data[n - 4 : n], "little"))
        return True

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, at: int, whence: int = io.SEEK_SET) -> int:
        if whence != io.SEEK_SET:
            raise io.UnsupportedOperation("only places from the start are known")
        self.at = at
        return at

    def readinto(self, out) -> int:
        k = bisect_right(self.texts, self.at) - 1
        while self._known(k) and self.at >= self.texts[k + 1]:
            k += 1
        if not self._known(k):
            return 0
        if k != self.k:
            place, end = self.places[k : k + 2]
            self.k, self.text = k, zlib.decompress(self._bytes(place, end - place), 31)
        part = self.text[self.at - self.texts[k] :][: len(out)]
        out[: len(part)] = part
        self.at += len(part)
        return len(part)


#: The letters of 4-bit base codes in BAM.
NIBBLES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)
#: How many records in a row must look like records for the first of them to be taken as one.
_IN_A_ROW = 4


def _bam_header(read) -> tuple[int, int]:
    """(its length, number of references); the next byte to read is the first record's."""
    if read(4) != b"BAM\x01":
        raise MalformedRecord("not a BAM file")
    number = lambda: int.from_bytes(read(4), "little", signed=True)
    n = number()
    read(n)
    at, references = 12 + n, number()
    for _ in range(references):
        n = number()
        read(n + 4)
        at += 8 + n
    return at, references


def _bam(read, at: int, end: int | None) -> Iterator[tuple]:
    """The records that start before end; the first one is at at and the next to read."""
    while end is None or at < end:
        size = read(4)
        if not size:
            return
        n = int.from_bytes(size, "little", signed=True)
        body = read(n) if n >= 32 else b""
        if len(body) < 32 or len(body) < n:
            raise MalformedRecord(f"an incomplete BAM record at {at}")
        n_name, n_cigar, n_seq = body[8], int.from_bytes(body[12:14], "little"), int.from_bytes(body[16:20], "little", signed=True)
        begin = 32 + n_name
        name = body[32 : begin - 1].decode("latin-1")
        begin += 4 * n_cigar
        packed = np.frombuffer(body, np.uint8, (n_seq + 1) // 2, begin)
        letters = NIBBLES[np.stack([packed >> 4, packed & 15], 1).ravel()[:n_seq]].tobytes().decode()
        raw = np.frombuffer(body, np.uint8, n_seq, begin + (n_seq + 1) // 2)
        # no quality is stored as 255 throughout
        qual = None if n_seq == 0 or (raw == 255).all() else np.minimum(raw.astype(np.int32) + 33, 255).astype(np.uint8).tobytes().decode("latin-1")
        yield at, "" if name == "*" else name, None, letters, qual
        at += 4 + len(body)


def _bam_next(f, at: int, references: int) -> int | None:
    """Where the record after the one at a place would be, if what is there can be a record."""
    f.seek(at)
    head = f.read(36)
    if len(head) < 36:
        return None
    size, reference, place = (int.from_bytes(head[k : k + 4], "little", signed=True) for k in (0, 4, 8))
    n_seq, mate, mate_place = (int.from_bytes(head[k : k + 4], "little", signed=True) for k in (20, 24, 28))
    n_name, n_cigar = head[12], int.from_bytes(head[16:18], "little")
    fine = -1 <= reference < references and -1 <= mate < references and place >= -1 and mate_place >= -1 and n_name and n_seq >= 0
    if not fine or size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    name = f.read(n_name)
    return at + 4 + size if len(name) == n_name and name[-1] == 0 and all(32 < c < 127 for c in name[:-1]) else None


def _bam_start(f, owned: int, references: int) -> int | None:
    """The first place before owned at which several records, or all to the end, follow each other. References and
    mates, which are small numbers or -1, are looked at for all places of a piece at once."""
    for low in range(0, owned, 1 << 20):
        f.seek(low)
        data = np.frombuffer(f.read(min(1 << 20, owned - low) + 35), np.uint8)
        if len(data) < 36:
            return None
        number = lambda k, n=len(data) - 35: sum(data[k + j : k + j + n].astype(np.uint32) << np.uint32(8 * j) for j in range(4)).view(np.int32)  # noqa: B023, E731
        size, reference, mate = number(0), number(4), number(24)
        likely = (size >= 33) & (reference >= -1) & (reference < max(references, 0)) & (mate >= -1) & (mate < max(references, 0))
        for k in np.flatnonzero(likely):
            at, seen = low + int(k), 0
            while seen < _IN_A_ROW and (after := _bam_next(f, at, references)) is not None:
                at, seen = after, seen + 1
            f.seek(at)
            if seen == _IN_A_ROW or seen and not f.read(1):
                return low + int(k)
    return None


class _Range(InputPartition):
    """A byte range of a file. blocks: of a BGZF file; for BAM, origin is the byte of the block of the first record, skip that
    record's place in the block's text, and references their number."""

    def __init__(self, idx: int, path: str, label: str, kind: str, start: int, end: int | None, zipped: bool, blocks: bool = False, origin: int = 0, skip: int = 0, references: int = 0):
        self.idx, self.path, self.label, self.kind, self.start, self.end, self.zipped = idx, path, label, kind, start, end, zipped
        self.blocks, self.origin, self.skip, self.references = blocks, origin, skip, references


def _first_record(path: str) -> tuple[int, int, int]:
    """Of a BAM file in BGZF: the byte of the block in which the first record begins, the place in it, the references."""
    with open_bytes(path) as raw:
        text = _Blocks(raw, 0, 1)
        at, references = _bam_header(io.BufferedReader(text, _BLOCK_BYTES).read)
        text.seek(at)
        text.readinto(bytearray(1))
        k = bisect_right(text.texts, at) - 1
        return text.places[k], at - text.texts[k], references


def columns(r: _Range) -> Iterator[tuple]:
    """Lists (ord, id, desc, seq, qual) of the records that start in the range, in batches."""
    with open_bytes(r.path) as raw:
        if not r.blocks:
            if r.kind == BAM:
                read = _Bgzf(raw).take
                yield from _batches(_bam(read, 0, None) if _bam_header(read) else ())
                return
            f = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if r.zipped else raw
            yield from _text_columns(r.kind, f, r.start, r.end)
            return
        text = _Blocks(raw, r.start, r.end)
        if text.first is None:
            return
        f, base = io.BufferedReader(text, 1 << 20), _DEFLATE * (text.first - r.origin)
        if r.kind == BAM:
            at = r.skip if r.start == r.origin else _bam_start(f, text.owned, r.references)
            if at is None:
                return
            f.seek(at)
            found = _batches(_bam(f.read, at, text.owned))
        else:
            # a line that begins with the text of a later range is the range's before: what precedes it is not known here
            found = _text_columns(r.kind, f, 1 if r.start else 0, None if text.owned is None else text.owned + 1)
        for ords, *others in found:
            yield [base + x for x in ords], *others


def _text_columns(kind: str, f, start: int, end: int | None) -> Iterator[tuple]:
    yield from _fastq_columns(f, start, end) if kind == FASTQ else _batches(_fasta(f, start, end))


def _batches(rows) -> Iterator[tuple]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + 2 * len(row[3])
        if size > BATCH_BYTES:
            yield tuple(zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(zip(*held, strict=True))


def _strings(values: list) -> pa.Array:
    """Text of a list of str or of ASCII bytes."""
    return pa.array(values, pa.binary()).cast(pa.string()) if any(isinstance(v, bytes) for v in values[:1]) else pa.array(values, pa.string())


class ReadsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.inputs = json.loads(options["inputs"])
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.limit = int(options.get("limit") or 0)

    def partitions(self) -> list[_Range]:
        out = []
        for x in self.inputs:
            path, kind = x["path"], x["format"]
            size, head = _size_and_magic(path)
            zipped = head[:2] == b"\x1f\x8b"
            for magic, name in ((b"BZh", "bzip2"), (b"\xfd7zXZ", "xz"), (b"(\xb5/\xfd", "zstd")):
                if head.startswith(magic):
                    raise UnsupportedCompression(f"{path}: {name} is not supported")
            if kind == BAM and not zipped:
                raise MalformedRecord(f"{path}: only BAM is read, no SAM or CRAM")
            blocks = _block_size(head) > 0
            origin, *more = _first_record(path) if blocks and kind == BAM else (0,)
            cuts = [origin] if zipped and not blocks or self.limit else list(range(origin, max(size, origin + 1), self.split))
            for a, z in zip(cuts, [*cuts[1:], max(size, origin + 1) if blocks and not self.limit else None], strict=True):
                out.append(_Range(x["idx"], path, x["label"], kind, a, z, zipped, blocks, origin, *more))
        return out

    def read(self, r: _Range | None) -> Iterator[pa.RecordBatch]:
        if r is None:  # what Spark asks for where there are no files
            return
        left = self.limit or sys.maxsize
        for ords, ids, descs, seqs, quals in columns(r):
            n = min(len(ords), left)
            descs = [d.decode() if isinstance(d, bytes) else d for d in descs[:n]]
            fixed = [pa.array([v] * n, t) for v, t in ((r.idx, pa.int32()), (r.label, pa.string()), (r.kind, pa.string()))]
            own = [pa.array(ords[:n], pa.int64()), _strings(ids[:n]), pa.array(descs, pa.string()), _strings(seqs[:n]), _strings(quals[:n])]
            yield pa.RecordBatch.from_arrays([*fixed, *own], schema=_ARROW)
            left -= n
            if not left:
                return


class ReadsSource(DataSource):
    """format("reads"); option inputs: JSON list of {idx, path, label, format}; limit: stop each file after so many."""

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self):
        return READS

    def reader(self, schema) -> ReadsReader:
        return ReadsReader(self.options)


def described(paths: list[str], basename: bool = False, fmt: str | None = None) -> list[dict]:
    return [{"idx": k, "path": p, "label": base_name(p) if basename else p, "format": fmt or detect_format(p)} for k, p in enumerate(paths)]


def read_reads(spark: SparkSession, paths: str | list[str], basename: bool = False, split_bytes: int = SPLIT_BYTES, limit: int = 0, fmt: str | None = None) -> DataFrame:
    """The reads of files in the order of the list; a file named twice is read twice. fmt tells the format of all files, whose
    names need not tell it then."""
    inputs = described([paths] if isinstance(paths, str) else list(paths), basename, fmt)
    spark.dataSource.register(ReadsSource)
    return spark.read.format("reads").option("inputs", json.dumps(inputs)).option("splitBytes", str(split_bytes)).option("limit", str(limit)).load()


def inputs_frame(spark: SparkSession, paths: list[str], basename: bool = False) -> DataFrame:
    """A row for each input, so that reports have rows for empty files too."""
    return spark.createDataFrame([(x["idx"], x["label"], x["format"]) for x in described(paths, basename)], "input_idx int, file string, format string")


def read_stdin(spark: SparkSession, stream=None) -> tuple[DataFrame, str]:
    """The reads of a stream and the path of the spooled copy: Spark has no stdin, so that the driver keeps it in a
    file that executors must see (local mode, or a shared temporary folder)."""
    data = (stream or sys.stdin.buffer).read()
    ending = {FASTQ: ".fastq", FASTA: ".fasta", BAM: ".bam"}[sniff(data[:65536])]
    with tempfile.NamedTemporaryFile(suffix=ending, delete=False) as f:
        f.write(data)
    return read_reads(spark, f.name), f.name
