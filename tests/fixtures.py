"""Small read files, made where a test needs them."""

import gzip
import struct
import zlib

READS = [
    ("read1", "ACGT" * 10, "I"), ("read2", "GGGGCCCCAAAATTTT" * 2, "H"), ("read3", "ACGTACGTNNNN" * 2, "?"), ("read4", "A" * 100, "5"), ("read5", "GC" * 5, "/"),
]
FASTQ = "".join(f"@{name}\n{seq}\n+\n{q * len(seq)}\n" for name, seq, q in READS)
FASTA = ">seq1 first sequence\nACGTACGT\nACGT\n>seq2\nGGGGCCCCAAAATTTT\n>seq3\nACGTNNNNACGT\n"
BAM_READS = [("read1", "ACGTACGT", 40), ("read2", "GGGGCCCC", 30), ("read3", "ACGTNNNN", 20)]


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam(reads=BAM_READS) -> bytes:
    """An unaligned BAM file; a quality of None is stored as missing."""
    text = b"@HD\tVN:1.6\n"
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0)
    codes = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}
    for name, seq, q in reads:
        packed = bytes((codes[seq[i]] << 4) | (codes[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        own = (name or "*").encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(own), 0, 4680, 0, 4, len(seq), -1, -1, 0) + own + packed + bytes([255 if q is None else q] * len(seq))
        out += struct.pack("<i", len(body)) + body
    return b"".join(_block(out[i : i + 60]) for i in range(0, len(out), 60)) + _block(b"")


def write(folder, name: str, data) -> str:
    raw = data if isinstance(data, bytes) else data.encode()
    if name.endswith(".gz"):
        raw = gzip.compress(raw[: len(raw) // 2]) + gzip.compress(raw[len(raw) // 2 :])
    path = folder / name
    path.write_bytes(raw)
    return str(path)
