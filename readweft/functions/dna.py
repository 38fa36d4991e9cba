"""Bases as Column expressions: everything is built from translate() and length() and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases of each IUPAC code (U counts as T).
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_PAIRS = ("ACGTacgt", "TGCAtgca")


def count_of(seq: Column | str, letters: str) -> Column:
    """How many characters of seq are among letters."""
    return F.length(seq).cast("long") - F.length(F.translate(seq, letters, "")).cast("long")


def base_counts(seq: Column | str) -> Column:
    """struct(a, c, g, t, n, other), case-insensitive; U is other."""
    named = {x.lower(): count_of(seq, x + x.lower()) for x in "ACGTN"}
    other = F.length(F.translate(seq, "ACGTNacgtn", "")).cast("long")
    return F.struct(*(c.alias(k) for k, c in named.items()), other.alias("other"))


def gc_content(seq: Column | str) -> Column:
    """(G + C) / (A + C + G + T); 0 without any of them."""
    return F.coalesce(count_of(seq, "GCgc") / F.nullif(count_of(seq, "ACGTacgt"), F.lit(0)), F.lit(0.0))


def n_fraction(seq: Column | str) -> Column:
    return F.coalesce(count_of(seq, "Nn") / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))


def reverse_complement(seq: Column | str) -> Column:
    """A, C, G and T of either case are exchanged; U, N and all other letters stay."""
    return F.reverse(F.translate(seq, *_PAIRS))


def complement_char(c: str) -> str:
    return c.translate(str.maketrans(*_PAIRS))


def protein_signal(seq: Column | str) -> Column:
    """Whether seq has a letter that is an amino acid and no nucleotide code."""
    return F.col(seq).rlike("[EFIJLOPQZefijlopqz]") if isinstance(seq, str) else seq.rlike("[EFIJLOPQZefijlopqz]")


def iupac_matches(code: str, base: str) -> bool:
    code, base = code.upper(), base.upper()
    if code in IUPAC:
        return ("T" if base == "U" else base) in IUPAC[code] and base in "ACGTU"
    return code == base


def iupac_class(code: str) -> str:
    """A regular expression for the letters that a code matches; other characters match themselves in any case."""
    if code.upper() not in IUPAC:
        both = dict.fromkeys((code.upper(), code.lower()))
        return "(?:" + "|".join(escaped(c) for c in both) + ")" if len(both) > 1 else escaped(code)
    own = IUPAC[code.upper()].replace("T", "TU")
    return f"[{own}{own.lower()}]"


def escaped(text: str) -> str:
    """text as a literal in Java's and RE2's regular expressions."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}" for c in text)
