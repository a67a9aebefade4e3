"""Column expressions on sequences: built-in functions only, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that normalization maps, and complements of DNA and its ambiguity codes.
NORMAL_FROM, NORMAL_TO = "acgtuU.~", "ACGTTT--"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"


def normalize_dna(seq: Column) -> Column:
    """Upper-case DNA: U becomes T, gaps '-', white space goes, all that isn't A, C, G, T, N or '-' becomes N."""
    bare = F.regexp_replace(seq, r"[ \t\r\n]", "")
    return F.regexp_replace(F.translate(bare, NORMAL_FROM, NORMAL_TO), "[^ACGTN-]", "N")


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def cat_seq(seq: Column) -> Column:
    return F.concat(seq, seq)


def decat_seq(seq: Column) -> Column:
    """The first half; the odd base of an odd length goes."""
    return F.substring(seq, F.lit(1), (F.length(seq) / 2).cast("int"))


def rotate_right(seq: Column, n: Column) -> Column:
    """Rotate by n bases, left if negative, modulo the length; an empty sequence stays."""
    size = F.length(seq)
    start = F.pmod(-n, size.cast("long")).cast("int") + 1
    return F.when(size == 0, seq).otherwise(F.substring(F.concat(seq, seq), start, size))


def rotate_share(seq: Column, share: float) -> Column:
    """Rotate by floor(length x share) bases."""
    return rotate_right(seq, F.floor(F.length(seq) * F.lit(float(share))))


def fasta_id(head: Column) -> Column:
    """The header up to its first space."""
    return F.substring_index(head, " ", 1)


def fasta_record(head: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), head, F.lit("\n"), seq)


def orf_seq(seq: Column, start: Column, length: Column, include_stop: bool = True) -> Column:
    """A reading frame's bases, read on around the circle; without the stop codon if so asked."""
    size = length - (0 if include_stop else 3)
    turns = F.ceil((start + size) / F.greatest(F.length(seq), F.lit(1))).cast("int")
    return F.substring(F.repeat(seq, turns), start + 1, size)


def least_rotation(seq: Column) -> Column:
    """Lexicographically least rotation, by trying all: memory grows with the square of the length, for short sequences."""
    n = F.length(seq)
    ring = F.concat(seq, seq)
    return F.when(n == 0, seq).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(ring, i, n))))
