"""Column functions on DNA text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
COMPLEMENT = "TGCA"


def clean_bases(seq: Column) -> Column:
    """Upper case without white space; U reads as T, and every other character than A, C, G, T as N."""
    joined = F.regexp_replace(F.upper(seq), r"\s+", "")
    return F.regexp_replace(F.translate(joined, "U", "T"), "[^ACGT]", "N")


def is_plain(seq: Column) -> Column:
    """Only A, C, G and T, at least one of them."""
    return seq.rlike("^[ACGT]+$")


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def without_n(seq: Column) -> Column:
    return F.regexp_replace(seq, "N", "")


def kmer_code(kmer: Column) -> Column:
    """Rank of a k-mer among those of its length, A < C < G < T, for k up to 31."""
    return F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("long")


def pack(seq: Column) -> Column:
    """Four bases a byte as an array of integers, the first base highest; a last byte is filled up with A.

    A length that is a multiple of four gives one more byte of A, as the byte format has it.
    """
    padded = F.rpad(seq, (F.floor(F.length(seq) / 4) * 4 + 4).cast("int"), F.lit("A"))
    groups = F.regexp_extract_all(padded, F.lit("[ACGT]{4}"), F.lit(0))
    return F.transform(groups, lambda g: kmer_code(g).cast("int"))


def unpack(packed: Column, length: Column) -> Column:
    """The bases of ``pack``'s bytes, cut to ``length``."""
    four = F.transform(packed, lambda b: F.translate(F.lpad(F.conv(b.cast("string"), 10, 4), 4, "0"), "0123", BASES))
    return F.substring(F.array_join(four, ""), F.lit(1), length)


def packed_kmer(packed: Column, offset: Column, k: int) -> Column:
    """The code of the k-mer at ``offset`` (from 0) of ``pack``'s bytes, for k up to 24; null beyond them."""
    first, most = F.floor(offset / 4).cast("int"), (k + 3 + 3) // 4
    joined = F.lit(0).cast("long")
    for i in range(most):  # a byte after the last counts as 0; only places before it are asked for
        joined = F.shiftleft(joined, 8).bitwiseOR(F.coalesce(F.try_element_at(packed, first + 1 + i).cast("long"), F.lit(0).cast("long")))
    shift = (F.lit(8 * most - 2 * k) - (offset % 4) * 2).cast("int")
    code = F.call_function("shiftright", joined, shift).bitwiseAND(F.lit((1 << (2 * k)) - 1))
    return F.when(offset + k <= F.size(packed) * 4, code)


def fasta_quality(seq: Column) -> Column:
    """The quality that a FASTA record gets when it is used as a read."""
    return F.repeat(F.lit("I"), F.length(seq))


def first_word(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S*)", 1)
