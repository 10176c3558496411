"""Column expressions over sequences, qualities, alignment flags and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the alignment flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE = (1 << i for i in range(11))


def has(flag: Column, bits: int) -> Column:
    """All of the bits are set."""
    return flag.bitwiseAND(bits) == bits


def lacks(flag: Column, bits: int) -> Column:
    """None of the bits is set."""
    return flag.bitwiseAND(bits) == 0


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def encode_bases(seq: Column) -> Column:
    """A, C, G, T as 0, 1, 2, 3; all else as 4."""
    return F.regexp_replace(F.translate(seq, "ACGT", "0123"), "[^0-3]", "4")


def decode_bases(code: Column) -> Column:
    return F.translate(code, "01234", "ACGTN")


def bisulfite(seq: Column, strand: Column) -> Column:
    """The fully converted sequence: C to T on the forward strand, G to A on the reverse one."""
    return F.when(strand == 0, F.translate(seq, "C", "T")).otherwise(F.translate(seq, "G", "A"))


def count_of(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def gc_percent(seq: Column) -> Column:
    """Whole percent of G and C among all letters, 0 for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.floor((count_of(seq, "G") + count_of(seq, "C")) * 100 / n)).otherwise(0).cast("int")


def mean_ascii(quality: Column) -> Column:
    """Mean of the raw quality characters' codes."""
    codes = F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.try_divide(F.aggregate(codes, F.lit(0), lambda s, c: s + c), F.size(codes))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n int, op string>>"""
    number, letter = (F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(number.alias("n"), letter.alias("op")), lambda x: F.struct(x["n"].cast("int").alias("n"), x["op"].alias("op")))


def cigar_length(cigar: Column, letters: str) -> Column:
    """Sum of the operations of these letters."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin(*letters), x["n"]).otherwise(0))


def reference_length(cigar: Column, legacy: bool = False) -> Column:
    """Reference bases under the alignment; legacy leaves = and X out."""
    return cigar_length(cigar, "MDN" if legacy else "MDN=X")


def query_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MIS=X")


def lifted(cigar: Column, text: Column, gap: str) -> Column:
    """A read's letters in reference order: aligned ones as they are, deleted and skipped positions as the gap letter."""
    step = lambda s, x: F.struct(
        F.concat(s["out"], F.when(x["op"].isin(*"M=X"), F.substr(text, s["at"], x["n"])).when(x["op"].isin(*"DN"), F.repeat(F.lit(gap), x["n"])).otherwise("")).alias("out"),
        (s["at"] + F.when(x["op"].isin(*"MIS=X"), x["n"]).otherwise(0)).alias("at"),
    )
    return F.aggregate(cigar_ops(cigar), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def natural_key(name: Column) -> Column:
    """A sort key that compares runs of digits as numbers, of any length: how many digits, then the digits."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(r: Column) -> Column:
        bare = F.regexp_replace(r, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), F.lit(":"), bare)

    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(r))


def places(cigar: Column) -> Column:
    """For each letter of a read its distance from the alignment's start on the reference, -1 where it isn't aligned."""
    many = lambda n, f: F.when(n > 0, f).otherwise(F.array().cast("array<int>"))

    def step(s: Column, x: Column) -> Column:
        aligned = many(x["n"], F.sequence(s["at"], s["at"] + x["n"] - 1))
        more = F.when(x["op"].isin(*"M=X"), aligned).when(x["op"].isin(*"IS"), F.array_repeat(F.lit(-1), x["n"])).otherwise(F.array().cast("array<int>"))
        return F.struct(F.concat(s["out"], more).alias("out"), (s["at"] + F.when(x["op"].isin(*"MDN=X"), x["n"]).otherwise(0)).alias("at"))

    return F.aggregate(cigar_ops(cigar), F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")), step, lambda s: s["out"])


def op_numbers(cigar: Column) -> Column:
    """For each letter of a read the number of its operation among those that hold letters."""
    held = F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*"MIS=X"))
    return F.flatten(F.transform(held, lambda x, i: F.array_repeat(i, x["n"])))
