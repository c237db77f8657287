"""Functions on nucleotide sequences and FASTA headers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide codes (fixed values).
IUPAC = "ACGTUSWKMYRBDHVN"
#: First and further characters of a sequence identifier as SAM allows them.
IDENTIFIER = r"^[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*$"
FOUR_MERS = tuple("".join(x) for x in product("ACGT", repeat=4))


def reverse_complement(seq: Column) -> Column:
    """Of A, C, G and T in either case; other characters stay."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def strip_newline(line: Column) -> Column:
    """A line without its \\n or \\r\\n."""
    return F.regexp_replace(line, r"\r?\n$", "")


def clean_sequence(seq: Column) -> Column:
    """Without spaces, tabs and line ends."""
    return F.translate(seq, " \t\r\n", "")


def is_nucleotides(seq: Column) -> Column:
    """Only IUPAC codes, in either case."""
    return seq.rlike(f"(?i)^[{IUPAC}]*$")


def identifier(header: Column) -> Column:
    """The identifier of a header line without its `>`: up to the first white space; null if it is not a valid one."""
    first = F.regexp_extract(header, r"^([^\s]*)", 1)
    return F.when(first.rlike(IDENTIFIER) & ~first.rlike(r"^[#*=]"), first)


def description(header: Column) -> Column:
    """What follows the identifier and white space."""
    return F.regexp_extract(header, r"(?s)^[^\s]*\s+(.*)$", 1)


def wrapped(seq: Column, width: int = 60) -> Column:
    """The sequence in lines of `width`."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_record(name: Column, seq: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width))
