"""Column expressions over DNA strings: windows, complements, labels and the 2-bit codec.

All are built-in expressions, so they stay in the JVM and fuse with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in code order (A 00, C 01, G 10, T 11).
BASES, CODES, COMPLEMENTS = "ACGT", "0123", "TGCA"


def is_dna(seq: Column) -> Column:
    """Only the four upper-case bases; null is false."""
    return F.coalesce(F.rlike(seq, F.lit("^[ACGT]*$")), F.lit(False))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def windows(seq: Column, k: int) -> Column:
    """All substrings of length k, in order; none if the text is shorter."""
    n = F.length(seq) - (k - 1)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, k))
    return F.when(n >= 1, cut).otherwise(F.array().cast("array<string>"))


def pieces(seq: Column, k: int, small: int = 256, large: int = 1 << 18) -> Column:
    """Overlapping pieces of at most ``small`` windows each: array of (at, part); every window lies in one.

    A window's place is found by counting from the start of its text, so windows of a long
    sequence are cut from pieces, and those from large pieces.  A short sequence is one piece.
    """
    starts = lambda n, step: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    windows_in = lambda text: F.length(text) - (k - 1)
    cut = lambda text, at, size: F.substring(text, at + 1, F.lit(size + k - 1))
    piece = lambda at, part: F.struct(at.alias("at"), part.alias("part"))
    inner = lambda at, text: F.transform(starts(windows_in(text), small), lambda j: piece((at + j).cast("int"), cut(text, j, small)))
    outer = F.flatten(F.transform(F.transform(starts(windows_in(seq), large), lambda i: piece(i, cut(seq, i, large))), lambda p: inner(p["at"], p["part"])))
    return F.when(windows_in(seq) <= small, F.array(piece(F.lit(0), seq))).otherwise(outer)


def source(label: Column, k: int) -> Column:
    return F.substring(label, 1, k - 1)


def target(label: Column, k: int) -> Column:
    """The last k-1 bases: of a k-mer its target node, of a merged label too."""
    return F.right(label, F.lit(k - 1))


def last_base(label: Column) -> Column:
    return F.right(label, F.lit(1))


def from_nodes(src: Column, dst: Column) -> Column:
    """The k-mer between two nodes."""
    return F.concat(src, last_base(dst))


def remainder(label: Column, k: int) -> Column:
    """What a label adds behind its source node."""
    return F.substring(label, F.lit(k), F.length(label))


def merge_labels(a: Column, b: Column, k: int) -> Column:
    return F.concat(a, remainder(b, k))


def append_bases(label: Column, bases: Column) -> Column:
    return F.concat(label, bases)


def replace_last_base(label: Column, base: Column) -> Column:
    return F.concat(F.left(label, F.length(label) - 1), base)


def replace_base_and_clear(chunk: Column, at: Column, base: Column) -> Column:
    """Put ``base`` at a 0-based offset and A (code 0) everywhere right of it."""
    return F.concat(F.left(chunk, at), base, F.repeat(F.lit("A"), F.length(chunk) - at - 1))


def codes(seq: Column) -> Column:
    """The bases as digits 0 to 3."""
    return F.translate(seq, BASES, CODES)


def pack(seq: Column | str) -> Column:
    """Two bits a base, four bases a byte from the high bits on, the last byte padded with zeros."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    even = F.concat(codes(seq), F.repeat(F.lit("0"), F.pmod(-F.length(seq), F.lit(4))))
    hexed = lambda c: F.lpad(F.conv(c, 4, 16), (F.length(c) / 2).cast("int"), "0")
    parts = F.transform(F.sequence(F.lit(1), F.length(even), F.lit(16)), lambda i: hexed(F.substring(even, i, 16)))
    return F.unhex(F.when(F.length(seq) > 0, F.array_join(parts, "")).otherwise(""))


def unpack(packed: Column, n: Column) -> Column:
    """The first n bases of packed bytes."""
    bits = F.hex(packed)
    based = lambda c: F.lpad(F.conv(c, 16, 4), F.length(c) * 2, "0")
    parts = F.transform(F.sequence(F.lit(1), F.length(bits), F.lit(8)), lambda i: based(F.substring(bits, i, 8)))
    return F.left(F.translate(F.when(F.length(bits) > 0, F.array_join(parts, "")).otherwise(""), CODES, BASES), n)


def pack_edge(label: Column) -> Column:
    """One byte with the number of padding bases, then the packed bases."""
    return F.concat(F.unhex(F.lpad(F.hex(F.pmod(-F.length(label), F.lit(4))), 2, "0")), pack(label))


def unpack_edge(packed: Column) -> Column:
    pad = F.conv(F.hex(F.substring(packed, 1, 1)), 16, 10).cast("int")
    body = F.substring(packed, F.lit(2), F.octet_length(packed))
    return unpack(body, F.octet_length(body) * 4 - pad)
