"""What the corpus operators share: whole-batch byte kernels, expressions, ranks.

Byte kernels work on the Arrow buffers of a binary column.  A batch is cut into
pieces of about ``PIECE`` bytes (a longer text is a piece of its own), so the
working memory of a Python worker doesn't depend on how many rows Spark packs
into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import materialize, new_folder, remove  # noqa: F401 (the operators take them from here)

#: Words are maximal runs of bytes outside this class.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
PIECE = 2 << 20

_U = np.uint64
_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256).astype(_U) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


# --------------------------------------------------------------------------- byte kernels


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, min(1 << n.bit_length(), PIECE + 1))
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def prefix_hash(buf: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """Prefix sums of table[byte] * base**position modulo 2**64; symbols of 64 bits are taken as they are.

    Hashes of ranges choose what is compared only: there are long strings that collide for every base.
    """
    p, _ = _power(len(buf))
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum((table[buf] if buf.dtype == np.uint8 else buf) * p[: len(buf)], out=out[1:])
    return out


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes lo..hi, independent of where they lie."""
    _, q = _power(len(h))
    return mix((h[hi] - h[lo]) * q[lo])


_LOWER_TABLE = _TABLE[_LOWER]
_PLACES = 64
#: A random value for each (place in the word, byte with A-Z lowered).
_WORD_TABLE = np.random.default_rng(20240502).integers(0, 1 << 64, (_PLACES, 256), dtype=_U)[:, _LOWER].reshape(-1)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses an offset."""
    w = ~_IS_WS[buf]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def white_space(buf: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that holds white space, or the end."""
    for k in range(at, len(buf), 1 << 16):
        found = np.flatnonzero(_IS_WS[buf[k : k + (1 << 16)]])
        if len(found):
            return k + int(found[0])
    return len(buf)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lowered, and for each text the index of its first word (and the total).

    A hash is the sum of a random value for every (place, byte) of the word, mixed: unlike a
    polynomial modulo 2**64 it has no long words that collide whatever the base.
    """
    starts, ends = words_of(buf, offsets)
    size = ends - starts
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    byte = buf[place + np.repeat(starts, size)].astype(np.int64)
    value = _WORD_TABLE[(place & (_PLACES - 1)) << 8 | byte]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] = mix(value[far] + (place[far] // _PLACES).astype(_U) * _U(0x9E3779B97F4A7C15))
    total = np.concatenate([[_U(0)], np.cumsum(value, dtype=_U)])
    return mix(total[edge[1:]] - total[edge[:-1]] + size.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), np.searchsorted(starts, offsets)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and off.size else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``most`` bytes."""
    data, off = buffers(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


# --------------------------------------------------------------------------- expressions


def words_col(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def unit_hash(col: Column) -> Column:
    """A number in 0..1 that depends on the value alone."""
    return F.shiftrightunsigned(F.xxhash64(col), 11) / F.lit(float(1 << 53))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, n: int) -> DataFrame:
    """The inner join of ``left``, of about ``n`` rows, with ``right``, which has one row a key and in ``count`` how many rows of left have it.

    Keys with more than n / 10,000 rows (and 1,000) are fewer than 10,000, so they may be
    broadcast, and their rows are spread over all tasks; the others meet in a merge join.
    ``left`` is read once.  Key columns of right are dropped; null keys don't meet.
    """
    most = max(1000, n // 10_000)
    values = [c for c in right.columns if c not in keys]
    heavy = right.where(F.col(count) > most).select(*[F.col(k).alias(f"_heavy_{k}") for k in keys], F.struct(*values).alias("_heavy"))
    if heavy.isEmpty():
        return left.join(right.hint("merge"), keys)
    on = lambda side: [F.col(k) == F.col(f"_{side}_{k}") for k in keys]
    out = left.join(F.broadcast(heavy), on("heavy"), "left").drop(*[f"_heavy_{k}" for k in keys])
    # rows that are done go to any task, under a number that no row of the other side has (there it is -1, but
    # not a literal, which the optimiser would take out of the join's keys)
    out = out.withColumn("_spread", F.when(F.col("_heavy").isNotNull(), F.monotonically_increasing_id()).otherwise(-1))
    light = right.where(F.col(count) <= most).select(*[F.col(k).alias(f"_light_{k}") for k in keys], (-F.signum(count)).cast("long").alias("_none"), F.struct(*values).alias("_light"))
    out = out.join(light.hint("merge"), [*on("light"), F.col("_spread") == F.col("_none")], "left").withColumn("_met", F.coalesce("_heavy", "_light")).where("_met is not null")
    return out.select(*left.columns, *[F.col("_met")[c].alias(c) for c in values])


def ranked(df: DataFrame, group: list[str], rank: str, key: list[str], rows_per_chunk: int = 10_000) -> DataFrame:
    """Add ``rank``: the 0-based rank in each group by (MD5 of the key, joined by colons; key).

    A group may hold any part of all rows.  Rows are cut into equal ranges of the
    hash, numbered inside (group, range), and shifted by the counts of the ranges
    before; the cut doesn't change the result.  Only the table of counts (rows /
    rows_per_chunk per group at least) meets in a window over a group.
    """
    bits = min(max((df.count() // rows_per_chunk).bit_length(), 6), 28)
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    df = df.withColumn("_rank_hash", F.unhex(F.md5(text.cast("binary"))))
    df = df.withColumn("_rank_chunk", F.shiftright(F.conv(F.hex(F.substring("_rank_hash", 1, 4)), 16, 10).cast("long"), 32 - bits))
    return _numbered(df, group, rank, [F.col("_rank_hash"), *[F.col(k).asc_nulls_first() for k in key]]).drop("_rank_hash")


def in_file_order(docs: DataFrame) -> DataFrame:
    """Add ``_rank_chunk`` and ``_rank_row``: where a row stands in the files that ``docs`` was read from, by path and row.

    A table that wasn't read from files directly is taken in the order of its partitions.
    """
    if "_metadata" not in docs.columns:
        try:
            at = docs.withColumn("_rank_row", F.col("_metadata.row_index"))
            return at.withColumn("_rank_chunk", F.struct(F.col("_metadata.file_path").alias("f"), F.shiftright("_rank_row", 14).alias("r")))
        except AnalysisException as e:
            if "_metadata" not in str(e):
                raise
    at = docs.withColumn("_rank_row", F.monotonically_increasing_id())
    return at.withColumn("_rank_chunk", F.struct(F.lit("").alias("f"), F.shiftright("_rank_row", 14).alias("r")))


def ranked_in_file_order(df: DataFrame, group: list[str], rank: str, key: list[str]) -> DataFrame:
    """Like ``ranked``, for rows with the columns of ``in_file_order``: by file, row in it, and key."""
    return _numbered(df, group, rank, [F.col("_rank_row"), *[F.col(k) for k in key]]).drop("_rank_row")


def _numbered(df: DataFrame, group: list[str], rank: str, order: list[Column]) -> DataFrame:
    counts = df.groupBy(*group, "_rank_chunk").agg(F.count(F.lit(1)).alias("_rank_n"))
    before = Window.partitionBy(*group).orderBy("_rank_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)))
    inside = df.withColumn("_rank_in", F.row_number().over(Window.partitionBy(*group, "_rank_chunk").orderBy(*order)) - 1)
    c = counts.select(*[F.col(g).alias(f"_rank_{g}") for g in group], F.col("_rank_chunk").alias("_rank_c"), "_rank_before")
    on = F.col("_rank_chunk") == F.col("_rank_c")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_rank_{g}"))
    return inside.join(c, on).withColumn(rank, F.col("_rank_in") + F.col("_rank_before")).drop("_rank_chunk", "_rank_in", "_rank_c", "_rank_before", *[f"_rank_{g}" for g in group])
