"""k-mers counted by neighbourhoods: what meets at a node is brought together by one exchange.

A node (k-1 bases) belongs to the bucket of its minimizer, the m-mer in it with the smallest
hash.  Neighbouring nodes of a read mostly share it, so a read is cut into runs of nodes of one
bucket, and a run goes there with one base more on each side, two bits a base: every bucket sees
all occurrences of all edges at its nodes.  Counts, degrees, adjacency and paths that stay in a
bucket need no other exchange.  An edge between two buckets is seen by both and belongs to that
of its source.

Rows of the exchange are (bucket, blob) with all runs of a batch of reads for a bucket.  Buckets
are taken one after the other, small ones together, so memory doesn't depend on the partitions;
a bucket of many windows is counted in portions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKETS = 1024
#: Bases of reads cut at a time, and windows counted at a time.
_PORTION = 1 << 22
_U = np.uint64
_ACGT = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[_ACGT] = np.arange(4)
_UNPACK = ((np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.uint8)
_ROWS = 1 << 18


class _Ints:
    """Windows of up to 32 bases as 64-bit numbers, in the order of their strings."""

    @staticmethod
    def windows(bases: np.ndarray, k: int) -> np.ndarray:
        n = max(bases.size - k + 1, 0)
        out, part, width, at = np.zeros(n, _U), bases.astype(_U), 1, 0
        while n:
            if k & width:
                out = (out << _U(2 * width)) | part[at : at + n]
                at += width
            if at == k:
                break
            part = (part[:-width] << _U(2 * width)) | part[width:]
            width *= 2
        return out

    @staticmethod
    def source(codes: np.ndarray, k: int) -> np.ndarray:
        return codes >> _U(2)

    @staticmethod
    def target(codes: np.ndarray, k: int) -> np.ndarray:
        return codes & _U((1 << 2 * (k - 1)) - 1)

    @staticmethod
    def chars(codes: np.ndarray, k: int) -> np.ndarray:
        out = np.empty((codes.size, k), np.uint8)
        for j in range(k):
            out[:, j] = _ACGT[(codes >> _U(2 * (k - 1 - j))).astype(np.uint8) & 3]
        return out


class _Texts:
    """Longer windows as fixed strings."""

    @staticmethod
    def windows(bases: np.ndarray, k: int) -> np.ndarray:
        if bases.size < k:
            return np.zeros(0, f"S{k}")
        text = _ACGT[bases]
        return np.ndarray(bases.size - k + 1, f"S{k}", text, strides=(1,))

    @staticmethod
    def source(codes: np.ndarray, k: int) -> np.ndarray:
        return codes.astype(f"S{k - 1}")

    @staticmethod
    def target(codes: np.ndarray, k: int) -> np.ndarray:
        return np.ascontiguousarray(_Texts.chars(codes, k)[:, 1:]).view(f"S{k - 1}").ravel()

    @staticmethod
    def chars(codes: np.ndarray, k: int) -> np.ndarray:
        return np.ascontiguousarray(codes).view(np.uint8).reshape(codes.size, k)


def _codec(k: int):
    return _Ints if k <= 32 else _Texts


def _strings(chars: np.ndarray) -> pa.Array:
    """Rows of equal length as an Arrow column."""
    n, k = chars.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(chars)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """32-bit hashes, different for different numbers."""
    x = x ^ np.uint32(0x5BD1E995)
    for shift in (16, 15):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(0x7FEB352D if shift == 16 else 0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _lowest(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    n, width = x.size - size + 1, 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[size - width : size - width + n])


def _buckets(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest hash, bucket) of the node at each place."""
    m = max(1, min(8, (k - 1) // 2))
    low = _lowest(_mixed(_Ints.windows(bases, m).astype(np.uint32)), k - m)
    return low, ((low * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(BUCKETS)


def _packed(bases: np.ndarray) -> bytes:
    b = np.zeros((bases.size + 3) // 4 * 4, np.uint8)
    b[: bases.size] = bases
    b = b.reshape(-1, 4)
    return (b[:, 0] << 6 | b[:, 1] << 4 | b[:, 2] << 2 | b[:, 3]).tobytes()


def _runs(first: np.ndarray, size: np.ndarray, bases: np.ndarray, k: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of reads: ids of their first positions, lengths of k at least, and bases one behind the other.

    A blob has the number of runs, the id of each one's first window, four times its length plus its
    marks (1: its first window's source is not of the bucket, 2: its last window's target isn't), and the bases.
    """
    end = np.cumsum(size)
    start = end - size
    low, bucket = _buckets(bases, k)
    read = np.repeat(np.arange(size.size, dtype=np.int32), size)[: low.size]
    new = np.empty(low.size, bool)
    new[1:] = low[1:] != low[:-1]
    new[start] = True
    new &= end[read] - np.arange(low.size) >= k - 1
    a = np.flatnonzero(new)
    read = read[a]
    last = end[read] - (k - 1)
    b = np.minimum(np.append(a[1:], bases.size) - 1, last)
    left, right = a > start[read], b < last
    at = a - left
    n = b + (k - 1) + right - at
    order = np.argsort(bucket[a], kind="stable")
    at, n, read = at[order], n[order], read[order]
    ids = first[read] + (at - start[read])
    marks = (n << 2 | left[order] | right[order].astype(np.int64) << 1).astype(np.uint32)
    stop = np.cumsum(n)
    stream = bases[np.repeat(at - (stop - n), n) + np.arange(stop[-1])]
    of = bucket[a][order]
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for i, j in zip(edges, np.append(edges[1:], of.size), strict=True):
        yield int(of[i]), np.int64(j - i).tobytes() + ids[i:j].tobytes() + marks[i:j].tobytes() + _packed(stream[stop[i] - n[i] : stop[j - 1]])


def _text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)


def _rows_of(pairs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*pairs, strict=True)
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])


def _cut_reads(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bases = [], 0

        def out():
            first, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
            return _rows_of([(b, 0, blob) for b, blob in _runs(first, size, _CODE[text], k)])

        for batch in batches:
            size, text = _text_column(batch.column(1))
            first = batch.column(0).to_numpy(zero_copy_only=False)
            end, row = np.cumsum(size), 0
            while row < size.size:
                # rows up to a portion, one at least
                done = end[row] - size[row]
                to = max(row + 1, int(np.searchsorted(end, done + _PORTION - bases, "right")))
                keep = size[row:to] >= k
                part = text[done : end[to - 1]]
                if not keep.all():
                    part = part[np.repeat(keep, size[row:to])]
                if keep.any():
                    held.append((first[row:to][keep], size[row:to][keep], part))
                    bases += part.size
                row = to
                if bases >= _PORTION // 2:
                    yield out()
                    held, bases = [], 0
        if held:
            yield out()

    return run


def _send_nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, text = _text_column(batch.column(0))
            text = text[np.repeat(size == k - 1, size)]
            known = np.zeros(256, bool)
            known[_ACGT] = True
            rows = text.reshape(-1, k - 1)
            bases = _CODE[rows[known[rows].all(axis=1)]].ravel()
            if bases.size:
                _, bucket = _buckets(bases, k)
                bucket = bucket[:: k - 1]
                order = np.argsort(bucket, kind="stable")
                rows, bucket = bases.reshape(-1, k - 1)[order], bucket[order]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                yield _rows_of([(int(bucket[i]), 1, np.int64(j - i).tobytes() + _packed(rows[i:j].ravel())) for i, j in zip(edges, np.append(edges[1:], bucket.size), strict=True)])

    return run


class Edges:
    """Distinct edges of some buckets by code: occurrences where the source (the target) is theirs, first and last id."""

    def __init__(self, k: int, code, at_src, at_dst, first, last):
        self.k, self.code, self.at_src, self.at_dst, self.first, self.last = k, code, at_src, at_dst, first, last

    @property
    def weight(self) -> np.ndarray:
        return np.maximum(self.at_src, self.at_dst)

    def where(self, mask: np.ndarray) -> Edges:
        return Edges(self.k, self.code[mask], self.at_src[mask], self.at_dst[mask], self.first[mask], self.last[mask])

    @property
    def src(self) -> np.ndarray:
        return _codec(self.k).source(self.code, self.k)

    @property
    def dst(self) -> np.ndarray:
        return _codec(self.k).target(self.code, self.k)


def _distinct(k: int, code, at_src, at_dst, first, last) -> Edges:
    order = np.argsort(code)
    code = code[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if code.size else np.zeros(0, int)
    if not at.size:
        return Edges(k, code, at_src, at_dst, first, last)
    low = first[order]
    high = low if last is first else last[order]
    return Edges(k, code[at], np.add.reduceat(at_src[order], at, dtype=np.int64), np.add.reduceat(at_dst[order], at, dtype=np.int64), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))


def _counted(blobs: list[bytes], k: int) -> Edges:
    """Edges of the windows of some blobs."""
    ids, marks, stream = [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        ids.append(np.frombuffer(blob, np.int64, n, 8))
        marks.append(np.frombuffer(blob, np.uint32, n, 8 + 8 * n))
        stream.append(_UNPACK[np.frombuffer(blob, np.uint8, -1, 8 + 12 * n)].ravel()[: int((marks[-1] >> 2).sum(dtype=np.int64))])
    ids, marks, bases = np.concatenate(ids), np.concatenate(marks), np.concatenate(stream)
    size = (marks >> 2).astype(np.int64)
    n = size - (k - 1)
    stop = np.cumsum(n)
    at = np.repeat(np.cumsum(size) - size - (stop - n), n) + np.arange(stop[-1])
    code = _codec(k).windows(bases, k)[at]
    edge = np.repeat(ids - (stop - n), n) + np.arange(stop[-1])
    at_src, at_dst = np.ones(stop[-1], np.int8), np.ones(stop[-1], np.int8)
    at_src[(stop - n)[(marks & 1).astype(bool)]] = 0
    at_dst[(stop - 1)[(marks & 2).astype(bool)]] = 0
    return _distinct(k, code, at_src, at_dst, edge, edge)


def _merged(parts: list[Edges], k: int) -> Edges:
    if len(parts) == 1:
        return parts[0]
    return _distinct(k, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("code", "at_src", "at_dst", "first", "last")))


def _portions(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[Edges, np.ndarray]]:
    """(edges, nodes that were sent) of buckets in order, small ones together."""
    blobs, parts, sent, size, seen, at = [], [], [], 0, 0, None

    def count():
        nonlocal blobs, size
        if blobs:
            parts.append(_counted(blobs, k))
            if len(parts) > 1 and parts[-1].code.size > sum(p.code.size for p in parts[:-1]) // 8:
                parts[:] = [_merged(parts, k)]
        blobs, size = [], 0

    def out():
        nonlocal parts, sent, seen
        count()
        got = (_merged(parts, k), np.concatenate([np.zeros(0, _codec(k).windows(np.zeros(0, np.uint8), k - 1).dtype), *sent])) if parts else None
        parts, sent, seen = [], [], 0
        return got

    for batch in batches:
        for bucket, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != at and seen + size >= _PORTION // 2 and (got := out()):
                yield got
            at, blob = bucket, blob.as_buffer()
            if kind:
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                bases = _UNPACK[np.frombuffer(blob, np.uint8, -1, 8)].ravel()[: n * (k - 1)]
                sent.append(_codec(k).windows(bases, k - 1)[:: k - 1])
                continue
            blobs.append(blob)
            size += len(blob) // 3  # windows, about
            if size >= _PORTION:
                seen += size
                count()
    if got := out():
        yield got


def _in_slices(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), _ROWS):
        yield pa.record_batch([c[i : i + _ROWS] for c in columns], names=names)


def _edge_rows(e: Edges, sent) -> Iterator[pa.RecordBatch]:
    e = e.where(e.at_src > 0)
    for i in range(0, e.code.size, _ROWS):
        s = slice(i, i + _ROWS)
        yield pa.record_batch([pa.array(e.first[s]), pa.array(e.last[s]), _strings(_codec(e.k).chars(e.code[s], e.k)), pa.array(e.at_src[s])], names=["edge_id", "last_seen", "kmer", "weight"])


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal neighbours begin, and their sizes."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if x.size else np.zeros(0, int)
    return at, np.diff(np.append(at, x.size))


def _node_rows(e: Edges, sent) -> Iterator[pa.RecordBatch]:
    """Nodes with degrees, the summed weight of the edges out and the largest weight at them."""
    out, in_ = e.where(e.at_src > 0), e.where(e.at_dst > 0)
    node, weight = np.concatenate([out.src, in_.dst]), np.concatenate([out.weight, in_.weight])
    is_out = np.arange(node.size) < out.code.size
    order = np.argsort(node)
    at, size = _groups(node[order])
    if at.size:
        outs = np.add.reduceat(is_out[order], at, dtype=np.int64)
        total = np.add.reduceat(np.where(is_out, weight, 0)[order], at)
        yield from _in_slices([_strings(_codec(e.k).chars(node[order][at], e.k - 1)), pa.array(size - outs), pa.array(outs), pa.array(total), pa.array(np.maximum.reduceat(weight[order], at))], ["node", "in_degree", "out_degree", "total", "most"])


def _adjacency_rows(e: Edges, sent) -> Iterator[pa.RecordBatch]:
    """Nodes and their outgoing edges, in the order of their targets."""
    out = e.where(e.at_src > 0)
    src, dst = out.src, e.where(e.at_dst > 0).dst
    node = np.unique(np.concatenate([src, dst]))
    for i in range(0, node.size, _ROWS):
        some = node[i : i + _ROWS]
        lo, hi = np.searchsorted(src, some, "left"), np.searchsorted(src, some, "right")
        s = slice(lo[0], hi[-1])
        chars = _codec(e.k).chars(out.code[s], e.k)
        items = pa.StructArray.from_arrays([_strings(chars[:, 1:]), pa.array(out.weight[s]), _strings(chars[:, -1:]), pa.array(out.first[s])], names=["dst", "weight", "last_char", "edge_id"])
        yield pa.record_batch([_strings(_codec(e.k).chars(some, e.k - 1)), pa.ListArray.from_arrays(pa.array((np.append(lo, hi[-1]) - lo[0]).astype(np.int32)), items)], names=["node", "outgoing"])


def _chased(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, steps to it, on a cycle) of each element of lists linked by prev (-1: none)."""
    p = np.where(prev >= 0, prev, np.arange(prev.size))
    d = (prev >= 0).astype(np.int64)
    left, reach = np.flatnonzero(prev[p] >= 0), 1
    while left.size and reach <= prev.size:
        q = p[left]
        p[left], d[left] = p[q], d[left] + d[q]
        left, reach = left[prev[p[left]] >= 0], 2 * reach
    cycle = np.zeros(prev.size, bool)
    cycle[left] = True
    return p, d, cycle


def _lows(prev: np.ndarray, cycle: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The smallest value of its cycle for each element that lies on one (whose indexes are ``cycle``)."""
    place = np.zeros(prev.size, np.int64)
    place[cycle] = np.arange(cycle.size)
    q, low, reach = place[prev[cycle]], value[cycle], 1
    while reach < cycle.size:
        low, q, reach = np.minimum(low, low[q]), q[q], 2 * reach
    return np.minimum(low, low[q]) if cycle.size else low


def _segment_rows(restricted: bool):
    def rows(e: Edges, sent) -> Iterator[pa.RecordBatch]:
        """Unbranched paths as far as they stay at these nodes: see ``segments``."""
        k, n = e.k, e.code.size
        src, dst, weight = e.src, e.dst, e.weight
        mine = np.flatnonzero(e.at_src > 0)
        into = np.flatnonzero(e.at_dst > 0)
        into = into[np.argsort(dst[into], kind="stable")]
        a, outs = _groups(src[mine])
        b, ins = _groups(dst[into])
        a, b = mine[a[outs == 1]], into[b[ins == 1]]
        # nodes with one edge out (a) and one in (b); both lists are sorted by node
        at = np.searchsorted(src[a], dst[b])
        ok = at < a.size
        ok[ok] = src[a][at[ok]] == dst[b][ok]
        if restricted:
            ok[ok] = np.isin(dst[b][ok], sent)
        prev = np.full(n, -1, np.int64)
        prev[a[at[ok]]] = b[ok]
        start, dist, cycle = _chased(prev)
        if cycle.any():
            on = np.flatnonzero(cycle)
            prev[on[_lows(prev, on, e.first) == e.first[on]]] = -1
            start, dist, _ = _chased(prev)
        own = mine[np.lexsort((dist[mine], start[mine]))]
        at, size = _groups(start[own])
        if not at.size:
            return
        head = start[own][at]
        linked = e.at_src[head] == 0
        ids, low = e.first[own], np.minimum.reduceat(e.first[own], at)
        low_at = np.flatnonzero(ids == np.repeat(low, size)) - at
        stop = np.cumsum(size)
        # the text: the first edge's source, then the last bases
        text_stop = stop + (k - 1) * np.arange(1, at.size + 1)
        text = np.empty(text_stop[-1], np.uint8)
        last = _codec(k).chars(e.code[own], k)[:, -1] if k > 32 else _ACGT[e.code[own].astype(np.uint8) & 3]
        text[np.arange(own.size) + (k - 1) * np.repeat(np.arange(1, at.size + 1), size)] = last
        text[(text_stop - size - (k - 1))[:, None] + np.arange(k - 1)] = _codec(k).chars(e.code[own[at]], k)[:, :-1]
        lists = pa.array(np.append(0, stop).astype(np.int32))
        w = weight[own]
        columns = {
            "seg_id": ids[stop - 1],
            "ptr": np.where(linked, e.first[head], -1),
            "n": size,
            "total": np.add.reduceat(w, at),
            "most": np.maximum.reduceat(w, at),
            "first_id": ids[at],
            "low": low,
            "low_at": low_at,
            "cyclic": cycle[own[at]],
            "seq": pa.StringArray.from_buffers(at.size, pa.py_buffer(np.append(0, text_stop).astype(np.int32)), pa.py_buffer(text)),
            "ids": pa.ListArray.from_arrays(lists, pa.array(ids)),
            "weights": pa.ListArray.from_arrays(lists, pa.array(w)),
        }
        yield from _in_slices([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))

    return rows


_OUTPUT = {
    "edges": (_edge_rows, "edge_id long, last_seen long, kmer string, weight long"),
    "nodes": (_node_rows, "node string, in_degree long, out_degree long, total long, most long"),
    "adjacency": (_adjacency_rows, "node string, outgoing array<struct<dst:string,weight:long,last_char:string,edge_id:long>>"),
    "segments": (_segment_rows, "seg_id long, ptr long, n long, total long, most long, first_id long, low long, low_at long, cyclic boolean, seq string, ids array<long>, weights array<long>"),
}


def neighbourhoods(reads: DataFrame, k: int, kind: str, min_weight: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """``edges``, ``nodes``, ``adjacency`` or ``segments`` of the graph of reads(first, part), its edges of ``min_weight`` at least.

    Segments: pieces of unbranched paths, cut where buckets meet.  seg_id is the id of the last edge, ptr that
    of the edge before the first, -1 if the path begins here; n, total, most (weights), first_id,
    low (smallest id) and low_at (its place), seq, ids and weights of the edges.  A cycle
    that lies in one bucket is cut before its smallest id and marked ``cyclic``.  ``through(node)`` restricts
    the nodes that a path may run through.
    """
    rows, schema = _OUTPUT[kind]
    if kind == "segments":
        rows = rows(through is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, sent in _portions(batches, k):
            yield from rows(edges if min_weight is None else edges.where(edges.weight >= min_weight), sent)

    form = "bucket int, kind int, blob binary"
    runs = reads.select("first", "part").mapInArrow(_cut_reads(k), form)
    if through is not None:
        runs = runs.union(through.where("node is not null").select("node").mapInArrow(_send_nodes(k), form))
    partitions = min(max(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), BUCKETS)
    return runs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
