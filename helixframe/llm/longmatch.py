"""Long repeated substrings: run-length BWT indexes over the places where repeats can be.

A text is a sequence of symbols: its bytes, or its words.  Each window of ``length``
symbols has an anchor, the q-gram with the smallest hash in it, so equal windows have
equal anchors at the same offset.  Consecutive windows with one anchor, whose offset lies
in the same part of all offsets, are a *segment*; all windows of a segment contain the same
piece around the anchor, its *core*.

1. Segments are listed with the hash of the core and a 128-bit digest of the content.  A
   core that occurs once in the corpus can't be part of a repeat, and goes.
2. Equal contents of a core are one string of its index, with a multiplicity.  A string of
   multiplicity two or more is repeated as a whole: its run in the index is that long.
3. Where a core has other contents too, one copy of each content is fetched.  Cores are put
   together to collections of bounded size, for which a run-length Burrows-Wheeler
   transform is built; of the suffix array only the samples at the ends of runs stay.
   Streaming the collection's positions against them gives the longest match of each with
   its neighbours in suffix order, hence every window that occurs twice.
4. A core with more than ``max_group`` different contents isn't gathered: its segments are
   cut into parts by the anchor's offset, which have longer cores, and are grouped anew, as
   often as needed.  At the end a segment is one window, and its core all of it.  So any
   number of contents is resolved exactly, in groups of bounded size.

Contents are compared by cryptographic digests or symbol by symbol; hashes only choose what
is compared.  Marked windows are united per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import join_counted, materialize, pieces, prefix_hash, range_hash, white_space, word_hashes
from helixframe.storage import release

_U = np.uint64
_POS = _U((1 << 23) - 1)
#: Bytes of rows, or symbols of one text, that are looked at together: a dozen arrays of 8 bytes a symbol are held for them.
_PIECE = 1 << 18
_LISTED = "doc_id long, th long, lo int, n int, at int, core long, s1 long, s2 long"


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries: prefix and suffix minima of blocks of w."""
    n = len(a)
    pad = np.full(-n % w, np.iinfo(a.dtype).max, a.dtype)
    b = np.concatenate([a, pad]).reshape(-1, w)
    pre = np.minimum.accumulate(b, axis=1).reshape(-1)
    suf = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def offsets_of_part(part: int, parts: int, length: int, q: int) -> tuple[int, int]:
    """The anchor offsets, first and last, of one of ``parts`` parts of 0..length-q."""
    n = length - q + 1
    return part * n // parts, (part + 1) * n // parts - 1


def segments_of(sym: np.ndarray, offsets: np.ndarray, length: int, q: int, parts: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, offset of the anchor in the first window, core hash) of every segment."""
    none = (np.zeros(0, np.int64),) * 5
    n = len(sym)
    if n < length:
        return none
    h = prefix_hash(sym)
    i = np.arange(n - q + 1)
    gram = range_hash(h, i, i + q)
    least = sliding_min((gram & ~_POS) | i.astype(_U), length - q + 1)
    anchor = (least & _POS).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][doc])
    if not len(at):
        return none
    anchor = anchor[at]
    part = ((anchor - at + 1) * parts - 1) // (length - q + 1)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
    k = np.flatnonzero(new)
    lo, a, part = at[k], anchor[k], part[k]
    hi = at[np.append(k[1:], len(at)) - 1]
    first, last = offsets_of_part(part, parts, length, q)
    core = range_hash(h, a - first, a - last + length) + part.astype(_U)
    text = doc[lo]
    return text, lo - offsets[text], hi - lo + 1, a - lo, core.view(np.int64)


def symbols(unit: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts and their offsets in them: the bytes, or 64-bit hashes of the words."""
    if unit == "byte":
        return buf, offsets
    if len(offsets) > 2 or len(buf) <= _PIECE:
        return word_hashes(buf, offsets)
    # a long text goes by parts that end in front of white space
    out, at = [], 0
    while at < len(buf):
        end = white_space(buf, at + _PIECE)
        out.append(word_hashes(buf[at:end], np.array([0, end - at]))[0])
        at = end
    sym = np.concatenate(out)
    return sym, np.array([0, len(sym)])


def digest(content: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(content, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def digests(contents: list) -> np.ndarray:
    """The digests of contents as two columns of LONGs."""
    return np.frombuffer(b"".join([hashlib.blake2b(c, digest_size=16).digest() for c in contents]), np.int64).reshape(-1, 2)


def list_segments(rows: DataFrame, unit: str, length: int, q: int, parts: int) -> DataFrame:
    slice_ = max(_PIECE, 4 * length)

    def run(batches):
        for batch in batches:
            for first, _, buf, off in pieces(batch.column(2), _PIECE):
                sym, off = symbols(unit, buf, off)
                # a text beyond the slice size is cut with an overlap, so that each window lies in one slice
                for s in range(0, max(1, len(sym) - length + 1), slice_ - length + 1) if len(off) == 2 else [0]:
                    part, o = (sym, off) if len(off) > 2 else (sym[s : s + slice_], np.array([0, min(slice_, len(sym) - s)]))
                    text, lo, n, at, core = segments_of(part, o, length, q, parts)
                    if len(text):
                        raw, width = memoryview(np.ascontiguousarray(part).view(np.uint8)), part.itemsize
                        begin = (o[text] + lo) * width
                        end = begin + (n - 1 + length) * width
                        sh = digests([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                        row = pa.array(text + first)
                        small = [pa.array(x.astype(np.int32)) for x in (lo + s, n, at)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *small, pa.array(core), pa.array(sh[:, 0].copy()), pa.array(sh[:, 1].copy())], names=["doc_id", "th", "lo", "n", "at", "core", "s1", "s2"])

    return rows.select("doc_id", "th", "bytes").mapInArrow(run, _LISTED)


# --------------------------------------------------------------------------- run-length index


def suffix_order(s: np.ndarray, stop: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array of symbols ``s`` (0: separators, which all differ), and (depth, ranks by that many symbols) of each doubling.

    ``stop`` is how far the next separator is.  Ranks and places are packed in one word, so
    that a plain sort does.
    """
    n = len(s)
    place = max((n - 1).bit_length(), 1)
    if 3 * place > 64:
        raise ValueError(f"a collection of {n} symbols is too large")
    per = max(1, (63 - place) // bits)
    key = np.zeros(n, _U)
    for j in range(per):
        key <<= _U(bits)
        key[: n - j] |= np.where(stop[: n - j] > j, s[j:], 0).astype(_U)
    low = _U((1 << place) - 1)
    if per * bits + place <= 64:
        key <<= _U(place)
        key |= np.arange(n, dtype=_U)
        key.sort()
        sa = (key & low).astype(np.int32)
        key >>= _U(place)
    else:
        sa = np.argsort(key, kind="stable").astype(np.int32)
        key = key[sa]
    rank = np.empty(n, np.int32)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (stop[sa[1:]] < per)
    del key
    head = np.flatnonzero(new).astype(np.int32)
    rank[sa] = np.repeat(head, np.diff(np.append(head, n)))
    levels, k = [(per, rank.copy())], per
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone).astype(np.int32)
    while len(open_):
        at = sa[open_]
        order = rank[at].astype(_U)
        order <<= _U(place)
        order |= rank[at + k].astype(_U)
        order <<= _U(place)
        order |= at.astype(_U)
        order.sort()
        sa[open_] = at = (order & low).astype(np.int32)
        order >>= _U(place)
        new = np.ones(len(at), bool)
        new[1:] = order[1:] != order[:-1]
        del order
        head = np.flatnonzero(new)
        rank[at] = np.repeat(open_[head], np.diff(np.append(head, len(at))))
        open_ = open_[~(new & np.append(new[1:], True))]
        k *= 2
        levels.append((k, rank.copy()))
    return sa, levels


class RunIndex:
    """Run-length BWT of a collection of symbol strings, with the text positions at the ends of runs."""

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(x) for x in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size + 1)])
        ends = self.starts[1:] - 1
        n = int(self.starts[-1])
        s = np.zeros(n, np.int32)
        inside = np.ones(n, bool)
        inside[ends] = False
        all_ = np.concatenate(texts)
        if all_.dtype == np.uint8:
            s[inside], top = all_.astype(np.int32) + 1, 256
        else:
            s[inside] = np.unique(all_, return_inverse=True)[1].reshape(-1) + 1
            top = int(s.max())
        del inside, all_
        self.stop = np.repeat(ends.astype(np.int32), size + 1) - np.arange(n, dtype=np.int32)
        sa, levels = suffix_order(s, self.stop, top.bit_length())
        bwt = s[sa - 1]
        # a separator differs from every other, so it is a run of its own
        head = np.flatnonzero(np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)]))
        self.runs = len(head)
        pos, before = sa[head], sa[head - 1]  # the first of a run and the last of the run before it
        lcp = self._common(s, levels, pos, before)
        lcp[head == 0] = 0
        order = np.argsort(pos)
        self.n, self.sample, self.phi, self.lcp = n, pos[order], before[order], lcp[order]

    @staticmethod
    def _common(s: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of pairs of suffixes: down the doublings, then symbol by symbol."""
        low = np.zeros(len(a), np.int64)
        for k, rank in reversed(levels):
            low += k * (rank[a + low] == rank[b + low])
        for _ in range(levels[0][0]):
            x = s[a + low]
            low += (x == s[b + low]) & (x > 0)
        return low

    def repeated(self, length: int) -> np.ndarray:
        """For each position whether the ``length`` symbols from there occur elsewhere in the collection.

        From the first position of a run to the next sample the predecessor in suffix order
        moves along with the position and the match shortens by one, so the positions of a
        sample that are repeated are the first ones, as are those of its predecessor.
        """
        ahead = np.minimum(np.diff(np.append(self.sample, self.n)), self.lcp - length + 1)
        long = ahead > 0
        begin = np.concatenate([self.sample[long], self.phi[long]])
        edge = np.bincount(begin, minlength=self.n + 1)
        edge -= np.bincount(begin + np.tile(ahead[long], 2), minlength=self.n + 1)
        return np.cumsum(edge[:-1], out=edge[:-1]) > 0


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MARK = "doc_id long, th long, s long, e long"


def index_cores(contents: DataFrame, unit: str, length: int, chunk: int) -> DataFrame:
    """Marks of the contents that occur once (cnt 1), by indexes of whole cores together: contents(core, doc_id, th, lo, cnt, content)."""
    kind = np.uint8 if unit == "byte" else _U

    def flush(rows: list):
        texts = [np.frombuffer(r[4], kind) for r in rows]
        index = RunIndex(texts)
        rep = index.repeated(length)
        s, e = runs_of(rep)  # a match doesn't reach over a separator, so a run lies in one text
        which = np.searchsorted(index.starts, s, "right") - 1
        cnt = np.array([r[3] for r in rows])
        own = cnt[which] == 1
        s, e, which = s[own], e[own], which[own]
        lo = np.array([r[2] for r in rows])[which] - index.starts[which]
        ids, ths = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
        at = pa.array(which)
        return pa.RecordBatch.from_arrays([ids.take(at), ths.take(at), pa.array(s + lo), pa.array(e + lo - 1 + length)], names=["doc_id", "th", "s", "e"])

    def run(batches):
        # whole cores until the next one would go beyond the chunk; a larger core is a collection of its own
        held, size, last, begin, before = [], 0, None, 0, 0
        for batch in batches:
            for core, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if core != last:
                    last, begin, before = core, len(held), size
                held.append(row)
                size += len(row[4]) // np.dtype(kind).itemsize
                if size > chunk and begin:
                    yield flush(held[:begin])
                    held, size, begin, before = held[begin:], size - before, 0, 0
        if held:
            yield flush(held)

    rows = contents.select("core", "doc_id", "th", "lo", "cnt", "content").repartition("core").sortWithinPartitions("core")
    return rows.mapInArrow(run, _MARK)


def cut_again(contents: DataFrame, unit: str, length: int, parts: int = 8) -> DataFrame:
    """The segments of contents(doc_id, th, lo, n, at, cnt, o1, o2, content) cut into parts of the anchor's offsets o1..o2, with the cores of those."""
    width = 1 if unit == "byte" else 8
    names = ["doc_id", "th", "lo", "n", "at", "cnt", "o1", "o2", "core", "s1", "s2", "content"]
    types = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()] + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary()]

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for doc, th, lo, n, at, cnt, o1, o2, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edge = [o1 + (o2 - o1 + 1) * k // parts for k in range(parts + 1)]
                for a, b in ((x, y - 1) for x, y in zip(edge[:-1], edge[1:], strict=True) if x < y):
                    # the windows with the anchor at a..b: from at - b to at - a behind the first
                    w1, w2 = max(0, at - b), min(n - 1, at - a)
                    if w1 > w2:
                        continue
                    core = content[(at - a) * width : (at - b + length) * width]
                    part = content[w1 * width : (w2 + length) * width]
                    out.append((doc, th, lo + w1, w2 - w1 + 1, at - w1, cnt, a, b, digest(core + b"%d %d" % (a, b))[0], *digest(part), part))
                    size += len(part)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, th long, lo int, n int, at int, cnt long, o1 int, o2 int, core long, s1 long, s2 long, content binary"
    return contents.select("doc_id", "th", "lo", "n", "at", "cnt", "o1", "o2", "content").mapInArrow(run, schema)


def fetch(rows: DataFrame, wanted: DataFrame, unit: str, length: int) -> DataFrame:
    """The contents of segments wanted(doc_id, th, lo, n, ...): one join by text, whose segments are a list no longer than itself."""
    extra = [c for c in wanted.columns if c not in ("doc_id", "th")]
    per = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*extra)).alias("parts"))
    r = rows.select(F.col("doc_id").alias("rd"), F.col("th").alias("rt"), "bytes")
    met = r.join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("th") == F.col("rt"))).select("doc_id", "th", "bytes", "parts")
    if unit == "byte":
        one = met.select("doc_id", "th", "bytes", F.explode("parts").alias("p")).select("doc_id", "th", "p.*", "bytes")
        return one.select("doc_id", "th", *extra, F.substring("bytes", F.col("lo") + 1, F.col("n") - 1 + length).alias("content"))

    def run(batches):
        for batch in batches:
            for first, end, buf, off in pieces(batch.column(2), _PIECE):
                sym, off = symbols(unit, buf, off)
                raw = memoryview(sym.view(np.uint8))
                part = batch.column(3).slice(first, end - first)
                flat = part.flatten()
                count = np.diff(part.offsets.to_numpy())
                begin = (np.repeat(off[:-1], count) + flat.field("lo").to_numpy()) * 8
                stop = begin + (flat.field("n").to_numpy().astype(np.int64) - 1 + length) * 8
                row = pa.array(np.repeat(np.arange(first, end), count))
                content = pa.array([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[flat.field(c) for c in extra], content], names=["doc_id", "th", *extra, "content"])

    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in extra)
    return met.mapInArrow(run, f"doc_id long, th long, {kinds}, content binary")


def _windows_end(length: int) -> Column:
    return (F.col("lo") + F.col("n") - 1 + length).cast("long").alias("e")


def _open(kinds: DataFrame) -> DataFrame:
    """The contents of cores where one content occurs once and another one exists, with the number of contents."""
    groups = kinds.groupBy(F.col("core").alias("gc")).agg(F.min("cnt").alias("least"), F.count(F.lit(1)).alias("size")).where("least = 1 and size > 1").select("gc", "size")
    return kinds.join(groups.hint("merge"), F.col("core") == F.col("gc")).drop("gc")


def repeats(rows: DataFrame, unit: str, length: int, q: int, parts: int, chunk: int, max_group: int) -> DataFrame:
    """The united marks (doc_id, th, starts, ends), in symbols, of rows(doc_id, th, bytes)."""
    # what a collection may hold: a content has less than 2 * length symbols
    max_group = max(2, min(max_group, (1 << 20) // (2 * length)))
    occ = materialize(list_segments(rows, unit, length, q, parts), f"{unit}-segments")
    again = occ.groupBy("core").agg(F.count(F.lit(1)).alias("total"), *[f(c).alias(f"{n}_{c}") for c in ("s1", "s2") for n, f in (("min", F.min), ("max", F.max))]).where("total > 1")
    again = materialize(again.select("core", "total", (F.expr("min_s1 <> max_s1 or min_s2 <> max_s2")).alias("varied")), f"{unit}-cores")
    cand = materialize(join_counted(occ, again, ["core"], "total", occ.count()).drop("total"), f"{unit}-candidates")
    release(occ, again)
    several = cand.where("varied")
    kinds = several.groupBy("core", "s1", "s2").agg(F.count(F.lit(1)).alias("cnt"), F.first(F.struct("doc_id", "th", "lo", "n", "at")).alias("r"))
    kinds = materialize(kinds.select("core", "s1", "s2", "cnt", "r.*"), f"{unit}-contents")
    same = join_counted(several, kinds.where("cnt > 1").select("core", "s1", "s2", "cnt"), ["core", "s1", "s2"], "cnt", cand.count())
    mark = ["doc_id", "th", F.col("lo").cast("long").alias("s"), _windows_end(length)]
    marks = cand.where("not varied").select(*mark).union(same.select(*mark))

    wanted = _open(kinds).select("doc_id", "th", "lo", "n", "at", "core", "cnt", "size")
    found = materialize(fetch(rows, wanted, unit, length), f"{unit}-fetched")
    # repeated rows give a content several times; equal rows have equal segments, so those have cnt > 1 and any copy does
    marks = materialize(marks.union(index_cores(found.where(F.col("size") <= max_group), unit, length, chunk)), f"{unit}-marks")
    release(cand, kinds)
    big = found.where(F.col("size") > max_group)
    part = F.floor(((F.col("at") + 1) * parts - 1) / (length - q + 1)).cast("int")
    spread = length - q + 1
    big = big.withColumn("o1", F.floor(part * spread / parts).cast("int")).withColumn("o2", (F.floor((part + 1) * spread / parts) - 1).cast("int"))
    done, cuts = [marks], []
    while not big.isEmpty():
        cut = materialize(cut_again(big, unit, length), f"{unit}-parts")
        kinds = cut.groupBy("core", "s1", "s2").agg(F.sum("cnt").alias("cnt"), F.first(F.struct("doc_id", "th", "lo", "n", "at", "o1", "o2", "content")).alias("r"))
        kinds = materialize(kinds.select("core", "s1", "s2", "cnt", "r.*"), f"{unit}-part-contents")
        single = cut.where("cnt = 1").select("core", "s1", "s2", "doc_id", "th", "lo", "n")
        same = join_counted(single, kinds.where("cnt > 1").select("core", "s1", "s2", "cnt"), ["core", "s1", "s2"], "cnt", cut.count()).select(*mark)
        next_ = materialize(_open(kinds), f"{unit}-open")
        cuts.append(next_)
        # a segment of one window has one content; only a collision of its hash could bring another, so it is never cut
        small = next_.where((F.col("size") <= max_group) | (F.col("o1") == F.col("o2")))
        done.append(materialize(same.union(index_cores(small, unit, length, chunk)), f"{unit}-marks"))
        release(cut, kinds)
        big = next_.where((F.col("size") > max_group) & (F.col("o1") < F.col("o2")))
    marks = done[0]
    for m in done[1:]:
        marks = marks.union(m)
    out = materialize(unite(marks), f"{unit}-united")
    release(found, *done, *cuts)
    return out


def unite(marks: DataFrame) -> DataFrame:
    """Overlapping and touching marks of a text become one: doc_id, th, starts, ends."""

    def run(batches):
        for batch in batches:
            starts, ends = [], []
            # both lists of a text are as long, as no mark has a null
            flat = [batch.column(k).flatten().to_numpy() for k in (2, 3)]
            edge = np.cumsum(batch.column(2).value_lengths().to_numpy())
            for s, e in zip(*(np.split(x, edge)[: batch.num_rows] for x in flat), strict=True):
                o = np.argsort(s, kind="stable")
                s, top = s[o], np.maximum.accumulate(e[o])
                new = np.concatenate([[True], s[1:] > top[:-1]])
                starts.append(s[new])
                ends.append(top[np.append(np.flatnonzero(new)[1:], len(s)) - 1])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "th", "starts", "ends"])

    # the marks of one text only: their number is bounded by its length
    per = marks.groupBy("doc_id", "th").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    return per.mapInArrow(run, "doc_id long, th long, starts array<long>, ends array<long>")


def _spans(starts: str, ends: str) -> Column:
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.col(starts).isNull(), none).otherwise(F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.get(F.col(ends), i).alias("end"))))


def long_matches(docs: DataFrame, length: int = 400, q: int = 64, words: int | None = None, chunk: int = 1 << 18, max_group: int = 1000) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_bytes, spans (array of start, end in bytes), kept (binary, the remaining bytes), passages.

    A byte is removed if it lies in a string of ``length`` bytes that also starts
    anywhere else in the corpus, in the same text or another; strings never cross texts.
    Texts are UTF-8; null is empty; texts shorter than ``length`` keep all bytes.  A
    repeated row is another text, so long texts of repeated rows go altogether.  Null
    and repeated doc_ids are told apart by the content.  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.

    With ``words``, passages (array of start, end in words, from 0) are the runs of words
    that lie in ``words`` neighbouring words that also start anywhere else, by the same
    indexes over words (A-Z lowered, by 64-bit hashes) in place of bytes; nothing is removed
    for them.  Without, the list is empty.
    """
    if not 0 < q <= length <= 1 << 18 or (words is not None and not 0 < words <= 1 << 18):
        raise ValueError("0 < q <= length and words > 0 are needed, lengths of 2^18 at most")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumn("th", F.xxhash64("bytes"))
    found = repeats(rows, "byte", length, q, 2, chunk, max_group)
    per = found.select("doc_id", "th", "starts", "ends", *[F.lit(None).cast("array<long>").alias(c) for c in ("first", "last")])
    if words:
        other = repeats(rows, "word", words, min(8, words), 1, chunk, max_group)
        per = per.unionByName(other.select("doc_id", "th", *[F.lit(None).cast("array<long>").alias(c) for c in ("starts", "ends")], F.col("starts").alias("first"), F.col("ends").alias("last")))
        # a text has one row of each at most
        per = per.groupBy("doc_id", "th").agg(*[F.first(c, True).alias(c) for c in ("starts", "ends", "first", "last")])
    p = per.withColumnRenamed("doc_id", "pd").withColumnRenamed("th", "pt")
    out = rows.join(p.hint("merge"), F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("th") == F.col("pt")), "left")
    gaps = F.transform(F.sequence(F.lit(0), F.size("starts")), lambda i: F.substring("bytes", (F.coalesce(F.get("ends", i - 1), F.lit(0)) + 1).cast("int"), (F.coalesce(F.get("starts", i), F.octet_length("bytes").cast("long")) - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("int")))
    kept = F.when(F.col("starts").isNull(), F.col("bytes")).otherwise(F.aggregate(gaps, F.lit(b""), lambda a, x: F.concat(a, x)))
    return out.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), _spans("starts", "ends").alias("spans"), kept.alias("kept"), _spans("first", "last").alias("passages"))


def _total(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def long_match_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op6, and behind them the removed spans and the words in repeated passages of over 50 words."""
    out = long_matches(docs, words=51)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_bytes", _total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), spans.alias("removed_spans"), _total("passages").alias("n_passage_words"))


def _oracle_marks(name: str, windows: str, length: int) -> str:
    """CTEs that end with ``name``_span(doc_id, s, e), the united windows of ``windows``(doc_id, i, key) whose key occurs twice."""
    return f"""{name}_rep AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT *, count(*) OVER (PARTITION BY key) AS times FROM {windows}) WHERE times > 1),
{name}_isle AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM {name}_rep),
{name}_span AS MATERIALIZED (SELECT doc_id, min(i) AS s, max(i) + {length} AS e FROM {name}_isle GROUP BY doc_id, isle)"""


#: DuckDB SQL for the query's rows: every window of every text, so for small tables only.
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
byte_win AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS INT), 800)) AS key FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
word_win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 51), ' ')) AS key FROM (SELECT doc_id, w, unnest(range(0, len(w) - 50)) AS i FROM d)),
{_oracle_marks("byte", "byte_win", 400)},
{_oracle_marks("word", "word_win", 51)},
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM byte_span),
gone AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(s || ':' || e, ',' ORDER BY s) AS removed_spans, max(e) AS last,
  string_agg(substring(h, CAST(2 * before + 1 AS INT), CAST(2 * (s - before) AS INT)), '' ORDER BY s) AS front FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
said AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_passage_words FROM word_span GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front || substring(h, CAST(2 * last + 1 AS INT)), h))) AS kept_sha256, coalesce(removed_spans, '') AS removed_spans, coalesce(n_passage_words, 0) AS n_passage_words
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN said USING (doc_id)
"""
