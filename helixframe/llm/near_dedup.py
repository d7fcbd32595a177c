"""Near-duplicate detection: MinHash bands, odd-sketch verification, exact confirmation.

Each text becomes its set of distinct five-word shingles (64-bit hashes).  MinHash
samples feed two structures: band keys, which bring candidates together, and an odd
sketch, a parity bitmap whose XOR population count estimates the similarity of a
candidate pair.  Pairs whose estimate is far below the threshold go; the others are
confirmed word by word on their full sets, so a reported link is never wrong.

Groups are never expanded into all pairs:

* texts with equal word sequences (by a 128-bit digest) are one node (the smallest doc_id);
* in a band bucket every node is compared with the smallest node only (a star);
* after connected components, only buckets that still hold several components are
  looked at again, and there only nodes outside the component of the bucket's
  smallest node are compared with nodes of other components.  Nodes of the same
  component need no comparison, so no link between different components is lost;
* before that, the shingles that only one node of those buckets has are counted: a node
  can share no more than its other shingles with any candidate, which bounds the
  similarity from above and exactly excludes most loosely edited copies;
* an odd sketch of the full set, too, is kept for those nodes.  The population count of
  the XOR of two of them never exceeds the size of the sets' difference, so a pair whose
  count is too large for the threshold is excluded exactly, inside the join.

With 32 bands of 4 rows, a pair of similarity 0.75 misses all bands with probability
5e-6; the sketch test keeps it but for about 1e-9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import PIECE, buffers, join_counted, materialize, mix, pieces, word_hashes
from helixframe.storage import release

_U = np.uint64
_SCHEMA = "doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes; fewer words than ``size`` make one shingle."""
    words, first = word_hashes(buf, offsets)
    mult = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
    n = max(0, len(words) - size + 1)
    sh = np.zeros(n, _U)
    for j in range(size):
        sh += words[j : j + n] * mult[j]
    sh = mix(sh)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(sh[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * mult[: b - a]).sum(dtype=_U) + _U(b - a)], _U))
        else:
            yield np.zeros(0, _U)


class Sketcher:
    """MinHash samples of a set, their band keys and their odd sketch."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 7):
        k = bands * rows
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.a = (rng.integers(0, 1 << 63, k).astype(_U) * _U(2) + _U(1))[:, None]
        self.b = rng.integers(0, 1 << 63, k).astype(_U)[:, None]
        self.nth = mix(np.arange(1, k + 1, dtype=_U))
        self.band = mix(np.arange(1, bands + 1, dtype=_U) + _U(1 << 20))
        self.mult = mix(np.arange(1, rows + 1, dtype=_U) + _U(1 << 21)) | _U(1)

    def samples(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(_U).max, _U)
        for i in range(0, len(s), 512):
            np.minimum(out, (s[i : i + 512] * self.a + self.b).min(axis=1), out=out)
        return out

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = mix(self.samples(s))
        keys = mix((low.reshape(self.bands, self.rows) * self.mult).sum(axis=1, dtype=_U) + self.band)
        bit = (mix(low + self.nth) % _U(self.bits)).astype(np.int64)
        parity = np.bincount(bit, minlength=self.bits) & 1
        odd = np.packbits(parity.astype(np.uint8)).view(_U)
        return keys.view(np.int64), odd.view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, set size, digest of the word sequence, band keys and odd sketch of each row."""

    def run(batches):
        make = Sketcher(bands, rows, bits)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in pieces(batch.column(1)):
                n, digest, keys, odd = [], [], [], []
                raw = buf.tobytes()
                for s, a, b in zip(shingle_sets(buf, off), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() if len(s) else None)
                    k, o = make(s) if len(s) else ([], [])
                    keys.append(k)
                    odd.append(o)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, odd)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists], names=["doc_id", "n_shingles", "digest", "bands", "odd"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCHEMA)


def estimate(odd_a: str, odd_b: str, samples: int, bits: int):
    """Similarity that two odd sketches tell: 1 + n/(4k) ln(1 - 2d/n)."""
    rest = F.greatest(1 - 2 * differing(odd_a, odd_b) / F.lit(float(bits)), F.lit(1e-9))
    return 1 + F.lit(bits / (4.0 * samples)) * F.log(rest)


class _Ids(dict):
    """A number of its own, from 1 on, for each word that is looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, and for no others; a and b are below 2**32."""
    return np.unique(a.astype(_U) << _U(32) | b.astype(_U), return_inverse=True)[1].reshape(-1)


def exact_links(left: list[bytes], right: list[bytes], percent: int, size: int = 5) -> np.ndarray:
    """Whether 100 * intersection >= percent * union for the shingle sets of left[i] and right[i], word by word.

    Words become numbers by their bytes and shingles numbers by the words, so nothing rests
    on a hash.  A sequence of fewer words than a shingle is one, with zeros for the rest.
    """
    ids = _Ids()
    words = [t.lower().split() for pair in zip(left, right, strict=True) for t in pair]
    n = np.array([len(w) for w in words], np.int64)
    kept = np.where(n >= size, n, np.where(n > 0, size, 0))  # with the zeros
    start = np.cumsum(kept) - kept
    seq = np.zeros(int(kept.sum()) + size, np.int64)
    flat = np.fromiter((ids[x] for w in words for x in w), np.int64, int(n.sum()))
    seq[np.arange(len(flat)) + np.repeat(start - (np.cumsum(n) - n), n)] = flat
    number, k = seq, 1
    while 2 * k <= size:
        number = _numbers(number[: len(number) - k], number[k:])
        k *= 2
    for j in range(k, size):
        number = _numbers(number[: len(seq) - j], seq[j:])
    count = np.where(kept > 0, kept - size + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) + np.repeat(start - (np.cumsum(count) - count), count)
    sets = np.unique((text << 32) | number[at])  # a batch has fewer than 2**31 texts and 2**32 shingles
    text, shingle = sets >> 32, sets & 0xFFFFFFFF
    of = np.bincount(text, minlength=len(n)).reshape(-1, 2)
    pair = np.sort((text >> 1) << 32 | shingle)
    both = np.bincount(pair[1:][pair[1:] == pair[:-1]] >> 32, minlength=len(of))
    return (both > 0) & (100 * both >= percent * (of.sum(axis=1) - both))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lo = 0
            done = np.cumsum(np.diff(buffers(left)[1]) + np.diff(buffers(right)[1]))
            while lo < len(done):
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PIECE, "right")))
                keep = exact_links(left.slice(lo, hi - lo).to_pylist(), right.slice(lo, hi - lo).to_pylist(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)], names=["a", "b"]).filter(pa.array(keep))
                lo = hi

    ta, tb = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    met = pairs.join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(run, "a long, b long").distinct()


def full_sketches(texts: DataFrame, bits: int) -> DataFrame:
    """(doc_id, n, parity): size and odd sketch of the full set of each text(doc_id, text); null for ids whose texts differ in them."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                n, parity = [], []
                for s in shingle_sets(buf, off):
                    n.append(len(s))
                    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(parity, pa.list_(pa.int64()))], names=["doc_id", "n", "parity"])

    one = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, parity array<long>").select("doc_id", F.struct("n", "parity").alias("w"))
    one = one.groupBy("doc_id").agg(F.min("w").alias("w"), F.max("w").alias("w_max"))
    same = F.col("w") == F.col("w_max")
    return one.select("doc_id", F.when(same, F.col("w.n")).alias("n"), F.when(same, F.col("w.parity")).alias("parity"))


def differing(odd_a: str, odd_b: str):
    """Population count of the XOR of two odd sketches."""
    return F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def lone_shingles(texts: DataFrame) -> DataFrame:
    """(doc_id, lone): how many shingles of each text(doc_id, text) no other of these texts has; texts without any are missing."""

    def run(batches):
        for batch in batches:
            for lo, _, buf, off in pieces(batch.column(1)):
                for k, s in enumerate(shingle_sets(buf, off), lo):
                    for i in range(0, len(s), 1 << 16):
                        part = pa.array(s[i : i + (1 << 16)].view(np.int64))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(part), k))), part], names=["doc_id", "shingle"])

    one = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    return one.where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lone"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b): alternating large and small stars.

    Each round is two aggregations with map-side combining and two joins; a node with
    any number of neighbours is never gathered.  Rounds stop when a round changes nothing.
    """
    e = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before, old = None, None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old is not None:
            release(*old)
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        met = large.join(low, F.col("u") == F.col("x"))
        old = (e, large)
        e = materialize(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("x", "m")).distinct(), "small-star")


def near_dedup(docs: DataFrame, percent: int = 75, bands: int = 32, rows: int = 4, bits: int = 512, min_estimate: float = 0.5, full_bits: int = 2048) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept.

    A text is lower-cased (A-Z) and cut into words at ASCII white space; its set is the
    distinct 5-word shingles, or its whole word sequence if shorter.  Null, empty and
    blank texts have an empty set, n_shingles 0, and are linked with nothing.  Rows with
    the same doc_id are one node.  A row with a null doc_id can't be named: it is linked
    with nothing, has a null component_id and stays.  Other columns are ignored.
    """
    sk = materialize(sketches(docs, bands, rows, bits), "sketches")
    full = sk.where("n_shingles > 0 and doc_id is not null")
    sets = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    member = join_counted(full.select("doc_id", "n_shingles", "digest"), sets, ["digest"], "copies", sk.count()).select("doc_id", "n_shingles", "rep")
    # repeated doc_ids: all texts of one id belong to one node
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    node = join_counted(full.select("digest", "doc_id", "bands", "odd"), sets, ["digest"], "copies", sk.count()).where("doc_id = rep")
    node = node.select("doc_id", "bands", "odd").dropDuplicates(["doc_id", "odd"])
    node = materialize(node, "nodes")
    entry = node.select(F.explode("bands").alias("key"), "doc_id")
    bucket = entry.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").select("key", "pivot")
    shared = materialize(entry.join(bucket, "key"), "buckets")
    sketch = node.select("doc_id", "odd")

    def likely(pairs: DataFrame) -> DataFrame:
        oa, ob = (sketch.select(F.col("doc_id").alias(k), F.col("odd").alias(f"odd_{k}")) for k in "ab")
        return pairs.join(oa.hint("merge"), "a").join(ob.hint("merge"), "b").where(estimate("odd_a", "odd_b", bands * rows, bits) >= min_estimate).select("a", "b").distinct()

    star = materialize(likely(shared.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()), "stars")
    nodes_in_buckets = star.select(F.col("a").alias("doc_id")).union(star.select("b")).union(shared.select("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = materialize(texts.join(nodes_in_buckets.hint("merge"), "doc_id", "left_semi"), "texts")
    links = materialize(confirm(star, texts, percent), "star-links")
    label = components(links)

    # Buckets that hold several components: nodes outside the pivot's component against the rest.
    lab = label.withColumnRenamed("node", "doc_id")
    tagged = shared.join(lab, "doc_id", "left").select("key", "pivot", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    mixed = tagged.groupBy("key").agg(F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.max(F.when(F.col("doc_id") == F.col("pivot"), F.col("c"))).alias("c_pivot"), F.count(F.lit(1)).alias("n")).where("c_min <> c_max and n > 2")
    tagged = materialize(tagged.join(mixed.select("key", "c_pivot"), "key").where("doc_id <> pivot"), "mixed-buckets")
    met = tagged.select("doc_id").distinct()
    met_texts = materialize(texts.join(met.hint("merge"), "doc_id", "left_semi"), "met-texts")
    lone = lone_shingles(met_texts)
    size = full.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")).join(lone, "doc_id")
    size = size.select("doc_id", "n", (F.col("n") - F.when(F.col("rows") == 1, F.col("lone")).otherwise(0)).alias("common"))
    # nodes without lone shingles are missing in ``size``; their bound is their own size
    size = met.join(size, "doc_id", "left").join(full.groupBy("doc_id").agg(F.max("n_shingles").alias("n0")), "doc_id")
    size = materialize(size.select("doc_id", F.col("n0").alias("n"), F.coalesce("common", "n0").alias("common")).where(100 * F.col("common") >= percent * F.col("n0")), "bounds")
    # A pair is looked at in the first band that it shares only, and by its sketches there; ids with several sets (null here) in every band.
    own = node.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    own = own.select("doc_id", *[F.when(F.col("sets") == 1, F.col(c)).alias(c) for c in ("bands", "odd")])
    whole = full_sketches(met_texts.join(size.select("doc_id"), "doc_id", "left_semi"), full_bits)
    own = materialize(own.join(whole.withColumnRenamed("n", "set_size"), "doc_id"), "met-sketches")
    tagged = tagged.join(size.hint("merge"), "doc_id").join(own.hint("merge"), "doc_id")
    out = tagged.where("c <> c_pivot").select("key", F.col("doc_id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("common").alias("mx"), *[F.col(k).alias(f"{k}_x") for k in ("bands", "odd", "set_size", "parity")])
    rest = out.join(tagged.select("key", F.col("doc_id").alias("y"), F.col("c").alias("cy"), "c_pivot", F.col("n").alias("ny"), F.col("common").alias("my"), *[F.col(k).alias(f"{k}_y") for k in ("bands", "odd", "set_size", "parity")]), "key")
    most = F.least("mx", "my")
    first = F.get(F.array_compact(F.zip_with("bands_x", "bands_y", lambda p, q: F.when(p == q, p))), F.lit(0)) == F.col("key")
    near = estimate("odd_x", "odd_y", bands * rows, bits) >= min_estimate
    # the difference of two sets of the threshold's similarity is this part of both sizes at most
    close = (100 + percent) * differing("parity_x", "parity_y") <= (100 - percent) * (F.col("set_size_x") + F.col("set_size_y"))
    rest = rest.where(F.expr("cx <> cy and (cy = c_pivot or x < y)") & (100 * most >= percent * (F.col("nx") + F.col("ny") - most)) & F.coalesce(first & near, F.lit(True)) & F.coalesce(close, F.lit(True)))
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = materialize(confirm(likely(rest), texts, percent), "rest-links")
    if not more.isEmpty() or not same.join(node.select("doc_id").distinct(), F.col("a") == F.col("doc_id"), "left_semi").isEmpty():
        label = components(links.union(more).union(same.join(node.select("doc_id").distinct(), F.col("a") == F.col("doc_id"), "left_semi")))
    label = label.withColumnRenamed("node", "rep")
    named = member.join(label, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    single = sk.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(single).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def ctes(docs: str, out: str) -> str:
    """SQL: CTEs that end with ``out``(doc_id, n_shingles, component_id, kept) of ``docs``: all pairs that share a shingle, so for small tables only."""
    return rf"""{out}_w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
{out}_s AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM {out}_w)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM {out}_w WHERE len(w) BETWEEN 1 AND 4)),
{out}_n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM {out}_s GROUP BY doc_id),
{out}_pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM {out}_s x JOIN {out}_s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
{out}_links AS MATERIALIZED (SELECT a, b FROM {out}_pairs JOIN {out}_n x ON x.doc_id = a JOIN {out}_n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
{out}_reach AS (SELECT doc_id, doc_id AS root FROM {docs} UNION SELECT b, root FROM {out}_reach JOIN {out}_links ON a = doc_id),
{out} AS MATERIALIZED (SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM {out}_reach r LEFT JOIN {out}_n n ON n.doc_id = r.doc_id GROUP BY r.doc_id)"""


#: DuckDB SQL for the query's rows.
ORACLE = f"WITH RECURSIVE {ctes('documents', 'near')} SELECT * FROM near"
