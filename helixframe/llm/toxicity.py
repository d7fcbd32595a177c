"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features are the distinct unigrams, bigrams and skip-bigrams (one word between) of a
text, hashed to 2**20 coordinates.  FTRL-proximal keeps a learning rate for each
coordinate; its L1 term leaves most weights at exactly zero, so that the model sent to
the executors is a short list of (coordinate, weight), at most 2**20 of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import PIECE, _IS_WS, _LOWER_TABLE, materialize, mix, pieces, prefix_hash, range_hash, unit_hash

_U = np.uint64
_BITS = 20
_ALNUM = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every n-gram occurrence; words are runs of letters, digits and bytes over 127."""
    w = _ALNUM[buf] & ~_IS_WS[buf]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    first[inner], last[inner - 1] = w[inner], w[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = range_hash(prefix_hash(buf, _LOWER_TABLE), starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    docs, coords = [text], [words]
    for gap, mult in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        docs.append(text[gap:][same])
        coords.append((words[:-gap] * _U(mult) + words[gap:])[same] if len(text) > gap else np.zeros(0, _U))
    return np.concatenate(docs), (mix(np.concatenate(coords)) >> _U(64 - _BITS)).astype(np.int64)


def ftrl(examples: list[np.ndarray], labels: list[int], alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 8, positive: float = 3.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over sparse binary examples: the coordinates with weights, the weights, the bias.

    Examples of label 1 count ``positive`` times, as they are rare.
    """
    z, n = np.zeros(1 << _BITS), np.zeros(1 << _BITS)
    zb = nb = bias = 0.0
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx = examples[k]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            bias = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - labels[k]) * (positive if labels[k] else 1.0)
            root = np.sqrt(ni + g * g)
            z[idx] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at], float(-zb / ((beta + nb**0.5) / alpha))


def held_out(doc_id, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int, max_bytes: int) -> list[tuple[str, int]]:
    """The training sample: texts and labels of the ids with the smallest hashes, within both bounds, in that order.

    An id has one text, the smallest if there are several, and its largest label.  The share
    of ids that is looked at holds more than ``max_rows`` and far fewer than all.
    """
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    lab = lab.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic")).withColumn("h", unit_hash(F.col("label_id")))
    lab = materialize(lab.where(F.col("h") < 1.25 * max_rows / max(lab.count(), 1)), "toxic-labels")
    got = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(lab), F.col("doc_id") == F.col("label_id"))
    got = materialize(got.groupBy("h", "label_id", "toxic").agg(F.min("text").alias("text")), "toxic-texts")
    sizes = sorted(map(tuple, got.select("h", "label_id", F.octet_length("text")).collect()))[:max_rows]
    used = np.cumsum([x[2] for x in sizes]) <= max_bytes
    last = int(used.sum()) - 1
    if last < 0:
        return []
    inside = (F.col("h") < sizes[last][0]) | ((F.col("h") == sizes[last][0]) & (F.col("label_id") <= sizes[last][1]))
    return [(r[2], int(r[3] > 0)) for r in sorted(got.where(inside).select("h", "label_id", "text", "toxic").collect())]


def train(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the sample."""
    examples, y = [], []
    for text, toxic in sample(docs, labels, max_rows, max_chars, max_bytes):
        b = np.frombuffer(text.encode(), np.uint8)
        examples.append(np.unique(features(b, np.array([0, len(b)]))[1]).astype(np.int32))
        y.append(toxic)
    return ftrl(examples, y)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_chars: int = 50_000, max_bytes: int = 128 << 20) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, held_out, score, predicted.

    Trained on ``labels(doc_id, toxic)`` of rows whose crc32(doc_id as text) mod 5 is not
    0, on the at most ``max_rows`` labelled ids with the smallest hashes whose texts, of at
    most ``max_chars`` characters each, have at most ``max_bytes`` bytes together, so that the
    same tables always give the same scores.  Every whole text is scored; null and empty
    texts get the score of the bias.  Several labels of one id count as the largest, several
    texts as the smallest; null labels are left out; without labels every score is 0.5 and
    predicted 1.  held_out is false for a null doc_id.  Repeated rows are scored each; an
    empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    at, w, bias = train(docs, labels, max_rows, max_chars, max_bytes)

    def run(batches):
        table = np.zeros(1 << _BITS, np.float64)
        table[at] = w
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1), PIECE):
                text, coord = features(buf, off) if len(buf) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                hit = table[coord] != 0
                once = np.unique((text[hit] << _BITS) | coord[hit])
                total = np.bincount(once >> _BITS, weights=table[once & ((1 << _BITS) - 1)], minlength=hi - lo) + bias
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
