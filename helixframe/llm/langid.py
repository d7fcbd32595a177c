"""Language identification of code-switched text: a linear-chain conditional random field.

The sequence is a whole text; a word's label is its language.  Emission features of a word: affixes, character n-grams and lexicon entries, hashed to
2**15 coordinates; transitions between languages are learned too.  Training maximises
the conditional likelihood by Adam over forward-backward expectations, on windows of
single languages and on windows spliced from two, so that switches are seen.

Texts are cut into windows so that numpy can step through many at once, but inference runs
over the whole chain: the product of a window's step matrices carries the messages of
both directions over it, so that every word's marginal depends on the whole text.  The
words' most likely languages give spans; a text's prediction is the language with the
largest sum of word marginals, and the score is that sum's part of all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import pieces, unit_hash

_F = 1 << 15
_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+")


def word_features(word: bytes, lexicon: dict[bytes, list[int]]) -> list[int]:
    w = word.decode("utf-8", "replace").lower()
    s = f"^{w}$"
    out = [f"w{w}"]
    out += [f"p{w[:k]}" for k in (1, 2, 3) if len(w) > k] + [f"s{w[-k:]}" for k in (1, 2, 3) if len(w) > k]
    out += [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)]
    out += [f"lexicon {k}" for k in lexicon.get(w.encode(), ())]
    return [zlib.crc32(f.encode()) & (_F - 1) for f in out]


def forward_backward(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (windows, words, labels), expected transition counts and first-word marginals.

    e: scores of windows sorted by falling length, padded; probabilities are rescaled at
    every word.
    """
    n, t_max, k = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    tr, st = np.exp(trans - trans.max()), np.exp(start - start.max())
    alive = np.searchsorted(-lens, -np.arange(1, t_max + 1), "right")
    alpha = np.zeros_like(p)
    alpha[:, 0] = p[:, 0] * st
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        m = alive[t]
        a = (alpha[:m, t - 1] @ tr) * p[:m, t]
        alpha[:m, t] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((n, k))
    count = np.zeros((k, k))
    gamma = alpha
    for t in range(t_max - 1, 0, -1):
        m = alive[t]
        b = p[:m, t] * beta[:m]
        now = b @ tr.T
        now /= now.sum(axis=1, keepdims=True)
        w = (alpha[:m, t - 1] * (b @ tr.T)).sum(axis=1)
        count += ((alpha[:m, t - 1] / w[:, None]).T @ b) * tr
        g = gamma[:m, t] * beta[:m]
        gamma[:m, t] = g / g.sum(axis=1, keepdims=True)
        beta[:m] = now
    g = gamma[:, 0] * beta
    gamma[:, 0] = g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
    return gamma, count, gamma[:, 0].sum(axis=0)


class Model:
    def __init__(self, langs: list[str], lexicon: dict[bytes, list[int]], w: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.langs, self.lexicon, self.w, self.trans, self.start = langs, lexicon, w, trans, start


def fit(samples: list[tuple[str, bytes]], langs: list[str], window: int = 32, per_text: int = 4, epochs: int = 4, batch: int = 128, rate: float = 0.05, lexicon_size: int = 1000, seed: int = 5) -> Model:
    """Fit on (language, text) samples; of each text ``per_text`` windows spread over the whole text."""
    rng = np.random.default_rng(seed)
    of = {x: i for i, x in enumerate(langs)}
    k = len(langs)
    by: list[list[list[bytes]]] = [[] for _ in langs]
    seen = [Counter() for _ in langs]
    for lang, text in samples:
        words = _WORDS.findall(text)
        last = max(len(words) - window, 0)
        for at in sorted({round(last * (i + 0.5) / per_text) for i in range(per_text)}):
            part = words[at : at + window]
            if part:
                by[of[lang]].append(part)
                seen[of[lang]].update(x.decode("utf-8", "replace").lower().encode() for x in part)
    lexicon: dict[bytes, list[int]] = {}
    for i, c in enumerate(seen):
        for x, _ in c.most_common(lexicon_size):
            lexicon.setdefault(x, []).append(i)
    seqs: list[tuple[list[bytes], list[int]]] = []
    for i, parts in enumerate(by):
        seqs += [(p, [i] * len(p)) for p in parts]
    full = [i for i in range(k) if by[i]]
    if len(full) > 1:
        for _ in range(len(seqs) // 2):
            i, j = rng.choice(full, 2, replace=False)
            a, b = (by[x][rng.integers(len(by[x]))] for x in (i, j))
            cut, size = rng.integers(1, window), rng.integers(4, window)
            c = a[cut : cut + size]
            both = a[:cut] + b[:size] + c
            lab = [i] * len(a[:cut]) + [j] * len(b[:size]) + [i] * len(c)
            seqs.append((both[:window], lab[:window]))
    vocab: dict[bytes, int] = {}
    for words, _ in seqs:
        for x in words:
            vocab.setdefault(x, len(vocab))
    feats = [word_features(x, lexicon) for x in vocab]
    size = np.array([len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats]) if feats else np.zeros(0, int)
    begin = np.concatenate([[0], np.cumsum(size)])
    theta = np.zeros(_F * k + k * k + k)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    step = 0
    for _ in range(epochs if k > 1 else 0):
        order = rng.permutation(len(seqs))
        for lo in range(0, len(order), batch):
            part = sorted((seqs[i] for i in order[lo : lo + batch]), key=lambda s: -len(s[0]))
            lens = np.array([len(s[0]) for s in part])
            ids = np.zeros((len(part), lens[0]), int)
            gold = np.zeros((len(part), lens[0]), int)
            mask = np.arange(lens[0]) < lens[:, None]
            ids[mask] = [vocab[x] for s in part for x in s[0]]
            gold[mask] = [y for s in part for y in s[1]]
            uniq, inv = np.unique(ids[mask], return_inverse=True)
            rows = np.concatenate([flat[begin[u] : begin[u + 1]] for u in uniq])
            reps = np.repeat(np.arange(len(uniq)), size[uniq])
            w = theta[: _F * k].reshape(_F, k)
            emit = np.add.reduceat(w[rows], np.concatenate([[0], np.cumsum(size[uniq])[:-1]]))
            e = np.zeros((*ids.shape, k))
            e[mask] = emit[inv]
            trans, start = theta[_F * k : -k].reshape(k, k), theta[-k:]
            gamma, count, first = forward_backward(e, lens, trans, start)
            delta = gamma[mask]
            delta[np.arange(len(delta)), gold[mask]] -= 1
            du = np.stack([np.bincount(inv, delta[:, c], len(uniq)) for c in range(k)], 1)
            grad = np.zeros_like(theta)
            grad[: _F * k] = np.stack([np.bincount(rows, du[reps, c], _F) for c in range(k)], 1).reshape(-1)
            pair = mask[:, 1:]
            seen_t = np.bincount(gold[:, :-1][pair] * k + gold[:, 1:][pair], minlength=k * k).reshape(k, k)
            grad[_F * k : -k] = (count - seen_t).reshape(-1)
            grad[-k:] = first - np.bincount(gold[:, 0], minlength=k)
            grad = grad / len(part) + 1e-4 * theta
            step += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(langs, lexicon, theta[: _F * k].reshape(_F, k).astype(np.float32), theta[_F * k : -k].reshape(k, k), theta[-k:])


class Emissions(dict):
    """Row of the emission matrix for each word, made at its first use; starts anew beyond ``most`` words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.rows = np.zeros((1024, len(model.langs)), np.float32)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.model.w[word_features(word, self.model.lexicon)].sum(axis=0)
        self[word] = i
        return i

    def lookup(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[ids]


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what _WORDS finds in each text."""
    w = _IN_WORD[buf]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    first[inner], last[inner - 1] = w[inner], w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def carried(p: np.ndarray, lens: np.ndarray, text: np.ndarray, nth: np.ndarray, tr: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What windows nth of texts receive from both sides: weights of the first label, and messages behind the last word.

    The matrix of a window, diag(p0) tr diag(p1) tr diag(p2) ..., is formed for all windows at
    once; then the windows of a text are run through one by one.  lens falls.
    """
    n, _, k = p.shape
    before, behind = np.tile(st, (n, 1)), np.ones((n, k))
    more = np.bincount(text, minlength=1)[text] > 1
    if not more.any():
        return before, behind
    own = np.flatnonzero(more)
    q, ln = p[own], lens[own]
    alive = np.searchsorted(-ln, -np.arange(1, int(ln[0]) + 1), "right")
    m = np.zeros((len(own), k, k))
    m[:, range(k), range(k)] = q[:, 0]
    for t in range(1, int(ln[0])):
        a = alive[t]
        x = (m[:a].reshape(-1, k) @ tr).reshape(a, k, k) * q[:a, t][:, None, :]
        m[:a] = x / x.max(axis=(1, 2), keepdims=True) if t % 8 == 0 else x
    m /= np.maximum(m.max(axis=(1, 2), keepdims=True), 1e-300)
    order = np.lexsort((nth[own], text[own]))
    at = nth[own][order]
    for w in range(1, int(at.max()) + 1):
        i = np.flatnonzero(at == w)  # the window before stands just before it in this order
        x = np.einsum("ni,nij->nj", before[own[order[i - 1]]], m[order[i - 1]]) @ tr
        before[own[order[i]]] = x / x.sum(axis=1, keepdims=True)
        i = np.flatnonzero(at == int(at.max()) + 1 - w)
        x = np.einsum("nij,nj->ni", m[order[i]], behind[own[order[i]]]) @ tr.T
        behind[own[order[i - 1]]] = x / x.sum(axis=1, keepdims=True)
    return before, behind


def posterior(p: np.ndarray, lens: np.ndarray, tr: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Word marginals of windows (by falling length) with what they receive from both sides; p is positive."""
    alive = np.searchsorted(-lens, -np.arange(1, p.shape[1] + 1), "right")
    alpha = np.zeros_like(p)
    a = p[:, 0] * before
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, p.shape[1]):
        m = alive[t]
        a = (alpha[:m, t - 1] @ tr) * p[:m, t]
        alpha[:m, t] = a / a.sum(axis=1, keepdims=True)
    beta = behind.copy()
    for t in range(p.shape[1] - 1, 0, -1):
        m = alive[t]
        b = p[:m, t] * beta[:m]
        alpha[:m, t] *= beta[:m]
        b = b @ tr.T
        beta[:m] = b / b.sum(axis=1, keepdims=True)
    alpha[:, 0] *= beta
    return alpha / np.maximum(alpha.sum(axis=2, keepdims=True), 1e-300)


def marginals(e: np.ndarray, n: np.ndarray, trans: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Marginals of every word of texts of n words each, whose scores follow each other in e."""
    k = e.shape[1]
    out = np.zeros((len(e), k))
    tr, st = np.exp(trans - trans.max()), np.exp(start - start.max())
    wins = -(-n // window)
    text = np.repeat(np.arange(len(n)), wins)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(wins) - wins, wins)
    first = (np.cumsum(n) - n)[text] + nth * window
    lens = np.minimum(window, n[text] - nth * window)
    scaled = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    # whole texts together, about 1024 windows a turn, more only for a text that alone has more
    cut = np.searchsorted(np.cumsum(wins), np.arange(1024, int(wins.sum()) + 1024, 1024), "left") + 1
    lo = 0
    for hi in np.unique(np.minimum(cut, len(n))).tolist():
        mine = np.flatnonzero((text >= lo) & (text < hi))
        lo = hi
        if not len(mine):
            continue
        mine = mine[np.argsort(-lens[mine], kind="stable")]
        ln, f = lens[mine], first[mine]
        mask = np.arange(ln[0]) < ln[:, None]
        place = (f[:, None] + np.arange(ln[0]))[mask]
        p = np.ones((len(ln), ln[0], k))
        p[mask] = scaled[place]
        before, behind = carried(p, ln, text[mine] - text[mine].min(), nth[mine], tr, st)
        for i in range(0, len(ln), 1024):
            part = slice(i, i + 1024)
            width = int(ln[i])
            out[place_of(mask, part, place)] = posterior(p[part, :width], ln[part], tr, before[part], behind[part])[mask[part, :width]]
    return out


def place_of(mask: np.ndarray, part: slice, place: np.ndarray) -> np.ndarray:
    """The places of the words of some rows of ``mask``."""
    count = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    return place[count[part.start] : count[min(part.stop, len(mask))]]


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int, max_chars: int, max_bytes: int, max_langs: int) -> Model | None:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).where(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return None
    part = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("lang") == lang, F.lit(2 * per_lang / n)).otherwise(part)
    # the smallest hashes of each language; a wide enough share of them first, repeated rows once
    hash_ = unit_hash(F.concat_ws(" ", "doc_id", "text"))
    some = known.withColumn("h", hash_).where(F.col("h") < part).distinct()
    by_hash = Window.partitionBy("lang").orderBy("h", F.col("doc_id").asc_nulls_first(), "text")
    some = some.withColumn("nth", F.row_number().over(by_hash)).withColumn("bytes", F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    got = some.where((F.col("nth") <= per_lang) & (F.col("bytes") <= max_bytes // len(counts))).select("lang", "nth", "text").collect()
    return fit([(r[0], r[2].encode()) for r in sorted(got)], sorted(counts))


_ROWS = "doc_id long, lang_pred string, score double, letter boolean, langs array<string>, starts array<long>, ends array<long>"


def identify(docs: DataFrame, per_lang: int = 400, max_chars: int = 50_000, max_bytes: int = 64 << 20, max_langs: int = 200, window: int = 128) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang, ...)``: doc_id, held_out, lang_pred, score, langs, starts, ends.

    Learned from text and non-null lang of rows whose crc32(doc_id as text) mod 4 is not
    2, on the at most ``per_lang`` texts of each language with the smallest hashes, of at most
    ``max_chars`` characters each and ``max_bytes`` bytes in all; of a text, four windows of
    32 words are learned.  Every whole text is labelled word by word; ``langs``, ``starts``
    and ``ends`` (in code points, end exclusive) are the runs of words with one most likely
    language.  ``window`` only tells how many words numpy steps through, not the result.
    Null texts and texts without a letter are ``und`` with score 0 and no spans, as are all
    texts if nothing could be learned.  held_out is false for a null doc_id.  Repeated rows
    are labelled each; an empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    model = train(docs, per_lang, max_chars, max_bytes, max_langs)

    def run(batches):
        cache = Emissions(model) if model else None
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1), 1 << 20):
                raw = buf.tobytes()
                words = [_WORDS.findall(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] if model else [[] for _ in range(hi - lo)]
                n = np.array([len(w) for w in words], np.int64)
                k = len(model.langs) if model else 1
                gamma = marginals(cache.lookup([x for w in words for x in w]).astype(np.float64), n, model.trans, model.start, window) if n.sum() else np.zeros((0, k))
                text = np.repeat(np.arange(len(n)), n)
                total = np.stack([np.bincount(text, gamma[:, c], len(n)) for c in range(k)], 1)
                best = total.argmax(axis=1)
                score = total[np.arange(len(n)), best] / np.maximum(total.sum(axis=1), 1e-9)
                names = np.array(model.langs if model else ["und"], object)
                label = gamma.argmax(axis=1)
                new = np.ones(len(text), bool)
                new[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                begin, end = word_places(buf, off) if len(text) else (np.zeros(0, np.int64),) * 2
                base = char[off[text[head]]]
                runs = np.searchsorted(text[head], np.arange(len(n) + 1)).astype(np.int32)
                ends = char[end[np.append(head[1:], len(text))[: len(head)] - 1]] - base
                lists = [pa.ListArray.from_arrays(pa.array(runs), x) for x in (pa.array(names[label[head]], pa.string()), pa.array(char[begin[head]] - base), pa.array(ends))]
                lang = np.where(n > 0, names[best], "und")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0)), batch.column(2).slice(lo, hi - lo), *lists], names=["doc_id", "lang_pred", "score", "letter", "langs", "starts", "ends"])

    letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("bytes"), letter.alias("letter"))
    out = rows.mapInArrow(run, _ROWS)
    own = lambda c, other: F.when(F.col("letter"), F.col(c)).otherwise(other).alias(c)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), own("lang_pred", F.lit("und")), own("score", F.lit(0.0)), own("langs", none("string")), own("starts", none("bigint")), own("ends", none("bigint")))


def language_digest(docs: DataFrame) -> DataFrame:
    """The rows of query op2, and behind them the language spans as lang:start:end."""
    found = identify(docs)
    spans = F.transform(F.arrays_zip("langs", "starts", "ends"), lambda x: F.concat_ws(":", x["langs"], x["starts"].cast("string"), x["ends"].cast("string")))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join(spans, ",").alias("spans"))
