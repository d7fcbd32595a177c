"""The corpus operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, langid, longmatch, mixing, near_dedup, packing, quality, secrets, toxicity, warc
from helixframe.llm.common import join_counted, materialize

SF = "/root/testdata/sf0.001"
RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string"


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edited(text, every):
    w = text.split(" ")
    return " ".join("edit" + str(RNG.randrange(10**6)) if i % every == 7 else x for i, x in enumerate(w))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = [prose(120) for _ in range(6)]
    out = [*base, base[0], base[0].upper(), "", None, " \t\n", "one two", "one two", "é", prose(4)]
    out += [edited(base[1], e) for e in (200, 60, 40, 25, 15, 8) for _ in range(4)]
    out += [base[2] + "\n" + base[3], base[3] + base[3], "x" * 5000, prose(3000)]
    return out


def test_near_dedup(spark, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r for r in near_dedup.near_dedup(table(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_dedup_ids(spark):
    got = near_dedup.near_dedup(table(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z"], [None, 5, 5, 3])).collect()
    assert len(got) == 4 and {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (5, 5, True), (3, 3, True)}
    assert near_dedup.near_dedup(table(spark, [])).count() == 0


def test_near_dedup_loose_copies(spark):
    """Copies edited at random places: many pairs lie just below and just above the threshold."""
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(f"e{RNG.randrange(10**6)}" if RNG.random() < p else w for w in base) for p in (0.012, 0.02, 0.028, 0.035, 0.045) for _ in range(24)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    comp = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if linked(sets[a], sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    assert 1 < len(set(comp)) < len(comp)
    order = RNG.sample(range(len(texts)), len(texts))
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(table(spark, [texts[i] for i in order], order)).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_near_dedup_of_colliding_words(spark):
    """Words that every polynomial modulo 2^64 maps to one hash, and words beyond the table of places."""
    tm = ["".join("ab"[x] for x in thue_morse(n)) for n in (1024, 4096)]
    texts = [*tm, *("".join("ba"["ab".index(c)] for c in t) for t in tm), "x" * 200 + "y" + "x" * 5000, "x" * 5000 + "y" + "x" * 200, "q " * 30, "q " * 31, "Q q q q q q"]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_dedup(table(spark, texts)).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (6, 1), 8: (6, 1)}


def test_exact_links():
    pairs = [(prose(RNG.randrange(0, 12)), None) for _ in range(200)]
    pairs = [(a, a if RNG.random() < 0.2 else edited(a, 9) if RNG.random() < 0.5 else prose(RNG.randrange(0, 8)) + " " + a) for a, _ in pairs] + [("", ""), ("a", "a"), ("a b", "a b c"), ("A\tb", "a b")]
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := t.lower().split()) > 4 else {tuple(w)} - {()}
    got = near_dedup.exact_links([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], 75)
    want = [bool(x & y) and 100 * len(x & y) >= 75 * len(x | y) for x, y in ((sets(a), sets(b)) for a, b in pairs)]
    assert got.tolist() == want and 20 < sum(want) < 200


def test_full_sketches_bound_the_difference(spark):
    rows = [prose(60), prose(60), "", "one two", prose(4000), prose(4000)]
    got = {r.doc_id: r for r in near_dedup.full_sketches(table(spark, [*rows, rows[0], rows[1], rows[2]], [*range(6), 0, 7, 7]).withColumn("text", F.col("text").cast("binary")), 2048).collect()}
    assert got[7].n is None and got[7].parity is None and got[0].n == 56 and got[2].n == 0
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for w in (t.split() for t in rows)]
    for i, j in itertools.combinations(range(6), 2):
        d = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(got[i].parity, got[j].parity, strict=True))
        assert d <= len(sets[i] ^ sets[j])
        assert d >= 0.9 * len(sets[i] ^ sets[j]) or len(sets[i] ^ sets[j]) > 400


def test_odd_sketch_estimates():
    make = near_dedup.Sketcher(32, 4, 512)
    import numpy as np

    a = near_dedup.mix(np.arange(1, 401, dtype=np.uint64))
    b = near_dedup.mix(np.arange(41, 441, dtype=np.uint64))
    d = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in make(a)[1] ^ make(b)[1])
    assert abs(1 + 512 / (4 * 128) * np.log(1 - 2 * d / 512) - 360 / 440) < 0.12


def test_exact_dedup(spark, texts):
    ids = [*range(len(texts)), None, 0]
    more = [*texts, texts[0], texts[0].replace(" ", " \t ", 3)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in more]
    got = exact_dedup.exact_dedup(table(spark, more, ids)).collect()
    size = Counter(norm)
    low = {n: min(i for i, m in zip(ids, norm, strict=True) if m == n and i is not None) for n in norm}
    want = Counter((i, low[n], size[n], i == low[n], hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm, strict=True))
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def plain_bad(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n, low = len(words), line.lower()
    marks = sum(any(c in "#*$%&|<>" for c in w) or any(x in "!?" and y in "!?" for x, y in itertools.pairwise(w)) for w in words)
    bars = sum(w in list("|>»›·•") for w in words)
    notices = len(re.findall(quality.NOTICE, low))
    end = line.rstrip(" \t\n\x0b\x0c\r")[-1:] in list(".!?:;\"')]…”’»")
    return (n < 5 and not end) or (marks >= 3 and 100 * marks > 30 * n) or (bars >= 3 and 200 * bars > 30 * n) or 1000 * notices > 30 * n or bool(re.search(quality.MENU.replace("\\z", "\\Z"), low))


def plain_quality(text):
    """(kept, clean text) by plain loops."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
    bad = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x) and plain_bad(x)]
    lost = sum(len(x) for x in re.findall(r"[^\x20\x09-\x0D]+", "\n".join(bad)))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return not failed and 100 * lost <= 50 * sum(map(len, w)), "\n".join(x for x in t.split("\n") if x not in bad), lost, len(hit)


def test_quality(spark, texts):
    repeated = "a b c d e f g h " * 4
    rows = [*texts, repeated, "home\n" + prose(60) + ".\nAll rights reserved by us here today", "x | y | z | v | w\n" * 9]
    bits = ["#", "a#b", "|", "»", "!?", "ok!", "word", "privacy policy", "home", "and", "so", "\t", "end.", "copyright 1", "(c)", "x\u2028"]
    rows += ["\n".join(" ".join(RNG.choice(bits) for _ in range(RNG.randrange(12))) for _ in range(30)) + "\n" + prose(40) for _ in range(60)]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows)).collect()}
    for i, t in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        kept, clean, lost, hit = plain_quality(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), hit, len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(w) < 20 or 100 * hit > 30 * len(w))
        assert (got[i].kept, got[i].clean_text, got[i].lost_chars) == (kept, clean, lost), t
    assert "home" not in got[len(texts) + 1].clean_text and "reserved" not in got[len(texts) + 1].clean_text and got[len(texts) + 1].kept
    assert not got[len(texts) + 2].kept
    assert quality.quality_rules(table(spark, [])).count() == 0


def test_quality_of_long_lines(spark):
    """Time grows with the length of a line, whatever it is made of."""
    million = 1 << 20
    rows = ["x" * million, "#" * million, "." * million, "!" * million, " " * million + "a", "| " * (million // 2), "a#b " * (million // 4), "\n".join(f"line {i} has five words" for i in range(100_000)), "home " + "y" * million]
    for i, t in enumerate(rows):
        began = time.monotonic()
        got = quality.quality_rules(table(spark, [t])).select("n_words", "lost_chars", "kept").first()
        assert time.monotonic() - began < 60 and not (got.kept and i != 7), i
    assert got.n_words == 2


def test_quality_stage_keeps_other_columns(spark):
    docs = table(spark, [prose(40) + ".", None, prose(40) + "."], [1, 2, None]).withColumn("n_words", F.lit("mine")).withColumn("document", F.lit(5)).withColumn("clean_text", F.lit(None).cast("int"))
    got = quality.passing(docs).collect()
    assert {r.doc_id for r in got} == {1, None} and all((r.n_words, r.document, r.kept, r.clean_text, r.n_chars) == ("mine", 5, "clash", None, len(r.text)) for r in got)
    with pytest.raises(ValueError, match="_q_"):
        quality.quality_rules(docs.withColumn("_q_words", F.lit(1)))
    assert quality.passing(docs.limit(0)).count() == 0


def test_quality_keeps_long_lines_with_a_mark(spark):
    mark = "R&D S&P M&A"
    words = [f"word{i}" for i in range(120)]
    put = lambda x: " ".join([*words[:60], x, *words[60:]]) + "."
    clean = [put(x) for x in ("our privacy policy says", "is licensed under terms", mark, "| and | or |", "")]
    prose_lines = "\n".join(" ".join(words[i : i + 20]) + "." for i in range(0, 120, 20))
    junk = ["Read our privacy policy and the terms of use here.", "a&b c$d e%f g#h i*j and so.", "news | sport | weather | money | more and more."]
    got = {r.doc_id: r.text for r in quality.passing(table(spark, [*clean, *(f"{prose_lines}\n{x}" for x in junk)])).collect()}
    assert got == dict(enumerate(clean)) | {len(clean) + i: prose_lines for i in range(3)}


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def brute_matches(seqs, length):
    """For each sequence the places that lie in ``length`` symbols that start elsewhere too."""
    seen = Counter(tuple(x[i : i + length]) if isinstance(x, list) else x[i : i + length] for x in seqs for i in range(len(x) - length + 1))
    key = lambda x, k: tuple(x[k : k + length]) if isinstance(x, list) else x[k : k + length]
    return [{j for k in range(len(x) - length + 1) if seen[key(x, k)] > 1 for j in range(k, k + length)} for x in seqs]


def test_long_matches(spark):
    body = "".join(RNG.choice("abcdefgh ") for _ in range(900))
    passage = prose(70)
    rows = [body, body[:500] + "X" * 50 + body[450:], "é" * 300, "é" * 300, "", None, "q" * 1000, body[100:450], body[:400], body[100:520] + "!"]
    rows += [prose(30) + body[200:650] + prose(30) for _ in range(5)]
    rows += [prose(40) + " " + passage + " " + prose(9), passage.upper().replace(" ", "\n "), prose(20) + " " + passage[: len(passage) // 2]]
    # words that a polynomial modulo 2^64 can't tell apart, whatever its base
    rows += ["".join("ab"[x] for x in thue_morse(4096)), "".join("ba"[x] for x in thue_morse(4096))]
    raw = [(t or "").encode() for t in rows]
    gone = brute_matches(raw, 400)
    said = brute_matches([b.lower().split() for b in raw], 51)
    assert any(said[15]) and any(said[16]) and not said[17]
    for kw in ({"words": 51}, {"max_group": 2, "words": 51}, {"chunk": 500}, {"max_group": 2, "chunk": 100}):
        got = {r.doc_id: r for r in longmatch.long_matches(table(spark, rows), **kw).collect()}
        for i, b in enumerate(raw):
            assert bytes(got[i].kept) == bytes(x for j, x in enumerate(b) if j not in gone[i]), (kw, i)
            assert got[i].n_bytes == len(b) and {j for s in got[i].spans for j in range(s.start, s.end)} == gone[i]
            assert {j for s in got[i].passages for j in range(s.start, s.end)} == (said[i] if "words" in kw else set())
    assert longmatch.long_matches(table(spark, []), words=51).count() == 0


def test_long_matches_in_many_contexts(spark):
    """One passage in many texts: its core has more contents than a group may have, so it is cut again and again."""
    passage = "".join(RNG.choice("abcdefghij") for _ in range(60))
    rows = [RNG.choice("xyz") + "".join(RNG.choice("klmn") for _ in range(30)) + passage + "".join(RNG.choice("opqr") for _ in range(RNG.randrange(30))) for _ in range(120)]
    rows += ["k" * 40 + passage[:45] for _ in range(3)] + ["k" * 40 + passage[:30] for _ in range(4)]
    gone = brute_matches([t.encode() for t in rows], 40)
    for kw in ({"max_group": 2}, {"max_group": 20}, {}):
        got = {r.doc_id: r for r in longmatch.long_matches(table(spark, rows), length=40, q=8, **kw).collect()}
        for i in range(len(rows)):
            assert {j for s in got[i].spans for j in range(s.start, s.end)} == gone[i], (kw, i)


def test_long_matches_ids_and_slices(spark, monkeypatch):
    import helixframe.llm.common as common

    long = "".join(RNG.choice("abcdefgh") for _ in range(30_000))
    rows = [long, long, long[:3000] + "!" + long[3000:], "z" * 500, "z" * 500]
    got = longmatch.long_matches(table(spark, rows, [None, 7, 8, 5, 5])).collect()
    assert all(len(r.kept) == (1 if r.doc_id == 8 else 0) for r in got) and len(got) == 5
    # texts beyond a slice and beyond a piece
    assert common.PIECE == 2 << 20
    huge = "".join(RNG.choices("abcdefghijklmnop", k=(5 << 20) + 17))
    got = {r.doc_id: r for r in longmatch.long_matches(table(spark, [huge, "<" + huge[-700:] + ">", huge[(4 << 20) - 300 : (4 << 20) + 300]])).collect()}
    at = [(s.start, s.end) for s in got[0].spans]
    assert at == [((4 << 20) - 300, (4 << 20) + 300), (len(huge) - 700, len(huge))] and bytes(got[1].kept) == b"<>" and bytes(got[2].kept) == b""


def test_run_index_against_brute_force():
    import numpy as np

    for n, alphabet in ((3, 2), (6, 4), (1, 1)):
        texts = [np.frombuffer(bytes(RNG.choices(range(97, 97 + alphabet), k=RNG.randrange(1, 200))), np.uint8) for _ in range(n)]
        texts += [texts[0][:50], np.frombuffer(b"".join(bytes([97]) * 130 for _ in range(1)), np.uint8)]
        for kind in (np.uint8, np.uint64):
            index = longmatch.RunIndex([t.astype(kind) for t in texts])
            assert index.runs <= index.n
            for length in (1, 4, 9, 40):
                seen = Counter(bytes(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
                rep = index.repeated(length)
                for k, t in enumerate(texts):
                    want = [seen[bytes(t[i : i + length])] > 1 if i + length <= len(t) else False for i in range(len(t))]
                    assert rep[index.starts[k] : index.starts[k] + len(t)].tolist() == want


class Batches:
    """A table of one task: mapInArrow gives the function's batches at once."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, f, _):  # noqa: N802
        return f(iter(self.batches))


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_long_matches_memory_of_a_worker(monkeypatch):
    """What a Python worker holds depends neither on the batch nor on a text's length, and cores go to an index whole, up to the chunk."""
    import numpy as np
    import pyarrow as pa

    texts = [prose(800).encode() for _ in range(1000)]
    for rows in (texts, [b" ".join(texts)]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)))] * 2 + [pa.array(rows, pa.binary())], names=["doc_id", "th", "bytes"])
        for unit, length, q, parts in (("byte", 400, 64, 2), ("word", 51, 8, 1)):
            most = peak_mb(lambda: [b.num_rows and None for b in longmatch.list_segments(Batches(batch), unit, length, q, parts)])  # noqa: B023
            assert most < 48, (unit, len(rows), most)
    raw = np.frombuffer(RNG.randbytes(1 << 19), np.uint8)
    assert peak_mb(lambda: longmatch.RunIndex(np.split(raw, 1024)).repeated(400)) < 80 * len(raw) / 1e6

    sizes, index = [], longmatch.RunIndex
    monkeypatch.setattr(longmatch, "RunIndex", lambda x: sizes.append(sum(map(len, x))) or index(x))
    core = np.repeat(range(6), [5, 5, 30, 1, 4, 4])
    n, content = len(core), [bytes(raw[k : k + 10]) for k in range(0, 10 * len(core), 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(core), *[pa.array(range(n))] * 2, pa.array([0] * n, pa.int32()), pa.array([1] * n), pa.array(content, pa.binary())], names=["core", "doc_id", "th", "lo", "cnt", "content"])
    list(longmatch.index_cores(Batches(batch.slice(0, 7), batch.slice(7)), "byte", 5, 100))
    assert sizes == [100, 300, 90]


def test_words_of_a_long_text():
    import numpy as np

    from helixframe.llm.common import word_hashes

    for text in (prose(200_000), " " + "x" * 600_000 + " y  " + "z" * 300_000, "a" * (1 << 18) + " b", "a " * (1 << 17) + "b \n"):
        buf = np.frombuffer(text.encode(), np.uint8)
        whole, part = (f(buf, np.array([0, len(buf)])) for f in (word_hashes, lambda *x: longmatch.symbols("word", *x)))
        assert whole[0].tolist() == part[0].tolist() and whole[1].tolist() == part[1].tolist()


def test_secrets(spark, texts):
    find = [
        ("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    parts = ["password", "Secret", "toKen", "api_key", "=", ":", " ", "'", '"', "abcdef", "AKIA", "ABCDEF0123", "deadbeef", "é", "\n", ",", "tok", "_"]
    rows = [*texts, *("".join(RNG.choice(parts) for _ in range(40)) for _ in range(200)), "ghp_" + "a1B2" * 9]
    got = {r.doc_id: r for r in secrets.secrets_digest(table(spark, rows)).collect()}
    for i, t in enumerate(rows):
        base = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(find) for m in p.finditer(t or "") if ok(m))
        text = ",".join(f"{find[k][0]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, got[i].spans, text)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
    assert "github:0:40" in got[len(rows) - 1].spans


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 800
    rows = [(1, "u", big), (2, "u\n2", big), (3, None, "small"), (4, "", "small"), (5, "u", None), (None, "u", "x"), (6, "u", "\r\n\r\nContent-Length: 3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, folder = warc.archive(pages)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, "response", None)
    assert bytes(got[2].payload).decode() == big and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == len(big.encode())
    assert all(got[i].record_type == "response" for i in (3, 4, 5, 6, None)) and bytes(got[6].payload) == b"\r\n\r\nContent-Length: 3"
    for f in Path(folder.removeprefix("file://"), "normal").glob("*.gz"):
        side = [tuple(map(int, x.split("\t"))) for x in Path(f"{f}.idx").read_text().splitlines()]
        data = f.read_bytes()
        assert all(zlib.decompress(data[a : a + n], 31).startswith(b"WARC/1.1") for a, n in side) and sum(n for _, n in side) == len(data)
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_mixing(spark):
    q = mixing.quantise({"a": 5, "b": 3, None: 1.5, "c": 0.01}, 50)
    plan = mixing.pfair_period(q)
    assert sum(q.values()) == 50 and all(r <= slot < d for _, _, slot, r, d in plan)
    for t in range(1, 51):
        done = Counter(s for s, _, slot, _, _ in plan if slot < t)
        assert all(abs(done[s] - n * t / 50) < 1 for s, n in q.items())
    rows = [(i if i % 9 else None, ["a", "b", None][min(i % 4, 2)]) for i in range(500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block=8, period=20).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.mix_slot, r.mix_pos) for r in got}) == 500 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_mixing_follows_the_target_weights(spark):
    counts = {"hot": 200_000} | {f"s{i}": 400 + i for i in range(40)}
    w = {s: n**0.5 for s, n in counts.items()}
    blocks = {s: -(-n // 64) for s, n in counts.items()}
    plan = list(mixing.pfair(mixing.whole(w), blocks))
    assert len(plan) == sum(blocks.values()) > 3000 and Counter(s for s, *_ in plan) == blocks
    # against the target weights themselves, far beyond 1000 slots, while a source has blocks
    slots = {s: [slot for n, _, slot, _, _ in plan if n == s] for s in counts}
    assert len({slot for _, _, slot, _, _ in plan}) == len(plan) and max(slots["hot"]) > 5000
    share = {s: x / sum(w.values()) for s, x in w.items()}
    for s in counts:
        for j, slot in enumerate(slots[s]):
            # j blocks are done at the beginning of the slot, j + 1 at its end
            assert j - share[s] * slot < 1 + 1e-6 and share[s] * slot - j < 1 + 1e-6
            assert -1 - 1e-6 < j + 1 - share[s] * (slot + 1) < 1 + 1e-6
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id < 1020, 'hot', concat('s', id % 990)) AS source")
    got = mixing.mix_sources(docs, block=1).collect()
    n = Counter(r.source for r in got)
    w = {s: x**0.5 for s, x in n.items()}
    place = Counter(r.source for r in got if r.mix_slot < 2000)
    # 991 sources: the hot one has 2.2 % of the slots by its weight
    assert sum(n.values()) == 3000 and len(n) == 991 and abs(place["hot"] - 2000 * w["hot"] / sum(w.values())) < 1
    with pytest.raises(ValueError):
        mixing.whole({"a": 1.0, "b": 0.0})


def by_hash(rows):
    """Rows of ids in the order of their hash, as the operators number them."""
    return sorted(rows, key=lambda r: (hashlib.md5(":".join(str(x) for x in r if x is not None).encode()).digest(), tuple(-1 if x is None else x for x in r)))


def test_mixing_against_plain_schedule(spark):
    """The whole result against slots filled one by one with exact fractions."""
    from fractions import Fraction

    n = {"a": 90, "b": 37, None: 20, "c": 1}
    rows = [(i, s) for i, s in enumerate(x for s, k in n.items() for x in [s] * k)]
    weights = {"a": 5, "b": 2.5, "c": 0.5}
    w = {s: Fraction(weights.get(s, n[s] ** 0.5)) for s in n}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    blocks, slot, want = {s: -(-k // 8) for s, k in n.items()}, 0, {}
    names, done = sorted(n, key=lambda s: (s is None, str(s))), Counter()
    while len(want) < sum(blocks.values()):
        free = [s for s in names if done[s] < blocks[s] and done[s] / w[s] // 1 <= slot]
        if free:
            s = min(free, key=lambda x: (-(-(done[x] + 1) / w[x] // 1), names.index(x), done[x]))
            want[s, done[s]] = slot
            done[s] += 1
        slot += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("document", F.lit("d")).withColumn("mix_slot", F.lit("old")).withColumn("mix_other", F.lit(3)).withColumn("_rank_chunk", F.lit(1))
    got = mixing.mix_sources(docs, weights=weights, block=8).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows) and all((r.document, r.mix_other, r["_rank_chunk"]) == ("d", 3, 1) for r in got)
    for s in n:
        order = by_hash([(i,) for i, x in rows if x == s])
        assert [(r.doc_id,) for r in sorted((r for r in got if r.source == s), key=lambda r: (r.mix_block, r.mix_pos))] == order
        assert all(r.mix_slot == want[s, r.mix_block] for r in got if r.source == s)


def test_packing_against_plain_version(spark, texts):
    """The whole result: pieces, best boundaries by trying all, batches by the order of hashes."""
    ids = [*range(len(texts) - 1), None]
    docs = table(spark, texts, ids).withColumn("size", F.lit("x")).withColumn("piece", F.lit("x")).withColumn("_rank_row", F.lit("x"))
    pieces = []
    for i, t in zip(ids, texts, strict=True):
        size = len((t or "").encode().split())
        pieces += [(i, p, 40 * p, min(40, size - 40 * p)) for p in range(max(1, -(-size // 40)))]
    hist = Counter(p[3] for p in pieces)
    pad = lambda b: sum(n * (min(x for x in b if x >= v) - v) for v, n in hist.items())
    best = min(pad([*c, max(hist)]) for r in range(3) for c in itertools.combinations(sorted(hist)[:-1], r))
    got = packing.pack(docs, buckets=3, max_len=40, budget=100).collect()
    assert Counter((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in got) == Counter(pieces)
    bounds = sorted({r.bucket_len for r in got})
    assert pad(bounds) == best and all(r.bucket_len == min(x for x in bounds if x >= r.n_tokens) and r.bucket == bounds.index(r.bucket_len) for r in got)
    for k, size in enumerate(bounds):
        order = by_hash([(r.doc_id, r.piece) for r in got if r.bucket == k])
        per = 100 // max(size, 1)
        assert {(r.doc_id, r.piece): (r.batch, r.row_in_batch) for r in got if r.bucket == k} == {x: divmod(j, per) for j, x in enumerate(order)}


def test_packing(spark, texts):
    hist = {1: 5, 2: 1, 4: 7, 7: 2, 9: 3, 10: 1}
    for k in (1, 2, 3, 6, 9):
        bounds, cost = packing.best_boundaries(hist, k)
        pad = lambda b: sum(n * (min(x for x in b if x >= v) - v) for v, n in hist.items())
        best = min(pad([*c, 10]) for r in range(min(k, 6)) for c in itertools.combinations([1, 2, 4, 7, 9], r))
        assert pad(bounds) == cost == best and len(bounds) <= k
    got = packing.pack(table(spark, texts), buckets=4, max_len=64, budget=256).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.piece, r.start_token, r.n_tokens) for r in got if r.doc_id == i)
        assert sum(n for *_, n in mine) == len((t or "").encode().split()) and all(s == 64 * p for p, s, _ in mine)
    batches = Counter((r.bucket, r.batch, r.bucket_len) for r in got)
    assert all(n * max(size, 1) <= 256 for (_, _, size), n in batches.items())
    assert len({(r.bucket, r.batch, r.row_in_batch) for r in got}) == len(got)
    assert packing.pack(table(spark, [])).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = table(spark, [None, "", "12 34 --", "the of and"], [900001, 900002, 900003, None]).select(*docs.columns).withColumn("lang", F.lit(None).cast("string"))
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(docs.unionByName(odd)).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in lang]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    assert all((i, "und") in got for i in (900001, 900002, 900003))
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}


def test_language_id_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {}
    for r in docs.where("lang is not null").orderBy("doc_id").collect():
        words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", r.text)
        if len(words) > 60 and not (zlib.crc32(str(r.doc_id).encode()) % 4 != 2):
            whole.setdefault(r.lang, " ".join(words[:60]))
    a, b = sorted(whole)[:2]
    mixed = f"{whole[a]} {whole[b]} {whole[a]}"
    odd = table(spark, [mixed, mixed, "12", None], [1_000_000, None, 1_000_001, 1_000_002]).select("doc_id", "text", "source", "n_chars", "digest", "kept").withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("x"))
    got = langid.identify(docs.unionByName(odd, True).withColumn("letter", F.lit(1))).where("doc_id is null or doc_id >= 1000000").collect()
    assert len(got) == 4
    for r in got:
        if r.doc_id in (1_000_001, 1_000_002):
            assert (r.lang_pred, r.score, r.langs) == ("und", 0.0, [])
        else:
            spans = list(zip(r.langs, r.starts, r.ends))
            n = len(whole[a]) + 1
            right = sum(min(e, y) - max(s, x) for lang, s, e in spans for want, x, y in ((a, 0, n), (b, n, n + len(whole[b])), (a, n + len(whole[b]), len(mixed))) if lang == want and s < y and e > x)
            assert right > 0.9 * len(mixed) and r.lang_pred == a and all(x[0] != y[0] and x[2] < y[1] for x, y in itertools.pairwise(spans))
    assert langid.identify(docs.limit(0)).count() == 0


def test_forward_backward_against_enumeration():
    import numpy as np

    rng = np.random.default_rng(1)
    e, trans, start = rng.normal(size=(3, 7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lens = np.array([7, 2, 1])
    flat = np.concatenate([e[i, :n] for i, n in enumerate(lens)])
    # windows don't matter: the whole chain is inferred
    got = [langid.marginals(flat, lens, trans, start, w) for w in (1, 2, 3, 5, 128)]
    trained = langid.forward_backward(e, lens, trans, start)[0]
    at = 0
    for i, n in enumerate(lens):
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = start[path[0]] + sum(e[i, t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            p[range(n), path] += np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        assert np.allclose(trained[i, :n], p) and all(np.allclose(g[at : at + n], p) for g in got)
        at += n


def test_language_id_windows_agree():
    import numpy as np

    rng = np.random.default_rng(2)
    n = rng.integers(0, 400, 3000)
    n[7] = 5000
    e = rng.normal(size=(int(n.sum()), 4)) * 3
    trans, start = rng.normal(size=(4, 4)), rng.normal(size=4)
    assert np.allclose(langid.marginals(e, n, trans, start, 128), langid.marginals(e, n, trans, start, 6000))


def test_toxicity(spark):
    bad = ["vile", "awful"]
    rows = [prose(30) + (" " + RNG.choice(bad) + "! " + prose(5) if i % 3 == 0 else "") for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == (r.doc_id % 3 == 0) for r in held)
    assert got[300].score == got[301].score and {r.held_out for r in got.values()} == {True, False}
    assert toxicity.toxicity(table(spark, ["a"]), labels.limit(0)).first().score == 0.5
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
    # bounds hold, and the sample doesn't depend on the order or repetition of rows
    docs = table(spark, [*rows, *rows, "another text of this id"], [*range(302), *range(302), 4]).withColumn("toxic", F.lit("x")).withColumn("h", F.lit("x"))
    one = toxicity.sample(docs.orderBy(F.desc("doc_id")), labels, 50, 10**6, 10**9)
    two = toxicity.sample(docs.repartition(3), labels.union(labels), 50, 10**6, 10**9)
    assert one == two and 40 < len(one) <= 50
    few = toxicity.sample(docs, labels, 50, 10**6, 2000)
    assert few == one[: len(few)] and 10 < len(few) < 25 and sum(len(t) for t, _ in few) <= 2000


def test_ftrl_against_plain_loops():
    import math

    import numpy as np

    rng = random.Random(8)  # of its own: how many weights are zero mustn't depend on the tests run before
    examples = [np.array(sorted(rng.sample(range(30), 5))) for _ in range(200)]
    labels = [int(3 in x or 4 in x) for x in examples]
    alpha, beta, l1, l2, epochs, positive, seed = 0.5, 1.0, 1.5, 0.1, 3, 2.0, 3
    z, n, weights = {}, {}, lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    rng, zb, nb = np.random.default_rng(seed), 0.0, 0.0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            w = {i: weights(i) for i in examples[k].tolist()}
            bias = -zb * alpha / (beta + math.sqrt(nb))
            g = (1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[k]) * (positive if labels[k] else 1)
            for i in w:
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / alpha
                z[i], n[i] = z.get(i, 0) + g - sigma * w[i], n.get(i, 0) + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias, nb + g * g
    at, w, bias = toxicity.ftrl(examples, labels, alpha, beta, l1, l2, epochs, positive, seed)
    want = {i: weights(i) for i in z if weights(i)}
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want) and 0 < len(want) < 30 and bias == pytest.approx(-zb * alpha / (beta + math.sqrt(nb)))


def test_join_counted(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}" if i % 7 else None) for i in range(6000)]
    n = Counter(k for _, k in rows if k)
    left = spark.createDataFrame(rows, "id long, k string")
    right = spark.createDataFrame([(k, c, k.upper()) for k, c in n.items() if k != "k0"] + [("z", 5000, "Z")], "k string, c long, v string")
    got = sorted(map(tuple, join_counted(left, right, ["k"], "c", 6000).select("id", "k", "c", "v").collect()))
    assert got == sorted((i, k, n[k], k.upper()) for i, k in rows if k and k != "k0") and n["hot"] > 1000


def test_pipeline_stages_with_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    one, two = prose(60) + ".", prose(60) + "."
    rows = [(5, one), (5, one), (5, two), (3, edited(two, 60)), (None, one), (None, None), (None, ""), (7, prose(50) + "."), (7, prose(50) + ".")]
    docs = spark.createDataFrame([(i, t, None, "s" if k % 2 else None, 1, 9, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept long, `_id` long")
    docs = docs.withColumn("_sha", F.lit("x")).withColumn("mix_slot", F.lit("x")).withColumn("component_id", F.lit("x")).withColumn("document", F.lit("x")).withColumn("_rank_row", F.lit("x"))
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0 and stage(spark, docs.limit(0), SF).columns == docs.columns, name
        assert stage(spark, docs, SF).columns == docs.columns and all(r.kept == 9 for r in stage(spark, docs, SF).collect())
    assert {r["_id"] for r in p.quality_stage(spark, docs, SF).collect()} == {0, 1, 2, 3, 4, 7, 8}
    kept = p.exact_stage(spark, docs, SF).collect()
    assert len(kept) == 6 and len({r.text or "" for r in kept}) == 6 and {2, 3, 7, 8} < {r["_id"] for r in kept}
    kept = [r["_id"] for r in p.near_stage(spark, docs, SF).collect()]
    # the row of id 5 with another text stays, as do texts without words
    assert len({0, 1, 4} & set(kept)) == 1 and len({2, 3} & set(kept)) == 1 and {5, 6, 7, 8} < set(kept) and len(kept) == 6
    assert sorted(r["_id"] for r in p.mixing_stage(spark, docs, SF).collect()) == list(range(9))
    assert p.packing_stage(spark, docs, SF).count() == 9 and p.packing_stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_against_plain_version(spark, tmp_path):
    """run() as a whole: which documents stay, with which text, by plain loops; their order by source; batches in that order."""
    import corpus_pipeline as p

    base = [prose(RNG.randrange(30, 90)) + "." for _ in range(12)]
    rows = [*base, *base[:4], base[1].replace(" ", "  "), *(edited(base[k], 40) for k in (2, 3, 5, 5)), "home\n" + base[6], base[7] + "\nall rights reserved", "x | y | z | v | w\n" * 9, "", None, "too short."]
    docs = [(100 + (k * 37) % 101, t, "en", "ab"[k % 3 == 0], len(t or "")) for k, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: plain_quality(t)[1] for i, t, *_ in docs if plain_quality(t)[0]}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    texts = {i: t for i, t in texts.items() if i == min(j for j, x in texts.items() if norm(x) == norm(t))}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    want = {i: len(texts[i].split()) for i in sets if comp[i] == i}
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want) < len(rows) - 8
    lens = sorted(set(want.values()))
    bounds = sorted({r.bucket_len for r in got})
    assert bounds == lens if len(lens) <= 16 else len(bounds) == 16
    assert all(r.batch == 0 for r in got) and len({(r.bucket, r.row_in_batch) for r in got}) == len(got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, d, SF).cache()
        assert out.columns == docs.columns and out.count() <= d.count()
        d = out
    assert 0.5 * docs.count() < d.count() < docs.count()
    packed = p.STAGES[-1][1](spark, d, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in d.select("doc_id").collect()}
    # the mixture's order decides what goes into which batch
    mixed = materialize(p.mixing_stage(spark, d, SF), "test-mixed")
    place = {r.doc_id: (r.mix_slot, r.mix_pos) for r in mixing.mix_sources(d).collect()}
    rows = p.packing_stage(spark, mixed, SF).collect()
    assert len(rows) == packed.count()
    for bucket in {r.bucket for r in rows}:
        mine = sorted((r for r in rows if r.bucket == bucket), key=lambda r: (r.batch, r.row_in_batch))
        order = [(*place[r.doc_id], r.piece) for r in mine]
        assert order == sorted(order)
