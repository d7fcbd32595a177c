"""Goldens of the graph operators on small topologies and reads."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import graph, paths
from helixframe.operators.contig_stats import contig_stats
from helixframe.plans import oracles
from helixframe.plans.assembler import assemble
from helixframe.sources import readers, sinks

K = 40
READ = "".join("ACGT"[(i * i * 7 + i // 3 + i * i * i // 11) % 4] for i in range(100))


def edges_of(spark, rows, labels=None):
    """rows: (src, dst, weight); edge ids in order."""
    labels = labels or [f"{s}{d}" for s, d, _ in rows]
    return spark.createDataFrame([(i, s, d, lab, w) for i, ((s, d, w), lab) in enumerate(zip(rows, labels, strict=True))], "edge_id long, src string, dst string, label string, weight long")


def reads_of(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def weights(df):
    return [r[0] for r in df.orderBy("edge_id").select("weight").collect()]


def test_build_same_read_twice(spark):
    e = graph.kmer_graph(reads_of(spark, [READ, READ]), K)
    s = graph.graph_stats(e).first()
    assert (s.node_count, s.edge_count, s.max_edge_weight, s.avg_edge_weight) == (62, 61, 2, 2.0)
    assert (s.max_in_degree, s.max_out_degree, round(s.avg_out_degree, 2), s.incoming_vert_count, s.outgoing_vert_count) == (1, 1, 0.98, 1, 1)
    assert graph.accepted_bytes(reads_of(spark, [READ, READ])).first()[0] == 200
    assert graph.kmer_graph(reads_of(spark, [READ]), K, True).count() == 122
    assert paths.remove_dead_paths(e, K).count() == 0  # 61 edges are fewer than 2k - 2
    assert graph.remove_weak_edges(e, 3).count() == 0
    small = paths.shrink(e, K)
    assert [(r.label, r.weight) for r in small.collect()] == [(READ, 2)]
    assert [(r.contig_id, r.seq) for r in paths.collapse(e, K).orderBy("contig_id").collect()] == [(0, READ), (1, READ)]
    assert graph.adjacency_stats(graph.adjacency(e)).first()[:2] == (62, 61)


def test_short_and_foreign_reads(spark):
    assert graph.accepted(reads_of(spark, ["ACGN", "acgt", "", None, "ACGT"])).count() == 2
    with pytest.raises(Exception, match="shorter"):
        graph.kmer_graph(reads_of(spark, ["ACGTACG"]), K).count()
    assert graph.kmer_graph(reads_of(spark, ["ACGTACG"]), K, on_short="drop").count() == 0
    s = graph.graph_stats(graph.kmer_graph(reads_of(spark, []), 5)).first()
    assert (s.node_count, s.edge_count, s.max_edge_weight, s.avg_edge_weight) == (0, 0, 0, None)
    with pytest.raises(ValueError):
        graph.kmer_graph(reads_of(spark, []), 2)


def side_by_side(spark, graphs):
    """Graphs of (src, dst, weight) as one, the nodes of the g-th marked with g."""
    return edges_of(spark, [(f"{g}.{a}", f"{g}.{b}", w) for g, rows in enumerate(graphs) for a, b, w in rows])


def sizes(edges, count):
    """(nodes, edges) of each of the graphs that stand side by side."""
    of = lambda column: F.substring_index(column, ".", 1).cast("int")
    n = dict(map(tuple, graph.nodes(edges).groupBy(of("node")).count().collect()))
    e = dict(map(tuple, edges.groupBy(of("src")).count().collect()))
    return [(n.get(g, 0), e.get(g, 0)) for g in range(count)]


def test_weak_edges(spark):
    cases = [
        ([("x", "y", 100), ("y", "z", 1)], 2, 1),
        ([("x", "y", 100), ("y", "z", 1), ("z", "w", 100)], 4, 2),
        ([("x", "y", 100), ("y", "z", 100)], 3, 2),
        ([("x", "y", 1), ("y", "z", 1), ("z", "x", 1)], 0, 0),
    ]
    e = graph.remove_weak_edges(side_by_side(spark, [rows for rows, *_ in cases]), 10)
    assert sizes(e, len(cases)) == [(n, m) for _, n, m in cases]


FORK_IN = [(0, 1, 8), (1, 2, 4), (2, 3, 115), (3, 4, 1)]
TAIL = [(5, 6, 4), (6, 7, 9)]
BOTH = [*FORK_IN, (7, 2, 2), *TAIL]


def test_standardize_contigs(spark):
    cases = [
        ([(0, 1, 100), (1, 2, 1)], [51, 51]),
        ([*FORK_IN, (2, 5, 2), *TAIL], [6, 6, 58, 58, 5, 5, 5]),
        (BOTH, [6, 6, 58, 58, 5, 5, 5]),
        ([*BOTH, (2, 8, 178), (8, 9, 298), (9, 10, 123), (10, 11, 9128)], [6, 6, 58, 58, 5, 5, 5, 2432, 2432, 2432, 2432]),
        ([(0, 1, 8), (1, 2, 4), (2, 3, 115), (3, 1, 1)], [8, 40, 40, 40]),
        ([(0, 1, 5), (1, 0, 9)], [5, 9]),
    ]
    assert weights(paths.standardize_contigs(side_by_side(spark, [rows for rows, _ in cases]))) == [w for _, want in cases for w in want]


def test_standardize_edges(spark):
    e = edges_of(spark, [("a", "b", 40), ("b", "c", 10), ("c", "d", 1), ("d", "e", 4)])
    assert paths.standardization_ratio(e, 17, 3, 3).first()[0] == 14 / 54
    assert weights(paths.standardize_edges(e, 17, 3, 3)) == [10, 3, 1]
    with pytest.raises(ValueError):
        paths.standardization_ratio(e, 2, 3, 3)


def test_shrink_topologies(spark):
    cases = [("01 12", 2, 1), ("01 12 20", 1, 1), ("01 12 23 31", 2, 2), ("01 12 13", 4, 3), ("01 21 13", 4, 3), ("01 02", 3, 2), ("01 21", 3, 2), ("wx xz xy yx wk kw", 3, 4)]
    e = paths.shrink(side_by_side(spark, [[(*p, 1) for p in pairs.split()] for pairs, *_ in cases]), 2)
    assert sizes(e, len(cases)) == [(n, m) for _, n, m in cases]


NAME = "A" * (K - 1) + "TGCT"
L = [NAME[i : i + K] for i in range(4)] + ["A" * (K - 1) + "G"]


@pytest.mark.parametrize(
    ("rows", "labels", "want"),
    [
        ([], [], []),
        ([("w", "x", 1)], [L[0]], [L[0]]),
        ([("w", "x", 1), ("y", "z", 1)], L[:2], L[:2]),
        ([("w", "x", 1), ("x", "y", 1), ("y", "z", 1)], L[:3], [NAME[: K + 2]]),
        ([("w", "x", 2), ("x", "y", 1), ("x", "z", 1)], L[:3], [L[0], L[0], L[1], L[2]]),
        ([("w", "x", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1)], L[:4], [NAME]),
        ([("w", "x", 1), ("x", "y", 2), ("y", "x", 2)], L[:3], [L[0] + "GCGC"]),
        ([("w", "x", 1), ("x", "y", 2), ("y", "x", 2), ("x", "z", 1)], L[:4], [L[0] + "GCGCT"]),
        ([("w", "x", 1), ("x", "y", 2), ("y", "x", 2), ("x", "z", 1), ("w", "k", 1), ("k", "w", 1)], [*L[:4], L[4], L[4]], [NAME[: K - 1] + "GGTGCGCT"]),
    ],
)
def test_collapse(spark, rows, labels, want):
    got = [r.seq for r in paths.collapse(edges_of(spark, rows, labels), K).collect()]
    assert sorted(got) == sorted(want)


def test_collapse_two_node_loop(spark):
    """b to c and back: with a way in, the way there, the way back and the way there again; what is left stands alone."""
    a, f, r, o = "AAC", "ACG", "CGA" + "C", "CGT"  # a: ..AC, f: AC to CG, r: CG to AC, o: CG to GT
    e = edges_of(spark, [("AA", "AC", 1), ("AC", "CG", 2), ("CG", "AC", 1), ("CG", "GT", 1)], [a, f, r, o])
    got = sorted(r.seq for r in paths.collapse(e, 3).collect())
    assert got == sorted([a + "G" + "AC" + "G", o])


def test_collapse_ring_of_loops(spark):
    """Two nodes with a loop each that lead to each other: one contig from the smaller node on, all weight is used."""
    e = edges_of(spark, [("b", "b", 2), ("b", "c", 1), ("c", "c", 1), ("c", "b", 1)], ["bX", "bc", "cY", "cb"])
    got = [r.seq for r in paths.collapse(e, 2).collect()]
    assert got == ["b" + "XX" + "c" + "Y" + "b"]


BUBBLE = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (7, 9), (9, 10), (3, 11), (11, 12), (12, 13), (13, 5)]


def test_standardize_examples(spark):
    bubble = lambda ws: edges_of(spark, [(str(a), str(b), w) for (a, b), w in zip(BUBBLE, ws, strict=True)])
    got = {r.edge_id: r.weight for r in paths.standardize_edges(bubble([8, 8, 8, 16, 16, 9, 9, 1, 4, 4, 8, 8, 8, 8]), 17, 3, 3).collect()}
    assert got == {i: 2 if i in (3, 4) else 1 for i in range(14) if i != 7}
    got = weights(paths.standardize_contigs(bubble([3, 2, 3, 1, 3, 5, 5, 3, 4, 6, 1, 2, 2, 2])))
    assert got == [3 if i in (0, 1, 2, 7) else 5 if i in (5, 6, 8, 9) else 2 for i in range(14)]


def test_shrink_through(spark):
    e = edges_of(spark, [(f"n{i}", f"n{i + 1}", i + 1) for i in range(6)], [f"{i}{i + 1}" for i in range(6)])
    some = spark.createDataFrame([("n1",), ("n2",), ("n4",), ("n0",)], "node string")
    got = [tuple(r) for r in paths.shrink(e, 2, some).orderBy("edge_id").collect()]
    assert got == [(0, "n0", "n3", "0123", 1), (3, "n3", "n5", "345", 4), (5, "n5", "n6", "56", 6)]
    ring = edges_of(spark, [("a", "b", 1), ("b", "c", 2), ("c", "a", 3)], ["ab", "bc", "ca"])
    got = [tuple(r) for r in paths.shrink(ring, 2, spark.createDataFrame([("a",), ("c",)], "node string")).collect()]
    assert got == [(1, "b", "b", "bcab", 2)]


def test_shrink_labels(spark):
    e = edges_of(spark, [("AAC", "ACG", 3), ("ACG", "CGT", 2), ("CGT", "AAT", 1)], ["AACG", "ACGT", "CGTCAAT"])
    assert [tuple(r) for r in paths.shrink(e, 4).collect()] == [(0, "AAC", "AAT", "AACGTCAAT", 3)]


def test_labels_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(paths, "_LABEL_CHUNK", 7)
    e = graph.kmer_graph(reads_of(spark, [READ]), 10)
    assert [r.label for r in paths.shrink(e, 10).collect()] == [READ]


def test_contracted_graphs_give_the_same(spark, monkeypatch):
    """Averaging, scaling and statistics of contracted random graphs against the plain ones; joins without a broadcast."""
    monkeypatch.setattr(paths, "_FEW", 0)
    rng, rows = random.Random(11), []
    for g in range(40):
        n = rng.randint(2, 14)
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, n + 2))} | {(i, i + 1) for i in range(rng.randint(0, n))}
        rows += [(f"{g}.{a}", f"{g}.{b}", rng.randint(1, 9)) for a, b in sorted(pairs)]
    rows += [(f"r.{i}", f"r.{(i + 1) % 9}", i + 1) for i in range(9)]
    rng.shuffle(rows)
    e = edges_of(spark, rows)
    short, place = paths.contract(e)
    assert short.count() < e.count() and graph.graph_stats(short).collect() == graph.graph_stats(e).collect()
    at = {r.edge_id: r.path_id for r in place.collect()}
    spread = lambda df: {i: got[at[i]] for got in [{r.edge_id: r.weight for r in df.collect()}] for i in at if at[i] in got}
    plain = lambda df: {r.edge_id: r.weight for r in df.collect()}
    even = paths.standardize_contigs(short)
    assert spread(even) == plain(paths.standardize_contigs(e))
    scaled = paths.standardize_edges(even, 500, 3, 3)
    assert spread(scaled) == plain(paths.standardize_edges(paths.standardize_contigs(e), 500, 3, 3))
    assert graph.graph_stats(even).collect() == graph.graph_stats(paths.standardize_contigs(e)).collect()


def prune(rows, k, tips, junction=3):
    """Dead paths by plain walks; rows of (edge_id, src, dst)."""

    def dead(rows):
        ins, outs = {}, {}
        for i, a, b in rows:
            ins.setdefault(b, []).append(i)
            outs.setdefault(a, []).append((i, b))
        gone = set()
        for node in outs:
            if node in ins:
                continue
            walk, at = [], node
            while len(walk) < 2 * k + 1 and at in outs and not (walk and len(ins.get(at, ())) >= junction):
                i, at = max(outs[at])
                walk.append(i)
            over = at in outs and len(ins.get(at, ())) < junction
            if not over and len(walk) <= (2 * k - 1 if at in outs else 2 * k - 2):
                gone |= set(walk)
        return gone

    while True:
        gone = dead(rows)
        if tips:
            gone |= dead([(i, b, a) for i, a, b in rows])
        if not gone:
            return {i for i, *_ in rows}
        rows = [r for r in rows if r[0] not in gone]


@pytest.mark.parametrize(("tips", "junction"), [(False, 2), (True, 3)])
def test_dead_paths_against_plain_walks(spark, tips, junction):
    rng, rows = random.Random(13), []
    for g in range(60):
        n = rng.randint(2, 14)
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, n + 2))} | {(i, i + 1) for i in range(rng.randint(0, n))}
        rows += [(f"{g}.{a}", f"{g}.{b}", 1) for a, b in sorted(pairs)]
    rng.shuffle(rows)
    got = {r.edge_id for r in paths.remove_dead_paths(edges_of(spark, rows), 3, tips, junction).collect()}
    assert got == prune([(i, a, b) for i, (a, b, _) in enumerate(rows)], 3, tips, junction) and 0 < len(got) < len(rows)


def test_dead_paths_bounds(spark):
    k = 3
    line = lambda n: edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}", 1) for i in range(n)])
    assert paths.remove_dead_paths(line(2 * k - 2), k).count() == 0
    assert paths.remove_dead_paths(line(2 * k - 1), k).count() == 2 * k - 1
    assert paths.remove_dead_paths(edges_of(spark, [("a", "b", 1), ("b", "a", 1)]), k).count() == 2


def test_random_graphs_against_sql(spark):
    """A hundred small graphs side by side: cycles, tips, junctions, loops and lone paths."""
    rng, rows = random.Random(5), []
    for g in range(100):
        n = rng.randint(2, 12)
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, n + 2))}
        rows += [(f"{g}.{a}", f"{g}.{b}", rng.randint(1, 9)) for a, b in sorted(pairs)]
    for g in range(5):
        rows += [(f"ring{g}.{i}", f"ring{g}.{(i + 1) % (g + 1)}", i + 1) for i in range(g + 1)]
    rng.shuffle(rows)
    e = edges_of(spark, rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE e (edge_id BIGINT, src VARCHAR, dst VARCHAR, label VARCHAR, weight BIGINT)")
    db.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", [(i, a, b, a + b, w) for i, (a, b, w) in enumerate(rows)])

    def same(df, ctes, cols):
        want = db.execute(f"WITH RECURSIVE {ctes} SELECT {cols} FROM out").fetchall()
        assert sorted(map(tuple, df.selectExpr(*cols.split(", ")).collect())) == sorted(want)

    same(paths.unitigs(e), oracles.unitigs("e", "out"), "edge_id, unitig_id, dist, cyclic")
    same(paths.standardize_contigs(e), oracles.standardize_contigs("e", "out"), "edge_id, weight")
    same(paths.remove_dead_paths(e, 3), oracles.remove_dead_paths("e", "out", 3), "edge_id")
    same(paths.weak_components(e), oracles.weak_components("e", "out"), "node, component")


def test_components_and_externals(spark):
    e = edges_of(spark, [("a", "b", 1), ("c", "b", 1), ("x", "y", 1), ("z", "z", 1)])
    got = {r.node: r.component for r in paths.weak_components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert {(r.node, r.kind) for r in graph.external_nodes(e).collect()} == {("a", "input"), ("c", "input"), ("x", "input"), ("b", "output"), ("y", "output")}


@pytest.mark.parametrize(
    ("lens", "genome", "want"),
    [(range(2, 11), 54, (7, 3, 3, 7)), ([80, 70, 50, 40, 30, 20], 290, (70, 2, 30, 70)), ([80, 70, 50, 40, 30, 20, 10, 5], 305, (50, 3, 20, 50)), ([], 10, (0, 0, 0, 0))],
)
def test_contig_stats(spark, lens, genome, want):
    assert tuple(contig_stats(spark.createDataFrame([(x,) for x in lens], "len long"), genome).first()) == want


def test_codec(spark):
    df = spark.createDataFrame([("AGGT",), ("AGGTCGG",), ("AGGTCG",), ("AGGTC",), ("A" * 35,)], "s string")
    got = df.select(F.hex(dna.pack_edge(F.col("s"))), dna.unpack_edge(dna.pack_edge(F.col("s"))), "s").collect()
    assert [r[0] for r in got[:4]] == ["002B", "012B68", "022B60", "032B40"]
    assert all(r[1] == r[2] for r in got)
    assert spark.range(1).select(dna.reverse_complement(F.lit("AGGTGTC"))).first()[0] == "GACACCT"


def test_files(spark, tmp_path):
    fq, fa, bfc, cfg = (tmp_path / x for x in ("a.fastq", "a.fasta", "a.tsv", "c.toml"))
    fq.write_text(f"@1\n{READ}\n+\n{'@' * 100}\n@2\n{READ}\n+\n{'I' * 100}\n")
    fa.write_text(f">one x\n{READ[:50]}\n{READ[50:]}\n>two\n{READ}\n")
    bfc.write_text(f"{READ[:K]}\t3\n{READ[1 : K + 1]}\t1\n{READ[:K]}\t4\textra\n")
    for kind, path in (("FastQ", fq), ("fasta", fa)):
        got = readers.read_reads(spark, [str(path)], kind)
        assert [r.seq for r in got.orderBy("read_id").collect()] == [READ, READ]
    w = graph.weighted_graph(readers.read_bfcounter(spark, [str(bfc)], 2, K), K)
    assert sorted(weights(w)) == [3, 4]
    with pytest.raises(FileNotFoundError):
        readers.read_reads(spark, [str(tmp_path / "none")], "fasta")
    with pytest.raises(IsADirectoryError):
        readers.read_reads(spark, [str(tmp_path)], "fasta")
    cfg.write_text(f'input_files = ["{fq}"]\ninput_file_type = "Fastq"\noutput_file = "{tmp_path}/out"\noriginal_genome_length = 100\nminimal_weight_threshold = 1\nk_mer_size = 10\nreverse_complement = false\n')
    out = assemble(spark, readers.load_config(str(cfg)))
    assert out.contigs.count() >= 1
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith(">contig_0\n")
    sinks.write_dot(graph.kmer_graph(reads_of(spark, ["ACGTT"]), 4), str(tmp_path / "dot"))
    dot = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*"))).splitlines()
    assert (dot[0], dot[-1]) == ("digraph {", "}") and sorted(dot[1:4]) == ['    "ACG"', '    "CGT"', '    "GTT"']
    assert sorted(dot[4:-1]) == ['    "ACG" -> "CGT" [ label = "ACGT (1)" ]', '    "CGT" -> "GTT" [ label = "CGTT (1)" ]']
    assert "??" in sinks.describe(graph.adjacency_stats(graph.adjacency(graph.kmer_graph(reads_of(spark, ["ACGTT"]), 4))))


def test_one_fasta_file_and_public_names(spark, tmp_path, caplog):
    import logging

    import helixframe
    from helixframe.plans.assembler import set_up_logging

    fq, cfg, out, logged = (tmp_path / x for x in ("a.fastq", "c.toml", "out.fasta", "log/run.log"))
    fq.write_text("".join(f"@{i}\n{READ[a:b]}\n+\n{'I' * (b - a)}\n" for i, (a, b) in enumerate([(0, 60), (20, 100), (0, 100)])))
    cfg.write_text(f'input_files = ["{fq}"]\ninput_file_type = "FASTQ"\noutput_file = "{out}"\noriginal_genome_length = 100\nminimal_weight_threshold = 1\nk_mer_size = 10\nreverse_complement = false\n')
    set_up_logging(str(logged))
    try:
        one = helixframe.BasicAsm.assemble(spark, helixframe.load_config(str(cfg)))
        text = out.read_text()
        two = helixframe.BasicAsm.assemble_with_adjacency(spark, helixframe.load_config(str(cfg)))
    finally:
        for h in [*logging.getLogger("helixframe").handlers]:
            logging.getLogger("helixframe").removeHandler(h)
        logging.getLogger("helixframe").setLevel(logging.NOTSET)
    assert sorted(map(tuple, one.contigs.collect())) == sorted(map(tuple, two.contigs.collect())) and out.read_text() == text
    assert text == "".join(f">contig_{r.contig_id}\n{r.seq}\n" for r in one.contigs.orderBy("contig_id").collect())
    said = logged.read_text()
    assert "node_count" in said and "n50" in said and "DEBUG" in said and "packed_bytes" in said
    with pytest.raises(ValueError, match="adjacency"):
        helixframe.BasicAsm.assemble_with_adjacency(spark, helixframe.Config((str(fq),), helixframe.InputFileType.BFCOUNTER, "", 100, 1, 10))


def test_bfcounter_takes_letters_as_they_are(spark, tmp_path):
    p = tmp_path / "k.tsv"
    p.write_text("ACGT\t3\nACNT\t4\nACGA\t1\n")
    got = lambda **kw: sorted((r.kmer, r.weight) for r in readers.read_bfcounter(spark, [str(p)], 2, 4, **kw).collect())
    assert got() == [("ACGT", 3), ("ACNT", 4)] and got(only_dna=True) == [("ACGT", 3)]
    p.write_text("ACGT\tx\n")
    with pytest.raises(Exception, match="not a count"):
        got()


def test_long_sequences_are_cut_into_pieces(spark):
    rng = random.Random(3)
    for n, small, large in ((0, 4, 16), (4, 4, 16), (5, 4, 16), (100, 4, 16), (101, 7, 21), (333, 8, 512)):
        seq = "".join(rng.choice("ACGT") for _ in range(n))
        rows = spark.createDataFrame([(seq,)], "s string").select(F.explode(dna.pieces(F.col("s"), 5, small, large)).alias("p")).select("p.at", F.posexplode(dna.windows(F.col("p.part"), 5)).alias("i", "w")).collect()
        assert sorted((r["at"] + r.i, r.w) for r in rows) == [(i, seq[i : i + 5]) for i in range(n - 4)]
    seq = "".join(rng.choice("ACGT") for _ in range(3_000_000))
    reads = spark.createDataFrame([(0, 3, seq)], "read_id long, n_ids long, seq string")
    got = graph.kmer_rows(reads, 31).agg(F.count(F.lit(1)), F.min("edge_id"), F.max("edge_id"), F.countDistinct("edge_id")).first()
    assert tuple(got) == (2_999_970, 0, 2_999_969, 2_999_970)


def test_records_of_all_files_stay(spark):
    n = 100_003
    records = spark.range(n).select(F.format_string("f%06d", "id").alias("file"), F.lit(0).alias("n"))
    assert readers._with_ids(records).select("read_id").distinct().count() == n


def test_edge_ids_of_many_files(spark, tmp_path):
    names = [tmp_path / f"{i:03}.fasta" for i in range(130)]
    for i, p in enumerate(names):
        p.write_text("".join(f">r\n{READ[(i + j) % 50 :][:45]}\n" for j in range(2)))
    reads = readers.read_fasta(spark, [str(p) for p in names])
    ids = [r.edge_id for r in graph.kmer_rows(reads, K, True).collect()]
    assert len(ids) == len(set(ids)) == 130 * 2 * 2 * 6 and min(ids) >= 0
    order = [r.file for r in reads.orderBy("read_id").collect()]
    assert order == sorted(order)


def test_edge_ids_of_long_reads(spark, tmp_path, monkeypatch):
    for at in (readers, graph):
        monkeypatch.setattr(at, "POSITIONS" if at is readers else "_POSITIONS", 5, raising=False)
    one, two = tmp_path / "1.fasta", tmp_path / "2.fasta"
    one.write_text(f">short\n{READ[:20]}\n>long\n{READ}\n>short\n{READ[50:70]}\n")
    two.write_text(f">short\n{READ[7:30]}\n")
    reads = readers.read_fasta(spark, [str(one), str(two)])
    got = [(r.edge_id, r.kmer) for r in graph.kmer_rows(reads, 10, True).collect()]
    assert len({i for i, _ in got}) == len(got) == 2 * (11 + 91 + 11 + 14)
    # age: by read, strand and position
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = [x[i : i + 10] for s in (READ[:20], READ, READ[50:70], READ[7:30]) for x in (s, rc(s)) for i in range(len(x) - 9)]
    assert [kmer for _, kmer in sorted(got)] == want
    # a table that has one id for a read can't hold the long one
    with pytest.raises(Exception, match="no edge ids"):
        graph.kmer_graph(reads_of(spark, [READ]), 10).collect()
    with pytest.raises(Exception, match="no edge ids"):
        graph.weighted_graph(spark.createDataFrame([(1 << 58, READ[:10], 1)], "read_id long, kmer string, weight long"), 10).collect()


def test_streaming(spark, tmp_path):
    from helixframe.streaming.kmers import streaming_kmer_counts

    reads_of(spark, ["ACGTA", "ACGTN"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, seq string").parquet(str(tmp_path / "in"))
    q = streaming_kmer_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("kmers").collect()} == {("ACGT", 1), ("CGTA", 1)}
