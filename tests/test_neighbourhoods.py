"""Graphs from neighbourhoods against the same graphs as plain tables."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import graph


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def tiled(spark, texts, size=45, step=7):
    """Reads over circular texts, some of them twice, and a changed base in every ninth."""
    seqs = []
    for text in texts:
        twice = text + text
        for i in range(0, len(text), step):
            s = twice[i : i + size]
            seqs += [s] * (1 + i % 2)
            if i % 9 == 4:
                seqs.append(s[:20] + ("A" if s[20] != "A" else "C") + s[21:])
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)


def plain(edges):
    """The same rows, without what is known of their reads."""
    return edges.sparkSession.createDataFrame(edges.collect(), edges.schema)



def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(("k", "both"), [(4, True), (21, False), (40, True)])
def test_counts_and_nodes(spark, k, both):
    reads = tiled(spark, [genome(300, 1)])
    e = graph.kmer_graph(reads, k, both)
    want = graph.kmer_rows(reads, k, both).groupBy("kmer").agg(F.count(F.lit(1)).alias("weight"), F.min("edge_id").alias("edge_id"))
    assert rows(e) == rows(graph.as_edges(want, k))
    flat = plain(e)
    assert rows(graph.degrees(e)) == rows(graph.degrees(flat)) and rows(graph.adjacency(e)) == rows(graph.adjacency(flat))
    strong = graph.remove_weak_edges(e, 4)
    assert rows(graph.isolated_nodes(graph.nodes(e), strong)) == rows(graph.isolated_nodes(graph.nodes(flat), graph.remove_weak_edges(flat, 4)))
    assert graph.graph_stats(strong).collect() == graph.graph_stats(plain(strong)).collect()


def test_one_exchange(spark):
    """Only runs of bases go over the network, whatever is asked of the nodes."""
    e = graph.kmer_graph(tiled(spark, [genome(200, 2)]), 21)
    for df in (e, graph.degrees(e), graph.adjacency(e), graph.isolated_nodes(graph.nodes(e), graph.remove_weak_edges(e, 3))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Join", "Aggregate"))
