"""The k-mer graph as a table of edges: edge_id, src, dst, label, weight.

edge_id is where the edge was first seen, (read, strand, position) in one LONG, so it is
unique and orders edges by age; the newest edge of a node is its first in walks.  A read
whose parts don't fit into their bits stops the job; longer reads have several ids of
their own (n_ids, from the readers).
Nodes are their strings.

A table of edges that ``kmer_graph`` gave, or ``remove_weak_edges`` of one, knows its reads; degrees, adjacency
and paths of such a graph come from its neighbourhoods (``minimizers``), of any other from its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators.minimizers import neighbourhoods
from helixframe.sources import readers
from helixframe.sources.readers import check_k


#: Windows of a long sequence that are cut into runs at a time.
_PIECE = 1 << 16


def accepted(reads: DataFrame) -> DataFrame:
    """Reads of A, C, G and T only."""
    return reads.where(dna.is_dna(F.col("seq")))


def accepted_bytes(reads: DataFrame) -> DataFrame:
    return accepted(reads).agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bytes"))


def _first_id(read_id, n_ids, positions):
    """The edge id of a read's first position; an error if its ids aren't LONGs or its positions exceed n_ids * 2^POSITIONS."""
    bits = readers.POSITIONS
    fits = (read_id >= 0) & (read_id <= F.lit(1 << 62 - bits) - n_ids) & (n_ids >= 1) & (positions <= F.shiftleft(n_ids, bits))
    text = F.concat(F.lit("no edge ids for read "), read_id.cast("string"), F.lit(f": {1 << bits} positions an id, ids below {1 << 62 - bits}"))
    return F.when(~fits, F.raise_error(text).cast("long")).otherwise(F.shiftleft(read_id, bits + 1))


@dataclass(frozen=True, eq=False)
class Kmers:
    """What a k-mer graph was made of: parts(first, part) of its reads, and the least weight of its edges."""

    parts: DataFrame
    k: int
    min_weight: int | None = None

    def table(self, kind: str, through: DataFrame | None = None) -> DataFrame:
        return neighbourhoods(self.parts, self.k, kind, self.min_weight, through)


def kmers_of(edges: DataFrame) -> Kmers | None:
    """What a table of edges was made of, if that is known."""
    return getattr(edges, "_helixframe_kmers", None)


def _made_of(edges: DataFrame, kmers: Kmers) -> DataFrame:
    edges._helixframe_kmers = kmers
    return edges


def _parts(reads: DataFrame, k: int, reverse_complement: bool, on_short: str, **sizes: int) -> DataFrame:
    """(first, part): both strands of the accepted reads in overlapping pieces; first is the edge id of a piece's first window."""
    check_k(k)
    n_ids = F.col("n_ids").cast("long") if "n_ids" in reads.columns else F.lit(1).cast("long")
    rows = accepted(reads).select("read_id", n_ids.alias("n_ids"), "seq")
    if on_short == "fail":
        short = F.raise_error(F.concat(F.lit(f"a read is shorter than {k}: "), "seq"))
        rows = rows.withColumn("seq", F.when(F.length("seq") >= k, F.col("seq")).otherwise(short))
    strands = F.array(F.col("seq"), dna.reverse_complement(F.col("seq"))) if reverse_complement else F.array("seq")
    first = _first_id(F.col("read_id").cast("long"), F.col("n_ids"), F.length("seq") - (k - 1))
    rows = rows.select(first.alias("first"), "n_ids", F.posexplode(strands).alias("strand", "s"))
    rows = rows.select((F.col("first") + F.shiftleft(F.col("n_ids"), readers.POSITIONS) * F.col("strand")).alias("first"), F.explode(dna.pieces(F.col("s"), k, **sizes)).alias("piece"))
    return rows.select((F.col("first") + F.col("piece.at")).alias("first"), F.col("piece.part").alias("part"))


def kmer_rows(reads: DataFrame, k: int, reverse_complement: bool = False, on_short: str = "fail") -> DataFrame:
    """(kmer, edge_id) of every window of every accepted read(read_id, seq), and of its reverse complement if asked for.

    A read has n_ids ids of its own from read_id on, one if the column is missing.
    """
    rows = _parts(reads, k, reverse_complement, on_short).select("first", F.posexplode(dna.windows(F.col("part"), k)).alias("pos", "kmer"))
    return rows.select("kmer", (F.col("first") + F.col("pos")).alias("edge_id"))


def as_edges(kmers: DataFrame, k: int) -> DataFrame:
    """kmers(edge_id, kmer, weight) as edges."""
    return kmers.select("edge_id", dna.source(F.col("kmer"), k).alias("src"), dna.target(F.col("kmer"), k).alias("dst"), F.col("kmer").alias("label"), F.col("weight").cast("long").alias("weight"))


def kmer_graph(reads: DataFrame, k: int, reverse_complement: bool = False, on_short: str = "fail") -> DataFrame:
    """Edges with the number of occurrences as weight: one exchange of packed runs of bases."""
    kmers = Kmers(_parts(reads, k, reverse_complement, on_short, small=_PIECE, large=8 * _PIECE), k)
    return _made_of(as_edges(kmers.table("edges"), k), kmers)


def kmer_spans(reads: DataFrame, k: int, reverse_complement: bool = False, on_short: str = "fail") -> DataFrame:
    """kmer, first_seen, last_seen: the smallest and largest edge id of each."""
    rows = kmers_of(kmer_graph(reads, k, reverse_complement, on_short)).table("edges")
    return rows.select("kmer", F.col("edge_id").alias("first_seen"), "last_seen")


def weighted_graph(kmers: DataFrame, k: int, reverse_complement: bool = False) -> DataFrame:
    """Edges of kmers(read_id, kmer, weight): each row is an edge of its own; parallel edges stay."""
    check_k(k)
    both = F.array("kmer", dna.reverse_complement(F.col("kmer"))) if reverse_complement else F.array("kmer")
    first = _first_id(F.col("read_id").cast("long"), F.lit(1).cast("long"), F.lit(1))
    rows = kmers.select(first.alias("first"), "weight", F.posexplode(both).alias("strand", "kmer"))
    return as_edges(rows.withColumn("edge_id", F.col("first") + F.shiftleft(F.col("strand").cast("long"), readers.POSITIONS)), k)


def edge_count(edges: DataFrame) -> Column:
    """How many edges a row stands for: one, but for contracted paths."""
    return F.col("n") if "n" in edges.columns else F.lit(1).cast("long")


def edge_total(edges: DataFrame) -> Column:
    """The summed weight of the edges that a row stands for."""
    return F.col("total") if "total" in edges.columns else F.col("weight")


def nodes(edges: DataFrame) -> DataFrame:
    if kmers := kmers_of(edges):
        return _made_of(kmers.table("nodes").select("node"), kmers)
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree: one aggregation over both ends of each edge."""
    if kmers := kmers_of(edges):
        return kmers.table("nodes").select("node", "in_degree", "out_degree")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def ambiguous_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("in_degree > 1 or out_degree > 1 or (in_degree = 0 and out_degree >= 1)").select("node")


def external_nodes(edges: DataFrame) -> DataFrame:
    """node, kind: input without incoming edges, else output without outgoing ones."""
    d = degrees(edges).where("in_degree = 0 or out_degree = 0")
    return d.select("node", F.when(F.col("in_degree") == 0, "input").otherwise("output").alias("kind"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, outgoing: array of (dst, weight, last_char, edge_id), ordered.  A node's edges are few: at most four by different bases, and its parallel ones."""
    if kmers := kmers_of(edges):
        return kmers.table("adjacency")
    item = F.struct("dst", "weight", dna.last_base(F.col("dst")).alias("last_char"), "edge_id")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(item)).alias("outgoing"))
    return nodes(edges).join(out, "node", "left").select("node", F.coalesce("outgoing", F.array().cast(out.schema["outgoing"].dataType)).alias("outgoing"))


def from_adjacency(adj: DataFrame) -> DataFrame:
    """Edges again; a label is its source followed by the last base of its target."""
    rows = adj.select("node", F.explode("outgoing").alias("e"))
    return rows.select(F.col("e.edge_id").alias("edge_id"), F.col("node").alias("src"), F.col("e.dst").alias("dst"), dna.from_nodes(F.col("node"), F.col("e.dst")).alias("label"), F.col("e.weight").alias("weight"))


def add_edge(outgoing, dst, weight, last_char, edge_id):
    return F.array_append(outgoing, F.struct(dst.alias("dst"), weight.alias("weight"), last_char.alias("last_char"), edge_id.alias("edge_id")))


def drop_edge_at(outgoing, position: int):
    return F.filter(outgoing, lambda _, i: i != position)


def drop_weak(outgoing, threshold: int):
    return F.filter(outgoing, lambda e: e["weight"] >= threshold)


def with_incoming(edges: DataFrame) -> DataFrame:
    """Nodes that some edge enters (semi join)."""
    if kmers_of(edges):
        return degrees(edges).where("in_degree > 0").select("node")
    return nodes(edges).join(edges.select(F.col("dst").alias("node")), "node", "left_semi")


def isolated_nodes(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches (anti join; nodes and light edges of one k-mer graph need none)."""
    of, kmers = kmers_of(all_nodes), kmers_of(edges)
    if of and kmers and of.parts is kmers.parts and of.k == kmers.k:
        return of.table("nodes").where(F.col("most") < F.lit(kmers.min_weight or 0)).select("node")
    return all_nodes.join(nodes(edges), "node", "left_anti")


def drop_weak_adjacency(adj: DataFrame, threshold: int) -> DataFrame:
    """The adjacency without light edges, then without nodes that are left alone."""
    left = adj.select("node", drop_weak(F.col("outgoing"), threshold).alias("outgoing"))
    hit = left.select(F.explode("outgoing.dst").alias("node")).distinct().withColumn("hit", F.lit(True))
    return left.join(hit, "node", "left").where("size(outgoing) > 0 or hit").select("node", "outgoing")


def remove_weak_edges(edges: DataFrame, threshold: int) -> DataFrame:
    """Edges of that weight at least; nodes exist by their edges, so lonely ones go with them."""
    kmers = kmers_of(edges)
    left = edges.where(F.col("weight") >= threshold)
    return _made_of(left, replace(kmers, min_weight=max(threshold, kmers.min_weight or threshold))) if kmers else left


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: counts, weights and degrees; averages of an empty graph are null.

    Edges are looked at once: their weights go with their source into the degrees' aggregation.
    Contracted paths count as the edges and inner nodes that they stand for.
    """
    most = F.col("most" if "most" in edges.columns else "weight")
    none = F.lit(None).cast("long")
    end = lambda node, i, o, n, total, top: F.struct(F.col(node).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"), n.alias("n"), total.alias("total"), top.alias("most"))
    ends = edges.select(F.explode(F.array(end("src", 0, 1, edge_count(edges), edge_total(edges), most), end("dst", 1, 0, none, none, none))).alias("e"))
    kmers = kmers_of(edges)
    d = kmers.table("nodes").select(F.col("in_degree").alias("i"), F.col("out_degree").alias("o"), F.col("out_degree").alias("n"), "total", "most") if kmers else ends.groupBy("e.node").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"), F.sum("e.n").alias("n"), F.sum("e.total").alias("total"), F.max("e.most").alias("most"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = d.agg(
        F.count(F.lit(1)).alias("ends"),
        zero(F.sum("o")).alias("rows"),
        zero(F.sum("n")).alias("edge_count"),
        zero(F.max("most")).alias("max_edge_weight"),
        (F.sum("total") / F.sum("n")).alias("avg_edge_weight"),
        zero(F.max("i")).alias("max_in_degree"),
        zero(F.max("o")).alias("max_out_degree"),
        zero(F.sum((F.col("i") == 0).cast("long"))).alias("incoming_vert_count"),
        zero(F.sum((F.col("o") == 0).cast("long"))).alias("outgoing_vert_count"),
    )
    one = one.withColumn("node_count", F.col("ends") + F.col("edge_count") - F.col("rows"))
    return one.select("node_count", "edge_count", "max_edge_weight", "avg_edge_weight", "max_in_degree", "max_out_degree", F.expr("try_divide(edge_count, node_count)").alias("avg_out_degree"), "incoming_vert_count", "outgoing_vert_count")


def adjacency_stats(adj: DataFrame) -> DataFrame:
    """Counts only; what an adjacency doesn't know is null."""
    null = lambda t, name: F.lit(None).cast(t).alias(name)
    return adj.agg(F.count(F.lit(1)).alias("node_count"), F.coalesce(F.sum(F.size("outgoing")), F.lit(0)).alias("edge_count")).select("node_count", "edge_count", null("long", "max_edge_weight"), null("double", "avg_edge_weight"), null("long", "max_in_degree"), null("long", "max_out_degree"), null("double", "avg_out_degree"), null("long", "incoming_vert_count"), null("long", "outgoing_vert_count"))


def label_stats(edges: DataFrame) -> DataFrame:
    """Average label length and what 2-bit packing would take and save."""
    packed = F.ceil(F.length("label") / 4) + 1
    return edges.agg(F.avg(F.length("label")).alias("avg_label"), F.sum(packed).alias("packed_bytes"), (100 * (1 - F.expr("try_divide(sum(ceil(length(label) / 4) + 1), sum(length(label)))"))).alias("saved_percent"))
