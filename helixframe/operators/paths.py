"""Operators that follow paths: unitigs, compaction, standardisation, pruning, components, contigs.

Walks are never followed edge by edge.  Pointer doubling brings every edge to the head
of its path in as many rounds as the logarithm of the longest path; a round is one
equi-join of the edges that haven't arrived, on LONG ids, and is written to the shared
folder to cut lineage.

An edge may stand for a whole unbranched path of ``n`` edges with ``total`` weight; those
columns are 1 and the weight where they are missing.  ``contract`` makes such tables, on which
pruning and averaging need no more work than there are branches.

Paths of k-mer graphs come in pieces (``segments``); single edges are brought together only where
the result has a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators.graph import degrees, edge_count, edge_total
from helixframe.operators.segments import edge_rows, segments, with_mean
from helixframe.storage import materialize, release

#: Rows of a table that is broadcast: some 40 bytes each.
_FEW = 200_000
#: k-mers whose last bases are put together in one row before a label is.
_LABEL_CHUNK = 4096


def _through(edges: DataFrame) -> DataFrame:
    """Nodes with one edge in and one out."""
    return degrees(edges).where("in_degree = 1 and out_degree = 1").select("node")


def _doubled(here: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pointer doubling of here(edge_id, ptr, dist, low, done) until all are done or no more become so: (done, not done, written tables).

    Rows that are done are written once and stay as targets; only the others are joined, as
    a broadcast once they are few.  What is left when a round brings none home lies on
    cycles; there ``low`` has seen all of the cycle after as many rounds as that takes.
    """
    tables = [materialize(here, name)]
    before, rounds = None, 0
    while True:
        left = tables[-1].where("not done")
        count = left.count()
        stuck = count == before
        if not count or (stuck and 1 << rounds >= 2 * count):
            break
        before = count
        arrived = tables[0].where("done")
        for t in tables[1:]:
            arrived = arrived.union(t.where("done"))
        far = (left if stuck else arrived.union(left)).select(F.col("edge_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        near = left.drop("done")
        near = F.broadcast(near) if count <= _FEW else near
        step = far.join(near, "ptr").select("edge_id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        tables.append(materialize(step, name))
        rounds += 1
    arrived = tables[0].where("done")
    for t in tables[1:]:
        arrived = arrived.union(t.where("done"))
    return arrived, tables[-1].where("not done"), tables


def unitigs(edges: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """edge_id, unitig_id, dist, cyclic: the head edge of the maximal unbranched path an edge lies on, and its place there, in edges.

    ``through(node)`` restricts the nodes that a path may run through.  A cycle of such
    nodes only has no head: its edge with the smallest id is made one, and the path is
    marked cyclic.
    """
    if (pieces := segments(edges, through)) is not None:
        return pieces.select("unitig_id", F.col("dist").alias("before"), "cyclic", F.posexplode("ids").alias("at", "edge_id")).select("edge_id", "unitig_id", (F.col("before") + F.col("at")).alias("dist"), "cyclic")
    nodes = _through(edges)
    if through is not None:
        nodes = nodes.join(through.select("node"), "node", "left_semi")
    t = edges.join(nodes, F.col("src") == F.col("node"), "left_semi").select("edge_id", F.col("src").alias("at"))
    prev = edges.select(F.col("edge_id").alias("prev"), F.col("dst").alias("at"), edge_count(edges).alias("size"))
    step = materialize(t.join(prev, "at").select("edge_id", "prev", "size"), "unitig-steps")
    heads = edges.select("edge_id").join(step, "edge_id", "left_anti")
    heads = heads.select("edge_id", F.col("edge_id").alias("ptr"), F.lit(0).cast("long").alias("dist"), F.col("edge_id").alias("low"), F.lit(True).alias("done"))
    rest = step.select("edge_id", F.col("prev").alias("ptr"), F.col("size").cast("long").alias("dist"), F.least("edge_id", "prev").alias("low"), F.lit(False).alias("done"))
    arrived, ring, tables = _doubled(heads.union(rest), "unitig")
    out = arrived.select("edge_id", F.col("ptr").alias("unitig_id"), "dist", F.lit(False).alias("cyclic"))
    if ring.isEmpty():
        out = materialize(out, "unitigs")
        release(step, *tables)
        return out
    # Cycles: every edge knows the smallest id of its cycle by now; cut there and walk once more.
    cut = ring.select("edge_id", "low").join(step, "edge_id")
    first = F.col("edge_id") == F.col("low")
    again = cut.select("edge_id", F.when(first, F.col("edge_id")).otherwise(F.col("prev")).alias("ptr"), F.when(first, F.lit(0).cast("long")).otherwise(F.col("size").cast("long")).alias("dist"), "low", first.alias("done"))
    arrived, _, more = _doubled(again, "rings")
    out = materialize(out.unionByName(arrived.select("edge_id", F.col("ptr").alias("unitig_id"), "dist", F.lit(True).alias("cyclic"))), "unitigs")
    release(step, *tables, *more)
    return out


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that stand for unbranched paths, place(edge_id, path_id, dist) of every edge).

    Columns: edge_id (the path's first), last_id, src, dst, weight (of the first edge),
    n, total, most (the largest weight).  Edges of pure cycles stay edges of their own.
    """
    u = unitigs(edges)
    pieces = segments(edges)
    place = u.select("edge_id", F.when(F.col("cyclic"), F.col("edge_id")).otherwise(F.col("unitig_id")).alias("path_id"), F.when(F.col("cyclic"), F.lit(0)).otherwise(F.col("dist")).cast("long").alias("dist"))
    if pieces is not None:
        return materialize(_contracted(pieces, pieces._helixframe_k), "contracted"), place
    rows = edges.select("edge_id", "src", "dst", "weight", edge_count(edges).alias("n"), edge_total(edges).alias("total")).join(place, "edge_id")
    ends = rows.groupBy("path_id").agg(F.max_by(F.struct("edge_id", "dst"), "dist").alias("last"), F.min_by(F.struct("src", "weight"), "dist").alias("first"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("weight").alias("most"))
    out = ends.select(F.col("path_id").alias("edge_id"), F.col("last.edge_id").alias("last_id"), "first.src", "last.dst", "first.weight", "n", "total", "most")
    return materialize(out, "contracted"), place


def _contracted(pieces: DataFrame, k: int) -> DataFrame:
    """``contract`` of a graph in pieces."""
    first, last = F.struct(F.left("seq", F.lit(k - 1)).alias("src"), F.get("weights", F.lit(0)).alias("weight")), F.struct(F.element_at("ids", -1).alias("edge_id"), F.right("seq", F.lit(k - 1)).alias("dst"))
    ends = pieces.where("not cyclic").groupBy("unitig_id").agg(F.max_by(last, "dist").alias("last"), F.min_by(first, "dist").alias("first"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    out = ends.select(F.col("unitig_id").alias("edge_id"), F.col("last.edge_id").alias("last_id"), "first.src", "last.dst", "first.weight", "n", "total", "most")
    rings = edge_rows(pieces.where("cyclic"), k)
    return out.union(rings.select("edge_id", "edge_id", "src", "dst", "weight", F.lit(1).cast("long"), "weight", "weight"))


def _reweighted(edges: DataFrame, weight: Column) -> list[Column]:
    """The columns of ``edges`` with a new weight, the same for all edges that one stands for."""
    new = {"weight": weight, "total": weight * edge_count(edges), "most": weight}
    return [new[c].alias(c) if c in new else F.col(c) for c in edges.columns]


def standardize_contigs(edges: DataFrame) -> DataFrame:
    """Every edge of an unbranched path gets the path's mean weight, rounded half up; pure cycles keep theirs."""
    if (pieces := segments(edges)) is not None:
        mean = pieces.where("not cyclic").groupBy("unitig_id").agg(F.round(F.sum("total") / F.sum("n")).cast("long").alias("mean"))
        return with_mean(pieces, mean)
    u = unitigs(edges)
    rows = edges.join(u.select("edge_id", "unitig_id", "cyclic"), "edge_id")
    mean = rows.where("not cyclic").groupBy("unitig_id").agg(F.round(F.sum(edge_total(edges)) / F.sum(edge_count(edges))).cast("long").alias("mean"))
    out = rows.join(mean, "unitig_id", "left")
    return out.select(*_reweighted(edges, F.when(F.col("cyclic"), F.col("weight")).otherwise(F.col("mean"))))


def standardization_ratio(edges: DataFrame, genome: int, k: int, threshold: int) -> DataFrame:
    """One row: p = (genome - k) / (sum of weights - sum of weights under the threshold)."""
    if genome < k:
        raise ValueError(f"the genome, {genome}, is shorter than k, {k}")
    s = edges.agg(F.sum(edge_total(edges)).alias("s"), F.coalesce(F.sum(F.when(F.col("weight") < threshold, edge_total(edges))), F.lit(0)).alias("light"))
    return s.select(F.expr(f"try_divide(double({genome - k}), s - light)").alias("p"))


def standardize_edges(edges: DataFrame, genome: int, k: int, threshold: int) -> DataFrame:
    """Weights scaled to copies in the genome; edges that round to 0 stay with weight 1 if they had the threshold, else go."""
    p = standardization_ratio(edges, genome, k, threshold)
    scaled = F.round(F.col("weight") * F.col("p")).cast("long")
    w = F.when((scaled == 0) & (F.col("weight") >= threshold), F.lit(1).cast("long")).otherwise(scaled)
    return edges.crossJoin(F.broadcast(p)).select(*_reweighted(edges, w)).where("weight >= 1")


def merged_labels(parts: DataFrame) -> DataFrame:
    """(path_id, label) of parts(path_id, dist, label, head): the head's label and the last bases of the others in order.

    They are put together in chunks of neighbours first, so that no list is longer than a
    chunk or than the label has chunks.
    """
    chunk = F.floor(F.col("dist") / _LABEL_CHUNK).alias("chunk")
    joined = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "")
    pieces = parts.groupBy("path_id", chunk).agg(joined("dist", "label").alias("label"))
    return pieces.groupBy("path_id").agg(joined("chunk", "label").alias("label"))


def merged_pieces(pieces: DataFrame, k: int) -> DataFrame:
    """Edges of whole paths from their pieces(unitig_id, dist, seq, weights), in chunks like ``merged_labels``."""
    label = F.when(F.col("dist") == 0, F.col("seq")).otherwise(dna.remainder(F.col("seq"), k))
    rows = pieces.select("unitig_id", "dist", label.alias("label"), F.struct(F.left("seq", F.lit(k - 1)).alias("src"), F.get("weights", F.lit(0)).alias("weight")).alias("first"), F.right("seq", F.lit(k - 1)).alias("dst"))
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "label"))), lambda x: x["label"]), "").alias("label")
    ends = lambda at: [F.min_by("first", at).alias("first"), F.max_by("dst", at).alias("dst")]
    chunks = rows.groupBy("unitig_id", F.floor(F.col("dist") / _LABEL_CHUNK).alias("chunk")).agg(joined("dist"), *ends("dist"))
    return chunks.groupBy("unitig_id").agg(joined("chunk"), *ends("chunk")).select(F.col("unitig_id").alias("edge_id"), "first.src", "dst", "label", "first.weight")


def shrink(edges: DataFrame, k: int, through: DataFrame | None = None) -> DataFrame:
    """Every unbranched path becomes one edge: labels merged, weight of the first edge.

    ``through(node)`` restricts the nodes that are merged over.
    """
    if (pieces := segments(edges, through)) is not None:
        return merged_pieces(pieces, k)
    u = unitigs(edges, through)
    e = edges.join(u, "edge_id")
    tail = F.when(F.col("dist") == 0, F.col("label")).otherwise(dna.remainder(F.col("label"), k))
    labels = merged_labels(e.select(F.col("unitig_id").alias("path_id"), "dist", tail.alias("label")))
    ends = e.groupBy("unitig_id").agg(F.min_by(F.struct("src", "weight"), "dist").alias("first"), F.max_by("dst", "dist").alias("dst"))
    return ends.join(labels, F.col("unitig_id") == F.col("path_id")).select(F.col("unitig_id").alias("edge_id"), "first.src", "dst", "label", "first.weight")


def dead_path_edges(edges: DataFrame, k: int, junction_degree: int = 3, backwards: bool = False) -> DataFrame:
    """edge_id of one round's dead paths.

    From each node without incoming edges the walk takes the newest outgoing edge and
    ends at a node without outgoing edges or with ``junction_degree`` incoming ones.  It
    is dead with at most 2k-2 edges up to a sink, or 2k-1 up to such a junction.
    ``backwards`` walks against the edges, from nodes without outgoing ones.
    """
    if backwards:
        newest = F.col("last_id" if "last_id" in edges.columns else "edge_id")
        edges = edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), edge_count(edges).alias("n"), newest.alias("age"))
    else:
        edges = edges.select("edge_id", "src", "dst", edge_count(edges).alias("n"), F.col("edge_id").alias("age"))
    info = degrees(edges).join(edges.groupBy("src").agg(F.max_by("edge_id", "age").alias("first")).withColumnRenamed("src", "node"), "node", "left")
    info = materialize(info, "tips")
    e = edges.select("edge_id", "dst", "n").join(info, F.col("dst") == F.col("node"))
    junction = F.col("in_degree") >= junction_degree
    jump = e.select("edge_id", F.when(~junction, F.col("first")).alias("to"), F.col("n").cast("long").alias("n"), (junction & F.col("first").isNotNull()).alias("junction"))
    heads = info.where("in_degree = 0 and first is not null").select(F.col("first").alias("edge_id"))
    tables = [materialize(jump, "jump")]
    while 1 << (len(tables) - 1) < 2 * k:
        j = tables[-1]
        far = j.select(F.col("edge_id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("junction").alias("junction2"))
        here = j.join(far, "to", "left")
        tables.append(materialize(here.select("edge_id", F.when(F.col("n2").isNotNull(), F.col("to2")).alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce("junction2", "junction").alias("junction")), "jump"))
    end = tables[-1].where(F.col("to").isNull() & (F.col("n") <= F.when(F.col("junction"), 2 * k - 1).otherwise(2 * k - 2)))
    reached = heads.join(end.select("edge_id"), "edge_id", "left_semi").distinct()
    for j in tables[:-1]:
        reached = materialize(reached.union(reached.join(j, "edge_id").where("to is not null").select("to")).distinct(), "dead")
    release(info, *tables[1:-1])
    return reached


def remove_dead_paths(edges: DataFrame, k: int, prune_output_tips: bool = False, junction_degree: int = 3) -> DataFrame:
    """Rounds of dead_path_edges until one finds none; ``prune_output_tips`` does the same backwards too.

    A plain graph is contracted first, so that rounds work on its branches only.
    """
    if "n" not in edges.columns:
        short, place = contract(edges)
        left = remove_dead_paths(short, k, prune_output_tips, junction_degree)
        if left is short:
            return edges
        if (pieces := segments(edges)) is not None:
            kept = pieces.join(left.select(F.col("edge_id").alias("unitig_id")), "unitig_id", "left_semi")
            return edge_rows(kept, pieces._helixframe_k).select(*edges.columns)
        return materialize(edges.join(place.join(left.select(F.col("edge_id").alias("path_id")), "path_id", "left_semi").select("edge_id"), "edge_id", "left_semi"), "pruned")
    while True:
        dead = dead_path_edges(edges, k, junction_degree)
        if prune_output_tips:
            dead = dead.union(dead_path_edges(edges, k, junction_degree, True)).distinct()
        if dead.isEmpty():
            return edges
        edges = materialize(edges.join(dead, "edge_id", "left_anti"), "pruned")


def remove_paths(edges: DataFrame, edge_ids: DataFrame) -> DataFrame:
    return edges.join(edge_ids, "edge_id", "left_anti")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable without regard to direction, by alternating stars."""
    if (pieces := segments(edges)) is not None:
        return _piece_components(pieces, pieces._helixframe_k)
    own = edges.select(F.explode(F.array("src", "dst")).alias("u")).distinct()
    e = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "wcc")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = materialize(both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "wcc")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        e = materialize(large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct(), "wcc")
    return own.join(e, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _piece_components(pieces: DataFrame, k: int) -> DataFrame:
    """``weak_components`` by way of the ends of whole paths."""
    nodes = dna.windows(F.col("seq"), k - 1)
    paths = pieces.groupBy("unitig_id").agg(F.sum("n").alias("size"), F.min(F.array_min(nodes)).alias("low"), F.min_by(F.left("seq", F.lit(k - 1)), "dist").alias("src"), F.max_by(F.right("seq", F.lit(k - 1)), "dist").alias("dst"), F.bool_or("cyclic").alias("ring"))
    paths = materialize(paths, "paths")
    ends = materialize(weak_components(paths.where("not ring").select("src", "dst")), "ends")
    at = paths.join(ends, F.col("src") == F.col("node"), "left").select("unitig_id", "size", "low", "ring", F.coalesce("component", "low").alias("of"), (F.col("component").isNull()).alias("alone"))
    named = at.groupBy("of", "alone").agg(F.min("low").alias("component"))
    at = materialize(at.join(named, ["of", "alone"]).select("unitig_id", "size", "ring", "of", "component"), "named")
    ends = ends.withColumnRenamed("component", "of").join(at.where("not ring").select("of", "component").distinct(), "of").select("node", "component")
    # inner nodes: the targets of all edges but a path's last
    inner = pieces.select("unitig_id", "dist", F.posexplode(nodes).alias("at", "node")).join(at, "unitig_id").where("at > 0 and (ring or dist + at < size)")
    return ends.union(inner.select("node", "component"))


def collapse(edges: DataFrame, k: int) -> DataFrame:
    """contigs(contig_id, seq, len): the compacted graph's edges, each as often as its weight, glued at loops.

    Without loops a contig is an edge label.  At a node with a loop edge S (weight s), at
    most one other edge in, A, and one out, B, one contig runs A S^s, and on through B if
    A has weight 1 or there is no A; the other copies of A and B stand alone.  If B leads
    to another such node, that contig runs on.  A loop over two nodes, b to c and back,
    with one more edge into b and the way back lighter than the way there, gives one
    contig A, there, back, there.  Loops that lead to each other in a ring have no first
    one: the contig starts at the ring's smallest node, and ends there after one turn.  Ids
    count by falling length, then sequence.
    """
    return collapse_compact(shrink(edges, k), k)


def collapse_compact(compact: DataFrame, k: int) -> DataFrame:
    """``collapse`` of a graph whose unbranched paths are edges already."""
    e = materialize(compact, "compact")
    d = materialize(degrees(e), "degrees")
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("edge_id").alias("s_id"), F.col("label").alias("s_label"), F.col("weight").alias("s"))
    one = d.where("in_degree <= 2 and out_degree <= 2").select("node")
    loops = loops.groupBy("node").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("s_id", "s_label", "s")]).where("c = 1").drop("c").join(one, "node", "left_semi")
    plain = e.where("src <> dst")
    a = plain.select(F.col("dst").alias("node"), F.col("edge_id").alias("a_id"), F.col("label").alias("a_label"), F.col("weight").alias("p"))
    b = plain.select(F.col("src").alias("node"), F.col("edge_id").alias("b_id"), F.col("label").alias("b_label"), F.col("dst").alias("b_dst"))
    x = materialize(loops.join(a, "node", "left").join(b, "node", "left").withColumn("glue", F.col("b_id").isNotNull() & (F.col("p").isNull() | (F.col("p") == 1))), "loops")
    # A two-node loop
    f = plain.select("edge_id", "src", "dst", "label", "weight").alias("f")
    r = plain.alias("r")
    pair = f.join(r, (F.col("f.src") == F.col("r.dst")) & (F.col("f.dst") == F.col("r.src")) & (F.col("r.weight") < F.col("f.weight")))
    pair = pair.select(F.col("f.edge_id").alias("f_id"), F.col("r.edge_id").alias("r_id"), F.col("f.src").alias("node"), F.col("f.dst").alias("c"), F.col("f.label").alias("f_label"), F.col("r.label").alias("r_label"))
    pair = pair.join(d.where("in_degree = 2 and out_degree = 1").select("node"), "node", "left_semi").join(d.where("in_degree = 1 and out_degree = 2").select(F.col("node").alias("c")), "c", "left_semi")
    pair = materialize(pair.join(a, "node").where("a_id <> r_id"), "pairs")
    used = pair.select(F.explode(F.array("a_id", "f_id", "f_id", "r_id")).alias("edge_id"))
    glued = pair.select(F.concat("a_label", dna.remainder(F.col("f_label"), k), dna.remainder(F.col("r_label"), k), dna.remainder(F.col("f_label"), k)).alias("seq"))
    if not x.isEmpty():
        used = used.union(x.select(F.explode(F.array_compact(F.array("a_id", F.when(F.col("glue"), F.col("b_id"))))).alias("edge_id")).distinct()).union(x.select(F.explode(F.expr("array_repeat(s_id, int(s))")).alias("edge_id")))
        nxt = x.where("glue").select(F.col("node").alias("from"), F.col("b_dst").alias("node"))
        entered = x.join(nxt, "node", "left_semi").select("node")
        ring = F.repeat(dna.remainder(F.col("s_label"), k), F.col("s").cast("int"))
        body = F.when(F.col("a_label").isNotNull(), F.concat("a_label", ring)).otherwise(F.concat(F.left("s_label", F.lit(k - 1)), ring))
        on = F.when(F.col("glue"), dna.remainder(F.col("b_label"), k)).otherwise("")
        start = x.join(entered, "node", "left_anti")
        next_ = F.when(F.col("glue"), F.col("b_dst"))
        more = x.select(F.col("node").alias("at"), F.concat(ring, on).alias("tail"), next_.alias("next"))
        chain, seen = _chains(start.select(F.concat(body, on).alias("seq"), next_.alias("at"), F.lit(None).cast("string").alias("stop")), more)
        glued = glued.union(chain)
        alone = materialize(x.join(start.select("node").union(seen), "node", "left_anti"), "rings")
        if not alone.isEmpty():
            turn = _ring_starts(alone.select("node", F.col("b_dst").alias("next")))
            first = alone.join(turn, "node").select(F.concat(F.left("s_label", F.lit(k - 1)), ring, on).alias("seq"), F.col("b_dst").alias("at"), F.col("node").alias("stop"))
            glued = glued.union(_chains(first, more)[0])
    taken = used.groupBy("edge_id").agg(F.count(F.lit(1)).alias("taken"))
    rest = e.join(taken, "edge_id", "left").select("label", (F.col("weight") - F.coalesce("taken", F.lit(0))).alias("n")).where("n > 0")
    seqs = rest.select(F.explode(F.expr("array_repeat(label, int(n))")).alias("seq")).union(glued)
    return number_contigs(seqs)


def _chains(chain: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq of the chains(seq, at, stop), nodes passed): each runs on over more(at, tail, next) until there is no next, or ``stop`` is."""
    seen = chain.select(F.lit(None).cast("string").alias("node")).limit(0)
    chain = materialize(chain, "chains")
    while True:
        step = chain.where("stop is null or at <> stop").join(more, "at")
        if step.isEmpty():
            return chain.select("seq"), seen
        seen = seen.union(step.select("at"))
        ended = chain.where("stop is null or at is null or at <> stop").join(more, "at", "left_anti").union(chain.where("stop is not null and at = stop").select("at", "seq", "stop"))
        chain = materialize(step.select(F.concat("seq", "tail").alias("seq"), F.col("next").alias("at"), "stop").union(ended.select("seq", "at", "stop")), "chains")


def _ring_starts(ring: DataFrame) -> DataFrame:
    """The smallest node of each ring(node, next)."""
    ring = materialize(ring.withColumn("low", F.least("node", "next")), "ring")
    n, steps = ring.count(), 1
    while steps < n:
        far = ring.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        ring = materialize(ring.join(far, "next").select("node", F.col("next2").alias("next"), F.least("low", "low2").alias("low")), "ring")
        steps *= 2
    return ring.where("node = low").select("node")


def number_contigs(seqs: DataFrame) -> DataFrame:
    """contig_id by falling length, then sequence, without a window over all rows: ranges are sorted and numbered apart."""
    s = materialize(seqs.select(F.length("seq").cast("long").alias("len"), "seq").orderBy(F.desc("len"), "seq").withColumn("at", F.monotonically_increasing_id()), "contigs")
    parts = s.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return s.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part").select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("contig_id"), "seq", "len")
