"""Sinks: contigs as FASTA, graphs as DOT or as a plain dump, and statistics in words."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import nodes

log = logging.getLogger("helixframe")


def fasta_lines(contigs: DataFrame, prefix: str = "contig") -> DataFrame:
    """contigs(contig_id, seq) as records: a header line and one unwrapped sequence line."""
    return contigs.select("contig_id", F.concat(F.lit(f">{prefix}_"), F.col("contig_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta(contigs: DataFrame, path: str, prefix: str = "contig") -> None:
    """A folder of FASTA part files in the order of contig_id."""
    fasta_lines(contigs, prefix).orderBy("contig_id").select("value").write.mode("overwrite").text(path)


def write_fasta_file(contigs: DataFrame, path: str, prefix: str = "contig") -> None:
    """One FASTA file in the order of contig_id, in place of any that is there.

    The parts are written by all executors; the driver's file system only appends them to
    each other, as bytes, in their order.
    """
    spark = contigs.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    write_fasta(contigs, parts, prefix)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, to = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in store.listStatus(folder) if x.getPath().getName().startswith("part-"))
    out = store.create(to, True)
    for name in names:
        src = store.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 16, False)
        src.close()
    out.close()
    store.delete(folder, True)


def dot_node_lines(edges: DataFrame) -> DataFrame:
    """One DOT statement for each node."""
    return nodes(edges).select(F.format_string('    "%s"', "node").alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """One DOT statement for each edge."""
    return edges.select(F.format_string('    "%s" -> "%s" [ label = "%s (%d)" ]', "src", "dst", "label", "weight").alias("value"))


def write_dot(edges: DataFrame, path: str) -> None:
    """A folder of part files that make a DOT graph when read in order: the head, nodes, edges, the tail; without sorting."""
    spark = edges.sparkSession
    head, tail = (spark.createDataFrame([(x,)], "value string").coalesce(1) for x in ("digraph {", "}"))
    head.union(dot_node_lines(edges)).union(dot_lines(edges)).union(tail).write.mode("overwrite").text(path)


def dump(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.col("label"), F.lit(" X weight "), F.col("weight").cast("string")).alias("value"))


def describe(stats: DataFrame) -> str:
    """A one-row statistics table as lines; unknown values are ``??``."""
    row = stats.first().asDict()
    lines = [f"{k}: {'??' if v is None else v}" for k, v in row.items()]
    n = row.get("node_count")
    for part in ("incoming_vert_count", "outgoing_vert_count"):
        if n and row.get(part) is not None:
            lines.append(f"{part} of nodes: {100 * row[part] / n:.2f} %")
    return "\n".join(lines)


def log_stats(stats: DataFrame, level: int = logging.DEBUG) -> None:
    log.log(level, "%s", describe(stats))


def print_stats(stats: DataFrame) -> None:
    print(describe(stats))
