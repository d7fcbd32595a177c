"""The whole assembly as one chain of operators."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import graph, paths
from helixframe.operators.contig_stats import contig_stats
from helixframe.operators.segments import edge_rows, segments
from helixframe.sources import readers, sinks
from helixframe.storage import materialize

log = logging.getLogger("helixframe")


@dataclass
class Assembly:
    """Contigs(contig_id, seq, len), their statistics and the length of the genome that those are relative to."""

    contigs: DataFrame
    stats: DataFrame
    original_genome_length: int

    def save(self, path: str, prefix: str = "contig") -> None:
        """A FASTA file if ``path`` ends in .fa, .fasta or .fna, else a folder of part files."""
        one = path.lower().endswith((".fa", ".fasta", ".fna"))
        (sinks.write_fasta_file if one else sinks.write_fasta)(self.contigs, path, prefix)


def assemble_graph(edges: DataFrame, k: int, genome: int, threshold: int, stages: dict | None = None, junction_degree: int = 3, prune_output_tips: bool = False) -> Assembly:
    """Prune, average, drop light edges, average, scale, prune, compact and collapse.

    The graph is contracted once, so that everything up to the labels works on its branches.
    ``stages`` receives each stage's edges; all but the first stand for whole paths (n, total).
    Each stage's statistics are logged at level DEBUG.
    """
    stages = {} if stages is None else stages

    def keep(name: str, df: DataFrame) -> DataFrame:
        log.info("%s", name)
        # a k-mer graph needs no table of its own: its paths come from its reads
        stages[name] = df = df if graph.kmers_of(df) else materialize(df, name)
        if log.isEnabledFor(logging.DEBUG):
            sinks.log_stats(graph.graph_stats(df))
        return df

    built = keep("built", edges)
    short, place = paths.contract(built)
    e = keep("pruned", paths.remove_dead_paths(short, k, prune_output_tips, junction_degree))
    e = graph.remove_weak_edges(paths.standardize_contigs(e), threshold)
    e = keep("averaged", paths.standardize_contigs(e))
    e = keep("scaled", paths.standardize_edges(e, genome, k, threshold))
    e = keep("final", paths.remove_dead_paths(e, k, prune_output_tips, junction_degree))
    contigs = materialize(paths.collapse_compact(keep("compact", _compact(built, place, e, k)), k), "contigs")
    return Assembly(contigs, contig_stats(contigs.select("len"), genome), genome)


def _compact(built: DataFrame, place: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """The paths of what is left as edges with labels, put together from the edges that were built."""
    u = paths.unitigs(left).withColumnRenamed("edge_id", "path_id").withColumnRenamed("dist", "before")
    if (pieces := segments(built)) is not None:
        rings = edge_rows(pieces.where("cyclic"), k).select(F.col("edge_id").alias("path_id"), F.lit(0).cast("long").alias("dist"), F.col("label").alias("seq"))
        rows = pieces.where("not cyclic").select(F.col("unitig_id").alias("path_id"), "dist", "seq").union(rings).join(u.join(left.select(F.col("edge_id").alias("path_id"), "weight"), "path_id"), "path_id")
        return paths.merged_pieces(rows.select("unitig_id", (F.col("before") + F.col("dist")).alias("dist"), "seq", F.array("weight").alias("weights")), k)
    at = place.join(u, "path_id").select("edge_id", F.col("unitig_id").alias("path_id"), (F.col("before") + F.col("dist")).alias("dist"))
    label = F.when(F.col("dist") == 0, F.col("label")).otherwise(dna.last_base(F.col("label")))
    labels = paths.merged_labels(built.select("edge_id", "label").join(at, "edge_id").select("path_id", "dist", label.alias("label")))
    rows = left.select(F.col("edge_id").alias("path_id"), "src", "dst", "weight").join(u, "path_id")
    ends = rows.groupBy("unitig_id").agg(F.min_by(F.struct("src", "weight"), "before").alias("first"), F.max_by("dst", "before").alias("dst"))
    return ends.join(labels, F.col("unitig_id") == F.col("path_id")).select(F.col("unitig_id").alias("edge_id"), "first.src", "dst", "label", "first.weight")


def build(spark: SparkSession, cfg: readers.Config, via_adjacency: bool = False) -> DataFrame:
    k, files = cfg.k_mer_size, list(cfg.input_files)
    if cfg.input_file_type is readers.InputFileType.BFCOUNTER:
        if via_adjacency:
            raise ValueError("weighted k-mers have no adjacency form")
        return graph.weighted_graph(readers.read_bfcounter(spark, files, cfg.minimal_weight_threshold, k), k, cfg.reverse_complement)
    edges = graph.kmer_graph(readers.read_reads(spark, files, cfg.input_file_type), k, cfg.reverse_complement)
    return graph.from_adjacency(graph.adjacency(edges)) if via_adjacency else edges


def assemble(spark: SparkSession, cfg: readers.Config, via_adjacency: bool = False) -> Assembly:
    """Read, assemble and write the contigs of a configuration."""
    began = time.monotonic()
    edges = build(spark, cfg, via_adjacency)
    if log.isEnabledFor(logging.DEBUG):
        sinks.log_stats(graph.label_stats(edges))
    out = assemble_graph(edges, cfg.k_mer_size, cfg.original_genome_length, cfg.minimal_weight_threshold)
    out.save(cfg.output_file)
    log.info("%d contigs", out.contigs.count())
    sinks.log_stats(out.stats, logging.INFO)
    log.info("assembled in %.1f s", time.monotonic() - began)
    return out


class Assemble(Protocol):
    """What an assembler offers: reads to contigs by a configuration, straight or by way of an adjacency table."""

    @staticmethod
    def assemble(spark: SparkSession, config: readers.Config) -> Assembly: ...

    @staticmethod
    def assemble_with_adjacency(spark: SparkSession, config: readers.Config) -> Assembly: ...


class BasicAsm:
    """The assembler of this module under the names of ``Assemble``."""

    @staticmethod
    def assemble(spark: SparkSession, config: readers.Config) -> Assembly:
        return assemble(spark, config)

    @staticmethod
    def assemble_with_adjacency(spark: SparkSession, config: readers.Config) -> Assembly:
        return assemble(spark, config, via_adjacency=True)


def set_up_logging(file: str | None = None) -> None:
    """Messages from INFO on to the console and, if a file is named, from DEBUG on to that."""
    log.setLevel(logging.DEBUG if file else logging.INFO)
    console = logging.StreamHandler()
    console.setLevel(logging.INFO)
    console.setFormatter(logging.Formatter("%(asctime)s - %(message)s", "%H:%M:%S"))
    handlers: list[logging.Handler] = [console]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(file))
        handlers[-1].setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
    for h in [*log.handlers]:
        log.removeHandler(h)
        h.close()
    for h in handlers:
        log.addHandler(h)
