"""Reads from FASTA, FASTQ, weighted k-mer tables and Parquet, and the run configuration.

Text sources are split like any text file.  A record's number in its file comes from the
start of its file block and its place in the block, so no file is read in one task.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.dna import is_dna

#: Bits of an edge id that hold the position in a read.
POSITIONS = 20


class InputFileType(Enum):
    """Names are read in any case."""

    FASTA = "fasta"
    FASTQ = "fastq"
    BFCOUNTER = "bfcounter"

    @classmethod
    def _missing_(cls, value):
        return next((x for x in cls if isinstance(value, str) and x.value == value.lower()), None)


@dataclass(frozen=True)
class Config:
    input_files: tuple[str, ...]
    input_file_type: InputFileType
    output_file: str
    original_genome_length: int
    minimal_weight_threshold: int
    k_mer_size: int = 40
    reverse_complement: bool = False

    def __post_init__(self):
        check_k(self.k_mer_size)


def check_k(k: int) -> int:
    if k < 3:
        raise ValueError(f"k must be 3 at least, not {k}")
    return k


def load_config(path: str) -> Config:
    """The configuration in a TOML file; a missing file is an error."""
    return parse_config(Path(path).read_text(encoding="utf-8"))


def parse_config(text: str) -> Config:
    """TOML with the keys of Config; a missing key or an unknown format is an error, other keys are ignored."""
    got = tomllib.loads(text)
    got = {k: v for k, v in got.items() if k in {x.name for x in fields(Config)}}
    got["input_files"] = tuple(got["input_files"])
    got["input_file_type"] = InputFileType(got["input_file_type"])
    return Config(**got)


def check_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Every path must name an existing file, on whatever file system."""
    if not paths:
        raise ValueError("no input files")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        at = hadoop.Path(p)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(at):
            raise FileNotFoundError(p)
        if not store.getFileStatus(at).isFile():
            raise IsADirectoryError(p)
    return list(paths)


def _numbered(lines: DataFrame) -> DataFrame:
    """(file, n, value): the 0-based number of each line in its file."""
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("n"), "value")


def _with_ids(records: DataFrame) -> DataFrame:
    """read_id, n_ids: records(file, n, ...) numbered without gaps between files, by file and record.

    A read is given as many ids as it has runs of 2^POSITIONS bases (as the longest of its
    file, one at least), so that ids with positions behind them stay apart: n_ids from
    read_id on.
    """
    most = F.max(F.length("seq")) if "seq" in records.columns else F.lit(0)
    files = records.groupBy("file").agg((F.max("n") + 1).cast("long").alias("size"), F.greatest(F.ceil(F.coalesce(most, F.lit(0)) / (1 << POSITIONS)), F.lit(1)).cast("long").alias("n_ids"))
    before = F.sum(F.col("size") * F.col("n_ids")).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", "n_ids", F.coalesce(before, F.lit(0)).alias("before"))
    # not hinted: there may be any number of files
    return records.join(files, "file").withColumn("read_id", F.col("before") + F.col("n") * F.col("n_ids")).drop("n", "before")


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read_id, n_ids, file, seq: the second of every four lines."""
    lines = _numbered(spark.read.text(check_files(spark, paths)))
    return _with_ids(lines.where("n % 4 = 1").select("file", F.floor(F.col("n") / 4).alias("n"), F.regexp_replace("value", r"\s+$", "").alias("seq")))


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read_id, n_ids, file, seq: records begin at ``>``; the lines behind the header are joined."""
    rec = _numbered(spark.read.option("lineSep", "\n>").text(check_files(spark, paths))).where(F.length(F.trim("value")) > 0)
    body = F.substring_index("value", "\n", 1)
    return _with_ids(rec.select("file", "n", F.regexp_replace(F.substring("value", F.length(body) + 1, F.length("value")), r"\s+", "").alias("seq")))


def read_bfcounter(spark: SparkSession, paths: list[str], min_weight: int = 0, k: int | None = None, only_dna: bool = False) -> DataFrame:
    """read_id, kmer, weight of a table kmer<TAB>count: lighter rows go, a count that is no number or a wrong length is an error.

    k-mers are taken as they are; ``only_dna`` drops those with other letters than A, C, G and T.
    """
    raw = _numbered(spark.read.text(check_files(spark, paths)))
    cell = F.split("value", "\t")
    rows = raw.where(F.length("value") > 0).select("file", "n", cell[0].alias("kmer"), F.trim(F.get(cell, F.lit(1))).alias("count"))
    bad = F.raise_error(F.concat(F.lit("not a count: "), F.coalesce("count", F.lit("")))).cast("long")
    rows = rows.select("file", "n", "kmer", F.when(F.coalesce(F.rlike("count", F.lit("^[0-9]{1,18}$")), F.lit(False)), F.expr("try_cast(count as bigint)")).otherwise(bad).alias("weight"))
    rows = rows.where(F.col("weight") >= min_weight)
    if only_dna:
        rows = rows.where(is_dna(F.col("kmer")))
    if k is not None:
        rows = rows.withColumn("kmer", F.when(F.length("kmer") == k, F.col("kmer")).otherwise(F.raise_error(F.concat(F.lit("k-mer of another length: "), "kmer"))))
    return _with_ids(rows).select("read_id", "file", "kmer", "weight")


def read_reads(spark: SparkSession, paths: list[str], kind: InputFileType | str) -> DataFrame:
    kind = InputFileType(kind)
    if kind is InputFileType.BFCOUNTER:
        raise ValueError("weighted k-mers are read with read_bfcounter")
    return read_fasta(spark, paths) if kind is InputFileType.FASTA else read_fastq(spark, paths)
