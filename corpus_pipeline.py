"""The corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``, and any others, whatever their names.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from helixframe.llm.common import materialize


def by_id(docs: DataFrame) -> DataFrame:
    """document (all columns), doc_id (LONG, of one row only) and text of each row.

    That is the doc_id where ids are unique; if some repeat or are null, the table is written
    with a number for every row instead, so that each row can be judged by itself.
    """
    whole = docs.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = whole.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    return whole if n[0] == n[1] else materialize(whole.withColumn("doc_id", F.monotonically_increasing_id()), "numbered-rows")


def kept_rows(whole: DataFrame, kept: DataFrame) -> DataFrame:
    return whole.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").select("document.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines removed and n_chars counted again.

    Null and empty texts go.  Repeated rows are judged each.  An empty table gives an empty one.
    """
    return quality.passing(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id.

    Null and empty texts are one group.  Where ids repeat or are null, rows are numbered and
    the first number stays, so one row stays of repeated rows, too.  An empty table gives an empty one.
    """
    whole = by_id(docs)
    return kept_rows(whole, exact_dedup.exact_dedup(whole).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, or number as in exact_stage.

    Null and empty texts stay, as they are linked with nothing.  An empty table gives an empty one.
    """
    whole = by_id(docs)
    return kept_rows(whole, near_dedup.near_dedup(whole).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: the files of the result, read in order, give it.

    A null source is a source of its own.  Repeated rows and null ids stay.  An empty table gives an empty one.
    """
    rows = docs.select(F.struct(*docs.columns).alias("document"), "doc_id", "source")
    return mixing.mix_sources(rows).orderBy("mix_slot", "mix_pos").select("document.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their buckets and batches, which follow the order of the mixture.

    Null and empty texts are a piece of no tokens.  Repeated rows and null ids are packed each.
    An empty table gives an empty one.
    """
    return packing.pack(docs, keep_order=True)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: DuckDB SQL for the rows of ``run``, stage by stage, for small tables; ids are unique there.
ORACLE_SQL = f"""
WITH RECURSIVE {quality.ctes("documents", "judged")},
clean AS MATERIALIZED (SELECT doc_id, source, clean_text AS text FROM judged WHERE kept),
single AS MATERIALIZED (SELECT * FROM clean QUALIFY doc_id = min(doc_id) OVER (PARTITION BY {exact_dedup.SQL_TEXT})),
{near_dedup.ctes("single", "near")},
apart AS MATERIALIZED (SELECT * FROM single WHERE doc_id IN (SELECT doc_id FROM near WHERE kept)),
{mixing.ctes("apart", "mixed")},
{packing.ctes("mixed", "packed", "mix_slot, mix_pos, piece")}
SELECT * FROM packed
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
