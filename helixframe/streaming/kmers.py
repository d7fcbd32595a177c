"""Streaming k-mer counts (an extension): the upsert of the batch graph as a stateful aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.sources.readers import check_k


def streaming_kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer, weight of a stream of reads(seq); write it in update or complete mode."""
    check_k(k)
    rows = reads.where(dna.is_dna(F.col("seq"))).select(F.explode(dna.windows(F.col("seq"), k)).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("weight"))
