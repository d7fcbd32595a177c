"""N50, L50, N90 and NG50 of contig lengths.

Lengths are first counted into one row for each different length, so the running sums go
over distinct lengths only, not over contigs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contig_stats(lengths: DataFrame, genome: int) -> DataFrame:
    """One row (n50, l50, n90, ng50) of lengths(len); zeros for an empty input.

    Running sums ascend, also for NG50; a metric is the length at which the sum first
    reaches its tipping point, or the largest.  L50 counts from the largest down.
    """
    h = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    up, down = Window.orderBy("len"), Window.orderBy(F.desc("len"))
    mass = F.col("len") * F.col("n")
    h = h.select("len", "n", F.sum(mass).over(up).alias("asc"), F.sum(mass).over(down).alias("desc"))
    total = F.sum(mass).over(Window.partitionBy())
    h = h.withColumn("total", total)
    at = lambda tip: F.coalesce(F.min(F.when(F.col("asc") >= tip, F.col("len"))), F.max("len"), F.lit(0))
    half = F.floor(F.col("total") / 2)
    # of the lengths whose sum from the top has not yet reached the half, how many contigs are needed
    above = F.col("desc") - mass
    need = F.when(above >= half, 0).otherwise(F.least(F.col("n"), F.ceil((half - above) / F.col("len"))))
    return h.agg(at(half).cast("long").alias("n50"), F.coalesce(F.sum(need), F.lit(0)).cast("long").alias("l50"), at(F.floor(F.col("total") * F.lit(0.1))).cast("long").alias("n90"), at(F.lit(genome // 2)).cast("long").alias("ng50"))
