"""Exact deduplication in three combining steps, with DataFrame functions only.

1. The partial aggregate of each task deduplicates the rows it has read (local).
2. The salted groups (digest, salt, text) merge what the tasks found; a group of any
   size is spread over ``salts`` keys, and the text itself is part of the key, so full
   contents are compared.
3. The salt winners, at most ``salts`` a group, are combined by (digest, text).

Only ids and counts are aggregated; no group is ever gathered in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import WS, join_counted, materialize


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " ")


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised texts are.  The row with the smallest doc_id
    stays; rows with a null doc_id never win against one that has an id, and stay
    (keep_id null) if the whole group has none.  Repeats of a row share its verdict.
    Two different texts with one SHA-256 digest stop the job, as they can't be told
    apart in the result.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("_text"))
    rows = rows.select("doc_id", "_text", F.unhex(F.sha2("_text", 256)).alias("_digest"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("_digest", "_salt", "_text").agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = merged.groupBy("_digest", "_text").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    by_digest = groups.groupBy("_digest").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    by_digest = materialize(by_digest, "exact-groups")
    alone = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two different texts have one SHA-256 digest")).cast("long")).otherwise(F.col("group_size"))
    n = by_digest.agg(F.sum("group_size")).first()[0] or 0
    out = join_counted(rows.select("doc_id", "_digest"), by_digest, ["_digest"], "group_size", n)
    return out.select(
        "doc_id",
        "keep_id",
        alone.alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


#: SQL: the normal text.
SQL_TEXT = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH d AS (SELECT doc_id, {SQL_TEXT} AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
