"""Packing by optimal length buckets.

Texts longer than ``max_len`` tokens are cut into pieces of ``max_len``; the histogram
of piece lengths, at most max_len + 1 rows whatever the input, goes to the driver; a
dynamic program picks the bucket boundaries with the least padding; inside each bucket
the pieces are numbered, in hash order or that of the input's files, and every floor(budget / boundary) of them form a
batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_file_order, materialize, ranked, ranked_in_file_order, words_col


def best_boundaries(hist: dict[int, int], buckets: int) -> tuple[list[int], int]:
    """Boundaries (ascending, the last is the largest length) with the least total padding, and that padding.

    cost[k][j]: the least padding of the lengths up to the j-th with k buckets; the next
    bucket takes the lengths i+1..j and pads them to the j-th.  Fewer buckets than asked
    for are used if there are fewer lengths.
    """
    lens = np.array(sorted(hist), np.int64)
    if not len(lens):
        return [], 0
    n = np.array([hist[int(x)] for x in lens], np.int64)
    rows = np.concatenate([[0], np.cumsum(n)])
    tokens = np.concatenate([[0], np.cumsum(n * lens)])
    k_max = min(buckets, len(lens))
    cost = lens * rows[1:] - tokens[1:]  # one bucket for lengths 0..j
    back = []
    for _ in range(1, k_max):
        new, arg = cost.copy(), np.full(len(lens), -1)
        for j in range(1, len(lens)):
            c = cost[:j] + lens[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(c.argmin())
            if c[i] < new[j]:
                new[j], arg[j] = c[i], i
        back.append(arg)
        cost = new
    out, j = [], len(lens) - 1
    for arg in reversed(back):
        if arg[j] >= 0:
            out.append(int(lens[j]))
            j = int(arg[j])
    out.append(int(lens[j]))
    return out[::-1], int(cost[-1])


def pack(docs: DataFrame, buckets: int = 16, max_len: int = 2048, budget: int = 65536, length_col: str | None = None, keep_order: bool = False) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text, ...)``: doc_id, piece, start_token, n_tokens, bucket, bucket_len, batch, row_in_batch.

    The tokens are the words of the text, or ``length_col`` holds their number (null or
    negative: 0).  Pieces of a text follow each other without gap or overlap; a null or
    empty text is one piece of 0 tokens, so every row of ``docs`` is in the result.
    Batches of a bucket hold floor(budget / bucket_len) rows, so padded batches stay
    within the budget; the last of a bucket may be smaller.  Repeated rows are packed
    each; ties of the hash order are rows alike in (doc_id, piece).  With ``keep_order``
    the batches of a bucket take its pieces in the order of the files that ``docs`` was
    read from, so that a mixture that was written in order stays mixed.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    if not 0 < max_len <= budget:
        raise ValueError("0 < max_len <= budget is needed")
    size = F.size(words_col(F.col("text"))) if length_col is None else F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0))
    at = ["_rank_chunk", "_rank_row"] if keep_order else []
    whole = (in_file_order(docs) if keep_order else docs).select(*at, F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"))
    # written once: the steps below read lengths only, no texts
    whole = materialize(whole, "pack-lengths")
    last = F.greatest(F.ceil(F.col("size") / max_len) - 1, F.lit(0))
    piece = whole.select(*at, "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    piece = piece.select(*at, "doc_id", "piece", (F.col("piece") * max_len).alias("start_token"), F.least(F.lit(max_len).cast("long"), F.col("size") - F.col("piece") * max_len).alias("n_tokens"))
    hist = {r[0]: r[1] for r in piece.groupBy("n_tokens").count().collect()}
    bounds, _ = best_boundaries(hist, buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(max_len).cast("long"))
    out = piece.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("n_tokens"))))
    out = out.withColumn("bucket_len", F.element_at(edges, F.col("bucket") + 1))
    number = ranked_in_file_order if keep_order else ranked
    out = number(out, ["bucket"], "_rank", ["doc_id", "piece"])
    per = F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))
    return out.select("doc_id", "piece", "start_token", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / per).alias("batch"), (F.col("_rank") % per).alias("row_in_batch"))


def ctes(docs: str, out: str, order: str, buckets: int = 16, max_len: int = 2048, budget: int = 65536) -> str:
    """SQL: CTEs that end with ``out``, the pieces of ``docs``(doc_id, text, ...); ``order`` is what numbers the pieces of a bucket.

    The dynamic program is a recursion over the number of buckets: of equal costs the one
    with fewer buckets, then the earlier boundary is taken.
    """
    return f"""{out}_size AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size FROM {docs}),
{out}_piece AS MATERIALIZED (SELECT *, least({max_len}, size - {max_len} * piece) AS n_tokens FROM (SELECT *, unnest(range(0, greatest((size + {max_len - 1}) // {max_len}, 1))) AS piece FROM {out}_size)),
{out}_len AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_tokens) - 1 AS j, n_tokens AS len, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS r, CAST(sum(count(*) * n_tokens) OVER (ORDER BY n_tokens) AS BIGINT) AS t FROM {out}_piece GROUP BY n_tokens),
{out}_dp AS (
  SELECT CAST(1 AS BIGINT) AS k, j, {{'c': len * r - t, 'i': CAST(-1 AS BIGINT)}} AS best FROM {out}_len
  UNION ALL
  SELECT d.k + 1, b.j, min(CASE WHEN d.j = b.j THEN {{'c': d.best.c, 'i': CAST(-1 AS BIGINT)}} ELSE {{'c': d.best.c + b.len * (b.r - a.r) - (b.t - a.t), 'i': d.j}} END)
  FROM {out}_dp d JOIN {out}_len a ON a.j = d.j JOIN {out}_len b ON d.j <= b.j WHERE d.k < least({buckets}, (SELECT count(*) FROM {out}_len)) GROUP BY d.k, b.j),
{out}_back AS (
  SELECT max(k) AS k, max(j) AS j FROM {out}_dp
  UNION ALL
  SELECT b.k - 1, CASE WHEN d.best.i >= 0 THEN d.best.i ELSE b.j END FROM {out}_back b JOIN {out}_dp d ON d.k = b.k AND d.j = b.j WHERE b.k > 1),
{out}_bound AS (SELECT list(DISTINCT len ORDER BY len) AS bounds FROM {out}_back JOIN {out}_len USING (j)),
{out}_in AS (SELECT p.*, len(list_filter(bounds, lambda x: x < n_tokens)) AS bucket, bounds FROM {out}_piece p, {out}_bound),
{out}_at AS (SELECT *, bounds[bucket + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY {order}) - 1 AS {out}_row FROM {out}_in),
{out} AS (SELECT doc_id, piece, piece * {max_len} AS start_token, n_tokens, CAST(bucket AS INT) AS bucket, bucket_len, {out}_row // ({budget} // greatest(bucket_len, 1)) AS batch, {out}_row % ({budget} // greatest(bucket_len, 1)) AS row_in_batch FROM {out}_at)"""


#: DuckDB SQL for the query's rows.
ORACLE = f"WITH RECURSIVE {ctes('documents', 'packed', 'md5(concat_ws(chr(58), doc_id, piece)), doc_id NULLS FIRST, piece')} SELECT * FROM packed"
