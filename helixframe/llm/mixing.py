"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks of ``block`` rows, in the order of the hashes of their ids.  Weights
are exact fractions w_s that sum to 1.  Block j of source s (from 0) may not run before
slot floor(j / w_s) and must have run by slot ceil((j+1) / w_s); earliest deadline first
among released blocks meets all windows, hence after every slot each source that still
has blocks has had its share to within less than one block.

Every block there is gets its slot from one such run, in integers of any size.  A single
task does it and streams the schedule out, so its memory depends on the number of sources
and its time on the number of blocks.  A source that has run out releases no more; slots
in which nothing is released stay empty, so nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, ranked

MIX_COLUMNS = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_pos")
_PLAN = "mix_source string, mix_block long, mix_slot long, mix_release long, mix_deadline long"


def quantise(weights: dict, period: int) -> dict:
    """Whole slots for each source that sum to ``period``: largest remainders, at least one each."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources don't fit in a period of {period} slots")
    total = float(sum(weights.values()))
    exact = {s: period * w / total for s, w in weights.items()}
    q = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (q[s] - exact[s], str(s)))
    while sum(q.values()) < period:
        for s in order[: period - sum(q.values())]:
            q[s] += 1
    while sum(q.values()) > period:
        q[max((s for s in q if q[s] > 1), key=lambda s: (q[s] - exact[s], str(s)))] -= 1
    return q


def whole(weights: dict) -> dict:
    """Positive integers in exactly the proportion of the weights."""
    bad = [s for s, x in weights.items() if not (math.isfinite(x) and x > 0)]
    if bad:
        raise ValueError(f"weights must be positive and finite, unlike that of {bad[0]!r}")
    exact = {s: Fraction(x) for s, x in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def pfair(q: dict, blocks: dict) -> Iterator[tuple]:
    """(source, j, slot, release, deadline) of all ``blocks`` of the sources, by earliest deadline first; whole weights q."""
    total = sum(q.values())
    names = sorted(q, key=lambda s: (s is None, str(s)))
    later = [(0, k, 0) for k, s in enumerate(names) if blocks[s]]  # (release, source, j)
    heapq.heapify(later)
    ready: list[tuple] = []
    slot = 0
    while later or ready:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            r, k, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-(j + 1) * total // q[names[k]]), k, j, r))
        due, k, j, r = heapq.heappop(ready)
        s = names[k]
        yield s, j, slot, r, due
        if j + 1 < blocks[s]:
            heapq.heappush(later, ((j + 1) * total // q[s], k, j + 1))
        slot += 1


def pfair_period(q: dict) -> list[tuple]:
    """One period of the schedule of whole weights: (source, j, slot, release, deadline)."""
    return list(pfair(q, q))


def schedule(counts: DataFrame, weights: dict | None, alpha: float, block: int, period: int | None) -> DataFrame:
    """The slots of all blocks of ``counts(source, count)``: one task streams them out."""

    def run(batches):
        n = {}
        for batch in batches:
            n |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if not n:
            return
        w = {s: float(x) ** alpha for s, x in n.items()} | {s: x for s, x in (weights or {}).items() if s in n}
        q = quantise(w, period) if period else whole(w)
        plan = pfair(q, {s: -(-x // block) for s, x in n.items()})
        types = [pa.string(), *[pa.int64()] * 4]
        names = ["mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline"]
        while rows := list(itertools.islice(plan, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return counts.select(F.col("source").cast("string"), "count").repartition(1).mapInArrow(run, _PLAN)


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, block: int = 64, period: int | None = None, max_sources: int = 1_000_000) -> DataFrame:
    """The rows of ``docs(doc_id, source, ...)`` with mix_block, mix_slot, mix_release, mix_deadline, mix_pos.

    Reading by (mix_slot, mix_pos) gives the mixture.  ``weights`` maps sources to target
    weights, which must be positive; sources it doesn't name, and all sources if it is
    None, weigh their row count to the power ``alpha`` (named weights are then relative
    to those).  The target is met exactly, whatever the number of slots; only if a
    ``period`` is given, the weights are first rounded to whole slots of it, one at least.
    A null source is a source of its own.  Every row is scheduled once, repeated rows and
    null ids too; ties of the hash order are rows alike in doc_id.  Sources are counted
    into one row each, and the one task that makes the schedule holds a row a source; more
    than ``max_sources`` stop the job.  An empty table gives an
    empty result.  Other columns stay, but for those with one of the five names above, which
    are replaced.
    """
    own = [c for c in docs.columns if c not in MIX_COLUMNS]
    docs = docs.select(F.struct(*own).alias("document"), "doc_id", "source")
    counts = materialize(docs.groupBy("source").count(), "mix-counts")
    if counts.count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    plan = materialize(schedule(counts, weights, alpha, block, period), "mix-plan").withColumnRenamed("mix_block", "mix_of")
    out = ranked(docs, ["source"], "mix_rank", ["doc_id"])
    out = out.withColumn("mix_block", F.floor(F.col("mix_rank") / block)).withColumn("mix_pos", F.col("mix_rank") % block)
    # not hinted: the schedule grows with the rows, and is broadcast only while it is small
    out = out.join(plan, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_block") == F.col("mix_of")))
    return out.select(*[F.col("document")[c].alias(c) for c in own], *MIX_COLUMNS)


def ctes(docs: str, out: str, block: int = 64) -> str:
    """SQL: CTEs that end with ``out``, the rows of ``docs``(doc_id, source, ...) with their mix columns; default weights.

    One step of the recursion fills a slot.  The square roots are whole numbers after a
    multiplication by 2^52, so windows are exact; for counts under four million.
    """
    return f"""{out}_n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
{out}_src AS (SELECT list(source ORDER BY source NULLS LAST) AS names, list(CAST(pow(n, 0.5) * 4503599627370496 AS HUGEINT) ORDER BY source NULLS LAST) AS q, list((n + {block - 1}) // {block} ORDER BY source NULLS LAST) AS b, sum(CAST(pow(n, 0.5) * 4503599627370496 AS HUGEINT)) AS total FROM {out}_n),
{out}_edf AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS HUGEINT) AS released, CAST(0 AS HUGEINT) AS due, list_transform(b, lambda x: CAST(0 AS BIGINT)) AS done FROM {out}_src
  UNION ALL
  SELECT now_, pick, done[pick], rel[pick], dl[pick], list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END) FROM (
    SELECT *, CAST(list_min(list_transform(range(1, len(done) + 1), lambda i: CASE WHEN rel[i] <= now_ THEN dl[i] * 1000000 + i END)) % 1000000 AS BIGINT) AS pick FROM (
      SELECT *, CAST(greatest(slot + 1, list_min(rel)) AS BIGINT) AS now_ FROM (
        SELECT slot, done, list_transform(range(1, len(done) + 1), lambda i: CASE WHEN done[i] < b[i] THEN (done[i] * total) // q[i] END) AS rel, list_transform(range(1, len(done) + 1), lambda i: ((done[i] + 1) * total + q[i] - 1) // q[i]) AS dl FROM {out}_edf, {out}_src)
      WHERE list_min(rel) IS NOT NULL))),
{out}_plan AS MATERIALIZED (SELECT names[k] AS source, j, slot, released, due FROM {out}_edf, {out}_src WHERE slot >= 0),
{out}_rank AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS nth FROM {docs}),
{out} AS MATERIALIZED (SELECT r.*, j AS mix_block, slot AS mix_slot, CAST(released AS BIGINT) AS mix_release, CAST(due AS BIGINT) AS mix_deadline, nth % {block} AS mix_pos FROM {out}_rank r JOIN {out}_plan p ON r.source IS NOT DISTINCT FROM p.source AND nth // {block} = j)"""


#: DuckDB SQL for the query's rows.
ORACLE = f"WITH RECURSIVE {ctes('documents', 'mixed')} SELECT doc_id, source, mix_block, mix_slot, mix_release, mix_deadline, mix_pos FROM mixed"
