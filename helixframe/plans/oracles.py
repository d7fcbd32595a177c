"""DuckDB SQL of the operators that follow paths, put together from common table expressions.

Each function takes the name of a CTE ``e(edge_id, src, dst, label, weight)`` and returns
CTEs that end with the one called ``out``; they chain as the operators do.  Paths are
followed by pointer doubling (``ROUNDS`` of it), tips by walks of at most 2k edges.
"""

from __future__ import annotations

ROUNDS = 20
#: Rounds of pruning that are written out; one more is looked at, and it is an error if that still finds something.
PRUNE_ROUNDS = 3


def degrees(e: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT node, CAST(sum(i) AS BIGINT) AS ins, CAST(sum(o) AS BIGINT) AS outs FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT dst, 1, 0 FROM {e}) GROUP BY node)"


def _doubled(e: str, step: str, out: str) -> str:
    return f"""{out}_all AS (
  SELECT {e}.edge_id, coalesce(prev, {e}.edge_id) AS ptr, CASE WHEN prev IS NULL THEN 0 ELSE 1 END::BIGINT AS dist, least({e}.edge_id, prev) AS low, 0 AS r FROM {e} LEFT JOIN {step} AS before_it ON {e}.edge_id = before_it.edge_id
  UNION ALL
  SELECT a.edge_id, b.ptr, a.dist + CASE WHEN a.r < {ROUNDS} AND b.dist < 4194304 THEN b.dist ELSE 0 END, least(a.low, b.low), a.r + 1 FROM {out}_all a JOIN {out}_all b ON a.ptr = b.edge_id WHERE a.r < {ROUNDS}),
{out} AS MATERIALIZED (SELECT edge_id, ptr, dist, low FROM {out}_all WHERE r = {ROUNDS})"""


def unitigs(e: str, out: str, through: str = "true") -> str:
    """``out``(edge_id, unitig_id, dist, cyclic); a cycle is cut before its edge with the smallest id, and walked again.

    Paths run through nodes d.node for which ``through`` is true.
    """
    return f"""{degrees(e, f"{out}_deg")},
{out}_step AS MATERIALIZED (SELECT t.edge_id, p.edge_id AS prev FROM {e} t JOIN {out}_deg d ON t.src = d.node AND ins = 1 AND outs = 1 AND {through} JOIN {e} p ON p.dst = t.src),
{_doubled(e, f"{out}_step", f"{out}_one")},
{out}_ring AS MATERIALIZED (SELECT edge_id, low FROM {out}_one WHERE ptr IN (SELECT edge_id FROM {out}_step)),
{out}_cut AS MATERIALIZED (SELECT * FROM {out}_step WHERE edge_id NOT IN (SELECT low FROM {out}_ring)),
{_doubled(e, f"{out}_cut", f"{out}_two")},
{out} AS MATERIALIZED (SELECT edge_id, ptr AS unitig_id, dist, edge_id IN (SELECT edge_id FROM {out}_ring) AS cyclic FROM {out}_two)"""


def standardize_contigs(e: str, out: str) -> str:
    return f"""{unitigs(e, f"{out}_u")},
{out} AS MATERIALIZED (SELECT edge_id, src, dst, label, CAST(CASE WHEN cyclic THEN weight ELSE round(avg(weight) OVER (PARTITION BY unitig_id)) END AS BIGINT) AS weight FROM {e} JOIN {out}_u USING (edge_id))"""


def standardize_edges(e: str, out: str, genome: str, k: int, threshold: int) -> str:
    return f"""{out}_p AS (SELECT ({genome} - {k}) / CAST(sum(weight) - coalesce(sum(weight) FILTER (WHERE weight < {threshold}), 0) AS DOUBLE) AS p FROM {e}),
{out} AS MATERIALIZED (SELECT * FROM (SELECT edge_id, src, dst, label, CAST(CASE WHEN round(weight * p) = 0 AND weight >= {threshold} THEN 1 ELSE round(weight * p) END AS BIGINT) AS weight FROM {e}, {out}_p) WHERE weight >= 1)"""


def weak_edges(e: str, out: str, threshold: int) -> str:
    return f"{out} AS MATERIALIZED (SELECT * FROM {e} WHERE weight >= {threshold})"


def shrink(e: str, out: str, k: int, through: str = "true") -> str:
    return f"""{unitigs(e, f"{out}_u", through)},
{out} AS MATERIALIZED (SELECT unitig_id AS edge_id, arg_min(src, dist) AS src, arg_max(dst, dist) AS dst, string_agg(CASE WHEN dist = 0 THEN label ELSE substring(label, {k}) END, '' ORDER BY dist) AS label, arg_min(weight, dist) AS weight FROM {e} JOIN {out}_u USING (edge_id) GROUP BY unitig_id)"""


def _dead(e: str, out: str, k: int) -> str:
    return f"""{degrees(e, f"{out}_deg")},
{out}_first AS MATERIALIZED (SELECT src AS node, max(edge_id) AS edge_id FROM {e} GROUP BY src),
{out}_walk AS (
  SELECT f.edge_id AS head, e.dst, f.edge_id, 1 AS n FROM {out}_first f JOIN {out}_deg d ON f.node = d.node AND ins = 0 JOIN {e} e ON e.edge_id = f.edge_id
  UNION ALL
  SELECT w.head, e.dst, e.edge_id, w.n + 1 FROM {out}_walk w JOIN {out}_deg d ON w.dst = d.node AND ins < 3 JOIN {out}_first f ON f.node = w.dst JOIN {e} e ON e.edge_id = f.edge_id WHERE w.n < {2 * k - 1}),
{out} AS MATERIALIZED (SELECT DISTINCT edge_id FROM {out}_walk WHERE head IN (SELECT head FROM {out}_walk w JOIN {out}_deg d ON w.dst = d.node WHERE (outs = 0 AND n <= {2 * k - 2}) OR (outs > 0 AND ins >= 3 AND n <= {2 * k - 1})))"""


def remove_dead_paths(e: str, out: str, k: int) -> str:
    parts, at = [], e
    for r in range(PRUNE_ROUNDS):
        parts += [_dead(at, f"{out}_d{r}", k), f"{out}_e{r} AS MATERIALIZED (SELECT * FROM {at} WHERE edge_id NOT IN (SELECT edge_id FROM {out}_d{r}))"]
        at = f"{out}_e{r}"
    parts += [_dead(at, f"{out}_more", k), f"{out} AS MATERIALIZED (SELECT * FROM {at} WHERE CASE WHEN (SELECT count(*) FROM {out}_more) > 0 THEN error('more rounds of pruning are needed') ELSE true END)"]
    return ",\n".join(parts)


def weak_components(e: str, out: str) -> str:
    """``out``(node, component) by smallest labels, of a compacted graph; rounds end when no label changes."""
    return f"""{out}_near AS MATERIALIZED (SELECT src AS a, dst AS b FROM {e} UNION SELECT dst, src FROM {e} UNION SELECT src, src FROM {e} UNION SELECT dst, dst FROM {e}),
{out}_all AS (
  SELECT DISTINCT a AS node, a AS component, 0 AS r, true AS changed FROM {out}_near
  UNION ALL
  SELECT node, component, r, bool_or(component <> before) OVER () FROM (SELECT n.a AS node, min(o.component) AS component, min(o.component) FILTER (WHERE n.a = n.b) AS before, o.r + 1 AS r FROM {out}_all o JOIN {out}_near n ON n.b = o.node WHERE o.changed GROUP BY n.a, o.r)),
{out} AS (SELECT node, component FROM {out}_all WHERE r = (SELECT max(r) FROM {out}_all))"""


def collapse(e: str, out: str, k: int) -> str:
    """``out``(contig_id, seq, len) of a graph without loops of one or two nodes; such loops are an error here."""
    return f"""{shrink(e, f"{out}_c", k)},
{out}_loops AS (SELECT count(*) AS n FROM {out}_c a JOIN {out}_c b ON a.src = b.dst AND a.dst = b.src),
{out} AS (SELECT row_number() OVER (ORDER BY length(label) DESC, label) - 1 AS contig_id, label AS seq, length(label) AS len FROM (SELECT label, unnest(range(weight)) AS copy FROM {out}_c) WHERE CASE WHEN (SELECT n FROM {out}_loops) > 0 THEN error('the graph has loops') ELSE true END)"""


def assembly(e: str, out: str, genome: str, k: int, threshold: int) -> str:
    """The whole chain of the assembler."""
    p = [f"{out}_{i}" for i in range(6)]
    return ",\n".join(
        [
            remove_dead_paths(e, p[0], k),
            standardize_contigs(p[0], p[1]),
            weak_edges(p[1], p[2], threshold),
            standardize_contigs(p[2], p[3]),
            standardize_edges(p[3], p[4], genome, k, threshold),
            remove_dead_paths(p[4], p[5], k),
            collapse(p[5], out, k),
        ]
    )
