"""Queries of problem 2."""

from __future__ import annotations

from engramix.llm import ranking as R
from engramix.sources.tables import read


def _fused(spark, folder, top=None):
    scored = read(spark, folder, "scored_rows", "query_id", "channel", "node_id", "label", "score")
    targets = read(spark, folder, "search_targets", "node_type", "tier_weight")
    recalled = read(spark, folder, "recall_items", "query_id", "node_id", "score")
    return R.fuse(scored, targets, recalled, top=top)


def p2_found(spark, folder):
    return _fused(spark, folder, top=5).select("query_id", "node_id")


def p2_ranking(spark, folder):
    from pyspark.sql import functions as F

    return _fused(spark, folder).select("query_id", "node_id", F.round("fused", 6).alias("fused"))


QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking}


def _poly(cs, x):
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _tail(p):
    r = f"sqrt(-2 * ln({p}))"
    return f"{_poly(R.TAIL_C, r)} / ({_poly(R.TAIL_D, r)} * {r} + 1)"


_Q = "(p - 0.5)"
_RANKED = f"""
WITH hits AS (
  SELECT query_id, node_id, channel, max(score) AS score FROM (
    SELECT query_id, node_id, lower(channel) AS channel, CASE WHEN lower(channel) = 'l2_distance' THEN -score ELSE score END AS score FROM scored_rows
    UNION ALL SELECT query_id, node_id, '(recalled)', score FROM recall_items)
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
pct AS (SELECT *, count(*) OVER (PARTITION BY query_id, channel) AS m, (rank() OVER (PARTITION BY query_id, channel ORDER BY score) + (count(*) OVER (PARTITION BY query_id, channel, score) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY query_id, channel) AS p FROM hits),
z AS (SELECT *, CASE WHEN p < {R.BREAK} THEN {_tail('p')} WHEN p > {1 - R.BREAK} THEN -({_tail('(1 - p)')})
  ELSE {_poly(R.MID_A, f'({_Q} * {_Q})')} * {_Q} / ({_poly(R.MID_B, f'({_Q} * {_Q})')} * {_Q} * {_Q} + 1) END AS z FROM pct),
w AS (SELECT query_id, node_id, coalesce(max(tier_weight), 0) AS w FROM scored_rows LEFT JOIN search_targets ON lower(trim(label)) = lower(node_type) GROUP BY ALL),
n AS (SELECT query_id, count(DISTINCT channel) AS n FROM hits GROUP BY 1),
f AS (SELECT query_id, node_id, any_value(w) * sum(z - least({R.FLOOR}, CASE WHEN 0.5 / m < {R.BREAK} THEN {_tail('(0.5 / m)')} ELSE 0 END)) / any_value(n) AS fused FROM z JOIN w USING (query_id, node_id) JOIN n USING (query_id) GROUP BY ALL)
"""

SQL = {
    "p2_found": _RANKED + "SELECT query_id, node_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, node_id) <= 5",
    "p2_ranking": _RANKED + "SELECT query_id, node_id, round(fused, 6) AS fused FROM f",
}
