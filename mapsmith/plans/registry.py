"""Where named queries and their SQL are kept, and what the SQL of several has in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


AREA = "(x1 - x0) * (y1 - y0)"
OVERLAP = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
#: Meet in more than one point.
JOIN = f"{MEET} AND NOT (least(a.x1, b.x1) = greatest(a.x0, b.x0) AND least(a.y1, b.y1) = greatest(a.y0, b.y0))"
NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
CELLS = "SELECT k, fid, unnest(range(x0, x1)) cx, y0, y1 FROM {t}"
ENDS = "e AS MATERIALIZED (SELECT k, fid, ax x, ay y, 0 side FROM edges UNION ALL SELECT k, fid, bx, by_, 1 FROM edges)"


def rounded(c: Column, n: int = 6) -> Column:
    return F.round(c.cast("double"), n)


def comps(edges: str, nodes: str, name: str = "c") -> str:
    """Recursive CTE ``name`` (k, comp): the least node that each of ``nodes`` (k) is connected with by ``edges``
    (a, b)."""
    return f"""both_{name} AS MATERIALIZED (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
{name}(k, comp) USING KEY (k) AS (SELECT k, k comp FROM {nodes} UNION (SELECT w.a, min({name}.comp) FROM {name} JOIN both_{name} w ON w.b = {name}.k JOIN recurring.{name} own_ ON own_.k = w.a WHERE {name}.comp < own_.comp GROUP BY w.a))"""
