"""Connected components of a distributed graph by alternating large and small stars.

Edges stay distributed: each step is two aggregations and joins of narrow
rows, ended by a checkpoint. The result maps every vertex of an edge to the
least vertex of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _spread(edges: DataFrame, lows: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u.

    The key of the right side is rebuilt, so that both sides are dealt anew and
    a hot vertex can be split by the adaptive skew join.
    """
    return edges.join(lows.select(F.col("u").alias("w"), "low"), F.col("u") == F.col("w")).drop("w")


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    return edges.select(ends).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the least of u and its neighbours."""
    sym = _both_ways(edges)
    lows = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))
    return _spread(sym, lows).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of these. Edges here have u > v."""
    lows = edges.groupBy("u").agg(F.min("v").alias("low"))
    linked = _spread(edges, lows)
    both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct(F.col("u").alias("u"), F.col("low").alias("v")))).alias("e")
    return linked.select(both).select("e.u", "e.v")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vertex, component) for each vertex of *edges*; loops and repeated edges are fine, null ends are dropped.

    A step ends when no vertex is both linked to a smaller one and the target
    of a link: then every link leads to the least vertex of its component.
    """
    given = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now = cut(given.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = now.where("u = v")
    now = now.where("u != v")
    while True:
        # As parents (v), and as children (u) with the number of their parents.
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")
        seen = now.select(ends).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if not seen.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count():
            break
        step = _large_star(now).where("u != v")
        now = cut(_small_star(step).where("u != v").distinct())
    vertices = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.unionByName(loops).select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    return vertices.unionByName(roots).groupBy("vertex").agg(F.min("component").alias("component"))
