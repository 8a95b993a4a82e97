"""Connected components by alternating large-star / small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join each vertex's neighbours to the smallest of them and itself.

    Large star moves the neighbours above the vertex, small star those below
    it.  The minimum is a partial aggregate and the neighbour lists are never
    gathered, so a vertex may have any number of edges.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # edges point from the larger end to the smaller
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(low, "u")
    moved = moved.where("v > u") if large else moved
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) links -> (vertex, comp) with the smallest vertex of its
    component, for the vertices that have links.

    Every step is written to the shared folder; the loop ends when a double
    step changes nothing, after O(log^2 n) steps (two to four on star-like
    links).
    """
    cur = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    # a sum of edge hashes names the edge set; unchanged means converged
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = cur.select(mark).first()
    while True:
        cur = saved(_star(_star(cur, True), False), name)
        now = cur.select(mark).first()
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("vertex"), F.col("b").alias("comp")).union(
        cur.select(F.col("b"), F.col("b")).distinct())
