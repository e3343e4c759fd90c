"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import dropped, hub_join, written


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over at most ``total`` edges, with repeats. A node's least neighbour is a partial aggregate; hubs' edges get it where they are (``hub_join``)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = hub_join(both, least, "u", "m", 2 * total if large else total)
    if large:
        return out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # n > 0 and <=> change no row; with them all parts of the plan read the same of ``least``, and Spark makes it once
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.filter("n > 0").select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("not (a <=> b)")


def _measured(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are flat: each a has one edge, to a b that is no a itself. So b is the least of its component."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up")))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    steep = F.expr("up > 1 or up > 0 and least = 0")
    total, steeps = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when(steep, 1))).first()
    return total, steeps == 0


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (id, component), the component being its least id. Loops, repeats and no edges at all are fine.

    Each round halves path lengths; a round is written to the shared folder, and the loop ends when all
    is flat, which needs no round more. The driver keeps a record of every stage, so a round has few.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total, flat = _measured(now)
    while not flat:
        far = written(_stars(now, True, total), "far")  # no more rows than edges
        new = written(_stars(far, False, total).distinct(), "edges")
        dropped(now, far)
        now = new
        total, flat = _measured(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
