"""Connected components by alternating stars, each step a written table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_own_shuffle
from ..sinks.shared import written


def _to_least(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(with_own_shuffle(least), "u").where("v > u")
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Each node, and its smaller neighbours, are tied to the least of them; `a` > `b` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(with_own_shuffle(least), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component` (its least node) for every node of the undirected `edges` (`a`, `b`).

    Nodes that are their component's least are among them. Edges are rewritten until each
    node points at its component's least; that takes a number of rounds that grows with the
    logarithm of a component's size.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = written(_smaller_to_least(_to_least(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
