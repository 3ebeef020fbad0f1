"""Connected components of a link table, as DataFrame rounds.

Alternating large-star and small-star steps: every node's larger (smaller)
neighbours are re-linked to its smallest neighbour, until nothing changes.  The
link table never grows beyond the nodes plus the links, no neighbourhood is
gathered in one place (minima combine map-side; the join on a hot centre is an
equi join that adaptive execution splits), and each round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _minima(edges: DataFrame) -> DataFrame:
    """u, m (the smallest of a node and its neighbours), odd of every node.  ``odd``: it has
    a smaller neighbour and another one besides; where no node is, every component is a star
    around its smallest node and ``m`` is that.  Written, so that the join on a centre with any
    share of the links has both sides dealt out anew and can be split."""
    low = _both(edges).groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return materialise(low.select("u", F.least("lo", "u").alias("m"), F.expr("lo < u and lo < hi").alias("odd")), "minima")


def _large_star(edges: DataFrame, minima: DataFrame) -> DataFrame:
    linked = _both(edges).join(minima.select("u", "m"), "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges (u, v) with v < u, as the large star gives them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v")))


def _round(edges: DataFrame, minima: DataFrame) -> DataFrame:
    return materialise(_small_star(_large_star(edges, minima)).distinct(), "edges")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every
    node that has a link (itself included).  Self links and repeats are ignored;
    nulls too; no links give an empty table.  With ``rounds`` it stops after so many:
    nodes of one component may then still differ, never those of two agree.
    ``links`` is read more than once: pass a table."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    minima = _minima(edges)
    while (rounds is None and minima.where("odd").take(1)) or rounds:
        rounds = rounds and rounds - 1
        edges = _round(edges, minima)
        minima = _minima(edges)
    return minima.select(F.col("u").alias("node"), F.col("m").alias("component"))
