"""Connected components of a graph given as an edge table.

Alternating large and small stars: both relink a node's neighbours to the least
node in reach, so edges never grow in number and a path of any length shrinks in
a logarithmic number of rounds. Each round is written to the shared folder;
nothing but two numbers a round reaches the driver. A table of few edges is
worked on by one task without shuffles, in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, materialise, release


def _gathered(edges: DataFrame, one: bool) -> DataFrame:
    """In one partition if so wished: what follows then needs no shuffle."""
    return edges.coalesce(1) if one else edges


def _large_star(edges: DataFrame, one: bool) -> DataFrame:
    both = _gathered(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), one)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, one: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _gathered(moved.unionByName(least.select("u", F.col("m").alias("v"))), one).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) of every node of edges (a, b) that isn't a root; roots are the least nodes.

    Up to `small` distinct edges, which never grow in number, are worked on by one task.
    """
    at = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = materialise(at, "components")
    state = _state(at)
    one = state[0] <= small
    while state[0]:
        last, at = at, materialise(_small_star(_large_star(at, one), one), "components")
        release(last)
        before, state = state, _state(at)
        if state == before:
            break
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
