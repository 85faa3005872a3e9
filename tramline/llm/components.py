"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: link each node's larger (or smaller) neighbours to the least node beside it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.where("b < a")
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = materialize(out.where("a != b").distinct(), "stars")
    discard(least, edges)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns a, b: long).

    The component is its least node. Null ends, loops, repeats and either
    direction are allowed; an empty edge table gives an empty result. Minima
    are pre-aggregated before each shuffle, every round is written to the
    shared folder, and both sides of each join are read from there, so AQE can
    split a node with very many neighbours.
    """
    edges = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        edges = _stars(_stars(edges, True), False)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
