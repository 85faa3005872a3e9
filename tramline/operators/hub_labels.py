"""Hub labels: distances and reachability by joins on a common hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out- and in-labels ``vertex, hub, dist`` from all-pairs distances (src, dst, travel_s).

    The hub of a pair is the vertex on one of its shortest paths that reaches
    the most vertices (ties: the least id). Meant for walks, whose connected
    pairs are few per stop: the work is the pairs times the vertices between.
    """
    ends = distances.select("src").unionByName(distances.select(F.col("dst").alias("src"))).distinct()
    d = distances.select("src", "dst", "travel_s").unionByName(ends.select("src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("travel_s")))
    rank = d.groupBy(F.col("src").alias("hub")).agg(F.count("*").alias("reach"))
    up = d.select("src", F.col("dst").alias("hub"), F.col("travel_s").alias("up"))
    down = d.select(F.col("src").alias("hub"), "dst", F.col("travel_s").alias("down"))
    via = up.join(down, "hub").join(d, ["src", "dst"]).where("up + down = travel_s").join(rank, "hub")
    best = via.groupBy("src", "dst").agg(F.min_by(F.struct("hub", "up", "down"), F.struct(-F.col("reach"), F.col("hub"))).alias("h"))
    out = best.select(F.col("src").alias("vertex"), "h.hub", F.col("h.up").alias("dist")).distinct()
    into = best.select(F.col("dst").alias("vertex"), "h.hub", F.col("h.down").alias("dist")).distinct()
    return out, into


def distances(out: DataFrame, into: DataFrame) -> DataFrame:
    """``src, dst, travel_s`` for all pairs with a common hub."""
    a = out.select(F.col("vertex").alias("src"), "hub", F.col("dist").alias("d1"))
    b = into.select(F.col("vertex").alias("dst"), "hub", F.col("dist").alias("d2"))
    return a.join(b, "hub").where("src <> dst").groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("travel_s"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out- and in-labels from a text column ``value`` of ``o|i vertex hub dist`` lines, ids from 1 on."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(part) == 4).select(part[0].alias("side"), (part[1].cast("long") - 1).alias("vertex"), (part[2].cast("long") - 1).alias("hub"), part[3].cast("long").alias("dist"))
    return tuple(rows.where(F.col("side") == s).drop("side") for s in ("o", "i"))


def earliest(queries: DataFrame, departures: DataFrame, arrivals: DataFrame, forward: DataFrame, backward: DataFrame, paths: bool = False) -> DataFrame:
    """``query_id, arr``: the first arrival event at the target that the first departure event at the source reaches.

    ``departures`` and ``arrivals`` hold event, stop_id, t; labels hold event
    and hub, or with ``paths`` event, path and pos, where a path is a hit if
    the forward position is no later. The least over all hits, so nothing is
    assumed about the order in which later events are reachable.
    """
    d = departures.select(F.col("stop_id").alias("source"), F.col("t").alias("dep"), "event")
    first = queries.join(d, "source").where("dep >= dep_s").groupBy("query_id", "target").agg(F.min_by("event", F.struct("dep", "event")).alias("event"), F.min("dep").alias("since"))
    key = "path" if paths else "hub"
    fwd = first.join(forward.withColumnRenamed("pos", "p1"), "event").drop("event")
    bwd = backward.withColumnRenamed("pos", "p2").join(arrivals.select("event", F.col("stop_id").alias("target"), F.col("t").alias("at")), "event").drop("event")
    hit = fwd.join(bwd, [key, "target"]).where("at >= since")
    if paths:
        hit = hit.where("p1 <= p2")
    return hit.groupBy("query_id").agg(F.min("at").alias("arr"))
