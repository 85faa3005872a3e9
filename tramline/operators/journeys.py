"""Journeys leg by leg, found backwards from the labels of the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settle
from .rounds import at_targets


def legs(queries: DataFrame, labels: DataFrame, events: DataFrame, footpaths: DataFrame) -> DataFrame:
    """``query_id, trips, leg, kind, from_stop, to_stop, dep, arr, trip_id``: one journey per Pareto row.

    ``labels`` is what ``rounds.raptor`` returns. A step undoes one ride of all
    journeys at once by equality joins on the stop and the time of arrival, so
    no parent has to be kept in the rounds. Ties: the shortest walk, then the
    least trip, then the latest place to board. Ride i is leg 2i, the walk after
    it 2i + 1, a first walk 1; a query that is already at its target has no leg.
    """
    at = settle(at_targets(labels, queries).join(queries.select("query_id", F.col("target").alias("stop_id")), "query_id").select("query_id", "trips", F.col("trips").alias("k"), "stop_id", "arr"))
    e = events.select("trip_id", "stop_index", "stop_id", "arr", "dep")
    on = e.select("trip_id", F.col("stop_index").alias("i"), F.col("stop_id").alias("board"), F.col("dep").alias("d"))
    known = labels.select("query_id", F.col("trips").alias("k0"), F.col("stop_id").alias("board"), F.col("arr").alias("ready"))
    out = []
    for _ in range((at.agg(F.max("k")).first()[0] or 0) + 1):
        ride = at.where("k > 0")
        # the last stop off a vehicle: the label's own, or one a footpath away
        off = ride.select("*", F.col("stop_id").alias("alight"), F.lit(0).cast("long").alias("walk")).unionByName(
            ride.join(footpaths, ride.stop_id == footpaths.dst).select(ride["*"], F.col("src").alias("alight"), F.col("travel_s").alias("walk"))
        )
        off = off.withColumn("down", F.col("arr") - F.col("walk")).join(e.where("stop_index > 0").select("trip_id", F.col("stop_index").alias("j"), F.col("stop_id").alias("alight"), F.col("arr").alias("down")), ["alight", "down"])
        via = off.join(on, "trip_id").where("i < j").join(known, ["query_id", "board"]).where("k0 < k AND ready <= d")
        pick = F.min_by(F.struct("alight", "down", "walk", "trip_id", "board", "d", "k0", "ready"), F.struct("walk", "trip_id", -F.col("i"), "k0"))
        one = settle(via.groupBy("query_id", "trips", "k", "stop_id", "arr").agg(pick.alias("v")).select("query_id", "trips", "k", "stop_id", "arr", "v.*"))
        out.append(one.select("query_id", "trips", (2 * F.col("k")).alias("leg"), F.lit("ride").alias("kind"), F.col("board").alias("from_stop"), F.col("alight").alias("to_stop"), F.col("d").alias("dep"), F.col("down").alias("arr"), "trip_id"))
        out.append(one.where("walk > 0").select("query_id", "trips", (2 * F.col("k") + 1).alias("leg"), F.lit("walk").alias("kind"), F.col("alight").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.col("down").alias("dep"), "arr", F.lit(None).cast("long").alias("trip_id")))
        start = at.where("k = 0").join(queries.select("query_id", "source", "dep_s"), "query_id").where("source <> stop_id")
        out.append(start.select("query_id", "trips", F.lit(1).cast("long").alias("leg"), F.lit("walk").alias("kind"), F.col("source").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.col("dep_s").alias("dep"), "arr", F.lit(None).cast("long").alias("trip_id")))
        at = one.select("query_id", "trips", F.col("k0").alias("k"), F.col("board").alias("stop_id"), F.col("ready").alias("arr"))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def measures(journey_legs: DataFrame) -> DataFrame:
    """Per journey: rides, source, target, arr, walk_s, first_walk_s, and whether every leg starts where and after the last one ends."""
    way = Window.partitionBy("query_id", "trips").orderBy("leg")
    x = journey_legs.withColumns({"_stop": F.lag("to_stop").over(way), "_arr": F.lag("arr").over(way)})
    ok = F.col("_stop").isNull() | ((F.col("_stop") == F.col("from_stop")) & (F.col("_arr") <= F.col("dep")))
    walk = F.when(F.col("kind") == "walk", F.col("arr") - F.col("dep")).otherwise(F.lit(0))
    return x.groupBy("query_id", "trips").agg(
        F.count(F.when(F.col("kind") == "ride", 1)).alias("rides"), F.min_by("from_stop", "leg").alias("source"), F.max_by("to_stop", "leg").alias("target"), F.max("arr").alias("arr"),
        F.sum(walk).alias("walk_s"), F.sum(F.when(F.col("leg") == 1, walk).otherwise(F.lit(0))).alias("first_walk_s"), F.bool_and(ok).alias("chained"),
    )
