"""Figures about a network and about events as a timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance_cm
from .layout import min_travel_time
from .pareto import improving


def events_as_connections(events: DataFrame) -> DataFrame:
    """``vehicle, dep_event, arr_event, seconds``: consecutive events of a user as a connection of a vehicle."""
    way = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = events.select(F.col("user_id").alias("vehicle"), F.col("event_id").alias("dep_event"), F.lead("event_id").over(way).alias("arr_event"), "ts", F.lead("ts").over(way).alias("next"))
    return nxt.where("arr_event IS NOT NULL").select("vehicle", "dep_event", "arr_event", F.expr("cast(cast(next - ts AS interval second) AS bigint)").alias("seconds"))


def segment_speeds(events: DataFrame, footpaths: DataFrame, stops: DataFrame) -> DataFrame:
    """``src, dst, metres, travel_s``: great-circle length and least time of each stop pair; times of 0 s are left out."""
    a = stops.select(F.col("stop_id").alias("src"), F.col("lon_e6").alias("x1"), F.col("lat_e6").alias("y1"))
    b = stops.select(F.col("stop_id").alias("dst"), F.col("lon_e6").alias("x2"), F.col("lat_e6").alias("y2"))
    d = distance_cm(F.col("x1") / 1e6, F.col("y1") / 1e6, F.col("x2") / 1e6, F.col("y2") / 1e6)
    pairs = min_travel_time(events, footpaths).where("travel_s > 0").join(a, "src").join(b, "dst")
    return pairs.select("src", "dst", F.round(d / 100).cast("long").alias("metres"), "travel_s")


def max_speed_per_stop(speeds: DataFrame) -> DataFrame:
    """``stop_id, mm_s``: the highest speed on a pair that leaves the stop, in whole millimetres a second."""
    return speeds.groupBy(F.col("src").alias("stop_id")).agg(F.max(F.expr("metres * 1000 div travel_s")).alias("mm_s"))


def isolated_stops(stops: DataFrame, events: DataFrame, footpaths: DataFrame) -> DataFrame:
    """``stop_id`` of stops that no trip and no footpath touches."""
    used = events.select("stop_id").unionByName(footpaths.select(F.col("src").alias("stop_id"))).unionByName(footpaths.select(F.col("dst").alias("stop_id")))
    return stops.select("stop_id").join(used.distinct(), "stop_id", "left_anti")


def distance_by_trips(labels: DataFrame, queries: DataFrame, stops: DataFrame, step_m: int = 10_000) -> DataFrame:
    """``km_from, trips_0 .. trips_16, trips_more``: answers by the distance between a query's ends and their number of trips.

    ``labels``: query_id, trips, arr at the targets.
    """
    a = stops.select(F.col("stop_id").alias("source"), F.col("lon_e6").alias("x1"), F.col("lat_e6").alias("y1"))
    b = stops.select(F.col("stop_id").alias("target"), F.col("lon_e6").alias("x2"), F.col("lat_e6").alias("y2"))
    m = F.round(distance_cm(F.col("x1") / 1e6, F.col("y1") / 1e6, F.col("x2") / 1e6, F.col("y2") / 1e6) / 100).cast("long")
    q = queries.join(a, "source").join(b, "target").select("query_id", (F.floor(m / step_m) * (step_m // 1000)).alias("km_from"))
    counts = [F.count(F.when(F.col("trips") == k, 1)).alias(f"trips_{k}") for k in range(17)]
    return labels.join(q, "query_id").groupBy("km_from").agg(*counts, F.count(F.when(F.col("trips") > 16, 1)).alias("trips_more"))


def walking_savings(pareto: DataFrame, queries: DataFrame, arrival_slacks: list[float], trip_slacks: list[float], shares: list[float]) -> DataFrame:
    """``arrival_slack, trip_slack, share, queries, reached``: how many queries have an answer within slack that walks at most ``share`` of the least-walking best answer's time.

    ``pareto``: query_id, trips, arr, walk. Anchors are the best (trips, arr)
    rows; a query without walking in its anchors is left out. Slacks and shares
    are in hundredths in the result.
    """
    spark = pareto.sparkSession
    best = improving(pareto).join(pareto, ["query_id", "trips", "arr"]).join(queries.select("query_id", "dep_s"), "query_id")
    anchor = best.groupBy("query_id", "trips", "arr", "dep_s").agg(F.min("walk").alias("walk"))
    base = anchor.groupBy("query_id").agg(F.min("walk").alias("base")).where("base > 0")
    grid = spark.createDataFrame([(round(a * 100), round(t * 100), round(s * 100)) for a in arrival_slacks for t in trip_slacks for s in shares], "arrival_slack long, trip_slack long, share long")
    near = anchor.select("query_id", F.col("trips").alias("at"), F.col("arr").alias("aa"), "dep_s").join(pareto, "query_id").join(base, "query_id")
    # slacks and shares multiply whole numbers, so no rounding decides
    cell = near.crossJoin(F.broadcast(grid)).where("(arr - dep_s) * 100 <= arrival_slack * (aa - dep_s) AND trips <= (trip_slack * at + 99) div 100 AND walk * 100 <= share * base")
    hit = cell.groupBy("arrival_slack", "trip_slack", "share").agg(F.countDistinct("query_id").alias("reached"))
    return grid.crossJoin(base.agg(F.count("*").alias("queries"))).join(hit, ["arrival_slack", "trip_slack", "share"], "left").withColumn("reached", F.coalesce("reached", F.lit(0).cast("long")))


def route_extremes(events: DataFrame, stops: DataFrame) -> DataFrame:
    """``route_id, longest_m, fastest_mm_s``: the longest stretch between two stops of a route, and the fastest ride on one."""
    w = Window.partitionBy("trip_id").orderBy("stop_index")
    c = events.select("route_id", F.col("stop_id").alias("src"), F.lead("stop_id").over(w).alias("dst"), (F.lead("arr").over(w) - F.col("dep")).alias("s")).where("dst IS NOT NULL")
    c = c.groupBy("route_id", "src", "dst").agg(F.min(F.when(F.col("s") > 0, F.col("s"))).alias("s"))
    a, b = stops.select(F.col("stop_id").alias("src"), F.col("lon_e6").alias("x1"), F.col("lat_e6").alias("y1")), stops.select(F.col("stop_id").alias("dst"), F.col("lon_e6").alias("x2"), F.col("lat_e6").alias("y2"))
    m = F.round(distance_cm(F.col("x1") / 1e6, F.col("y1") / 1e6, F.col("x2") / 1e6, F.col("y2") / 1e6) / 100).cast("long")
    return c.join(a, "src").join(b, "dst").withColumn("m", m).groupBy("route_id").agg(F.max("m").alias("longest_m"), F.max(F.expr("m * 1000 div s")).alias("fastest_mm_s"))


def labels_per_round(labels: DataFrame) -> DataFrame:
    """``trips, labels, queries``: what each round of a search improved, and for how many queries."""
    return labels.groupBy("trips").agg(F.count("*").alias("labels"), F.countDistinct("query_id").alias("queries"))
