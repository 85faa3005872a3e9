"""Transfer patterns: the sequences of legs that good journeys take, and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import settle
from .layout import catch
from .pareto import improving
from .time_dependent import travel_functions

LEG = ["kind", "from_stop", "to_stop"]


def build(queries: DataFrame, legs: DataFrame) -> DataFrame:
    """``source, target, trips, path``: distinct patterns of the journeys in ``legs`` (``journeys.legs``).

    Run over all departures of a day (a profile's queries) for full patterns;
    an answer is only as good as the journeys that the patterns come from.
    """
    one = legs.groupBy("query_id", "trips").agg(F.sort_array(F.collect_list(F.struct("leg", *LEG))).alias("p"))
    path = F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in LEG]))
    return one.join(queries.select("query_id", "source", "target"), "query_id").select("source", "target", "trips", path.alias("path")).distinct()


def prefixes(patterns: DataFrame) -> DataFrame:
    """``source, prefix``: every distinct beginning of a pattern, the nodes of the source's pattern graph."""
    cut = patterns.select("source", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    return cut.select("source", F.expr("slice(path, 1, n)").alias("prefix")).distinct()


def direct_functions(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """Travel-time functions of direct rides, for the stop pairs that some pattern rides."""
    leg = patterns.select(F.explode("path").alias("l")).where("l.kind = 'ride'").select("l.from_stop", "l.to_stop").distinct()
    e = events.select("trip_id", "stop_index", "stop_id", "arr", "dep")
    on = e.join(leg, e.stop_id == leg.from_stop).select("trip_id", "from_stop", "to_stop", F.col("stop_index").alias("i"), "dep")
    off = e.select("trip_id", F.col("stop_id").alias("to_stop"), F.col("stop_index").alias("j"), "arr")
    rides = on.join(off, ["trip_id", "to_stop"]).where("i < j")
    return travel_functions(rides.select(F.col("from_stop").alias("dep_stop"), F.col("to_stop").alias("arr_stop"), "dep", "arr"))


def earliest(queries: DataFrame, patterns: DataFrame, functions: DataFrame, footpaths: DataFrame) -> DataFrame:
    """``query_id, trips, arr``: the Pareto set over all patterns between each query's ends, a leg of all a round."""
    ride = functions.withColumnsRenamed({"dep_stop": "from_stop", "arr_stop": "to_stop"})
    walk = footpaths.select(F.col("src").alias("from_stop"), F.col("dst").alias("to_stop"), "travel_s")
    keep = ["query_id", "trips", "path", "at"]
    at = settle(queries.join(patterns, ["source", "target"]).select("query_id", "trips", "path", F.col("dep_s").cast("long").alias("at")))
    stay = queries.where("source = target").select("query_id", F.lit(0).cast("long").alias("trips"), F.col("dep_s").cast("long").alias("arr"))
    out = [stay]
    for n in range(at.agg(F.max(F.size("path"))).first()[0] or 0):
        leg = at.select(*keep, F.expr(f"path[{n}].kind").alias("kind"), F.expr(f"path[{n}].from_stop").alias("from_stop"), F.expr(f"path[{n}].to_stop").alias("to_stop"))
        by_ride = leg.where("kind = 'ride'").join(ride, ["from_stop", "to_stop"]).withColumn("rank", catch("at")).where("rank < size(deps)")
        by_ride = by_ride.select("query_id", "trips", "path", F.expr("arrs[rank]").alias("at"))
        on_foot = leg.where("kind = 'walk'").join(walk, ["from_stop", "to_stop"]).select("query_id", "trips", "path", (F.col("at") + F.col("travel_s")).alias("at"))
        now = settle(by_ride.unionByName(on_foot))
        out.append(now.where(F.size("path") == n + 1).select("query_id", "trips", F.col("at").alias("arr")))
        at = now.where(F.size("path") > n + 1)
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return improving(rows)


def lower_bounds(patterns: DataFrame, functions: DataFrame, footpaths: DataFrame) -> DataFrame:
    """``source, target, least_s, least_trips``: what no journey over a pair's patterns can beat, from the fastest ride of every leg."""
    fast = functions.select(F.col("dep_stop").alias("from_stop"), F.col("arr_stop").alias("to_stop"), F.array_min(F.zip_with("deps", "arrs", lambda d, a: a - d)).alias("s"), F.lit("ride").alias("kind"))
    walk = footpaths.select(F.col("src").alias("from_stop"), F.col("dst").alias("to_stop"), F.col("travel_s").alias("s"), F.lit("walk").alias("kind"))
    legs = patterns.select("source", "target", "trips", "path", F.explode("path").alias("l")).select("source", "target", "trips", "path", "l.*")
    cost = legs.join(fast.unionByName(walk), LEG).groupBy("source", "target", "trips", "path").agg(F.sum("s").alias("s"))
    return cost.groupBy("source", "target").agg(F.min("s").alias("least_s"), F.min("trips").alias("least_trips"))


def bounded_patterns(queries: DataFrame, patterns: DataFrame, functions: DataFrame, footpaths: DataFrame, bounds: DataFrame) -> DataFrame:
    """``earliest`` after patterns that cannot beat the pair's direct alternative are dropped: those whose fastest legs take longer than a bound on each query.

    ``bounds``: query_id, latest. Pruning changes no answer up to ``latest``.
    """
    fast = functions.select(F.col("dep_stop").alias("from_stop"), F.col("arr_stop").alias("to_stop"), F.array_min(F.zip_with("deps", "arrs", lambda d, a: a - d)).alias("s"), F.lit("ride").alias("kind"))
    walk = footpaths.select(F.col("src").alias("from_stop"), F.col("dst").alias("to_stop"), F.col("travel_s").alias("s"), F.lit("walk").alias("kind"))
    legs = patterns.select("source", "target", "trips", "path", F.explode("path").alias("l")).select("source", "target", "trips", "path", "l.*")
    cost = legs.join(fast.unionByName(walk), LEG).groupBy("source", "target", "trips", "path").agg(F.sum("s").alias("s"))
    worth = queries.join(bounds, "query_id").join(cost, ["source", "target"]).where(F.col("dep_s") + F.col("s") <= F.col("latest"))
    return earliest(queries, settle(worth.select("source", "target", "trips", "path").distinct()), functions, footpaths)
