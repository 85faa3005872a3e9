"""Event-to-event transfers and their use in a hierarchy of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settle
from .layout import catch


def event_transfers(events: DataFrame, layout: DataFrame, footpaths: DataFrame, of_trips: DataFrame | None = None, to_routes: DataFrame | None = None) -> DataFrame:
    """All useful transfers from an arrival to the first catchable trip of each route nearby.

    ``of_trips`` (trip_id) and ``to_routes`` (route_id) leave only those from some trips and to some routes.

    Columns: from_route, from_rank, t_from_index, from_trip, from_arr,
    to_route, to_rank, to_index, to_dep, to_stop. Left out: boarding at a last
    stop; the same route with a trip and a place no earlier; U-turns (the stop
    before the change is the stop after it and could be left there in time).
    Arrivals move to the stops they can walk to and search there; what they
    find, many times their number, moves no more.
    """
    rank = Window.partitionBy("route_id", "stop_index").orderBy("dep", "trip_id")
    trip = Window.partitionBy("trip_id").orderBy("stop_index")
    e = events.withColumn("rank", (F.row_number().over(rank) - 1).cast("long")).withColumns({"prev_stop": F.lag("stop_id").over(trip), "prev_arr": F.lag("arr").over(trip)})
    e = e.where("stop_index >= 1")
    if of_trips is not None:
        e = e.join(of_trips.select("trip_id").distinct(), "trip_id", "left_semi")
    if to_routes is not None:
        layout = layout.join(to_routes.select("route_id").distinct(), "route_id", "left_semi")
    stay = footpaths.select("src").unionByName(footpaths.select(F.col("dst").alias("src"))).unionByName(events.select(F.col("stop_id").alias("src"))).distinct()
    walk = footpaths.select("src", "dst", "travel_s").unionByName(stay.select("src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("travel_s")))
    nxt = Window.partitionBy("route_id").orderBy("stop_index")
    to = layout.withColumns({"next_stop": F.lead("stop_id").over(nxt), "next_arrs": F.lead("arrs").over(nxt)}).where("stop_index < last_index")
    to = to.select(F.col("route_id").alias("to_route"), F.col("stop_index").alias("to_index"), F.col("stop_id").alias("to_stop"), "deps", "slots", "next_stop", "next_arrs")
    e = e.select("trip_id", "route_id", "rank", "stop_index", "stop_id", "arr", "prev_stop", "prev_arr")
    ready = e.join(walk, F.col("stop_id") == F.col("src")).withColumnRenamed("dst", "to_stop").withColumn("ready", F.col("arr") + F.col("travel_s")).drop("stop_id", "src", "travel_s")
    found = ready.join(to, "to_stop").withColumn("to_rank", catch("ready").cast("long")).where("to_rank < size(deps)")
    t = found.withColumns({"to_dep": F.expr("get(deps, int(to_rank))"), "next_arr": F.expr("get(next_arrs, int(to_rank))")}).drop("deps", "slots", "next_arrs")
    t = t.where("NOT (route_id = to_route AND to_rank >= rank AND to_index >= stop_index)")
    # a trip's first ride can't turn back: there is no stop before it to be at
    t = t.where("NOT (stop_index >= 2 AND prev_stop = next_stop AND prev_arr <= next_arr)")
    return t.select(
        F.col("route_id").alias("from_route"), F.col("rank").alias("from_rank"), F.col("stop_index").alias("t_from_index"), F.col("trip_id").alias("from_trip"),
        F.col("arr").alias("from_arr"), "to_route", "to_rank", "to_index", "to_dep", "to_stop",
    )


def reduce_transfers(transfers: DataFrame, layout: DataFrame, footpaths: DataFrame) -> DataFrame:
    """``transfers`` less those that improve no arrival anywhere, judged per trip from its last stop backwards.

    A transfer at place i stays if it gives the earliest arrival at some stop
    (directly or one footpath further) among riding on and all transfers from
    place i on, and is strictly earlier than all from later places. So one row
    per (trip, stop, place) is aggregated before the shuffle, and the scan
    backwards is a running minimum over at most as many rows as the trip has
    places. Ties go to riding on, then to the least route, place and rank.
    """
    tail = layout.select(F.col("route_id").alias("to_route"), "stop_index", "stop_id", "arrs")
    key = ["to_route", "to_index", "to_rank"]
    by_change = transfers.select("from_trip", F.col("t_from_index").alias("i"), *key).join(tail, "to_route").where("stop_index > to_index")
    by_change = by_change.select("from_trip", "i", "stop_id", F.expr("arrs[int(to_rank)]").alias("at"), F.lit(1).alias("kind"), *key)
    own = layout.where("stop_index > 0").select("stop_index", "stop_id", F.explode(F.arrays_zip("trip_ids", "arrs")).alias("e"))
    none = [F.lit(None).cast(transfers.schema[c].dataType).alias(c) for c in key]
    own = own.select(F.col("e.trip_ids").alias("from_trip"), F.col("stop_index").alias("i"), "stop_id", F.col("e.arrs").alias("at"), F.lit(0).alias("kind"), *none)

    def best(rows: DataFrame) -> DataFrame:
        m = rows.groupBy("from_trip", "i", "stop_id").agg(F.min(F.struct("at", "kind", *key)).alias("m"))
        return m.select("from_trip", "i", "stop_id", "m.*")

    # a walk starts from the earliest arrival at its foot, so only those are walked on
    ridden = best(by_change.unionByName(own))
    walked = ridden.join(footpaths, F.col("stop_id") == F.col("src")).select("from_trip", "i", F.col("dst").alias("stop_id"), (F.col("at") + F.col("travel_s")).alias("at"), "kind", *key)
    later = Window.partitionBy("from_trip", "stop_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    kept = best(ridden.unionByName(walked)).withColumn("before", F.min("at").over(later)).where("kind = 1 AND (before IS NULL OR at < before)")
    kept = kept.select("from_trip", F.col("i").alias("t_from_index"), *key).distinct()
    return transfers.join(kept, ["from_trip", "t_from_index", *key], "left_semi").select(*transfers.columns)


def layout_graph(events: DataFrame, footpaths: DataFrame, component: DataFrame) -> DataFrame:
    """``src, dst, weight``: trips between footpath components per consecutive stop pair, both directions."""
    trip = Window.partitionBy("trip_id").orderBy("stop_index")
    pair = events.select("stop_id", F.lead("stop_id").over(trip).alias("next")).where("next IS NOT NULL")
    a, b = component.select(F.col("vertex").alias("stop_id"), F.col("component").alias("src")), component.select(F.col("vertex").alias("next"), F.col("component").alias("dst"))
    one = pair.join(a, "stop_id").join(b, "next").where("src <> dst").select("src", "dst")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def boundary_events(events: DataFrame, cells: DataFrame, levels: int = 4) -> DataFrame:
    """``level, n``: events after which the trip leaves its cell of that level."""
    trip = Window.partitionBy("trip_id").orderBy("stop_index")
    c = events.join(cells, "stop_id").withColumn("next_cell", F.lead("cell_id").over(trip)).where("next_cell IS NOT NULL")
    lv = c.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return lv.where("shiftright(cell_id ^ next_cell, level) <> 0").groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n"))


def crossing_footpaths(footpaths: DataFrame, cells: DataFrame) -> DataFrame:
    """Footpaths between different cells; a valid partition has none."""
    a, b = cells.select(F.col("stop_id").alias("src"), F.col("cell_id").alias("sc")), cells.select(F.col("stop_id").alias("dst"), F.col("cell_id").alias("dc"))
    return footpaths.join(a, "src").join(b, "dst").where("sc <> dc").select("src", "dst")


def updated_transfers(stored: DataFrame, before: DataFrame, events: DataFrame, layout: DataFrame, footpaths: DataFrame) -> DataFrame:
    """The event transfers of ``events`` from those ``stored`` for the events ``before``: only what changed trips touch is made anew.

    A trip has changed if any of its events has, or if it is on one side
    alone. Transfers of changed trips, and all that lead to a route with a
    changed trip (its first catchable trip may be another one now), are made
    from ``layout``, that of ``events``; of the others only the trips' ranks are
    renewed. The work follows the changed trips' routes and what is near them.
    """
    cols = ["trip_id", "route_id", "stop_index", "stop_id", "arr", "dep"]
    sides = before.select(*cols, F.lit(1).alias("s")).unionByName(events.select(*cols, F.lit(2).alias("s")))
    differ = sides.groupBy(*cols).agg(F.sum("s").alias("s")).where("s <> 3")
    changed = settle(differ.select("trip_id").distinct())
    routes = settle(differ.select("route_id").distinct())
    rank = layout.where("stop_index = 0").select(F.posexplode("trip_ids").alias("from_rank", "from_trip")).withColumn("from_rank", F.col("from_rank").cast("long"))
    kept = stored.join(changed.withColumnRenamed("trip_id", "from_trip"), "from_trip", "left_anti").join(routes.withColumnRenamed("route_id", "to_route"), "to_route", "left_anti")
    kept = kept.drop("from_rank").join(rank, "from_trip").select(*stored.columns)
    own = event_transfers(events, layout, footpaths, of_trips=changed)
    others = event_transfers(events, layout, footpaths, to_routes=routes).join(changed.withColumnRenamed("trip_id", "from_trip"), "from_trip", "left_anti")
    return kept.unionByName(own.select(*stored.columns)).unionByName(others.select(*stored.columns))


def sampled_transfers(transfers: DataFrame, percent: int) -> DataFrame:
    """``transfers`` that leave or enter a hashed sample of ``percent`` of the trips: what new trips in a timetable would add."""
    pick = lambda c: F.pmod(F.col(c) * 2_654_435_761, F.lit(1000)) < percent * 10
    return transfers.where(pick("from_trip") | pick("to_trip"))


def with_to_trip(transfers: DataFrame, layout: DataFrame) -> DataFrame:
    """``transfers`` with ``to_trip``, the trip that is boarded."""
    to = layout.where("stop_index = 0").select(F.col("route_id").alias("to_route"), F.posexplode("trip_ids").alias("to_rank", "to_trip"))
    return transfers.join(to.withColumn("to_rank", F.col("to_rank").cast("long")), ["to_route", "to_rank"]).select(*transfers.columns, "to_trip")


def combinable(a: str, b: str, min_transfer: str = "min_transfer_s", walk: str = "travel_s") -> Column:
    """Whether connection ``b`` can follow ``a``: the same trip, the same stop after its transfer time, or a footpath between (struct columns)."""
    same_trip = (F.col(f"{a}.trip_id") == F.col(f"{b}.trip_id")) & (F.col(f"{a}.arr") <= F.col(f"{b}.dep"))
    stay = (F.col(f"{a}.arr_stop") == F.col(f"{b}.dep_stop")) & (F.col(f"{a}.arr") + F.col(min_transfer) <= F.col(f"{b}.dep"))
    foot = F.coalesce(F.col(f"{a}.arr") + F.col(walk) <= F.col(f"{b}.dep"), F.lit(False))
    return same_trip | stay | foot
