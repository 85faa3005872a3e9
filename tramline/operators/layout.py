"""From stop events to the physical tables that queries scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settle
from .asof import following, succeeding
from .graph import matching, weak_components


#: Width in seconds of the slots that narrow the search in a sorted array of departures.
SLOT = 7200
#: Places of a trip that an event's vertex tells apart.
PLACES = 256


def connections(events: DataFrame) -> DataFrame:
    """One row per consecutive event pair of a trip: dep_stop, arr_stop, dep, arr, trip_id."""
    w = Window.partitionBy("trip_id").orderBy("stop_index")
    nxt = events.select("trip_id", F.col("stop_id").alias("dep_stop"), "dep", F.lead("stop_id").over(w).alias("arr_stop"), F.lead("arr").over(w).alias("arr"))
    return nxt.where("arr_stop IS NOT NULL").select("dep_stop", "arr_stop", "dep", "arr", "trip_id")


def departures(events: DataFrame) -> DataFrame:
    """``route_id, stop_index, stop_id, last_index, deps, arrs, trip_ids, slots``: the route-major layout.

    ``deps`` and ``arrs`` are ordered by the trips' rank in their route. The
    route must be FIFO: an earlier rank is no later anywhere, so both arrays
    ascend. A route's place holds one array entry per trip of a service day.
    ``slots`` is the index that ``catch`` searches. Events move once, dealt by
    route; arrays are made where they stay.
    """
    one = F.sort_array(F.collect_list(F.struct("dep", "trip_id", "arr")))
    rows = events.select("route_id", "stop_index", "stop_id", "dep", "trip_id", "arr").repartition("route_id").groupBy("route_id", "stop_index", "stop_id").agg(one.alias("e"))
    last = Window.partitionBy("route_id")
    out = rows.select(
        "route_id", "stop_index", "stop_id", F.max("stop_index").over(last).alias("last_index"), F.col("e.dep").alias("deps"), F.col("e.arr").alias("arrs"), F.col("e.trip_id").alias("trip_ids")
    )
    return with_slots(out)


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slots``, the index of its ascending array ``deps``."""
    ends = f"sequence(cast(floor(deps[0] / {SLOT}) as long), cast(floor(deps[size(deps) - 1] / {SLOT}) as long) + 1)"
    return rows.withColumn("slots", F.expr(f"transform({ends}, b -> size(filter(deps, d -> d < b * {SLOT})))"))


def catch(time: str) -> Column:
    """Rank of the first departure of ``deps`` no earlier than column ``time``; ``size(deps)`` if none.

    Departures ascend, so the rank is the number of earlier ones. ``slots[i]``
    counts those before the i-th slot from the first departure's slot on, and
    only the departures inside the time's own slot are compared.
    """
    base = f"cast(floor(deps[0] / {SLOT}) as long)"
    at = f"cast(floor({time} / {SLOT}) - {base} as int)"
    inside = f"slots[{at}] + size(filter(slice(deps, slots[{at}] + 1, slots[{at} + 1] - slots[{at}]), d -> d < {time}))"
    return F.expr(f"CASE WHEN {time} <= deps[0] THEN 0 WHEN {time} > deps[size(deps) - 1] THEN size(deps) ELSE {inside} END")


def trip_rank(events: DataFrame) -> DataFrame:
    """``trip_id, route_id, trip_rank``: place of each trip in its route, by first departure, then id."""
    first = events.groupBy("trip_id", "route_id").agg(F.min("dep").alias("t0"))
    return first.select("trip_id", "route_id", (F.row_number().over(Window.partitionBy("route_id").orderBy("t0", "trip_id")) - 1).cast("long").alias("trip_rank"))


def _sequences(events: DataFrame) -> DataFrame:
    e = F.sort_array(F.collect_list(F.struct("stop_index", "stop_id", "arr", "dep")))
    return events.groupBy("trip_id").agg(e.alias("e")).select("trip_id", F.col("e.stop_id").alias("seq"), F.col("e.arr").alias("arrs"), F.col("e.dep").alias("deps"))


def latest(time: str) -> Column:
    """Rank of the last arrival of ``arrs`` no later than column ``time``; -1 if none. Arrivals ascend."""
    return F.expr(f"size(filter(arrs, a -> a <= {time})) - 1")


def ordered_connections(conn: DataFrame, by: str) -> DataFrame:
    """Distinct connections in one of four total orders, range-partitioned: departure, arrival, or either at its stop."""
    keys = {
        "departure": ["dep", "arr", "trip_id", "dep_stop", "arr_stop"],
        "arrival": ["arr", "dep", "trip_id", "dep_stop", "arr_stop"],
        "departure_stop": ["dep_stop", "dep", "arr", "trip_id", "arr_stop"],
        "arrival_stop": ["arr_stop", "arr", "dep", "trip_id", "dep_stop"],
    }[by]
    return conn.distinct().orderBy(*keys)


def trips_of_connections(conn: DataFrame) -> DataFrame:
    """Stop events from connections: each trip's connections in order of departure; route_id is the trip's own.

    The first arrival is a second before the first departure, the last departure a second after the last arrival.
    """
    way = Window.partitionBy("trip_id").orderBy("dep", "arr")
    c = conn.withColumns({"i": (F.row_number().over(way) - 1).cast("long"), "was": F.lag("arr").over(way), "n": F.count("*").over(Window.partitionBy("trip_id"))})
    on = c.select("trip_id", F.col("i").alias("stop_index"), F.col("dep_stop").alias("stop_id"), F.coalesce("was", F.col("dep") - 1).alias("arr"), "dep")
    end = c.where("i = n - 1").select("trip_id", (F.col("i") + 1).alias("stop_index"), F.col("arr_stop").alias("stop_id"), "arr", (F.col("arr") + 1).alias("dep"))
    return on.unionByName(end).select("trip_id", F.col("trip_id").alias("route_id"), "stop_index", "stop_id", "arr", "dep")


def valid_connections(conn: DataFrame, stops: DataFrame) -> DataFrame:
    """Connections between known stops that take no negative time."""
    ids = stops.select("stop_id")
    out = conn.join(ids.withColumnRenamed("stop_id", "dep_stop"), "dep_stop", "left_semi").join(ids.withColumnRenamed("stop_id", "arr_stop"), "arr_stop", "left_semi")
    return out.where("dep <= arr").select(*conn.columns)


def geographic_routes(events: DataFrame) -> DataFrame:
    """``seq, n_trips``: trips with the same stop sequence are one route."""
    return _sequences(events).groupBy("seq").agg(F.count("*").alias("n_trips"))


def offset_routes(events: DataFrame) -> DataFrame:
    """``seq, rel, n_trips``: trips that are equal up to a shift in time are one route.

    The first arrival and the last departure carry no passenger and are left out of the comparison.
    """
    s = _sequences(events)
    base = F.col("deps")[0]
    arr = F.transform(F.slice("arrs", 2, F.size("arrs")), lambda x: x - base)
    dep = F.transform(F.slice("deps", 1, F.size("deps") - 1), lambda x: x - base)
    return s.select("seq", F.concat(dep, arr).alias("rel")).groupBy("seq", "rel").agg(F.count("*").alias("n_trips"))


def fifo_routes(events: DataFrame) -> DataFrame:
    """``trip_id, route_no, first_trip``: greedy first fit into routes without overtaking.

    Trips of a stop sequence come in order of their times; each joins the first
    route whose last trip is no later at any event. ``first_trip`` names the
    route together with ``route_no``. The greedy state is sequential, so a stop
    sequence is one group; its size is the trips of one line.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        trips = sorted((list(t), i) for t, i in zip(pdf["times"], pdf["trip_id"], strict=True))
        ends: list[list] = []
        out = []
        for times, trip in trips:
            for no, end in enumerate(ends):
                if all(a <= b for a, b in zip(end, times, strict=True)):
                    ends[no] = times
                    break
            else:
                no = len(ends)
                ends.append(times)
            out.append((trip, no))
        return pd.DataFrame({"trip_id": [t for t, _ in out], "route_no": [n for _, n in out], "first_trip": trips[0][1]})

    s = _sequences(events).select("trip_id", F.concat_ws(",", "seq").alias("key"), F.flatten(F.zip_with("arrs", "deps", lambda a, d: F.array(a, d))).alias("times"))
    return s.groupBy("key").applyInPandas(fit, "trip_id long, route_no long, first_trip long")


def optimal_fifo_routes(events: DataFrame) -> DataFrame:
    """``trip_id, route_no, first_trip``: as few routes without overtaking as there can be for each stop sequence.

    A trip may follow another that is no later anywhere. A largest matching of
    trips to followers leaves the least number of chains, and each is a route.
    """
    s = settle(_sequences(events).select("trip_id", F.concat_ws(",", "seq").alias("key"), F.flatten(F.zip_with("arrs", "deps", lambda a, d: F.array(a, d))).alias("times")))
    a, b = s.select("key", F.col("trip_id").alias("a"), F.col("times").alias("t1")), s.select("key", F.col("trip_id").alias("b"), F.col("times").alias("t2"))
    # pairs of one line's trips: what a line holds bounds them
    can = a.join(b, "key").where("a <> b AND forall(zip_with(t1, t2, (x, y) -> x <= y), z -> z) AND (t1 <> t2 OR a < b)")
    follows = matching(can.select("key", "a", "b"), "key").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    chain = weak_components(s.select(F.col("trip_id").alias("vertex")), follows.withColumn("travel_s", F.lit(0).cast("long")))
    named = s.select("key", F.col("trip_id").alias("vertex")).join(chain, "vertex")
    first = Window.partitionBy("key")
    no = F.dense_rank().over(Window.partitionBy("key").orderBy("component")) - 1
    return named.select(F.col("vertex").alias("trip_id"), no.cast("long").alias("route_no"), F.min("vertex").over(first).alias("first_trip"))


def routes(events: DataFrame, kind: str = "fifo", group: DataFrame | None = None) -> DataFrame:
    """``trip_id, route_no, first_trip`` by name of the rule: geographic, fifo, optimal (also: frequency) or offset.

    With ``group`` (trip_id, group_id; as for trips with and without bicycles)
    trips of different groups never share a route.
    """
    kind = {"frequency": "optimal"}.get(kind.lower(), kind.lower())
    if kind in ("fifo", "optimal"):
        out = fifo_routes(events) if kind == "fifo" else optimal_fifo_routes(events)
    else:
        s = _sequences(events).withColumn("key", F.concat_ws(",", "seq"))
        base = F.col("deps")[0]
        rel = F.concat(F.transform(F.slice("deps", 1, F.size("deps") - 1), lambda x: x - base), F.transform(F.slice("arrs", 2, F.size("arrs")), lambda x: x - base))
        s = s.withColumn("rel", rel if kind == "offset" else F.array(F.lit(0).cast("long")))
        no = F.dense_rank().over(Window.partitionBy("key").orderBy("rel")) - 1
        out = s.select("trip_id", no.cast("long").alias("route_no"), F.min("trip_id").over(Window.partitionBy("key")).alias("first_trip"))
    if group is None:
        return out
    g = out.join(group.select("trip_id", "group_id"), "trip_id")
    no = F.dense_rank().over(Window.partitionBy("first_trip").orderBy("route_no", "group_id")) - 1
    return g.select("trip_id", no.cast("long").alias("route_no"), "first_trip")


def overtaking_pairs(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Adjacent trips (by first departure) of a route of which the later is earlier somewhere; empty for FIFO routes."""
    e = events.select("trip_id", "stop_index", "arr", "dep").join(routes, "trip_id")
    first = e.groupBy("trip_id").agg(F.min("dep").alias("t0"))
    w = Window.partitionBy("first_trip", "route_no", "stop_index").orderBy("t0", "arr", "trip_id")
    x = e.join(first, "trip_id").select("trip_id", "arr", "dep", F.lag("arr").over(w).alias("pa"), F.lag("dep").over(w).alias("pd"))
    return x.where("pa > arr OR pd > dep").select("trip_id").distinct()


def min_travel_time(events: DataFrame, footpaths: DataFrame) -> DataFrame:
    """``src, dst, travel_s``: fastest ride to the next stop or footpath for each stop pair."""
    ride = connections(events).select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst"), (F.col("arr") - F.col("dep")).alias("travel_s"))
    return ride.unionByName(footpaths.select("src", "dst", "travel_s")).where("src <> dst").groupBy("src", "dst").agg(F.min("travel_s").alias("travel_s"))


def event_node(kind: int) -> Column:
    """The vertex of an event's departure (0) or arrival (1), from trip_id and stop_index; a trip of more than ``PLACES`` events is an error."""
    place = F.when(F.col("stop_index") < PLACES, F.col("stop_index")).otherwise(F.raise_error(F.lit(f"a trip has more than {PLACES} events")))
    return (F.col("trip_id") * PLACES + place) * 2 + kind


def time_expanded_nodes(events: DataFrame) -> DataFrame:
    """``node, kind, stop_id, t, trip_id, stop_index``: departures but at last stops, arrivals but at first ones."""
    last = F.max("stop_index").over(Window.partitionBy("trip_id"))
    e = events.withColumn("_last", last)
    dep = e.where("stop_index < _last").select(event_node(0).alias("node"), F.lit("dep").alias("kind"), "stop_id", F.col("dep").alias("t"), "trip_id", "stop_index")
    arr = e.where("stop_index > 0").select(event_node(1).alias("node"), F.lit("arr").alias("kind"), "stop_id", F.col("arr").alias("t"), "trip_id", "stop_index")
    return dep.unionByName(arr)


def time_expanded_edges(events: DataFrame, footpaths: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """``src, dst, kind, travel_s, hop``: ride, stay, wait and change edges of the event graph.

    Vertices are those of ``time_expanded_nodes``. ride: a departure to the
    trip's next arrival; stay: an arrival to the trip's next one; wait: a
    departure to the next one at the stop; change: an arrival to the first
    departure at the stop (after ``min_transfer_s`` where ``stops`` is given)
    and at each footpath target that can be reached. Both look ahead by as-of
    joins in time buckets, so a hub stop is no window group of its own.
    """
    nodes = time_expanded_nodes(events)
    dep, arr = nodes.where("kind = 'dep'"), nodes.where("kind = 'arr'")
    way = Window.partitionBy("trip_id").orderBy("stop_index")
    after = arr.select(F.col("node").alias("dst"), F.col("t").alias("t2"), "trip_id", (F.col("stop_index") - 1).alias("stop_index"))
    ride = dep.join(after, ["trip_id", "stop_index"]).select(F.col("node").alias("src"), "dst", F.lit("ride").alias("kind"), (F.col("t2") - F.col("t")).alias("travel_s"), F.lit(0).alias("hop"))
    stay = arr.select(F.col("node").alias("src"), F.lead("node").over(way).alias("dst"), F.lit("stay").alias("kind"), (F.lead("t").over(way) - F.col("t")).alias("travel_s"), F.lit(0).alias("hop")).where("dst IS NOT NULL")
    wait = succeeding(dep.select("stop_id", "t", "node"), ["stop_id"], "t", ["node"]).where("next IS NOT NULL")
    wait = wait.select(F.col("node").alias("src"), F.col("next.node").alias("dst"), F.lit("wait").alias("kind"), (F.col("next.t") - F.col("t")).alias("travel_s"), F.lit(0).alias("hop"))
    here = arr if stops is None else arr.join(stops.select("stop_id", "min_transfer_s"), "stop_id").withColumn("ready", F.col("t") + F.col("min_transfer_s"))
    here = here.select("stop_id", (F.col("t") if stops is None else F.col("ready")).alias("t"), F.col("t").alias("from_t"), F.col("node").alias("from"))
    walk = arr.join(footpaths, arr.stop_id == footpaths.src).select(F.col("dst").alias("stop_id"), (F.col("t") + F.col("travel_s")).alias("t"), F.col("t").alias("from_t"), F.col("node").alias("from"))
    change = following(here.unionByName(walk), dep.select("stop_id", "t", "node"), ["stop_id"], "t", ["node"]).where("next IS NOT NULL")
    change = change.select(F.col("from").alias("src"), F.col("next.node").alias("dst"), F.lit("change").alias("kind"), (F.col("next.t") - F.col("from_t")).alias("travel_s"), F.lit(1).alias("hop"))
    return ride.unionByName(stay).unionByName(wait).unionByName(change)


def reverse_footpaths(footpaths: DataFrame) -> DataFrame:
    """Footpaths walked the other way."""
    return footpaths.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "travel_s")


def reverse(events: DataFrame) -> DataFrame:
    """The network run backwards: times negated, arrival and departure swapped, stop order mirrored (footpaths: ``reverse_footpaths``)."""
    last = F.max("stop_index").over(Window.partitionBy("trip_id"))
    return events.select("trip_id", "route_id", (last - F.col("stop_index")).alias("stop_index"), "stop_id", (-F.col("dep")).alias("arr"), (-F.col("arr")).alias("dep"))


def duplicate_trips(events: DataFrame, offset: int = 86_400) -> DataFrame:
    """All trips and a copy of each ``offset`` seconds later; copies get negative ids (-1 - id)."""
    later = events.withColumns({"arr": F.col("arr") + offset, "dep": F.col("dep") + offset, "trip_id": -1 - F.col("trip_id")})
    return events.unionByName(later)


def scale_times(events: DataFrame, factor: float) -> DataFrame:
    """All times multiplied and truncated to whole seconds."""
    return events.withColumns({c: (F.col(c) * factor).cast("long") for c in ("arr", "dep")})


def with_buffer(events: DataFrame, stops: DataFrame) -> DataFrame:
    """``dep_eff``: the departure less the stop's minimum transfer time."""
    return events.join(stops.select("stop_id", "min_transfer_s"), "stop_id", "left").withColumn("dep_eff", F.col("dep") - F.coalesce("min_transfer_s", F.lit(0)))


def in_bounding_box(events: DataFrame, stops: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Events of the trips that touch no stop outside ``box`` (lon min, lon max, lat min, lat max; e6)."""
    outside = stops.where(~(F.col("lon_e6").between(box[0], box[1]) & F.col("lat_e6").between(box[2], box[3])))
    bad = events.join(outside.select("stop_id"), "stop_id", "left_semi").select("trip_id").distinct()
    return events.join(bad, "trip_id", "left_anti")
