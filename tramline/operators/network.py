"""Tools that change a network: footpath speeds, components, other graphs, repairs of trips and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance_cm, in_box
from ..plans.iterate import rounds_of, settle
from ..sources.timetable import Timetable
from . import graph
from .layout import connections, min_travel_time

#: Named boxes (lon min, lon max, lat min, lat max) in degrees.
BOXES = {
    "germany": (5.730, 15.130, 47.160, 55.070),
    "deutschland": (5.730, 15.130, 47.160, 55.070),
    "switzerland": (5.826, 10.819, 45.487, 48.142),
    "bern": (7.307, 7.563, 46.868, 47.085),
    "london": (-0.612, 0.715, 51.233, 51.707),
}


def walk_seconds(cm: Column, kmh: float) -> Column:
    """Whole seconds for a distance at a speed; a distance of 0 counts as one centimetre."""
    return F.floor(F.greatest(F.lit(1.0), cm) / kmh * 0.036).cast("long")


def measured(footpaths: DataFrame, stops: DataFrame) -> DataFrame:
    """``footpaths`` with ``cm``, the great-circle length."""
    a = stops.select(F.col("stop_id").alias("src"), F.col("lon_e6").alias("x1"), F.col("lat_e6").alias("y1"))
    b = stops.select(F.col("stop_id").alias("dst"), F.col("lon_e6").alias("x2"), F.col("lat_e6").alias("y2"))
    d = distance_cm(F.col("x1") / 1e6, F.col("y1") / 1e6, F.col("x2") / 1e6, F.col("y2") / 1e6)
    return footpaths.join(a, "src").join(b, "dst").select("src", "dst", "travel_s", d.alias("cm"))


def with_min_time(footpaths: DataFrame, seconds: int) -> DataFrame:
    return footpaths.select("src", "dst", F.greatest("travel_s", F.lit(seconds).cast("long")).alias("travel_s"))


def with_max_speed(footpaths: DataFrame, stops: DataFrame, kmh: float) -> DataFrame:
    """Footpaths no faster than ``kmh`` over their great-circle length."""
    return measured(footpaths, stops).select("src", "dst", F.greatest("travel_s", walk_seconds(F.col("cm"), kmh)).alias("travel_s"))


def with_speed(footpaths: DataFrame, stops: DataFrame, kmh: float) -> DataFrame:
    """Footpaths that all are walked at ``kmh``."""
    return measured(footpaths, stops).select("src", "dst", walk_seconds(F.col("cm"), kmh).alias("travel_s"))


def one_hop_transfers(footpaths: DataFrame, most: int, closed: bool = False) -> DataFrame:
    """Direct footpaths for all walks of at most ``most`` seconds, both directions; ``closed`` under further walks if wanted."""
    out = graph.symmetric_minimum(graph.closure(footpaths, most))
    return graph.closure(out) if closed else out


def transfers_by_distance(stops: DataFrame, cm: int = 40_000, kmh: float = 5.1, cell_e6: int = 10_000) -> DataFrame:
    """Footpaths between all stops within ``cm``, walked at ``kmh``; a cell of the grid must be as wide as that."""
    near = graph.radius_pairs(stops, cm, cell_e6).select("src", "dst", F.lit(0).cast("long").alias("travel_s"))
    return with_speed(near, stops, kmh)


def connect_isolated(t: Timetable, cm: int = 1000, kmh: float = 4.5, cell_e6: int = 10_000) -> DataFrame:
    """``t.footpaths`` and new ones, both ways, from stops without any to all stops within ``cm``."""
    alone = t.stops.join(t.footpaths.select(F.col("src").alias("stop_id")).distinct(), "stop_id", "left_anti").select(F.col("stop_id").alias("src"))
    near = graph.radius_pairs(t.stops, cm, cell_e6, alone).select("src", "dst", F.lit(0).cast("long").alias("travel_s"))
    new = with_speed(near, t.stops, kmh)
    back = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "travel_s")
    return t.footpaths.select("src", "dst", "travel_s").unionByName(new).unionByName(back).groupBy("src", "dst").agg(F.min("travel_s").alias("travel_s"))


def add_graph(t: Timetable, vertices: DataFrame, edges: DataFrame, same_cm: int = 500, near_cm: int = 10_000, kmh: float = 4.5, cell_e6: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Stops and a walking graph joined: ``vertex, stop_id`` of all vertices, and ``src, dst, travel_s`` over vertex names.

    ``vertices``: vertex, lon_e6, lat_e6; a stop's vertex is -1 - stop_id. A
    stop is one with its nearest graph vertex within ``same_cm``, and joined to
    it by a walk at ``kmh`` within ``near_cm``. Edges are taken both ways, the
    least time per pair stays.
    """
    points = t.stops.select(F.col("stop_id").alias("point_id"), "lon_e6", "lat_e6")
    beside = settle(graph.nearest(points, vertices.select(F.col("vertex").alias("stop_id"), "lon_e6", "lat_e6"), cell_e6))
    same = beside.where(F.col("distance_cm") <= same_cm).groupBy(F.col("stop_id").alias("vertex")).agg(F.min("point_id").alias("stop_id"))
    one = settle(same.select("vertex", "stop_id"))
    names = vertices.select("vertex").join(one, "vertex", "left").select("vertex", F.when(F.col("stop_id").isNull(), F.col("vertex")).otherwise(-1 - F.col("stop_id")).alias("name"))
    a, b = names.select(F.col("vertex").alias("src"), F.col("name").alias("s")), names.select(F.col("vertex").alias("dst"), F.col("name").alias("d"))
    walks = edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "travel_s")
    joined = beside.join(one.select(F.col("stop_id").alias("point_id")), "point_id", "left_anti").where(F.col("distance_cm") <= near_cm)
    joined = joined.join(names.withColumnRenamed("vertex", "stop_id"), "stop_id").select((-1 - F.col("point_id")).alias("src"), F.col("name").alias("dst"), walk_seconds(F.col("distance_cm").cast("double"), kmh).alias("travel_s"))
    own = t.footpaths.select((-1 - F.col("src")).alias("src"), (-1 - F.col("dst")).alias("dst"), "travel_s")
    stops = t.stops.select((-1 - F.col("stop_id")).alias("vertex"), "stop_id")
    others = names.where("name >= 0").select(F.col("name").alias("vertex"), F.lit(None).cast("long").alias("stop_id"))
    return stops.unionByName(others), graph.symmetric_minimum(walks.unionByName(joined).unionByName(own))


def reduce_graph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges without vertices of at most two neighbours that are not in ``keep`` (vertex); distances between the others stay.

    Edges are symmetric. Rounds remove independent vertices: those with the
    least id among their removable neighbours; a way through becomes an edge.
    """
    left = settle(graph.symmetric_minimum(edges))
    kept = settle(keep.select(F.col("vertex").alias("src")).distinct())
    for _ in rounds_of(None):
        thin = left.groupBy("src").agg(F.count("*").alias("n")).where("n <= 2").join(kept, "src", "left_anti").select("src")
        rival = left.join(thin, "src").join(thin.withColumnRenamed("src", "dst"), "dst").where("dst < src").select("src").distinct()
        gone = settle(thin.join(rival, "src", "left_anti"))
        if gone.isEmpty():
            return left
        out = left.join(gone, "src").select(F.col("src").alias("v"), "dst", "travel_s")
        through = out.select("v", F.col("dst").alias("src"), F.col("travel_s").alias("t1")).join(out, "v").where("src <> dst").select("src", "dst", (F.col("t1") + F.col("travel_s")).alias("travel_s"))
        rest = left.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti")
        left = settle(rest.select("src", "dst", "travel_s").unionByName(through).groupBy("src", "dst").agg(F.min("travel_s").alias("travel_s")))
    return left


def impassable(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Edges where stops can be walked to and from but not through: each stop's arrivals end at ``-1 - stop``, its walks start at the stop."""
    s = stops.select(F.col("stop_id").alias("dst"), F.lit(True).alias("_stop"))
    return edges.join(s, "dst", "left").select("src", F.when(F.col("_stop"), -1 - F.col("dst")).otherwise(F.col("dst")).alias("dst"), "travel_s")


def without_dead_ends(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges without vertices of one neighbour that are not in ``keep``, until there are none."""
    left = settle(edges.select("src", "dst", "travel_s"))
    for _ in rounds_of(None):
        both = left.select("src", "dst").unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        ends = settle(both.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src").join(keep.select(F.col("vertex").alias("src")), "src", "left_anti"))
        if ends.isEmpty():
            return left
        left = settle(left.join(ends, "src", "left_anti").join(ends.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    return left


def without_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch no vertex of ``gone`` (vertex): these are isolated."""
    v = gone.select("vertex")
    return edges.join(v.withColumnRenamed("vertex", "src"), "src", "left_anti").join(v.withColumnRenamed("vertex", "dst"), "dst", "left_anti")


def graph_figures(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, loops, edges beyond the first of a pair, largest degree, edges whose reverse is missing."""
    ends = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).agg(F.countDistinct("v").alias("vertices"))
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    counts = pairs.agg(F.sum("n").alias("edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("loops"), F.sum(F.col("n") - 1).alias("multiple"))
    degree = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_degree"))
    one_way = pairs.alias("a").join(pairs.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")), "left_anti").agg(F.count("*").alias("one_way"))
    return ends.crossJoin(counts).crossJoin(degree).crossJoin(one_way)


def on_vertices(t: Timetable, stops: DataFrame) -> Timetable:
    """The timetable on some stops: trips that touch another stop go, and so do its footpaths."""
    ids = stops.select("stop_id").distinct()
    bad = t.stop_events.join(ids, "stop_id", "left_anti").select("trip_id").distinct()
    foot = t.footpaths.join(ids.withColumnRenamed("stop_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("stop_id", "dst"), "dst", "left_semi")
    return Timetable(t.stops.join(ids, "stop_id", "left_semi"), t.trips.join(bad, "trip_id", "left_anti"), t.stop_events.join(bad, "trip_id", "left_anti"), foot, t.cells.join(ids, "stop_id", "left_semi"))


def largest_component(t: Timetable) -> DataFrame:
    """``stop_id`` of the largest strongly connected part of the least-travel-time graph (ties: the least component)."""
    comp = settle(graph.strong_components(min_travel_time(t.stop_events, t.footpaths)))
    best = comp.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return comp.join(F.broadcast(best), "component").select(F.col("vertex").alias("stop_id"))


def reduced_to_component(t: Timetable, closed: Timetable | None = None) -> tuple[Timetable, Timetable | None]:
    """The timetable on its largest component, and the version with closed footpaths on the same stops."""
    stops = settle(largest_component(t))
    return on_vertices(t, stops), None if closed is None else on_vertices(closed, stops)


def in_named_box(t: Timetable, name: str) -> Timetable:
    """The timetable inside one of ``BOXES``; other names are an error."""
    box = BOXES[name.lower()]
    inside = t.stops.where(in_box(F.col("lon_e6") / 1e6, F.col("lat_e6") / 1e6, *box))
    return on_vertices(t, inside)


def validated(t: Timetable) -> Timetable:
    """Without trips of fewer than two events or at unknown stops, trips that the next one dominates, and stops that nothing uses.

    Trips of one stop sequence come in order of their times; one goes if the
    next leaves no earlier and arrives no later everywhere.
    """
    e = t.stop_events.join(t.stops.select("stop_id", F.lit(True).alias("_known")), "stop_id", "left")
    one = e.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("stop_index", "stop_id", "arr", "dep"))).alias("e"), F.count("_known").alias("k"))
    one = one.where("k = size(e) AND k > 1").select("trip_id", F.col("e.stop_id").alias("seq"), F.col("e.arr").alias("arrs"), F.col("e.dep").alias("deps"))
    nxt = Window.partitionBy("seq").orderBy("deps", "arrs", "trip_id")
    one = one.withColumns({"da": F.lead("arrs").over(nxt), "dd": F.lead("deps").over(nxt)})
    # the first arrival and the last departure carry nobody
    later = "forall(zip_with(slice(deps, 1, size(deps) - 1), slice(dd, 1, size(dd) - 1), (a, b) -> a <= b), x -> x)"
    sooner = "forall(zip_with(slice(arrs, 2, size(arrs) - 1), slice(da, 2, size(da) - 1), (a, b) -> a >= b), x -> x)"
    kept = settle(one.where(f"dd IS NULL OR NOT ({later} AND {sooner})").select("trip_id"))
    events = t.stop_events.join(kept, "trip_id", "left_semi")
    used = events.select("stop_id").unionByName(t.footpaths.select(F.col("src").alias("stop_id"))).unionByName(t.footpaths.select(F.col("dst").alias("stop_id"))).distinct()
    return Timetable(t.stops.join(used, "stop_id", "left_semi"), t.trips.join(kept, "trip_id", "left_semi"), events, t.footpaths, t.cells.join(used, "stop_id", "left_semi"))


def with_order(df: DataFrame, column: str, order: DataFrame) -> DataFrame:
    """``df`` with ids of ``column`` replaced by ``order`` (old, new); rows with other ids go."""
    new = order.select(F.col("old").alias(column), "new")
    return df.join(new, column).withColumn(column, F.col("new")).drop("new").select(*df.columns)


def upsert_stops(stops: DataFrame, more: DataFrame, cm: int = 300, cell_e6: int = 10_000) -> DataFrame:
    """``stops`` and those of ``more`` that have no stop within ``cm``; one within that distance takes the new one's name."""
    points = more.select(F.col("stop_id").alias("point_id"), "lon_e6", "lat_e6")
    near = settle(graph.nearest(points, stops, cell_e6).where(F.col("distance_cm") < cm))
    name = near.join(more.select(F.col("stop_id").alias("point_id"), F.col("name").alias("_name")), "point_id").groupBy("stop_id").agg(F.min_by("_name", F.struct("distance_cm", "point_id")).alias("_name"))
    old = stops.join(name, "stop_id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    new = more.join(near.select(F.col("point_id").alias("stop_id")), "stop_id", "left_anti")
    return old.select(*stops.columns).unionByName(new.select(*stops.columns))


def upsert_trips(events: DataFrame, more: DataFrame) -> DataFrame:
    """``events`` with the trips of ``more``: one with the stops and departures of a known trip takes its place."""

    def key(e: DataFrame) -> DataFrame:
        return e.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("stop_index", "stop_id", "dep"))).alias("k"))

    gone = key(events).join(key(more).select("k").distinct(), "k", "left_semi").select("trip_id")
    return events.join(gone, "trip_id", "left_anti").unionByName(more.select(*events.columns))


def upsert_footpaths(footpaths: DataFrame, more: DataFrame) -> DataFrame:
    """``footpaths`` where those of ``more`` set the time of their pair."""
    rest = footpaths.join(more.select("src", "dst"), ["src", "dst"], "left_anti")
    return rest.unionByName(more.groupBy("src", "dst").agg(F.min("travel_s").alias("travel_s")))


def with_bicycles(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events of the trips in ``allowed`` (trip_id)."""
    return events.join(allowed.select("trip_id").distinct(), "trip_id", "left_semi")


def mean_travel_time(events: DataFrame, first: int, last: int) -> DataFrame:
    """``src, dst, ms``: waiting and riding time averaged over all moments in [first, last), in whole milliseconds.

    At a moment the next departure counts whose arrival no later one beats;
    moments after the last departure don't count, pairs without any are absent.
    """
    c = connections(events).where((F.col("dep_stop") != F.col("arr_stop")) & (F.col("dep") >= first)).groupBy("dep_stop", "arr_stop", "dep").agg(F.min("arr").alias("arr"))
    pair = Window.partitionBy("dep_stop", "arr_stop")
    c = c.withColumn("best", F.min("arr").over(pair.orderBy(F.desc("dep")).rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("since", F.coalesce(F.lag("dep").over(pair.orderBy("dep")), F.lit(first)))
    # whoever comes between since and dep arrives at best: the sum over these moments, twice
    upto = F.least("dep", F.lit(last))
    c = c.where(F.col("since") < upto).withColumns({"n": upto - F.col("since"), "twice": (upto - F.col("since")) * (2 * F.col("best") - F.col("since") - upto)})
    return c.groupBy(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst")).agg(F.expr("sum(twice) * 500 div sum(n)").alias("ms"))


def change_time_pairs(footpaths: DataFrame, stops: DataFrame) -> DataFrame:
    """``src, dst, travel_s``: the stops in reach of half a stop's minimum transfer time."""
    limit = stops.select(F.col("stop_id").alias("src"), F.expr("min_transfer_s div 2").alias("half"))
    most = limit.agg(F.max("half")).first()[0] or 0
    return graph.closure(footpaths, most).join(limit, "src").where("travel_s <= half").select("src", "dst", "travel_s")
