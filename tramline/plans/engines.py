"""Registered queries of further engines: event graph, buffers, profiles, three criteria, walks that are not a closed table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import criteria, event_graph, graph, layout, profiles, rounds, transfers, ultra, walking
from ..sources import feed, gtfs
from ..sources.feed import FEED
from ..sources.timetable import WALKERS, query_table
from .catalog import FULL, MOST, N, ROUNDS, _labels, _lay, _mc, _query, _reduced, _sub, _targets
from .iterate import checkpoint_folder, settle


@_query(f"{_labels(FULL)} SELECT query_id, stop_id, arr FROM l{FULL}")
def te_reachability(spark, sf_dir, t):
    nodes = settle(layout.time_expanded_nodes(t.stop_events))
    return event_graph.search(query_table(spark, sf_dir, N), nodes, settle(layout.time_expanded_edges(t.stop_events, t.footpaths)), t.footpaths)


_buffered = _labels(ROUNDS, events="eff")


@_query(f", eff AS MATERIALIZED (SELECT trip_id, route_id, stop_index, stop_id, arr, dep - 60 * (stop_id % 3) AS dep FROM stop_events) {_buffered} {_targets(ROUNDS)} SELECT * FROM p")
def raptor_buffered(spark, sf_dir, t):
    # one rule for all: a stop's transfer time lowers every departure there
    stops = t.stops.withColumn("min_transfer_s", 60 * (F.col("stop_id") % 3))
    events = layout.with_buffer(t.stop_events, stops).withColumn("dep", F.col("dep_eff")).drop("dep_eff", "min_transfer_s")
    q = settle(query_table(spark, sf_dir, N))
    return rounds.at_targets(rounds.raptor(q, settle(layout.departures(events)), t.footpaths, to_target=True), q)


_profile = f"{_sub} {_labels(ROUNDS, 'sub')} {_targets(ROUNDS, 'sub')}, f AS (SELECT query_id // 1000000 AS query_id, query_id % 1000000 AS dep, trips, arr FROM p WHERE trips > 0) SELECT DISTINCT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.query_id = x.query_id AND y.dep >= x.dep AND y.trips <= x.trips AND y.arr <= x.arr AND (y.dep > x.dep OR y.trips < x.trips OR y.arr < x.arr))"


@_query(_profile, 4)
def profile_segments(spark, sf_dir, t):
    lay = _lay(t)
    return profiles.by_segments(settle(query_table(spark, sf_dir, 4)), t.stop_events, lay, settle(transfers.event_transfers(t.stop_events, lay, t.footpaths)), t.footpaths, 3600)


@_query(f"{_sub} {_labels(ROUNDS, 'sub')}, f AS (SELECT l.query_id // 1000000 AS query_id, l.query_id % 1000000 AS dep, l.arr FROM l{ROUNDS} l JOIN sub q ON q.query_id = l.query_id AND q.target = l.stop_id) SELECT DISTINCT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.query_id = x.query_id AND y.dep >= x.dep AND y.arr <= x.arr AND (y.dep > x.dep OR y.arr < x.arr))", 4)
def profile_connections(spark, sf_dir, t):
    return profiles.by_connections(settle(query_table(spark, sf_dir, 4)), t.stop_events, _lay(t), settle(layout.connections(t.stop_events)), t.footpaths, 3600)


_every = " UNION ALL ".join(f"SELECT query_id, CAST({i} AS BIGINT) AS trips, stop_id, arr FROM l{i}" for i in range(FULL + 1))


@_query(f"{_sub} {_labels(FULL, 'sub')}, a AS (SELECT *, lag(arr) OVER (PARTITION BY query_id, stop_id ORDER BY trips) AS before FROM ({_every})), f AS MATERIALIZED (SELECT query_id // 1000000 AS query_id, stop_id, query_id % 1000000 AS dep, trips, arr FROM a WHERE trips > 0 AND (before IS NULL OR arr < before)) SELECT DISTINCT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.query_id = x.query_id AND y.stop_id = x.stop_id AND y.dep >= x.dep AND y.trips <= x.trips AND y.arr <= x.arr AND (y.dep > x.dep OR y.trips < x.trips OR y.arr < x.arr))", 2)
def profile_one_to_all(spark, sf_dir, t):
    return profiles.one_to_all(settle(query_table(spark, sf_dir, 2)), t.stop_events, _lay(t), t.footpaths, 3600)


@_query(f"{_mc(MOST)} SELECT * FROM mc", 6)
def mc_segments(spark, sf_dir, t):
    lay = _lay(t)
    return profiles.walking_by_segments(settle(query_table(spark, sf_dir, 6)), lay, settle(transfers.event_transfers(t.stop_events, lay, t.footpaths)), t.footpaths)


_bounded_twin = f"{_mc(MOST)}, an AS (SELECT * FROM (SELECT query_id, trips, min(arr) AS arr FROM mc GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM mc y WHERE y.query_id = x.query_id AND y.trips < x.trips AND y.arr <= x.arr)) SELECT DISTINCT m.query_id, m.trips, m.arr, m.walk FROM mc m JOIN queries q USING (query_id) JOIN an ON an.query_id = m.query_id AND m.arr - dep_s <= 1.25 * (an.arr - dep_s) AND m.trips <= ceil(1.5 * an.trips)"


@_query(_bounded_twin, 6)
def bounded_search(spark, sf_dir, t):
    return criteria.bounded_search(settle(query_table(spark, sf_dir, 6)), _lay(t), t.footpaths, 1.25, 1.5)


@_query(_bounded_twin, 6)
def backward_bounded_search(spark, sf_dir, t):
    back = settle(layout.departures(layout.reverse(t.stop_events)))
    return criteria.bounded_search(settle(query_table(spark, sf_dir, 6)), _lay(t), t.footpaths, 1.25, 1.5, back)


def _chain(t):
    """Footpaths as a graph that is not closed: a walk of two edges is the third footpath of each group."""
    return settle(t.footpaths.where("travel_s = 120"))


_pareto = f"{_labels(ROUNDS)} {_targets(ROUNDS)} SELECT * FROM p"


@_query(_pareto)
def raptor_over_graph(spark, sf_dir, t):
    q = settle(query_table(spark, sf_dir, N))
    return rounds.at_targets(rounds.raptor(q, _lay(t), walking.over_graph(_chain(t)), to_target=True), q)


@_query(_pareto)
def raptor_over_hub_labels(spark, sf_dir, t):
    q = settle(query_table(spark, sf_dir, N))
    return rounds.at_targets(rounds.raptor(q, _lay(t), walking.over_labels(*walking.canonical_labels(_chain(t))), to_target=True), q)


@_query(_pareto)
def raptor_over_shortcuts(spark, sf_dir, t):
    lay, q = _lay(t), settle(query_table(spark, sf_dir, N))
    cuts = settle(walking.shortcuts(_reduced(t, lay), lay, t.footpaths))
    return ultra.journeys(q, lay, cuts, *ultra.footpath_ends(q, t.footpaths))


@_query(f"{_labels(FULL)} SELECT query_id, stop_id, arr FROM l{FULL}")
def connections_over_graph(spark, sf_dir, t):
    return rounds.connection_scan(query_table(spark, sf_dir, N), settle(layout.connections(t.stop_events)), walking.over_graph(_chain(t)))


@_query(f"{_labels(FULL)} SELECT query_id, stop_id, arr FROM l{FULL}")
def connections_over_hub_labels(spark, sf_dir, t):
    return rounds.connection_scan(query_table(spark, sf_dir, N), settle(layout.connections(t.stop_events)), walking.over_labels(*walking.canonical_labels(_chain(t))))


@_query("SELECT src, dst, travel_s FROM footpaths WHERE false")
def shortcut_faults(spark, sf_dir, t):
    # every footpath is the shortest walk over the chain, so none may be at fault
    return walking.shortcut_faults(t.footpaths, _chain(t)).select("src", "dst", "travel_s")


@_query("SELECT src AS source, dst AS target, travel_s AS dist FROM footpaths")
def contraction_distances(spark, sf_dir, t):
    pairs = t.footpaths.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return graph.hierarchy_distances(settle(pairs), settle(graph.contract(_chain(t))))


_foot2 = "SELECT 'walking' AS mode, src, dst, travel_s FROM footpaths UNION ALL SELECT 'scooter', src, dst, travel_s // 4 + 300 FROM footpaths"


def _two_modes(k: int) -> str:
    crit = ["arr", "walking_s", "scooter_s"]
    weak, strict = " AND ".join(f"y.{c} <= x.{c}" for c in crit), " OR ".join(f"y.{c} < x.{c}" for c in crit)
    sky = lambda n: f"SELECT DISTINCT * FROM {n} x WHERE NOT EXISTS (SELECT 1 FROM {n} y WHERE y.query_id = x.query_id AND y.stop_id = x.stop_id AND {weak} AND ({strict}))"
    go = lambda n: f"SELECT query_id, stop_id, arr, walking_s, scooter_s FROM {n} UNION SELECT query_id, dst, arr + travel_s, walking_s + CASE WHEN mode = 'walking' THEN travel_s ELSE 0 END, scooter_s + CASE WHEN mode = 'scooter' THEN travel_s ELSE 0 END FROM {n} JOIN f2 ON src = stop_id"
    out = f""", f2 AS ({_foot2}), rp AS MATERIALIZED (SELECT DISTINCT route_id, stop_index, stop_id FROM stop_events WHERE stop_index < 7),
        rd AS MATERIALIZED (SELECT route_id, stop_index, dep, min(trip_id) AS trip_id FROM stop_events GROUP BY 1, 2, 3),
        m0 AS (SELECT query_id, source AS stop_id, dep_s AS arr, CAST(0 AS BIGINT) AS walking_s, CAST(0 AS BIGINT) AS scooter_s FROM queries), w0 AS ({go('m0')}), g0 AS MATERIALIZED ({sky('w0')})"""
    for i in range(1, k + 1):
        out += f""", o{i} AS (SELECT query_id, trip_id, walking_s, scooter_s, min(p.stop_index) AS i FROM (SELECT g.*, rp.route_id, rp.stop_index FROM g{i - 1} g JOIN rp ON rp.stop_id = g.stop_id) p
            ASOF JOIN rd ON rd.route_id = p.route_id AND rd.stop_index = p.stop_index AND p.arr <= rd.dep GROUP BY 1, 2, 3, 4),
        q{i} AS MATERIALIZED (SELECT o.query_id, e.stop_id, min(e.arr) AS arr, o.walking_s, o.scooter_s FROM o{i} o JOIN stop_events e ON e.trip_id = o.trip_id AND e.stop_index > o.i GROUP BY 1, 2, 4, 5),
        z{i} AS MATERIALIZED ({sky(f'q{i}')}), w{i} AS MATERIALIZED (SELECT * FROM g{i - 1} UNION {go(f'z{i}')}), g{i} AS MATERIALIZED ({sky(f'w{i}')})"""
    rows = " UNION ALL ".join(f"SELECT query_id, CAST({i} AS BIGINT) AS trips, stop_id, arr, walking_s, scooter_s FROM g{i}" for i in range(k + 1))
    return out + f", tg AS (SELECT x.query_id, trips, arr, walking_s, scooter_s FROM ({rows}) x JOIN queries q ON q.query_id = x.query_id AND q.target = x.stop_id) SELECT DISTINCT * FROM tg x WHERE NOT EXISTS (SELECT 1 FROM tg y WHERE y.query_id = x.query_id AND y.trips <= x.trips AND {weak} AND (y.trips < x.trips OR {strict}))"


@_query(_two_modes(MOST), 4)
def multimodal_pareto(spark, sf_dir, t):
    lay, q = _lay(t), settle(query_table(spark, sf_dir, 4))
    faster = t.footpaths.select("src", "dst", F.expr("travel_s div 4").alias("travel_s"))
    walks = settle(walking.by_mode({"walking": t.footpaths, "scooter": faster}))
    places, arrivals = rounds.sides(lay)
    return walking.multimodal(q, lambda labels, cost: criteria.ride_one_trip(labels, places, arrivals, cost), walks, ["walking", "scooter"])


def _feed(spark, sf_dir):
    """The feed of the given tables, written as files and read back."""
    folder = f"{checkpoint_folder(spark)}/feed-{uuid.uuid4().hex}"
    feed.write(feed.tables(spark, sf_dir), folder)
    return gtfs.read(spark, folder)


@_query(f"{WALKERS} {FEED} SELECT CAST(n AS VARCHAR) AS service_id, day FROM fd")
def calendar_unroll(spark, sf_dir, t):
    f = _feed(spark, sf_dir)
    return gtfs.service_days(f["calendar"], f["calendar_dates"], "2024-01-01", "2024-01-07")


@_query(f"{WALKERS} {FEED} SELECT CAST(trip_id AS VARCHAR) AS trip, day * 86400 + start AS dep FROM fr JOIN fd USING (n)")
def frequency_expand(spark, sf_dir, t):
    f = _feed(spark, sf_dir)
    often = f["frequencies"].select(F.col("trip_id").alias("trip")).distinct()
    return gtfs.trip_events(f, "2024-01-01", "2024-01-07").where("stop_index = 0").join(often, "trip", "left_semi").select("trip", "dep")


@_query(f"{WALKERS} {FEED} SELECT stop_index, count(*) AS n, count(DISTINCT stop_id) AS stops, CAST(sum(CASE WHEN stop_index = 0 THEN dep - 1 ELSE arr END) AS BIGINT) AS arrs, CAST(sum(CASE WHEN stop_index = 7 THEN arr + 1 ELSE dep END) AS BIGINT) AS deps FROM fe GROUP BY 1")
def feed_network_events(spark, sf_dir, t):
    net = gtfs.network(_feed(spark, sf_dir), "2024-01-01", "2024-01-01")
    return net.stop_events.groupBy("stop_index").agg(F.count("*").alias("n"), F.countDistinct("stop_id").alias("stops"), F.sum("arr").alias("arrs"), F.sum("dep").alias("deps"))


@_query(f"{WALKERS} {FEED}, known AS (SELECT DISTINCT stop_id FROM fe), own AS (SELECT * FROM queries WHERE source IN (SELECT * FROM known) AND target IN (SELECT * FROM known)), hops AS (SELECT * FROM footpaths WHERE src IN (SELECT * FROM known) AND dst IN (SELECT * FROM known)) {_labels(ROUNDS, 'own', 'fe', 'hops')} {_targets(ROUNDS, 'own')} SELECT * FROM p")
def gtfs_earliest_arrival(spark, sf_dir, t):
    # stops have dense numbers after the import; names tell which they are
    net = gtfs.network(_feed(spark, sf_dir), "2024-01-01", "2024-01-01")
    ids = settle(net.stops.select("name", F.col("stop_id").alias("no")).join(t.stops.select("name", "stop_id"), "name").select("stop_id", "no"))
    q = query_table(spark, sf_dir, N).join(ids.withColumnRenamed("no", "a"), F.col("source") == F.col("stop_id")).drop("stop_id").join(ids.withColumnRenamed("no", "b"), F.col("target") == F.col("stop_id"))
    q = settle(q.select("query_id", F.col("a").alias("source"), F.col("b").alias("target"), "dep_s"))
    return rounds.at_targets(rounds.raptor(q, settle(layout.departures(net.stop_events)), net.footpaths, to_target=True), q)
