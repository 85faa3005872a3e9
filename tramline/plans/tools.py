"""Registered queries of the network tools, analytics, stores and functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, criteria, event_graph, graph, hierarchy, layout, network, rounds, time_dependent, transfers
from ..sources import exports, store
from ..sources.timetable import Timetable, query_table
from .catalog import FULL, MOST, N, ROUNDS, _conn, _dist, _ev, _labels, _lay, _mc, _query, _targets
from .iterate import checkpoint_folder, settle

_ends = "JOIN stops a ON a.stop_id = f.src JOIN stops b ON b.stop_id = f.dst"
_secs = lambda kmh: f"CAST(floor(greatest(1.0, {_dist}) / {kmh} * 0.036) AS BIGINT)"
_reach = "ed AS (SELECT DISTINCT src, dst FROM ge WHERE src <> dst), rc(src, dst) AS (SELECT src, dst FROM ed UNION SELECT rc.src, ed.dst FROM rc JOIN ed ON rc.dst = ed.src), both_ways AS (SELECT a.src AS v, a.dst AS w FROM rc a JOIN rc b ON a.src = b.dst AND a.dst = b.src UNION SELECT src, src FROM ed UNION SELECT dst, dst FROM ed), sc AS (SELECT v, min(w) AS component FROM both_ways GROUP BY 1)"
_rides = "SELECT dep_stop AS src, arr_stop AS dst, arr - dep AS travel_s FROM conn"


@_query(f"SELECT f.src, f.dst, greatest(travel_s, {_secs(4.5)}) AS travel_s FROM footpaths f {_ends}")
def footpaths_max_speed(spark, sf_dir, t):
    return network.with_max_speed(t.footpaths, t.stops, 4.5)


@_query(f"SELECT f.src, f.dst, {_secs(5.1)} AS travel_s FROM footpaths f {_ends}")
def footpaths_one_speed(spark, sf_dir, t):
    return network.with_speed(t.footpaths, t.stops, 5.1)


@_query("SELECT src, dst, greatest(travel_s, 200) AS travel_s FROM footpaths")
def footpaths_min_time(spark, sf_dir, t):
    return network.with_min_time(t.footpaths, 200)


@_query(f", f AS (SELECT a.stop_id AS src, b.stop_id AS dst, {_dist} AS d FROM stops a, stops b WHERE a.stop_id <> b.stop_id) SELECT f.src, f.dst, {_secs(5.1)} AS travel_s FROM f {_ends} WHERE d <= 200000")
def transfers_by_distance(spark, sf_dir, t):
    return network.transfers_by_distance(t.stops, 200_000, 5.1, 30_000)


@_query("SELECT src, dst, travel_s FROM footpaths WHERE travel_s <= 120 AND src // 3 = dst // 3")
def one_hop_transfers(spark, sf_dir, t):
    return network.one_hop_transfers(t.footpaths, 120)


@_query(f", near AS (SELECT a.stop_id AS src, b.stop_id AS dst, {_dist} AS d FROM stops a, stops b WHERE a.stop_id <> b.stop_id AND a.stop_id NOT IN (SELECT src FROM footpaths WHERE src % 3 <> 1 AND dst % 3 <> 1)), f AS (SELECT src, dst FROM near WHERE d <= 300000), n AS (SELECT f.src, f.dst, {_secs(4.5)} AS travel_s FROM f {_ends}) SELECT src, dst, min(travel_s) AS travel_s FROM (SELECT src, dst, travel_s FROM footpaths WHERE src % 3 <> 1 AND dst % 3 <> 1 UNION ALL SELECT * FROM n UNION ALL SELECT dst, src, travel_s FROM n) GROUP BY 1, 2")
def connect_isolated_stops(spark, sf_dir, t):
    # every third stop loses its footpaths first; a last stop whose group is not whole has none either
    foot = t.footpaths.where("src % 3 <> 1 AND dst % 3 <> 1")
    return network.connect_isolated(Timetable(t.stops, t.trips, t.stop_events, foot, t.cells), 300_000, 4.5, 40_000)


@_query("SELECT src, dst, travel_s FROM footpaths WHERE src % 3 <> 1 AND dst % 3 <> 1")
def reduced_graph(spark, sf_dir, t):
    # the middle stops of the chain are contracted: the ends' distance stays
    keep = t.stops.where("stop_id % 3 <> 1").select(F.col("stop_id").alias("vertex"))
    return network.reduce_graph(t.footpaths.where("travel_s = 120"), keep)


@_query(f"{_conn}, ge AS ({_rides} UNION ALL SELECT * FROM footpaths), {_reach}, sz AS (SELECT component, count(*) AS n FROM sc GROUP BY 1) SELECT v AS stop_id FROM sc WHERE component = (SELECT component FROM sz ORDER BY n DESC, component LIMIT 1)")
def largest_component(spark, sf_dir, t):
    return network.largest_component(t)


@_query(f"{_conn}, ge AS (SELECT * FROM ({_rides}) WHERE src < dst OR src % 4 = 0), {_reach} SELECT v AS vertex, component FROM sc")
def strong_components_rides(spark, sf_dir, t):
    e = layout.connections(t.stop_events).select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst")).where("src <> dst AND (src < dst OR src % 4 = 0)").distinct()
    return graph.strong_components(settle(e))


@_query(f"{_conn}, ge AS (SELECT src, dst, min(travel_s) AS travel_s FROM ({_rides} UNION ALL SELECT * FROM footpaths) WHERE src <> dst GROUP BY 1, 2) SELECT a.src, a.dst AS via, b.dst FROM ge a JOIN ge b ON a.dst = b.src AND a.src <> b.dst LEFT JOIN ge d ON d.src = a.src AND d.dst = b.dst WHERE d.src IS NULL OR d.travel_s > a.travel_s + b.travel_s")
def triangle_violations_rides(spark, sf_dir, t):
    return graph.triangle_violations(settle(layout.min_travel_time(t.stop_events, t.footpaths)))


@_query(f"{_conn}, ge AS ({_rides}), pr AS (SELECT src, dst, count(*) AS n FROM ge GROUP BY 1, 2) SELECT (SELECT count(*) FROM (SELECT src FROM ge UNION SELECT dst FROM ge)) AS vertices, CAST(sum(n) AS BIGINT) AS edges, CAST(sum(CASE WHEN src = dst THEN n ELSE 0 END) AS BIGINT) AS loops, CAST(sum(n - 1) AS BIGINT) AS multiple, (SELECT max(n) FROM (SELECT count(*) AS n FROM ge GROUP BY src)) AS max_degree, (SELECT count(*) FROM pr x WHERE NOT EXISTS (SELECT 1 FROM pr y WHERE y.src = x.dst AND y.dst = x.src)) AS one_way FROM pr")
def graph_figures(spark, sf_dir, t):
    return network.graph_figures(layout.connections(t.stop_events).select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst")))


@_query(f"{_conn}, a AS (SELECT dep_stop AS src, arr_stop AS dst FROM conn), b AS (SELECT src, dst FROM footpaths) SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'rides only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def edge_sets(spark, sf_dir, t):
    a = settle(layout.connections(t.stop_events).select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst")).distinct())
    b = t.footpaths.select("src", "dst")
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "src", "dst")
    return kind(a.intersect(b), "both").unionByName(kind(a.union(b).distinct(), "either")).unionByName(kind(a.subtract(b), "rides only"))


@_query(f"{_conn} SELECT row_number() OVER (ORDER BY arr_stop, arr, dep, trip_id, dep_stop) - 1 AS no, trip_id, dep FROM (SELECT DISTINCT dep_stop, arr_stop, dep, arr, trip_id FROM conn)")
def ordered_connections(spark, sf_dir, t):
    c = layout.ordered_connections(layout.connections(t.stop_events), "arrival_stop").withColumn("key", F.struct("arr_stop", "arr", "dep", "trip_id", "dep_stop"))
    return exports.numbered(c, "key").select("no", "trip_id", "dep")


@_query("SELECT trip_id, stop_index, stop_id, CASE WHEN stop_index = 0 THEN dep - 1 ELSE arr END AS arr, CASE WHEN stop_index = 7 THEN arr + 1 ELSE dep END AS dep FROM stop_events")
def trips_of_connections(spark, sf_dir, t):
    return layout.trips_of_connections(layout.valid_connections(layout.connections(t.stop_events), t.stops)).drop("route_id")


_mean = "c AS (SELECT dep_stop AS src, arr_stop AS dst, dep, min(arr) AS arr FROM conn WHERE dep_stop <> arr_stop AND dep >= 28800 GROUP BY 1, 2, 3), m AS (SELECT *, min(arr) OVER (PARTITION BY src, dst ORDER BY dep DESC) AS best, coalesce(lag(dep) OVER (PARTITION BY src, dst ORDER BY dep), 28800) AS since FROM c), k AS (SELECT src, dst, least(dep, 36000) - since AS n, (least(dep, 36000) - since) * (2 * best - since - least(dep, 36000)) AS twice FROM m WHERE since < least(dep, 36000))"


@_query(f"{_conn}, {_mean} SELECT src, dst, CAST(sum(twice) * 500 // sum(n) AS BIGINT) AS ms FROM k GROUP BY 1, 2")
def mean_travel_time(spark, sf_dir, t):
    return network.mean_travel_time(t.stop_events, 28_800, 36_000)


@_query("SELECT src, dst, travel_s FROM footpaths WHERE travel_s <= 120 * (src % 3)")
def change_time_pairs(spark, sf_dir, t):
    return network.change_time_pairs(t.footpaths, t.stops.withColumn("min_transfer_s", 240 * (F.col("stop_id") % 3)))


_points = "pt AS (SELECT stop_id AS point_id, lon_e6 + 1000 AS lon_e6, lat_e6 + 700 AS lat_e6 FROM stops)"


@_query(f", {_points}, nr AS (SELECT point_id, b.stop_id, CAST(round({_dist}) AS BIGINT) AS distance_cm FROM pt a, stops b) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY distance_cm, stop_id) AS INTEGER) AS nth FROM nr) WHERE nth <= 2")
def nearest_stops(spark, sf_dir, t):
    points = t.stops.select(F.col("stop_id").alias("point_id"), (F.col("lon_e6") + 1000).alias("lon_e6"), (F.col("lat_e6") + 700).alias("lat_e6"))
    return graph.nearest(points, t.stops, 20_000, 2)


@_query("SELECT trip_id FROM (SELECT e.trip_id, e.arr, e.dep, lag(e.arr) OVER w AS pa, lag(e.dep) OVER w AS pd FROM stop_events e JOIN trips USING (trip_id) JOIN (SELECT trip_id, min(dep) AS t0 FROM stop_events GROUP BY 1) f USING (trip_id) WINDOW w AS (PARTITION BY pat, stop_index ORDER BY f.t0, e.arr, e.trip_id)) WHERE pa > arr OR pd > dep GROUP BY 1")
def geographic_overtaking(spark, sf_dir, t):
    return layout.overtaking_pairs(t.stop_events, settle(layout.routes(t.stop_events, "geographic")))


@_query("SELECT src, dst FROM footpaths WHERE src % 16 <> dst % 16")
def crossing_footpaths_of_a_bad_partition(spark, sf_dir, t):
    return transfers.crossing_footpaths(t.footpaths, t.stops.select("stop_id", (F.col("stop_id") % 16).alias("cell_id")))


@_query("SELECT stop_id FROM stops WHERE stop_id NOT IN (SELECT stop_id FROM stop_events WHERE route_id % 5 = 0) AND stop_id NOT IN (SELECT src FROM footpaths WHERE travel_s = 240)")
def isolated_stops_of_some_routes(spark, sf_dir, t):
    return analytics.isolated_stops(t.stops, t.stop_events.where("route_id % 5 = 0"), t.footpaths.where("travel_s = 240"))


def _improved(k: int) -> str:
    first = "SELECT CAST(0 AS BIGINT) AS trips, query_id, stop_id FROM l0"
    rest = [f"SELECT CAST({i} AS BIGINT), n.query_id, n.stop_id FROM l{i} n LEFT JOIN l{i - 1} o ON o.query_id = n.query_id AND o.stop_id = n.stop_id WHERE o.arr IS NULL OR n.arr < o.arr" for i in range(1, k + 1)]
    return " UNION ALL ".join([first, *rest])


@_query(f"{_labels(FULL)} SELECT trips, count(*) AS labels, count(DISTINCT query_id) AS queries FROM ({_improved(FULL)}) GROUP BY 1")
def labels_per_round(spark, sf_dir, t):
    return analytics.labels_per_round(rounds.raptor(query_table(spark, sf_dir, N), _lay(t), t.footpaths))


@_query(f"{_conn}, cs AS (SELECT route_id, dep_stop AS src, arr_stop AS dst, min(CASE WHEN arr > dep THEN arr - dep END) AS s FROM conn JOIN trips USING (trip_id) GROUP BY 1, 2, 3) SELECT route_id, max(CAST(round({_dist} / 100) AS BIGINT)) AS longest_m, max(CAST(round({_dist} / 100) AS BIGINT) * 1000 // s) AS fastest_mm_s FROM cs f {_ends} GROUP BY 1")
def route_extremes(spark, sf_dir, t):
    return analytics.route_extremes(t.stop_events, t.stops)


_bucket = ", ".join(f"count(*) FILTER (WHERE trips = {k}) AS trips_{k}" for k in range(17))


@_query(f"{_labels(ROUNDS)} {_targets(ROUNDS)} SELECT CAST(CAST(round({_dist} / 100) AS BIGINT) // 10000 * 10 AS BIGINT) AS km_from, {_bucket}, count(*) FILTER (WHERE trips > 16) AS trips_more FROM p JOIN queries q USING (query_id) JOIN stops a ON a.stop_id = q.source JOIN stops b ON b.stop_id = q.target GROUP BY 1")
def distance_by_trips(spark, sf_dir, t):
    q = settle(query_table(spark, sf_dir, N))
    return analytics.distance_by_trips(rounds.at_targets(rounds.raptor(q, _lay(t), t.footpaths, to_target=True), q), q, t.stops)


@_query(f"{_mc(MOST)}, bt AS (SELECT * FROM (SELECT query_id, trips, min(arr) AS arr FROM mc GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM mc y WHERE y.query_id = x.query_id AND y.trips < x.trips AND y.arr <= x.arr)), an AS (SELECT m.query_id, m.trips, m.arr, q.dep_s, min(walk) AS walk FROM mc m JOIN bt USING (query_id, trips, arr) JOIN queries q USING (query_id) GROUP BY 1, 2, 3, 4), bs AS (SELECT query_id, min(walk) AS base FROM an GROUP BY 1 HAVING min(walk) > 0), gr AS (SELECT a AS arrival_slack, s AS trip_slack, h AS share FROM (VALUES (100), (110), (125), (150)) x(a), (VALUES (100), (125), (150)) y(s), (VALUES (75), (50), (25)) z(h)) SELECT CAST(gr.arrival_slack AS BIGINT) AS arrival_slack, CAST(gr.trip_slack AS BIGINT) AS trip_slack, CAST(gr.share AS BIGINT) AS share, (SELECT count(*) FROM bs) AS queries, (SELECT count(DISTINCT m.query_id) FROM an JOIN mc m ON m.query_id = an.query_id JOIN bs ON bs.query_id = an.query_id WHERE (m.arr - an.dep_s) * 100 <= gr.arrival_slack * (an.arr - an.dep_s) AND m.trips <= (gr.trip_slack * an.trips + 99) // 100 AND m.walk * 100 <= gr.share * base) AS reached FROM gr", 12)
def walking_savings(spark, sf_dir, t):
    q = settle(query_table(spark, sf_dir, 12))
    return analytics.walking_savings(settle(criteria.walking(q, _lay(t), t.footpaths)), q, [1, 1.1, 1.25, 1.5], [1, 1.25, 1.5], [0.75, 0.5, 0.25])


@_query(f"{_ev}, tt AS (SELECT tr.trip_id AS a, x.trip_id AS b FROM tr JOIN ev x ON x.route_id = to_route AND x.stop_index = to_index AND x.rank = to_rank) SELECT trip_id, coalesce(n_out, 0) AS n_out, CAST(0 AS BIGINT) AS max_out, coalesce(n_in, 0) AS n_in, CAST(0 AS BIGINT) AS max_in FROM (SELECT a AS trip_id, count(*) AS n_out FROM tt GROUP BY 1) FULL JOIN (SELECT b AS trip_id, count(*) AS n_in FROM tt GROUP BY 1) USING (trip_id)")
def transfers_of_trips(spark, sf_dir, t):
    lay = _lay(t)
    return hierarchy.trip_levels_both(transfers.event_transfers(t.stop_events, lay, t.footpaths).withColumn("level", F.lit(0)), lay)


@_query("SELECT cell, stop_id, count(*) AS n FROM (SELECT stop_id, c.cell_id >> 1 AS cell, lag(c.cell_id >> 1) OVER (PARTITION BY trip_id ORDER BY stop_index) AS was FROM stop_events JOIN cells c USING (stop_id)) WHERE was <> cell GROUP BY 1, 2")
def border_stops(spark, sf_dir, t):
    return hierarchy.border_stops(t.stop_events, t.cells, 1)


@_query(f"{_ev} SELECT 'transfer' AS kind, count(*) AS n, count(*) AS weight FROM tr UNION ALL SELECT 'ride', count(*), 0 FROM stop_events WHERE stop_index < 7 UNION ALL SELECT 'stay', count(*), 0 FROM stop_events WHERE stop_index BETWEEN 1 AND 6")
def split_event_graph(spark, sf_dir, t):
    lay = _lay(t)
    g = event_graph.split_event_graph(transfers.event_transfers(t.stop_events, lay, t.footpaths), lay)
    return g.groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@_query("SELECT kind, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT 'board' AS kind, 0 AS w FROM (SELECT DISTINCT route_id, stop_index FROM stop_events WHERE stop_index < 7) UNION ALL SELECT 'leave', 0 FROM (SELECT DISTINCT route_id, stop_index FROM stop_events WHERE stop_index > 0) UNION ALL SELECT 'ride', count(*) FROM stop_events WHERE stop_index < 7 GROUP BY route_id, stop_index UNION ALL SELECT 'walk', travel_s FROM footpaths) GROUP BY 1")
def time_dependent_graph(spark, sf_dir, t):
    e = time_dependent.graph_edges(_lay(t), t.footpaths)
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("travel_s"), F.size("deps").cast("long"))).alias("weight"))


@_query("SELECT '<node id=\"n' || stop_id || '\"><data key=\"lon\">' || printf('%.6f', lon_e6 / 1e6) || '</data><data key=\"lat\">' || printf('%.6f', lat_e6 / 1e6) || '</data></node>' AS line FROM stops UNION ALL SELECT '<edge source=\"n' || src || '\" target=\"n' || dst || '\"><data key=\"time\">' || travel_s || '</data></edge>' FROM footpaths")
def export_graphml(spark, sf_dir, t):
    lines = exports.graphml(t.stops.select(F.col("stop_id").alias("vertex"), "lon_e6", "lat_e6"), t.footpaths)
    return lines.where("line LIKE '<node%' OR line LIKE '<edge %'").select("line")


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"


@_query("SELECT trip_id, route_id, stop_index, stop_id, arr, dep FROM stop_events")
def parquet_round_trip(spark, sf_dir, t):
    at = _folder(spark)
    store.save_timetable(t, at)
    return store.load_timetable(spark, at).stop_events


@_query("SELECT f.src, f.dst, f.travel_s, a.lon_e6, a.lat_e6, c.cell_id FROM footpaths f JOIN stops a ON a.stop_id = f.src JOIN cells c ON c.stop_id = f.src")
def csv_round_trip(spark, sf_dir, t):
    at = _folder(spark)
    exports.write_csv(exports.csv_tables(t), at)
    back = store.read_csv_tables(spark, at)
    own = back.stops.select(F.col("stop_id").alias("src"), "lon_e6", "lat_e6").join(back.cells.withColumnRenamed("stop_id", "src"), "src")
    return back.footpaths.join(own, "src").select("src", "dst", "travel_s", "lon_e6", "lat_e6", "cell_id")


@_query("SELECT src, dst, travel_s FROM footpaths")
def dimacs_round_trip(spark, sf_dir, t):
    at = _folder(spark)
    exports.dimacs(t.footpaths).write.text(at)
    return store.read_dimacs(spark, at)[0]


@_query("SELECT stop_id, cell_id FROM cells")
def partition_round_trip(spark, sf_dir, t):
    component = settle(graph.weak_components(t.stops.select(F.col("stop_id").alias("vertex")), t.footpaths))
    at = _folder(spark)
    # one line per component in order of its least stop
    lines = t.cells.join(component.select(F.col("component").alias("stop_id")).distinct(), "stop_id").orderBy("stop_id")
    lines.select(F.col("cell_id").cast("string")).write.text(at)
    return store.read_partition(spark, at, component)


@_query("SELECT s_suppkey AS id, regexp_matches(s_name, '^[0-9]+$') AS number, len(s_name) - len(replace(s_name, '0', '')) AS zeros, CASE WHEN s_suppkey * 1234 >= 1024 * 1024 THEN printf('%.1f', s_suppkey * 1234 / 1048576.0) || 'MB' WHEN s_suppkey * 1234 >= 1024 THEN printf('%.1f', s_suppkey * 1234 / 1024.0) || 'KB' ELSE (s_suppkey * 1234) || 'B' END AS size, CAST(list_sort([s_suppkey % 7, s_suppkey % 5, s_suppkey % 3])[2] AS BIGINT) AS middle, CAST(s_suppkey * 256 + s_suppkey % 9 AS BIGINT) AS packed FROM (SELECT s_name, CAST(s_suppkey AS BIGINT) AS s_suppkey FROM supplier)")
def string_and_number_functions(spark, sf_dir, t):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"), "s_name")
    three = F.array(F.col("id") % 7, F.col("id") % 5, F.col("id") % 3)
    return s.select("id", text.is_number(F.col("s_name")).alias("number"), text.count_of(F.col("s_name"), "0").cast("long").alias("zeros"), text.byte_size(F.col("id") * 1234).alias("size"), text.percentile_of(three, 0.5).alias("middle"), text.packed_time(F.col("id"), F.col("id") % 9).alias("packed"))
