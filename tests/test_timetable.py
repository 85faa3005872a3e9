"""Hand-made micro networks, cross-algorithm equalities and the SQL twins."""

import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tramline.functions import columns
from tramline.operators import criteria, graph, hierarchy, hub_labels, journeys, layout, pareto, rounds, time_dependent, transfer_patterns, transfers
from tramline.plans import catalog, iterate
from tramline.sources import exports, gtfs
from tramline.sources.timetable import Timetable, project, query_table
from tramline.streaming import hourly

SF = "/root/testdata/sf0.001"


def events(spark, trips):
    """trips: {trip: (route, [(stop, arr, dep)])}"""
    rows = [(t, r, i, s, a, d) for t, (r, es) in trips.items() for i, (s, a, d) in enumerate(es)]
    return spark.createDataFrame(rows, "trip_id long, route_id long, stop_index long, stop_id long, arr long, dep long")


def feet(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs], "src long, dst long, travel_s long")


def one(spark, source, target, dep):
    return spark.createDataFrame([(0, source, target, dep)], "query_id long, source long, target long, dep_s long")


A, B, C, D, E = range(5)
ASOF = {0: (0, [(A, 100, 100), (B, 200, 210), (C, 300, 300)])}
WALK = {0: (0, [(A, 100, 100), (B, 200, 200)]), 1: (1, [(D, 250, 250), (C, 400, 400)])}
TRADE = {0: (0, [(A, 0, 0), (C, 500, 500)]), 1: (1, [(A, 0, 0), (B, 100, 100)]), 2: (2, [(B, 100, 100), (C, 400, 400)])}


@pytest.mark.parametrize(
    ("trips", "foot", "query", "want"),
    [
        (ASOF, [], (A, C, 100), [(1, 300)]),
        (ASOF, [], (A, C, 101), []),
        (WALK, [(B, D, 50)], (A, C, 0), [(2, 400)]),
        (TRADE, [], (A, C, 0), [(1, 500), (2, 400)]),
        (ASOF, [], (A, A, 50), [(0, 50)]),
    ],
)
def test_micro_networks(spark, trips, foot, query, want):
    ev, fp, q = events(spark, trips), feet(spark, foot), one(spark, *query)
    lay = layout.departures(ev)
    rap = rounds.at_targets(rounds.raptor(q, lay, fp), q)
    assert sorted((r.trips, r.arr) for r in rap.collect()) == want
    tb = rounds.trip_based(q, lay, transfers.event_transfers(ev, lay, fp), fp)
    assert sorted((r.trips, r.arr) for r in tb.collect()) == want
    csa = rounds.connection_scan(q, layout.connections(ev), fp).where(f"stop_id = {query[1]}").collect()
    assert [r.arr for r in csa] == ([min(a for _, a in want)] if want else [])


def random_network(seed):
    rng = random.Random(seed)
    trips, t = {}, 0
    for r in range(8):
        seq = rng.sample(range(12), rng.randint(2, 6))
        ride = [rng.randint(20, 90) for _ in seq]
        for start in sorted(rng.sample(range(0, 3000, 60), 6)):
            now, es = start, []
            for s, w in zip(seq, ride, strict=True):
                es.append((s, now, now + 5))
                now += w
            trips[t] = (r, es)
            t += 1
    return trips, [(2 * i, 2 * i + 1, rng.randint(10, 60)) for i in range(5)]


def dijkstra(trips, foot, source, dep):
    """Earliest arrivals by a label-setting search over (time, stop), riding every catchable trip."""
    walk = {}
    for a, b, w in foot:
        walk.setdefault(a, []).append((b, w))
        walk.setdefault(b, []).append((a, w))
    best, heap = {}, [(dep, source, True)]
    for b, w in walk.get(source, ()):
        heapq.heappush(heap, (dep + w, b, False))
    while heap:
        now, s, _ = heapq.heappop(heap)
        if s in best:
            continue
        best[s] = now
        for _, es in trips.values():
            for i, (x, _, d) in enumerate(es[:-1]):
                if x == s and d >= now:
                    for y, a, _ in es[i + 1 :]:
                        heapq.heappush(heap, (a, y, False))
                        for b, w in walk.get(y, ()):
                            heapq.heappush(heap, (a + w, b, False))
                    break
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_algorithms_agree_with_dijkstra(spark, seed):
    trips, foot = random_network(seed)
    ev, fp = events(spark, trips), feet(spark, foot)
    q = spark.createDataFrame([(i, i, (i * 5 + 3) % 12, 100 * i) for i in range(8)], "query_id long, source long, target long, dep_s long")
    lay = layout.departures(ev).checkpoint()
    labels = rounds.raptor(q, lay, fp).checkpoint()
    got = {(r.query_id, r.stop_id): r.arr for r in rounds.earliest(labels).collect()}
    assert got == {(i, s): a for i in range(8) for s, a in dijkstra(trips, foot, i, 100 * i).items()}
    assert {(r.query_id, r.stop_id): r.arr for r in rounds.connection_scan(q, layout.connections(ev), fp).collect()} == got
    want = sorted(map(tuple, rounds.at_targets(labels, q).collect()))
    full = transfers.event_transfers(ev, lay, fp).checkpoint()
    assert sorted(map(tuple, rounds.trip_based(q, lay, full, fp).collect())) == want
    less = transfers.reduce_transfers(full, lay, fp).checkpoint()
    assert less.count() <= full.count()
    assert sorted(map(tuple, rounds.trip_based(q, lay, less, fp).collect())) == want
    mc = criteria.walking(q, lay, fp, 16).checkpoint()
    assert sorted(map(tuple, pareto.improving(mc).select("query_id", "trips", "arr").collect())) == want
    tight = criteria.bounded(mc, q, 1.0, 1.0).select("query_id", "trips", "arr").distinct()
    assert sorted(map(tuple, tight.collect())) == want


def test_greedy_fifo(spark):
    ev = events(spark, {0: (0, [(A, 0, 0), (B, 100, 100), (C, 200, 200)]), 1: (0, [(A, 10, 10), (B, 90, 90), (C, 190, 190)]), 2: (0, [(A, 20, 20), (B, 120, 120), (C, 220, 220)])})
    assert {r.trip_id: r.route_no for r in layout.fifo_routes(ev).collect()} == {0: 0, 1: 1, 2: 0}
    assert layout.geographic_routes(ev).first().n_trips == 3


def test_u_turn_is_dropped(spark):
    ev = events(spark, {0: (0, [(A, 90, 90), (B, 100, 110), (C, 200, 200)]), 1: (1, [(C, 210, 210), (B, 300, 310), (E, 400, 400)])})
    assert transfers.event_transfers(ev, layout.departures(ev), feet(spark, [])).where("from_trip = 0 AND to_stop = 2").count() == 0


def test_skyline(spark):
    rows = spark.createDataFrame([(0, 5, 5), (0, 5, 5), (0, 4, 9), (0, 6, 4), (0, 6, 6)], "q long, arr long, walk long")
    assert sorted(map(tuple, pareto.skyline(rows, ["q"], ["arr", "walk"]).collect())) == [(0, 4, 9), (0, 5, 5), (0, 6, 4)]


def test_closure_and_components(spark):
    e = feet(spark, [(1, 2, 10), (2, 3, 10), (1, 3, 50), (7, 8, 5)])
    got = {(r.src, r.dst): r.travel_s for r in graph.closure(e).collect()}
    assert got == {(1, 2): 10, (2, 1): 10, (2, 3): 10, (3, 2): 10, (1, 3): 20, (3, 1): 20, (7, 8): 5, (8, 7): 5}
    assert graph.closure(e, 15).count() == 6
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "vertex long")
    assert {r.vertex: r.component for r in graph.weak_components(v, e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    assert graph.triangle_violations(e).count() == 2


def test_strong_components_and_levels(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 4, 1)], "src long, dst long, travel_s long")
    assert {r.vertex: r.component for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.vertex: r.level for r in graph.topological_levels(e.where("src > 1")).collect()} == {2: 0, 1: 1, 3: 1, 4: 2}


def test_column_functions(spark):
    row = spark.createDataFrame([("25:01:02", "bad", "20240229", "20240230", -5, 3725, 12)], "a string, b string, c string, d string, n int, s int, x int")
    got = row.select(
        columns.parse_seconds(row.a), columns.parse_seconds(row.b), columns.parse_day(row.c).cast("string"), columns.parse_day(row.d), columns.format_seconds(row.s), columns.format_seconds(row.n), columns.bit_width(row.x), columns.weekday(columns.parse_day(row.c))
    ).first()
    assert tuple(got) == (90062, None, "2024-02-29", None, "01:02:05", "-00:00:05", 4, 4)


@pytest.mark.parametrize(
    ("times", "want"),
    [([(100, 100), (100, 100), (160, 160)], [(100, 100), (101, 101), (161, 161)]), ([(100, 100), (90, 95)], None), ([(5, 6)], [(5, 6)])],
)
def test_repair(spark, times, want):
    df = spark.createDataFrame([(times,)], "t array<struct<arr:bigint,dep:bigint>>")
    got = df.select(gtfs.repaired(df.t).alias("r")).first().r
    assert (None if got is None else [tuple(x) for x in got]) == want


def test_gtfs_feed(spark, tmp_path):
    files = {
        "agency": "agency_id,agency_name,agency_timezone\na,Ag,UTC\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20240101,20240107\n",
        "calendar_dates": "service_id,date,exception_type\nwk,20240103,2\nwk,20240106,1\n",
        "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nr,a,1,Line,3\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon,extra\nA,\"Stop, A\",49.0,8.0,x\nB,B,49.1,8.1,x\n",
        "trips": "route_id,service_id,trip_id\nr,wk,t\nr,wk,t\nr,no,u\nx,wk,v\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:00:00,A,1\nt,08:10:00,08:11:00,B,2\nt,,,A,3\n",
        "frequencies": "trip_id,start_time,end_time,headway_secs\nt,00:00:00,00:20:00,600\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = gtfs.read(spark, str(tmp_path))
    assert feed["stops"].where("name = 'Stop, A'").count() == 1 and feed["transfers"].count() == 0
    days = gtfs.service_days(feed["calendar"], feed["calendar_dates"], "2024-01-01", "2024-01-07")
    assert sorted(r.day for r in days.collect()) == [0, 1, 3, 4, 5]
    got = gtfs.trip_events(feed, "2024-01-01", "2024-01-07")
    deps = sorted(r.dep for r in got.where("stop_index = 0").collect())
    assert deps == [d * 86_400 + s for d in (0, 1, 3, 4, 5) for s in (0, 600, 1200)]
    last = got.where("stop_index = 1").first()
    assert last.dep == last.arr + 1


FAST = ["direct_connection", "td_earliest_arrival", "journey_measures", "transfer_pattern_pareto", "tb_reduced_pareto", "single_bit_view", "max_speed_per_stop", "isolated_stops", "events_as_connections", "events_hourly_stream", "stop_degree", "min_travel_time_graph", "route_offset_groups", "footpath_closure", "footpath_radius", "raptor_pareto", "tb_pareto", "boundary_events_per_level", "layout_graph", "mc_pareto", "bounded_mc", "calendar_unroll", "hub_label_query", "export_metis", "export_dimacs", "export_stops"]


@pytest.mark.parametrize("name", FAST)
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)


def test_hub_labels(spark):
    d = graph.closure(feet(spark, [(1, 2, 10), (2, 3, 10), (1, 3, 50), (7, 8, 5)])).checkpoint()
    out, into = hub_labels.canonical(d)
    assert sorted(map(tuple, hub_labels.distances(out, into).collect())) == sorted(map(tuple, d.collect()))
    lines = spark.createDataFrame([("o 1 3 7",), ("i 2 3 4",), ("",)], "value string")
    assert hub_labels.distances(*hub_labels.parse(lines)).collect() == [(0, 1, 11)]
    q = one(spark, A, C, 100)
    dep = spark.createDataFrame([(1, A, 90), (2, A, 110)], "event long, stop_id long, t long")
    arr = spark.createDataFrame([(8, C, 100), (9, C, 300), (10, C, 400)], "event long, stop_id long, t long")
    hubs = spark.createDataFrame([(2, 5)], "event long, hub long"), spark.createDataFrame([(8, 5), (9, 5), (10, 5)], "event long, hub long")
    assert hub_labels.earliest(q, dep, arr, *hubs).collect() == [(0, 300)]
    path = spark.createDataFrame([(2, 5, 3)], "event long, path long, pos long"), spark.createDataFrame([(9, 5, 2), (10, 5, 3)], "event long, path long, pos long")
    assert hub_labels.earliest(q, dep, arr, *path, paths=True).collect() == [(0, 400)]


def test_csv_export_round_trip(spark, tmp_path):
    tables = exports.csv_tables(project(spark, SF))
    exports.write_csv(tables, f"file://{tmp_path}")
    for name, df in tables.items():
        back = spark.read.schema(df.schema).option("header", True).csv(f"file://{tmp_path}/{name}")
        assert back.count() == df.count() and back.exceptAll(df).isEmpty()
    n = exports.numbered(spark.range(1000).select((999 - F.col("id")).alias("x")).repartition(7), "x")
    assert n.where("no <> x").isEmpty() and n.count() == 1000


@pytest.mark.parametrize("seed", [3, 4])
def test_pruned_query_journeys_and_travel_functions_agree(spark, seed):
    trips, foot = random_network(seed)
    ev, fp = events(spark, trips), feet(spark, foot)
    q = spark.createDataFrame([(i, i, (i * 7 + 5) % 12, 60 * i) for i in range(12)], "query_id long, source long, target long, dep_s long").checkpoint()
    lay = layout.departures(ev).checkpoint()
    labels = rounds.raptor(q, lay, fp).checkpoint()
    want = sorted(map(tuple, rounds.at_targets(labels, q).collect()))
    cells = spark.createDataFrame([(s, s // 2 % 4) for s in range(12)], "stop_id long, cell_id long")
    full = transfers.event_transfers(ev, lay, fp).checkpoint()
    few = transfers.reduce_transfers(full, lay, fp).checkpoint()
    for some in (full, few):
        leveled = hierarchy.customize(some, lay, cells, 2).checkpoint()
        assert leveled.count() == some.count()
        assert sorted(map(tuple, rounds.trip_based(q, lay, leveled, fp, cells=cells).collect())) == want
    undominated = hierarchy.undominated_transfers(full)
    assert sorted(map(tuple, rounds.trip_based(q, lay, undominated, fp).collect())) == want
    n = {r.level: r.n for r in hierarchy.level_histogram(leveled).collect()}
    assert sum(n.values()) == few.count() and set(n) <= {0, 1, 2}
    assert max(r.level for r in hierarchy.stop_importance(leveled, lay).collect()) == max(n) == max(r.max_level for r in hierarchy.trip_levels(leveled).collect())
    got = journeys.measures(journeys.legs(q, labels, ev, fp)).collect()
    ends = {r.query_id: (r.source, r.target) for r in q.collect()}
    assert all(r.chained and r.rides == r.trips and (r.source, r.target) == ends[r.query_id] for r in got)
    assert sorted((r.query_id, r.trips, r.arr) for r in got) == [w for w in want if w[1] > 0 or ends[w[0]][0] != ends[w[0]][1]]
    f = time_dependent.travel_functions(layout.connections(ev))
    assert sorted(map(tuple, time_dependent.earliest(q, f, fp).collect())) == sorted(map(tuple, rounds.earliest(labels).collect()))


def test_catch_is_the_first_departure_no_earlier(spark):
    deps = [-4000, -10, 0, 0, 1799, 1800, 5400, 90_000]
    ev = events(spark, {i: (0, [(A, d, d), (B, d + 5, d + 5)]) for i, d in enumerate(deps)})
    times = sorted({t + x for t in deps for x in (-1, 0, 1)} | {-9000, 3600, 200_000})
    asked = spark.createDataFrame([(t,) for t in times], "arr long")
    got = asked.crossJoin(layout.departures(ev).where("stop_index = 0")).select("arr", layout.catch("arr").alias("rank")).collect()
    assert {r.arr: r.rank for r in got} == {t: sum(d < t for d in deps) for t in times}


def test_reduction_drops_what_riding_on_beats(spark):
    # changing to trip 1 at B reaches C later than staying; changing to trip 2 reaches E
    ev = events(spark, {0: (0, [(A, 0, 0), (B, 100, 100), (C, 200, 200)]), 1: (1, [(B, 110, 110), (C, 250, 250)]), 2: (2, [(B, 120, 120), (E, 300, 300)])})
    lay = layout.departures(ev)
    few = transfers.reduce_transfers(transfers.event_transfers(ev, lay, feet(spark, [])), lay, feet(spark, []))
    assert [(r.from_trip, r.to_route) for r in few.collect()] == [(0, 2)]


def test_bisection_keeps_components_together(spark):
    stops = spark.createDataFrame([(i, 100 * (i // 2), 7 * (i // 2) % 5) for i in range(32)], "stop_id long, lon_e6 long, lat_e6 long")
    component = stops.select(F.col("stop_id").alias("vertex"), F.expr("stop_id div 2").alias("component"))
    cell = {r.stop_id: r.cell_id for r in hierarchy.bisect(stops, component, 2).collect()}
    assert len(cell) == 32 and all(cell[2 * i] == cell[2 * i + 1] for i in range(16))
    assert set(cell.values()) == {0, 1, 2, 3}


def test_hourly_stream_equals_batch_and_takes_late_rows(spark, tmp_path):
    rows = [(1, "2024-01-01 10:05:00"), (1, "2024-01-01 10:55:00"), (2, "2024-01-01 11:00:00"), (1, "2024-01-01 10:20:00")]
    for n, (u, ts) in enumerate(rows):
        spark.createDataFrame([(u, ts)], "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.read.parquet(*[f"{tmp_path}/in/{n}" for n in range(4)])
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = hourly.run_available(hourly.hourly(stream), f"file://{tmp_path}/work", ["user_id", "hour"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, hourly.hourly(source).collect()))
    assert sorted(r.n for r in got) == [1, 3]


def test_transfer_patterns_answer_other_departures(spark):
    ev = events(spark, TRADE | {3: (0, [(A, 50, 50), (C, 550, 550)]), 4: (1, [(A, 60, 60), (B, 160, 160)]), 5: (2, [(B, 160, 160), (C, 460, 460)])})
    q, fp = one(spark, A, C, 0), feet(spark, [])
    way = journeys.legs(q, rounds.raptor(q, layout.departures(ev), fp), ev, fp).checkpoint()
    known = transfer_patterns.build(q, way).checkpoint()
    assert known.count() == 2 and transfer_patterns.prefixes(known).count() == 3
    f = transfer_patterns.direct_functions(known, ev)
    for dep, want in ((0, [(0, 1, 500), (0, 2, 400)]), (40, [(0, 1, 550), (0, 2, 460)]), (55, [(0, 2, 460)]), (61, [])):
        assert sorted(map(tuple, transfer_patterns.earliest(one(spark, A, C, dep), known, f, fp).collect())) == want


def test_journeys_of_many_trips_are_found(spark):
    # a ring of ten stops whose every hop is a route of its own, twice round after the last departure asked for
    ev = events(spark, {k: (k, [(k % 10, 90_000 + 1000 * k, 90_000 + 1000 * k), ((k + 1) % 10, 90_500 + 1000 * k, 90_500 + 1000 * k)]) for k in range(20)})
    t = Timetable(None, None, ev, feet(spark, [(100, 101, 1)]), None)
    got = catalog.earliest_arrival_one_to_all(spark, SF, t).collect()
    assert len(got) == catalog.N * 10
    want = {r.query_id: (r.target - r.source) % 10 for r in query_table(spark, SF, catalog.N).collect()}
    assert max(want.values()) > 8
    for f in (catalog.raptor_pareto, catalog.tb_pareto):
        assert {r.query_id: r.trips for r in f(spark, SF, t).collect()} == want


def test_geo_ranks_go_on_with_the_number_of_stops(spark):
    stops = spark.range(2050).selectExpr("id AS stop_id", "id * 10 AS lon_e6", "CAST(0 AS BIGINT) AS lat_e6")
    got = catalog.geo_rank_targets(spark, SF, Timetable(stops, None, None, None, None)).collect()
    assert sorted((r.source, r.r) for r in got) == [(s, r) for s in range(10) for r in range(12)]
    assert {r.target for r in got if r.source == 0} == {2**r for r in range(12)}


def test_a_loop_without_fixpoint_is_an_error(monkeypatch):
    monkeypatch.setattr(iterate, "BOUND", 3)
    assert list(iterate.rounds_of(2)) == [1, 2]
    with pytest.raises(RuntimeError):
        list(iterate.rounds_of(None))
