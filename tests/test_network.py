"""Network tools, stores, exports and engines that no registered query holds, against plain Python."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import text
from tramline.operators import event_graph, graph, hierarchy, hub_labels, journeys, layout, network, profiles, rounds, time_dependent, transfer_patterns, transfers, ultra, walking
from tramline.sources import exports, gtfs, store
from tramline.sources.timetable import Timetable

from .test_timetable import dijkstra, events, feet, random_network


def plain_distances(edges, source):
    best, heap = {}, [(0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = d
        for a, b, w in edges:
            if a == v:
                heapq.heappush(heap, (d + w, b))
    return best


def random_graph(seed, n=18, m=45):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 20)) for _ in range(m)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, travel_s long")


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_and_bounded_searches(spark, seed):
    rows = random_graph(seed)
    e = edges_of(spark, rows).checkpoint()
    true = {s: plain_distances(rows, s) for s in range(18)}
    pairs = spark.createDataFrame([(s, t) for s in range(0, 18, 3) for t in range(18) if s != t], "source long, target long")
    got = {(r.source, r.target): r.dist for r in graph.hierarchy_distances(pairs, graph.contract(e).checkpoint()).collect()}
    assert got == {(s, t): true[s][t] for s in range(0, 18, 3) for t in range(18) if s != t and t in true[s]}
    start = spark.createDataFrame([(s, s, 0) for s in range(5)], "source long, vertex long, dist long")
    near = {(r.source, r.vertex): r.dist for r in graph.shortest(start, e, limit=12).collect()}
    assert near == {(s, v): d for s in range(5) for v, d in true[s].items() if d <= 12}
    want = spark.createDataFrame([(s, t) for s in range(5) for t in (7, 9) if t in true[s]], "source long, vertex long")
    some = {(r.source, r.vertex): r.dist for r in graph.shortest(start, e, targets=want).collect()}
    assert all(some[r.source, r.vertex] == true[r.source][r.vertex] for r in want.collect())


def test_strong_components_of_random_graphs(spark):
    rows = random_graph(3, 20, 30) + [(50, 51, 1), (51, 52, 1), (52, 50, 1), (52, 53, 1)]
    reach = {v: set(plain_distances(rows, v)) for v in {x for a, b, _ in rows for x in (a, b)}}
    got = {r.vertex: r.component for r in graph.strong_components(edges_of(spark, rows)).collect()}
    assert got == {v: min(w for w in reach[v] if v in reach[w]) for v in reach}


def test_reduction_keeps_distances(spark):
    rows = [(a, b, w) for a, b, w in random_graph(5, 24, 26) if a != b]
    both = rows + [(b, a, w) for a, b, w in rows]
    keep = [v for v in range(24) if v % 3 == 0]
    left = [tuple(r) for r in network.reduce_graph(edges_of(spark, rows), spark.createDataFrame([(v,) for v in keep], "vertex long")).collect()]
    assert len(left) < len({(a, b) for a, b, _ in both})
    for s in keep:
        a, b = plain_distances(both, s), plain_distances([(x, y, w) for x, y, w in left], s)
        assert {v: d for v, d in a.items() if v in keep} == {v: d for v, d in b.items() if v in keep}
    trimmed = network.without_dead_ends(edges_of(spark, [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)]), spark.createDataFrame([(0,)], "vertex long"))
    assert trimmed.count() == 0
    split = network.impassable(edges_of(spark, [(5, 1, 3), (1, 6, 4)]), spark.createDataFrame([(1,)], "stop_id long"))
    assert sorted(map(tuple, split.collect())) == [(1, 6, 4), (5, -2, 3)]
    assert network.without_vertices(edges_of(spark, [(0, 1, 1), (1, 2, 1), (3, 4, 1)]), spark.createDataFrame([(2,)], "vertex long")).count() == 2


def test_matching_is_largest(spark):
    rng = random.Random(4)
    groups = {g: {(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(1, 20))} for g in "xyz"}

    def largest(pairs):
        mate = {}

        def go(a, seen):
            for b in [y for x, y in pairs if x == a]:
                if b not in seen:
                    seen.add(b)
                    if b not in mate or go(mate[b], seen):
                        mate[b] = a
                        return True
            return False

        return sum(go(a, set()) for a in {x for x, _ in pairs})

    rows = spark.createDataFrame([(g, a, b) for g, ps in groups.items() for a, b in ps], "g string, a long, b long")
    got = defaultdict(list)
    for r in graph.matching(rows, "g").collect():
        got[r.g].append((r.a, r.b))
    for g, ps in groups.items():
        assert set(got[g]) <= ps and len({a for a, _ in got[g]}) == len({b for _, b in got[g]}) == len(got[g]) == largest(ps)


def test_optimal_routes(spark):
    # greedy first fit opens a third route here, two are enough
    trips = {0: (0, [(0, 0, 10), (1, 20, 30)]), 1: (0, [(0, 0, 11), (1, 50, 60)]), 2: (0, [(0, 0, 12), (1, 40, 41)]), 3: (0, [(0, 0, 13), (1, 55, 61)]), 4: (0, [(2, 0, 5), (3, 9, 9)])}
    ev = events(spark, trips)
    for kind in ("optimal", "frequency", "fifo"):
        routes = layout.routes(ev, kind).checkpoint()
        assert layout.overtaking_pairs(ev, routes).count() == 0 and routes.count() == 5
    n = lambda kind: layout.routes(ev, kind).select("first_trip", "route_no").distinct().count()
    assert n("optimal") <= n("fifo") and n("optimal") == 3 and n("geographic") == 2
    bikes = spark.createDataFrame([(i, i % 2) for i in range(5)], "trip_id long, group_id long")
    apart = layout.routes(ev, "geographic", bikes).collect()
    assert len({(r.first_trip, r.route_no) for r in apart}) == 3


def small(spark, trips, foot, n=12):
    stops = spark.createDataFrame([(i, f"s{i}", 8_000_000 + 900 * i, 49_000_000 + 500 * (i % 4), 0) for i in range(n)], "stop_id long, name string, lon_e6 long, lat_e6 long, min_transfer_s long")
    ev = events(spark, trips).checkpoint()
    return Timetable(stops, ev.select("trip_id", "route_id").distinct(), ev, feet(spark, foot), stops.select("stop_id", (F.col("stop_id") % 4).alias("cell_id")))


def test_path_labels_answer_earliest_arrivals(spark):
    trips, foot = random_network(1)
    t = small(spark, trips, foot)
    nodes = layout.time_expanded_nodes(t.stop_events).checkpoint()
    edges = layout.time_expanded_edges(t.stop_events, t.footpaths).checkpoint()
    q = spark.createDataFrame([(i, i, (i * 5 + 3) % 12, 100 * i) for i in range(8)], "query_id long, source long, target long, dep_s long")
    forward, backward = event_graph.path_labels(nodes, edges)
    dep = nodes.where("kind = 'dep'").select(F.col("node").alias("event"), "stop_id", "t")
    arr = nodes.where("kind = 'arr'").select(F.col("node").alias("event"), "stop_id", "t")
    # a position on a trip is reached if it lies behind where the trip is boarded
    got = {r.query_id: r.arr for r in hub_labels.earliest(q, dep, arr, forward.withColumn("pos", F.col("pos") + 1), backward, paths=True).collect()}
    want = {r.query_id: r.arr for r in event_graph.search(q, nodes, edges, lambda x: x).join(q.select("query_id", F.col("target").alias("stop_id")), ["query_id", "stop_id"]).where("arr > 0").collect()}
    assert got and got == {k: v for k, v in want.items() if k in got} and set(got) == {k for k in want if q.where(f"query_id = {k} AND source <> target").count()}
    whole = event_graph.search(q, nodes, edges, t.footpaths).collect()
    assert {(r.query_id, r.stop_id): r.arr for r in whole} == {(i, s): a for i in range(8) for s, a in dijkstra(trips, foot, i, 100 * i).items()}


def test_walks_agree_with_closed_footpaths(spark):
    trips, foot = random_network(2)
    chain = [(a, b, w) for a, b, w in foot] + [(1, 2, 15)]
    t = small(spark, trips, chain)
    closed = graph.closure(t.footpaths).checkpoint()
    lay = layout.departures(t.stop_events).checkpoint()
    q = spark.createDataFrame([(i, i, (i * 5 + 3) % 12, 100 * i) for i in range(8)], "query_id long, source long, target long, dep_s long")
    want = sorted(map(tuple, rounds.raptor(q, lay, closed).collect()))
    assert sorted(map(tuple, rounds.raptor(q, lay, walking.over_graph(t.footpaths)).collect())) == want
    assert sorted(map(tuple, rounds.raptor(q, lay, walking.over_labels(*walking.canonical_labels(t.footpaths))).collect())) == want
    full = transfers.event_transfers(t.stop_events, lay, closed).checkpoint()
    cuts = walking.shortcuts(transfers.reduce_transfers(full, lay, closed), lay, closed).checkpoint()
    at = lambda x: sorted(map(tuple, rounds.at_targets(x, q).collect()))
    over = sorted(map(tuple, ultra.journeys(q, lay, cuts, *ultra.footpath_ends(q, closed)).collect()))
    assert over == at(rounds.raptor(q, lay, closed)) == at(rounds.raptor(q, lay, closed, to_target=True))
    assert walking.shortcut_faults(cuts, t.footpaths).count() == 0
    assert walking.shortcut_faults(cuts.withColumn("travel_s", F.col("travel_s") + 1), t.footpaths).count() == cuts.count()
    more = walking.augmented(full)
    own = more.join(full.select("from_route", "from_rank", "t_from_index", "to_route", "to_index", F.col("to_rank").alias("was")), ["from_route", "from_rank", "t_from_index", "to_route", "to_index"])
    assert more.count() >= full.count() and own.where("to_rank > was").count() == 0
    tagged = transfers.with_to_trip(full, lay)
    assert tagged.count() == full.count()
    assert 0 < transfers.sampled_transfers(tagged, 30).count() < full.count()


def test_profiles_and_reached_index(spark):
    trips, foot = random_network(1)
    t = small(spark, trips, foot)
    lay = layout.departures(t.stop_events).checkpoint()
    q = spark.createDataFrame([(0, 0, 5, 0), (1, 3, 8, 200)], "query_id long, source long, target long, dep_s long")
    all_ = profiles.one_to_all(q, t.stop_events, lay, t.footpaths, 1500).checkpoint()
    full = transfers.event_transfers(t.stop_events, lay, t.footpaths).checkpoint()
    to = profiles.by_segments(q, t.stop_events, lay, full, t.footpaths, 1500)
    mine = all_.join(q.select("query_id", F.col("target").alias("stop_id")), ["query_id", "stop_id"]).select("query_id", "dep", "trips", "arr")
    assert sorted(map(tuple, to.collect())) == sorted(map(tuple, mine.collect())) != []
    few = profiles.one_to_all(q, t.stop_events, lay, t.footpaths, 1500, spark.createDataFrame([(5,), (8,)], "stop_id long"))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.where("stop_id in (5, 8)").collect()))
    seg = spark.createDataFrame([(0, 1, 2, 5, 1), (0, 1, 2, 3, 3), (0, 1, 4, 1, 2)], "query_id long, route_id long, rank long, from_index long, k long")
    got = {(r["rank"], r.k): r.place for r in profiles.reached_index(seg).collect()}
    assert got == {(2, 1): 5, (2, 2): 5, (2, 3): 3, (4, 2): 1, (4, 3): 1}


def test_patterns_with_bounds_and_their_graph(spark):
    trips, foot = random_network(1)
    t = small(spark, trips, foot)
    lay = layout.departures(t.stop_events).checkpoint()
    q = spark.createDataFrame([(i, i, (i * 5 + 3) % 12, 100 * i) for i in range(8)], "query_id long, source long, target long, dep_s long").checkpoint()
    labels = rounds.raptor(q, lay, t.footpaths).checkpoint()
    way = journeys.legs(q, labels, t.stop_events, t.footpaths).checkpoint()
    known = transfer_patterns.build(q, way).checkpoint()
    f = transfer_patterns.direct_functions(known, t.stop_events).checkpoint()
    want = sorted(map(tuple, rounds.at_targets(labels, q).collect()))
    best = rounds.at_targets(labels, q).groupBy("query_id").agg(F.max("arr").alias("latest")).checkpoint()
    assert sorted(map(tuple, transfer_patterns.bounded_patterns(q, known, f, t.footpaths, best).collect())) == [x for x in want if x[1] > 0 or x[0] in {r.query_id for r in q.where("source <> target").collect()}]
    low = {(r.source, r.target): (r.least_s, r.least_trips) for r in transfer_patterns.lower_bounds(known, f, t.footpaths).collect()}
    for query, n, a in want:
        r = q.where(f"query_id = {query}").first()
        if n:
            assert low[r.source, r.target][0] <= a - r.dep_s and low[r.source, r.target][1] <= n
    nodes, links = exports.pattern_graph(transfer_patterns.prefixes(known), 3)
    names = {r.node for r in nodes.collect()}
    assert names and all(r.src in names and r.dst in names for r in links.collect())
    assert exports.gml(nodes, links).count() == 3 + nodes.count() + links.count()
    told = {(r.query_id, r.trips): r.text for r in exports.journey_text(way, t.stops).collect()}
    assert all(x.count("\n") + 1 == way.where(f"query_id = {k} AND trips = {n}").count() for (k, n), x in told.items())
    assert any("(trip " in x for x in told.values())


def test_validated_and_upserts(spark):
    trips = {0: (0, [(0, 0, 100), (1, 200, 210), (2, 300, 300)]), 1: (0, [(0, 0, 110), (1, 190, 220), (2, 290, 300)]), 2: (0, [(0, 0, 120), (1, 260, 270), (2, 400, 400)]), 3: (1, [(3, 0, 0)]), 4: (1, [(0, 0, 5), (99, 9, 9)])}
    t = small(spark, trips, [(4, 5, 60)])
    v = network.validated(t)
    assert sorted(r.trip_id for r in v.trips.collect()) == [1, 2]
    assert sorted(r.stop_id for r in v.stops.collect()) == [0, 1, 2, 4, 5]
    more = spark.createDataFrame([(50, "near 3", 8_002_701, 49_001_500, 0), (51, "far", 9_000_000, 49_000_000, 0)], t.stops.schema)
    up = {r.stop_id: r.name for r in network.upsert_stops(t.stops, more).collect()}
    assert up[3] == "near 3" and up[51] == "far" and 50 not in up and len(up) == 13
    again = events(spark, {70: (0, [(0, 0, 120), (1, 261, 270), (2, 401, 400)]), 71: (5, [(0, 1, 1), (1, 2, 2)])})
    assert sorted(r.trip_id for r in network.upsert_trips(t.stop_events, again).select("trip_id").distinct().collect()) == [0, 1, 3, 4, 70, 71]
    feet2 = network.upsert_footpaths(t.footpaths, edges_of(spark, [(4, 5, 30), (1, 2, 9)]))
    assert sorted(map(tuple, feet2.collect())) == [(1, 2, 9), (4, 5, 30), (5, 4, 60)]
    assert network.with_bicycles(t.stop_events, spark.createDataFrame([(0,)], "trip_id long")).count() == 3
    order = spark.createDataFrame([(i, 100 - i) for i in range(12)], "old long, new long")
    assert sorted(r.src for r in network.with_order(network.with_order(t.footpaths, "src", order), "dst", order).collect()) == [95, 96]
    inside, both = network.reduced_to_component(t, t)
    assert inside.stops.count() == both.stops.count() == 2
    with pytest.raises(KeyError):
        network.in_named_box(t, "atlantis")
    assert network.in_named_box(t, "Germany").stops.count() == 12 and network.in_named_box(t, "london").trips.count() == 0


def test_graphs_are_joined_with_stops(spark):
    t = small(spark, {0: (0, [(0, 0, 0), (1, 5, 5)])}, [(0, 1, 60)], 3)
    vertices = spark.createDataFrame([(7, 8_000_001, 49_000_001), (8, 8_001_300, 49_000_500), (9, 9_000_000, 49_000_000)], "vertex long, lon_e6 long, lat_e6 long")
    names, edges = network.add_graph(t, vertices, edges_of(spark, [(7, 8, 40), (8, 9, 50)]))
    got = {(r.src, r.dst): r.travel_s for r in edges.collect()}
    # vertex 7 is stop 0; 8 is near stop 1 but another place
    assert got[-1, 8] == got[8, -1] == 40 and got[8, 9] == 50 and (7, 8) not in got and (-2, 8) in got and got[-1, -2] == 60
    assert {r.vertex for r in names.collect()} == {-1, -2, -3, 8, 9}


def test_readers(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, kind, values in (("first_out", "<u4", [0, 2, 2, 3]), ("head", "<u4", [1, 2, 0]), ("travel_time", "<i4", [5, 6, 7])):
        (folder / name).write_bytes(np.uint64(len(values)).tobytes() + np.array(values, kind).tobytes())
    assert sorted(map(tuple, store.read_vectors(spark, f"file://{folder}").collect())) == [(0, 1, 5), (0, 2, 6), (2, 0, 7)]
    (tmp_path / "g.co").write_text("c x\nv 1 8500000 49000000\nv 2 8600000 49100000\n")
    (tmp_path / "g.gr").write_text("c x\np sp 2 1\na 1 2 9\n")
    arcs, points = store.read_dimacs(spark, f"file://{tmp_path}/g.gr", f"file://{tmp_path}/g.co")
    assert [tuple(r) for r in arcs.collect()] == [(0, 1, 9)] and sorted(r.lon for r in points.collect()) == [8.5, 8.6]
    (tmp_path / "hubs").write_text("2\n1 0 0\n2 0 4 1 0\n1 0 3\n0\n")
    out, into = store.read_hub_lists(spark, f"file://{tmp_path}/hubs")
    assert sorted(map(tuple, out.collect())) == [(0, 0, 0), (1, 0, 3)] and sorted(map(tuple, into.collect())) == [(0, 0, 4), (0, 1, 0)]
    (tmp_path / "bad").write_text("1\n2 0 0\n0\n")
    with pytest.raises(ValueError, match="label line"):
        store.read_hub_lists(spark, f"file://{tmp_path}/bad")
    (tmp_path / "paths").write_text("3 1\n2\n")
    assert sorted(map(tuple, store.read_path_hubs(spark, f"file://{tmp_path}/paths").collect())) == [(0, 0, 1), (1, 1, 0), (2, 0, 0)]
    (tmp_path / "t.csv").write_text('# note\nb, a ,c\n1," x",9\n,y,8\n')
    rows = store.read_table(spark, f"file://{tmp_path}/t.csv", {"a": "string", "b": "long", "z": "int"}, comment="#").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([("x", 1, None), ("y", None, None)], key=repr)
    ids = {r.k: r.id for r in store.id_table(spark.createDataFrame([("q",), ("b",), ("q",), (None,)], "k string"), "k").collect()}
    assert ids == {"b": 0, "q": 1}


def test_feed_as_parquet_and_first_rows(spark, tmp_path):
    for name, cols in gtfs.COLUMNS.items():
        body = {"stops": "A,Alpha,49,8\nA,Second,0,0\n", "routes": "r,a,1,One,3,,\nr,b,2,Two,3,,\n"}.get(name, "")
        (tmp_path / f"{name}.txt").write_text(cols.replace(" ", ",") + "\n" + body)
    gtfs.to_parquet(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")
    feed = gtfs.from_parquet(spark, f"file://{tmp_path}/out")
    assert [r.name for r in feed["stops"].collect()] == ["Alpha"] and [r.name for r in feed["routes"].collect()] == ["[1] One"]


def test_exports_of_hierarchies_and_hypergraphs(spark):
    trips, foot = random_network(2)
    t = small(spark, trips, foot)
    lay = layout.departures(t.stop_events).checkpoint()
    full = transfers.event_transfers(t.stop_events, lay, t.footpaths).checkpoint()
    leveled = full.join(t.cells.select(F.col("stop_id").alias("to_stop"), F.col("cell_id").alias("to_cell")), "to_stop").withColumn("level", F.col("to_cell") % 3).checkpoint()
    component = graph.weak_components(t.stops.select(F.col("stop_id").alias("vertex")), t.footpaths).checkpoint()
    tables = exports.hierarchy_tables(t, lay, leveled, component)
    assert set(tables) >= {"stops", "trips", "stop_times", "footpaths", "partition", "transfers", "components"}
    assert tables["transfers"].columns == ["FromTrip", "FromIndex", "ToTrip", "ToIndex", "Level"] and tables["transfers"].count() == full.count()
    edges, where = event_graph.leveled_events(leveled, lay, t.cells)
    assert edges.where("hop = 1").count() == full.select("from_trip", "t_from_index", "to_route", "to_rank", "to_index").distinct().count() and where.count() == where.select("node").distinct().count()
    nodes = layout.time_expanded_nodes(t.stop_events)
    graph_lines, path_lines = event_graph.hub_label_files(nodes, layout.time_expanded_edges(t.stop_events, t.footpaths))
    assert graph_lines.count() - 1 == layout.time_expanded_edges(t.stop_events, t.footpaths).count() and path_lines.count() == len(trips)
    routes = t.stop_events.select("route_id", "stop_id").distinct().withColumn("weight", F.lit(2))
    lines = [r.line for r in exports.hmetis(component, routes).orderBy("line_no").collect()]
    m, n, kind = map(int, lines[0].split())
    assert kind == 11 and len(lines) == 1 + m + n and all(x.split()[0] == "2" for x in lines[1 : m + 1]) and sum(map(int, lines[m + 1 :])) == 12
    per_stop = hierarchy.events_per_level(leveled, lay, 2).collect()
    reached = leveled.select("from_route", "from_rank", "t_from_index").distinct().count()
    assert sum(r.level_0 + r.level_1 + r.level_2 for r in per_stop) == reached
    assert hierarchy.overlay(leveled, 2).count() == leveled.where("level >= 2").count()
    assert exports.edge_table(t.footpaths).columns == ["FromVertex", "ToVertex", "TravelTime"]
    e = time_dependent.graph_edges(lay, t.footpaths)
    assert {r.kind for r in e.select("kind").distinct().collect()} == {"board", "leave", "ride", "walk"}
    latest = lay.where("stop_index > 0").select("arrs", F.lit(700).alias("t")).select(F.expr("aggregate(arrs, 0, (n, a) -> n + if(a <= t, 1, 0)) - 1").alias("want"), layout.latest("t").alias("got"))
    assert latest.where("want <> got").count() == 0


def test_combinable_connections(spark):
    rows = [(1, 0, 1, 10, 20, "same trip"), (2, 0, 1, 10, 20, "stay"), (3, 0, 1, 10, 20, "too soon")]
    a = spark.createDataFrame([(t, s, d, x, y) for t, s, d, x, y, _ in rows], "trip_id long, dep_stop long, arr_stop long, dep long, arr long").select(F.struct("*").alias("a"))
    b = spark.createDataFrame([(1, 1, 2, 20, 30, 5, None), (9, 1, 2, 25, 30, 5, None), (9, 1, 2, 24, 30, 5, None), (9, 4, 2, 40, 50, 5, 15)], "trip_id long, dep_stop long, arr_stop long, dep long, arr long, min_transfer_s long, travel_s long")
    b = b.select(F.struct("trip_id", "dep_stop", "arr_stop", "dep", "arr").alias("b"), "min_transfer_s", "travel_s")
    got = {(r.a.trip_id, r.b.dep): r.ok for r in a.crossJoin(b).select("a", "b", transfers.combinable("a", "b").alias("ok")).collect()}
    assert got[1, 20] and not got[2, 20] and got[2, 25] and not got[2, 24] and got[3, 40]


def test_text_and_number_functions(spark):
    df = spark.createDataFrame([("abcabx", "zabca", [5.0, 1.0, 3.0], 1234567)], "a string, b string, v array<double>, n long")
    r = df.select(
        text.longest_common("a", "b").alias("lcs"), text.two_smallest(F.col("v")).alias("two"), text.mean_of(F.col("v")).alias("mean"), text.percentile_of(F.col("v"), 0.5).alias("median"),
        text.grouped(F.col("n")).alias("grouped"), text.percent(F.lit(1), F.lit(8)).alias("percent"), text.byte_size(F.col("n")).alias("size"), text.last_index(F.col("a"), "ab").alias("last"),
        text.count_of(F.col("a"), "ab").alias("count"), text.is_color(F.lit("#00ffAA")).alias("color"), text.is_number(F.lit("-3.5")).alias("number"), text.is_number(F.lit("3.")).alias("not_number"),
        text.boxes_meet(tuple(map(F.lit, (0, 2, 0, 2))), tuple(map(F.lit, (2, 3, 1, 9)))).alias("meet"), text.box_holds(tuple(map(F.lit, (0, 2, 0, 2))), F.lit(1), F.lit(3)).alias("holds"),
        text.line_distance(*map(F.lit, (0.0, 3.0, -1.0, 0.0, 1.0, 0.0))).alias("line"), text.planar_distance_cm(*map(F.lit, (8.0, 49.0, 8.01, 49.0))).alias("plane"),
        *[c.alias(f"u{i}") for i, c in enumerate(text.unpacked_time(text.packed_time(F.lit(77), F.lit(5))))],
    ).first()
    assert (r.lcs, r.two, r.mean, r.median, r.grouped, r.percent, r.size) == ("abca", [1.0, 3.0], 3.0, 3.0, "1,234,567", "12.50%", "1.2MB")
    assert (r["last"], r["count"], r.color, r.number, r.not_number, r.meet, r.holds, r.line, r.u0, r.u1) == (3, 2, True, True, False, True, False, 3.0, 77, 5)
    assert abs(r.plane - 73_030) < 150


def test_pagerank_stops_when_nothing_changes(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 1)], "src long, dst long")
    a = {r.vertex: r["rank"] for r in graph.pagerank(e, None).collect()}
    b = {r.vertex: r["rank"] for r in graph.pagerank(e, 40).collect()}
    assert all(abs(a[v] - b[v]) < 1e-6 for v in a)
