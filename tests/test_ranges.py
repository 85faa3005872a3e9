"""As-of joins in buckets, searches over ranges of departures, and shortcuts of an open walking graph."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import asof, layout, profiles, ranges, rounds, transfers, ultra

from .test_timetable import events, feet, random_network


#: Longer than any timetable here: a search per departure lets the last one of a range wait for what leaves after it.
SPAN = 100_000


@pytest.mark.parametrize("width", [7, 1000])
def test_what_follows_in_buckets(spark, width):
    rng = random.Random(4)
    hot = lambda: rng.choice([1, 1, 1, 2, 3])
    left = [(i, hot(), rng.randint(-20, 120)) for i in range(150)] + [(900, None, 3), (901, 1, None), (902, 8, 0)]
    right = [(hot(), rng.randint(-20, 100), rng.randint(0, 50)) for _ in range(80)] + [(1, 30, 5)] * 2 + [(None, 3, 1), (7, 1, 1)]
    a, b = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v long")
    got = {r.id: r.next and tuple(r.next) for r in asof.following(a, b, ["k"], "t", ["v"], width).collect()}
    after = lambda k, t: [(x, v) for h, x, v in right if h is not None and h == k and t is not None and x >= t]
    assert got == {i: min(after(k, t), default=None) for i, k, t in left}
    low = {r.id: r.least for r in asof.least_following(a, b, ["k"], "t", "v", width).collect()}
    assert low == {i: min(v for _, v in after(k, t)) for i, k, t in left if after(k, t)}
    rows = [(i, k, t) for i, k, t in left if k is not None and t is not None]
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {r[0]: (s[2], s[0]) if s and s[1] == r[1] else None for r, s in zip(order, [*order[1:], None], strict=True)}
    assert {r.id: r.next and tuple(r.next) for r in asof.succeeding(a, ["k"], "t", ["id"], width).collect()} == want
    assert asof.following(a, b.limit(0), ["k"], "t", ["v"]).where("next IS NOT NULL").count() == 0 == asof.least_following(a, b.limit(0), ["k"], "t", "v").count()


@pytest.mark.parametrize("seed", [1, 5])
def test_ranges_equal_a_search_per_departure(spark, seed):
    trips, foot = random_network(seed)
    e, f = events(spark, trips).checkpoint(), feet(spark, foot).checkpoint()
    lay = layout.departures(e).checkpoint()
    q = spark.createDataFrame([(0, 0, 5, 0), (1, 3, 8, 200), (2, 4, 4, 0)], "query_id long, source long, target long, dep_s long").checkpoint()
    each = profiles.one_to_all(q, e, lay, f, SPAN)
    want = {tuple(r) for r in each.select("query_id", "stop_id", "dep", "trips", "arr").collect()}
    # a walk alone that is as early leaves no journey
    near = {(r.query_id, r.stop_id): r.walk for r in ranges.near_stops(q, f).collect()}
    want = {r for r in want if (r[0], r[1]) not in near or r[4] < r[2] + near[r[0], r[1]]}
    got = [tuple(r) for r in ranges.range_search(q, lay, f, SPAN, to_target=False).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    goal = {r.query_id: r.target for r in q.collect()}
    mine = {r for r in want if r[1] == goal[r[0]]}
    assert {tuple(r) for r in ranges.range_search(q, lay, f, SPAN).collect()} == mine
    scan = [tuple(r) for r in ranges.profile_scan(q, layout.connections(e), f, SPAN).collect()]
    flat = {(a, d, z) for a, _, d, _, z in mine}
    steps = {x for x in flat if not any(y[0] == x[0] and y != x and y[1] >= x[1] and y[2] <= x[2] for y in flat)}
    assert len(scan) == len(set(scan)) and set(scan) == steps


def open_graph(seed):
    """Streets between twelve stops and crossings, connected, both ways."""
    rng = random.Random(seed)
    vertices = [*range(12), *range(100, 108)]
    rng.shuffle(vertices)
    rows = {(a, b): rng.randint(5, 60) for a, b in zip(vertices, vertices[1:], strict=False)}
    for _ in range(8):
        a, b = rng.sample(vertices, 2)
        rows.setdefault((a, b), rng.randint(20, 90))
    both = {}
    for (a, b), w in rows.items():
        for x in ((a, b), (b, a)):
            both[x] = min(w, both.get(x, w))
    return [(a, b, w) for (a, b), w in both.items()]


@pytest.mark.parametrize("seed", [2, 3])
def test_shortcuts_are_enough_between_rides(spark, seed):
    trips, _ = random_network(seed)
    e = events(spark, trips).checkpoint()
    lay = layout.departures(e).checkpoint()
    edges = feet(spark, open_graph(seed)).checkpoint()
    stops = spark.range(12).select(F.col("id").alias("stop_id"))
    walks = ultra.stop_graph(edges, stops).checkpoint()
    cuts = ultra.shortcuts(lay, edges, stops).checkpoint()
    assert 0 < cuts.count() < walks.count()
    assert cuts.join(walks, ["src", "dst", "travel_s"], "left_anti").count() == 0
    q = spark.createDataFrame([(i, i % 12, (i * 5 + 3) % 12, 60 * i) for i in range(24)], "query_id long, source long, target long, dep_s long").checkpoint()
    want = sorted(map(tuple, rounds.at_targets(rounds.raptor(q, lay, walks), q).collect()))
    near, egress = ultra.ends(q, edges, stops)
    assert sorted(map(tuple, ultra.journeys(q, lay, cuts, near, egress).collect())) == want
    hops = transfers.event_transfers(e, lay, cuts).checkpoint()
    assert sorted(map(tuple, rounds.trip_based(q, lay, hops, cuts, near=near, egress=egress).collect())) == want
    best = {}
    for i, _, arr in want:
        best[i] = min(arr, best.get(i, arr))
    assert {r.query_id: r.arr for r in rounds.connection_scan_between(q, layout.connections(e), cuts, near, egress).collect()} == best


@pytest.mark.parametrize("seed", [1, 4])
def test_updated_transfers_equal_a_rebuild(spark, seed):
    trips, foot = random_network(seed)
    e, f = events(spark, trips).checkpoint(), feet(spark, foot).checkpoint()
    lay = layout.departures(e).checkpoint()
    ids = sorted(r.trip_id for r in e.select("trip_id").distinct().collect())
    late = F.when(F.col("trip_id").isin(ids[1::7]), 40).otherwise(0)
    new = e.where(~F.col("trip_id").isin(ids[3:4])).withColumns({"arr": F.col("arr") + late, "dep": F.col("dep") + late})
    # a late trip that overtakes is a route of its own
    new = new.withColumn("route_id", F.when(F.col("trip_id").isin(ids[1::7]), 1000 + F.col("trip_id")).otherwise(F.col("route_id"))).checkpoint()
    lay2 = layout.departures(new).checkpoint()
    stored = transfers.event_transfers(e, lay, f).checkpoint()
    whole = sorted(map(tuple, transfers.event_transfers(new, lay2, f).collect()))
    assert sorted(map(tuple, transfers.updated_transfers(stored, e, new, lay2, f).collect())) == whole
    assert sorted(map(tuple, transfers.updated_transfers(stored, e, e, lay, f).collect())) == sorted(map(tuple, stored.collect()))
    assert sorted(map(tuple, transfers.updated_transfers(stored.limit(0), e.limit(0), e, lay, f).collect())) == sorted(map(tuple, stored.collect()))
