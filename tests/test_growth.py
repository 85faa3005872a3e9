"""Steps that must not grow beyond their input: planner sizes, stored layouts, shared places, batches."""

import pytest
from pyspark.sql import functions as F

from tramline.functions import text
from tramline.operators import graph, layout, rounds, ultra
from tramline.plans import catalog, iterate
from tramline.sources import timetable

from .test_timetable import events, feet, random_network


def planned_bytes(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_settled_tables_have_their_own_size(spark):
    # exploded rows, and a join whose estimate is the product of its sides
    many = iterate.settle(spark.range(4).select(F.explode(F.sequence(F.lit(0), F.lit(200_000))).alias("x"), F.rand(1).alias("r")))
    assert many.count() == 800_004 and planned_bytes(many) > 4_000_000
    a = iterate.settle(spark.range(1000).withColumnRenamed("id", "k"))
    for _ in range(6):
        a = iterate.settle(a.join(a.select("k"), "k"))
    assert a.count() == 1000 and planned_bytes(a) < 1 << 20
    iterate.discard(a)


def test_planner_does_not_take_events_for_small(spark):
    sf = "/root/testdata/sf0.01"
    trips = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    assert planned_bytes(timetable.project(spark, sf).stop_events) >= 8 * planned_bytes(trips)


def test_large_layouts_are_stored_in_buckets(spark, monkeypatch):
    trips, foot = random_network(3)
    e, f = events(spark, trips), feet(spark, foot)
    lay = iterate.settle(layout.departures(e))
    q = spark.createDataFrame([(i, i % 7, (3 * i + 1) % 7, 10 * i) for i in range(6)], "query_id long, source long, target long, dep_s long")
    want = sorted(rounds.raptor(q, lay, f).collect())
    monkeypatch.setattr(rounds, "SMALL_BYTES", 0)
    places, _ = rounds.sides(lay)
    labels = q.select("query_id", F.col("source").alias("stop_id")).hint("merge")
    plan = labels.join(places, "stop_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(rounds.raptor(q, lay, f).collect()) == want


def test_broadcasts_of_a_layout_are_bounded_over_all_rounds(spark, monkeypatch):
    trips, _ = random_network(3)
    lay = iterate.settle(layout.departures(events(spark, trips)))
    size = lay.agg(F.sum(64 + 8 * F.size("deps"))).first()[0]
    monkeypatch.setattr(rounds, "SMALL_BYTES", 2 * size)
    labels = spark.range(3).withColumnRenamed("id", "stop_id").hint("shuffle_hash")
    assert "BroadcastHashJoin" not in plan_of(labels.join(rounds.sides(lay)[0], "stop_id"))
    monkeypatch.setattr(rounds, "SMALL_BYTES", 16 * size)
    assert "BroadcastHashJoin" in plan_of(labels.join(rounds.sides(lay)[0], "stop_id"))


def test_places_are_measured_once(spark):
    # three places, 40 stops each
    stops = spark.range(120).select(F.col("id").alias("stop_id"), (F.col("id") % 3 * 1000).alias("lon_e6"), F.lit(49_000_000).alias("lat_e6"))
    pairs = graph.radius_pairs(stops, 8_000, 2_000)
    got = {(r.src, r.dst) for r in pairs.collect()}
    assert got == {(a, b) for a in range(120) for b in range(120) if a != b and abs(a % 3 - b % 3) < 2}
    own = graph.radius_pairs(stops, 8_000, 2_000, spark.createDataFrame([(4,), (5,)], "src long"))
    assert {(r.src, r.dst) for r in own.collect()} == {p for p in got if p[0] in (4, 5)}
    near = graph.nearest(stops.withColumnRenamed("stop_id", "point_id"), stops, 2_000, 3)
    assert sorted((r.point_id, r.nth, r.stop_id) for r in near.collect()) == [(i, n + 1, i % 3 + 3 * n) for i in range(120) for n in range(3)]


@pytest.mark.parametrize("seed", [3])
def test_shortcuts_in_batches_of_sources(spark, seed, monkeypatch):
    trips, foot = random_network(seed)
    e, f = events(spark, trips), feet(spark, foot)
    lay, stops = iterate.settle(layout.departures(e)), iterate.settle(e.select("stop_id").union(f.select("src")).distinct())
    edges = iterate.settle(graph.symmetric_minimum(f))
    want = sorted(ultra.shortcuts(lay, edges, stops).collect())
    monkeypatch.setattr(ultra, "SOURCES", 4)
    assert sorted(ultra.shortcuts(lay, edges, stops).collect()) == want


def test_halves_of_byte_sizes(spark):
    rows = spark.createDataFrame([(157_952,), (158_464,), (1_048_576,), (1023,), (None,), ((1 << 40) * 3,)], "n long")
    assert [r[0] for r in rows.select(text.byte_size(F.col("n"))).collect()] == ["154.2KB", "154.8KB", "1.0MB", "1023B", None, "3.0TB"]


def test_geo_ranks_end_where_the_twin_ends(spark, tmp_path):
    sf = str(tmp_path)
    spark.range(1100).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name")).write.parquet(f"{sf}/supplier.parquet")
    spark.range(10).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{sf}/orders.parquet")
    rows = catalog.queries()["geo_rank_targets"](spark, sf).collect()
    assert len(rows) == 100 and max(r.r for r in rows) == 9


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_tables_are_not_broadcast(spark):
    # 400,000 rows that files hold in some kilobytes
    key = "spark.sql.sources.fileCompressionFactor"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "1.0")
        packed = iterate.settle(spark.range(400_000).select((F.col("id") % 2).alias("k"), F.lit(1).cast("long").alias("x")))
        assert "BroadcastHashJoin" not in plan_of(packed.join(packed.withColumnRenamed("x", "y"), "k"))
        spark.conf.set(key, "1.0")
        few = iterate.settle(spark.range(1000).withColumnRenamed("id", "k"))
        assert spark.conf.get(key) == "1.0" and "BroadcastHashJoin" in plan_of(packed.join(few, "k"))
    finally:
        spark.conf.set(key, old)


def test_large_connections_are_stored_in_buckets(spark, monkeypatch):
    trips, foot = random_network(5)
    e, f = events(spark, trips), feet(spark, foot)
    c = iterate.settle(layout.connections(e))
    q = spark.createDataFrame([(i, i % 7, (3 * i + 1) % 7, 10 * i) for i in range(6)], "query_id long, source long, target long, dep_s long")
    want = sorted(rounds.connection_scan(q, c, f).collect())
    monkeypatch.setattr(rounds, "SMALL_BYTES", 0)
    plan = plan_of(q.select("query_id", F.col("source").alias("dep_stop")).hint("shuffle_hash").join(rounds.stored(c, "dep_stop"), "dep_stop"))
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort " not in plan
    assert sorted(rounds.connection_scan(q, c, f).collect()) == want


def test_events_move_once_for_a_layout(spark):
    trips, _ = random_network(3)
    assert plan_of(layout.departures(events(spark, trips))).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", [0])
def test_strong_components_of_long_graphs(spark, seed, monkeypatch):
    # rings of several lengths, chained one way, with chords and tails
    import random

    rnd, pairs, parts, at = random.Random(seed), set(), [], 0
    for n in (20, 5, 1, 2):
        own = list(range(at, at + n))
        rnd.shuffle(own)
        pairs |= {(a, b) for a, b in zip(own, own[1:] + own[:1]) if a != b}
        pairs |= {(own[i], own[(i + 2) % n]) for i in range(0, n, 3) if n > 2}
        if parts:
            pairs.add((parts[-1][0], own[0]))
        parts.append(own)
        at += n
    monkeypatch.setattr(graph, "SHALLOW", 2)
    asked = []
    whole = graph._spread_least
    monkeypatch.setattr(graph, "_spread_least", lambda v, e, r=None: asked.append(r) or whole(v, e, r))
    got = dict(graph.strong_components(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect())
    assert got == {v: min(p) for p in parts for v in p} and asked[0] == 2 and None in asked
