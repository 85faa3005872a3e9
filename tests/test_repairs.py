"""Nearest stops anywhere on the globe, streams of part files, boxes, skylines and bounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import graph, layout, network
from tramline.operators.pareto import skyline
from tramline.streaming import hourly

POINT, STOP = "point_id long, lon_e6 long, lat_e6 long", "stop_id long, lon_e6 long, lat_e6 long"


def cm(a, b):
    x1, y1, x2, y2 = (math.radians(v / 1e6) for v in (*a, *b))
    return round(637_813_700 * math.acos(max(-1, min(1, math.sin(y1) * math.sin(y2) + math.cos(y1) * math.cos(y2) * math.cos(x2 - x1)))))


@pytest.mark.parametrize("lat", [65, 70, 80, -89.9])
def test_nearest_at_any_latitude(spark, lat):
    rng = random.Random(lat)
    near = lambda n, spread: [(i, rng.choice([179_990_000, -179_990_000, 10_000_000]) + rng.randint(-spread, spread), int(lat * 1e6) + rng.randint(-spread // 4, spread // 4)) for i in range(n)]
    wrap = lambda rows: [(i, (x + 180_000_000) % 360_000_000 - 180_000_000, max(-90_000_000, min(90_000_000, y))) for i, x, y in rows]
    stops, points = wrap(near(60, 60_000)), wrap(near(40, 60_000))
    # a stop due north against one to the east that a narrow degree brings nearer
    stops += [(100, 10_000_000, int(lat * 1e6) + 4_400 if lat < 89 else int(lat * 1e6) - 4_400), (101, 10_010_200, int(lat * 1e6))]
    points += [(100, 10_000_000, int(lat * 1e6)), (101, -100_000_000, 20_000_000)]
    got = graph.nearest(spark.createDataFrame(points, POINT), spark.createDataFrame(stops, STOP), 10_000, 2).collect()
    want = {(p, s, d, n + 1) for p, *a in points for n, (d, s) in enumerate(sorted((cm(a, b), s) for s, *b in stops)[:2])}
    assert {(r.point_id, r.nth, r.distance_cm) for r in got} == {(p, n, d) for p, _, d, n in want}
    assert {tuple(r) for r in got} == want


def test_nearest_without_stops(spark):
    assert graph.nearest(spark.createDataFrame([(1, 0, 0)], POINT), spark.createDataFrame([], STOP), 10_000).count() == 0


def test_named_boxes():
    assert network.BOXES["switzerland"] == (5.826, 10.819, 45.487, 48.142) and network.BOXES["london"] == (-0.612, 0.715, 51.233, 51.707)


def test_streams_of_part_files_and_late_rows(spark, tmp_path):
    base = spark.range(900).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"))
    folder = f"file://{tmp_path}/in"
    base.repartition(3).write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{folder}/events.parquet").coalesce(1).write.parquet(f"{folder}/other.parquet")
    got = hourly.run_available(hourly.hourly(hourly.open_events(spark, folder), "1 day"), f"file://{tmp_path}/state", ["user_id", "hour"])
    want = base.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # an hour long past comes in a batch of its own, after the watermark
    for k, start in enumerate((1_700_000_000, 1_700_500_000, 1_700_000_060)):
        spark.range(1).select(F.lit(1).alias("user_id"), F.timestamp_seconds(F.lit(start)).alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/late/{k}/events.parquet")
    stream = hourly.open_events(spark, f"file://{tmp_path}/late/*", files=1)
    report = {}
    rows = hourly.run_available(hourly.hourly(stream, "1 hour"), f"file://{tmp_path}/state2", ["user_id", "hour"], report=report).collect()
    assert sum(r.n for r in rows) + report["late"] == 3


def test_skylines_of_one_two_and_three_criteria(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k long, a long, b long, c long")
    for crit in (["a"], ["a", "b"], ["a", "b", "c"]):
        at = [("k", "a", "b", "c").index(x) for x in crit]
        own = {(r[0], *(r[i] for i in at)) for r in rows}
        want = {x for x in own if not any(y[0] == x[0] and y != x and all(p <= q for p, q in zip(y[1:], x[1:], strict=True)) for y in own)}
        got = [tuple(r) for r in skyline(df, ["k"], crit).collect()]
        assert len(got) == len(want) and set(got) == want


def test_events_beyond_what_a_vertex_tells_apart_are_an_error(spark):
    rows = [(1, 1, i, i, i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "trip_id long, route_id long, stop_index long, stop_id long, arr long, dep long")
    with pytest.raises(Exception, match="more than 256 events"):
        layout.time_expanded_nodes(df).collect()
