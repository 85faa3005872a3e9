"""Transfer patterns of a whole day, asked for departures and targets that did not build them."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import day_patterns, layout, rounds

from .test_timetable import events, feet, random_network

QUERY = "query_id long, source long, target long, dep_s long"


@pytest.mark.parametrize("seed", [2, 7])
def test_unseen_queries_are_answered_as_by_rounds(spark, seed, tmp_path):
    trips, foot = random_network(seed)
    e, f = events(spark, trips).checkpoint(), feet(spark, foot).checkpoint()
    lay = layout.departures(e).checkpoint()
    last = e.agg(F.max("dep")).first()[0]
    sources = spark.createDataFrame([(x,) for x in [0, 1, 2, 3, 4, 5, 5, None]], "source long")
    folder = str(tmp_path / "trees")
    blocks = day_patterns.build(sources, lay, f, 0, last + 1, folder, blocks=3)
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 5), rng.randint(0, 11), rng.randint(0, last)) for i in range(60)]
    q = spark.createDataFrame(rows, QUERY).checkpoint()
    trees = day_patterns.stored(spark, folder, q, blocks)
    whole = [tuple(r) for r in trees.select(*day_patterns.NODE).collect()]
    assert len(whole) == len(set(whole)) and {r[0] for r in whole} == {0, 1, 2, 3, 4, 5}
    by = day_patterns.direct_rides(trees, e).checkpoint()
    want = sorted(map(tuple, rounds.at_targets(rounds.raptor(q, lay, f), q).collect()))
    assert any(r[1] > 1 for r in want)
    assert sorted(map(tuple, day_patterns.pareto(q, trees, by).collect())) == want
    # a query without a source, target or departure has no row, nor has a stop that no tree knows
    odd = spark.createDataFrame([(1, None, 2, 5), (2, 1, None, 5), (3, 1, 2, None), (4, 1, 999, 5), (5, 999, 1, 5)], QUERY)
    assert day_patterns.pareto(odd, trees, by).count() == 0
    assert day_patterns.pareto(q.limit(0), trees, by).count() == 0


def test_nodes_are_interned_and_a_block_is_read_alone(spark, tmp_path):
    # twelve runs of one line, and a second line from its end: one prefix each, whatever the departure
    trips = [(n, 0, [(1, n * 100, n * 100), (2, n * 100 + 50, n * 100 + 50), (3, n * 100 + 90, n * 100 + 90)]) for n in range(12)]
    rows = [(t, r, i, s, a, d) for t, r, stops in trips for i, (s, a, d) in enumerate(stops)]
    rows += [(100 + n, 1, i, s, n * 100 + 95 + i * 40, n * 100 + 95 + i * 40) for n in range(12) for i, s in enumerate((3, 4))]
    e = spark.createDataFrame(rows, "trip_id long, route_id long, stop_index long, stop_id long, arr long, dep long").checkpoint()
    f = spark.createDataFrame([(2, 7, 5)], "src long, dst long, travel_s long")
    lay = layout.departures(e).checkpoint()
    got = day_patterns.prefix_trees(spark.createDataFrame([(1,), (3,)], "source long"), lay, f, 0, 5000)
    seen = sorted((r.source, r.board, r.alight, r.stop_id, r.walk, r.trips) for r in got.where("trips > 0").collect())
    assert seen == [(1, 1, 2, 2, 0, 1), (1, 1, 2, 7, 5, 1), (1, 1, 3, 3, 0, 1), (1, 3, 4, 4, 0, 2), (3, 3, 4, 4, 0, 1)]
    folder = str(tmp_path / "trees")
    blocks = day_patterns.build(spark.createDataFrame([(x,) for x in range(1, 9)], "source long"), lay, f, 0, 5000, folder, blocks=4)
    one = day_patterns.stored(spark, folder, spark.createDataFrame([(0, 3, 4, 0)], QUERY), blocks)
    files = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("block=")[1][0] for r in files}) == 1
    assert day_patterns.prefix_trees(spark.createDataFrame([], "source long"), lay, f, 0, 5000).count() == 0
