"""The scan in order of departure against rounds, for every way to walk."""

import pytest

from tramline.operators import layout, ordered_scan, rounds, ultra, walking
from tramline.plans import iterate

from .test_timetable import events, feet, random_network


def queries(spark, n=9):
    return spark.createDataFrame([(7 * i - 20, i % 12, (3 * i + 1) % 12, 40 * i) for i in range(n)], "query_id long, source long, target long, dep_s long")



@pytest.mark.parametrize("seed", [1, 4])
def test_one_pass_finds_what_rounds_find(spark, seed, monkeypatch):
    trips, foot = random_network(seed)
    c, f = iterate.settle(layout.connections(events(spark, trips))), feet(spark, foot)
    chain = feet(spark, [(i, i + 1, 15 + 5 * i) for i in range(4)] + [(4, 100, 10), (100, 9, 10)])
    q, many = queries(spark), 10_000
    ways = {"closed": f, "graph": walking.over_graph(iterate.settle(chain)), "labels": walking.over_labels(*walking.canonical_labels(chain))}
    want = {n: sorted(rounds.connection_scan(q, c, w, max_rounds=many).collect()) for n, w in ways.items()}
    monkeypatch.setattr(rounds, "_scan_connections", None)
    for block in (256, 2):
        monkeypatch.setattr(ordered_scan, "BLOCK", block)
        for n, w in ways.items():
            assert sorted(rounds.connection_scan(q, c, w).collect()) == want[n], n


def test_walks_at_the_ends_and_cuts_between(spark, monkeypatch):
    trips, foot = random_network(2)
    c, f = iterate.settle(layout.connections(events(spark, trips))), feet(spark, foot)
    q = queries(spark)
    ends = ultra.footpath_ends(q, f)
    got = sorted(rounds.connection_scan_between(q, c, f, *ends).collect())
    # with a connection that takes no time at a stop of its own, in rounds
    still = c.unionByName(spark.createDataFrame([(500, 501, 7, 7, 900)], c.schema))
    assert got and sorted(rounds.connection_scan_between(q, still, f, *ends).collect()) == got


def test_many_changes_take_no_rounds(spark, monkeypatch):
    # a line whose every hop is a trip of its own
    e = events(spark, {k: (k, [(k, 100 * k, 100 * k), (k + 1, 100 * k + 50, 100 * k + 50)]) for k in range(30)})
    monkeypatch.setattr(iterate, "BOUND", 5)
    q = spark.createDataFrame([(0, 0, 30, 0)], "query_id long, source long, target long, dep_s long")
    got = rounds.connection_scan(q, layout.connections(e), feet(spark, [])).collect()
    assert {r.stop_id: r.arr for r in got} == {0: 0} | {k + 1: 100 * k + 50 for k in range(30)}


def test_connections_that_take_no_time_are_used(spark):
    # the second leaves when the first ends, in the same second
    e = events(spark, {0: (0, [(0, 10, 10), (1, 10, 10)]), 1: (1, [(1, 10, 10), (2, 10, 10)]), 2: (2, [(2, 5, 10), (3, 20, 20)])})
    q = spark.createDataFrame([(0, 0, 3, 10)], "query_id long, source long, target long, dep_s long")
    got = rounds.connection_scan(q, layout.connections(e), feet(spark, [])).collect()
    assert {r.stop_id: r.arr for r in got} == {0: 10, 1: 10, 2: 10, 3: 20}
