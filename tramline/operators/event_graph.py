"""Searches over the event graph, labels read off it, and its exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import rounds_of, settle
from .layout import event_node
from .rounds import Walks, _walk


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, footpaths: Walks) -> DataFrame:
    """``query_id, stop_id, arr``: the earliest arrival events that the first departures in reach lead to, and a walk behind them.

    A departure that is reached reaches all later ones at its stop over wait
    edges, so a label per query and stop stands for them; a round opens the
    departures between the new label and the old one, rides, stays on to all
    later arrivals of the trips, and changes.
    """
    dep = settle(nodes.where("kind = 'dep'").select("node", "stop_id", "t", "trip_id", "stop_index"))
    arr = nodes.where("kind = 'arr'").select(F.col("node").alias("dst"), F.col("stop_id").alias("arr_stop"), F.col("t").alias("arr"), "trip_id", F.col("stop_index").alias("j"))
    # a change leads to the same stop or a neighbour: where and when its departure is
    change = settle(edges.where("kind = 'change'").join(dep.select(F.col("node").alias("dst"), F.col("stop_id").alias("to_stop"), F.col("t").alias("to_t")), "dst").select("src", "to_stop", "to_t"))
    near = settle(_walk(queries.select("query_id", F.col("source").alias("stop_id"), F.col("dep_s").cast("long").alias("arr")), footpaths))
    first = near.join(dep, "stop_id").where("t >= arr").groupBy("query_id", "stop_id").agg(F.min("t").alias("t"))
    # label: the first departure reached at a stop; was: where the last rounds began
    delta = settle(first.withColumn("was", F.lit(None).cast("long")))
    label, reached = delta.select("query_id", "stop_id", "t"), None
    for _ in rounds_of(None):
        if delta.isEmpty():
            break
        opened = delta.withColumnRenamed("t", "since").join(dep, "stop_id").where("t >= since AND (was IS NULL OR t < was)")
        on = opened.groupBy("query_id", "trip_id").agg(F.min("stop_index").alias("i"))
        got = settle(on.join(arr, "trip_id").where("j > i").select("query_id", F.col("dst").alias("src"), F.col("arr_stop").alias("stop_id"), "arr").distinct())
        best = got.groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))
        reached = best if reached is None else reached.unionByName(best).groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))
        reached = settle(reached)
        offer = got.join(change, "src").groupBy("query_id", F.col("to_stop").alias("stop_id")).agg(F.min("to_t").alias("t"))
        old = label.withColumnRenamed("t", "was")
        delta = settle(offer.join(old, ["query_id", "stop_id"], "left").where("was IS NULL OR t < was").select("query_id", "stop_id", "t", "was"))
        label = settle(label.unionByName(delta.select("query_id", "stop_id", "t")).groupBy("query_id", "stop_id").agg(F.min("t").alias("t")))
    out = near if reached is None else near.unionByName(_walk(reached, footpaths))
    return out.groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))


def path_labels(nodes: DataFrame, edges: DataFrame, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Forward labels ``event, path, pos`` of departures and backward labels of arrivals, over trips as paths.

    A trip is a path; its position is the place along it. A departure's label
    names every trip that it reaches with the first place where that can be
    boarded; an arrival's label is its own trip and place. ``stops`` restricts
    the departures labelled to those at some stops: labels of one block of
    stops are built in one batch, so blocks bound what is held at once.
    """
    dep = settle(nodes.where("kind = 'dep'").select("node", "stop_id", "t", "trip_id", "stop_index"))
    from_ = dep if stops is None else dep.join(stops.select("stop_id").distinct(), "stop_id", "left_semi")
    # what an arrival boards: the first departure of each trip that some later departure at the place belongs to
    board = edges.where("kind = 'change'").select(F.col("src").alias("arr_node"), "dst")
    at = dep.select(F.col("node").alias("dst"), F.col("stop_id").alias("s"), F.col("t").alias("t0"))
    board = settle(board.join(at, "dst").join(dep.select(F.col("stop_id").alias("s"), "t", F.col("trip_id").alias("path"), F.col("stop_index").alias("pos")), "s").where("t >= t0").groupBy("arr_node", "path").agg(F.min("pos").alias("pos")))
    same = from_.select(F.col("node").alias("event"), "stop_id", F.col("t").alias("t0"))
    label = same.join(dep, "stop_id").where("t >= t0").groupBy("event", F.col("trip_id").alias("path")).agg(F.min("stop_index").alias("pos"))
    delta = label = settle(label)
    arrivals = nodes.where("kind = 'arr'").select(F.col("node").alias("arr_node"), F.col("trip_id").alias("path"), F.col("stop_index").alias("j"))
    for _ in rounds_of(None):
        ride = delta.join(arrivals, "path").where("j > pos").select("event", "arr_node")
        offer = ride.join(board, "arr_node").groupBy("event", "path").agg(F.min("pos").alias("pos"))
        old = label.withColumnRenamed("pos", "was")
        delta = settle(offer.join(old, ["event", "path"], "left").where("was IS NULL OR pos < was").select("event", "path", "pos"))
        if delta.isEmpty():
            break
        label = settle(label.unionByName(delta).groupBy("event", "path").agg(F.min("pos").alias("pos")))
    back = nodes.where("kind = 'arr'").select(F.col("node").alias("event"), F.col("trip_id").alias("path"), F.col("stop_index").alias("pos"))
    return label, back


def split_event_graph(transfers: DataFrame, layout: DataFrame) -> DataFrame:
    """``src, dst, kind, weight``: events split into arrival and departure; transfers weigh 1, riding and staying aboard 0."""
    e = layout.select("route_id", "stop_index", "last_index", F.posexplode("trip_ids").alias("rank", "trip_id"))
    node = {k: event_node(k) for k in (0, 1)}
    on = e.where("stop_index < last_index").select(node[0].alias("src"), ((F.col("trip_id") * 256 + F.col("stop_index") + 1) * 2 + 1).alias("dst"), F.lit("ride").alias("kind"), F.lit(0).alias("weight"))
    stay = e.where("stop_index > 0 AND stop_index < last_index").select(node[1].alias("src"), node[0].alias("dst"), F.lit("stay").alias("kind"), F.lit(0).alias("weight"))
    to = e.select(F.col("route_id").alias("to_route"), F.col("rank").cast("long").alias("to_rank"), F.col("stop_index").alias("to_index"), F.col("trip_id").alias("to_trip"))
    t = transfers.join(to, ["to_route", "to_rank", "to_index"])
    change = t.select(((F.col("from_trip") * 256 + F.col("t_from_index")) * 2 + 1).alias("src"), ((F.col("to_trip") * 256 + F.col("to_index")) * 2).alias("dst"), F.lit("transfer").alias("kind"), F.lit(1).alias("weight"))
    return on.unionByName(stay).unionByName(change)


def hub_label_files(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``line`` of a DIMACS graph of the events, and ``line`` of its trips as paths (vertices in order), both numbered from 1 on."""
    no = settle(numbered_nodes(nodes))
    a, b = no.select(F.col("node").alias("src"), F.col("no").alias("a")), no.select(F.col("node").alias("dst"), F.col("no").alias("b"))
    arcs = edges.join(a, "src").join(b, "dst").select(F.concat_ws(" ", F.lit("a"), "a", "b", "travel_s").alias("line"))
    head = no.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m"))).select(F.concat_ws(" ", F.lit("p sp"), "n", "m").alias("line"))
    paths = no.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("t", "no"))).alias("p")).select(F.concat_ws(" ", F.transform("p", lambda x: x["no"])).alias("line"))
    return head.unionByName(arcs), paths


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``no``: 1, 2, ... in order of node."""
    from ..sources.exports import numbered

    return numbered(nodes, "node").withColumn("no", F.col("no") + 1)


def leveled_events(leveled: DataFrame, layout: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``src, dst, hop, level`` of a hierarchy as an event graph (transfers hop 1, riding hop 0), and ``node, stop_id, cell_id``."""
    g = split_event_graph(leveled, layout)
    to = layout.select(F.col("route_id").alias("to_route"), F.col("stop_index").alias("to_index"), F.posexplode("trip_ids").alias("to_rank", "to_trip"))
    lv = leveled.join(to.withColumn("to_rank", F.col("to_rank").cast("long")), ["to_route", "to_index", "to_rank"])
    lv = lv.select(((F.col("from_trip") * 256 + F.col("t_from_index")) * 2 + 1).alias("src"), ((F.col("to_trip") * 256 + F.col("to_index")) * 2).alias("dst"), "level")
    edges = g.join(lv, ["src", "dst"], "left").select("src", "dst", F.col("weight").alias("hop"), F.coalesce("level", F.lit(0)).cast("long").alias("level"))
    e = layout.select("stop_index", "stop_id", "last_index", F.explode("trip_ids").alias("trip_id"))
    both = e.where("stop_index < last_index").select(event_node(0).alias("node"), "stop_id").unionByName(e.where("stop_index > 0").select(event_node(1).alias("node"), "stop_id"))
    return edges, both.join(cells, "stop_id").select("node", "stop_id", "cell_id")
