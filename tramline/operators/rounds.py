"""Journey queries in rounds, for a whole table of queries at once.

All queries advance together, keyed by query_id. A round joins only the labels
that the last round improved; its result is settled before the next one, so
plans stay flat. Departures are compared through per-(route, place) arrays in
rank order, so a reached stop meets one row per route place rather than one
per trip, and the scan along a route is a minimum of trip ranks per place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import bucketed, discard, rounds_of, settle
from . import ordered_scan
from .layout import catch
from .pareto import improving


#: Rounds after which the best labels are written anew; between them they are the last ones and the rounds since.
SETTLE_EVERY = 3
#: Measured bytes up to which a table goes to every task, by all rounds of a search together.
SMALL_BYTES = 16 << 20
#: Rounds that a search is reckoned to take: each broadcasts a small layout anew.
LIKELY_ROUNDS = 16
#: Measured bytes of one bucket of a larger layout.
BUCKET_BYTES = 8 << 20
#: Footpaths as a closed table, or a way to walk: labels in, labels with all that is in walking reach out.
Walks = DataFrame | Callable[[DataFrame], DataFrame]


def _walk(labels: DataFrame, footpaths: Walks) -> DataFrame:
    """Labels and what one footpath makes of them; the least arrival per query and stop."""
    if callable(footpaths):
        return footpaths(labels.select("query_id", "stop_id", "arr"))
    hop = labels.join(footpaths, labels.stop_id == footpaths.src).select("query_id", F.col("dst").alias("stop_id"), (F.col("arr") + F.col("travel_s")).alias("arr"))
    return labels.select("query_id", "stop_id", "arr").unionByName(hop).groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))


def sides(layout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layout as boarding places (with departures) and as arrivals, each broadcast while its arrays are ``SMALL_BYTES`` at most over ``LIKELY_ROUNDS``.

    Every round broadcasts anew, through the driver. Beyond that size both are
    stored in buckets of their join keys, so that no round shuffles an array:
    the labels move to the buckets, hashed there (a hint), as a merge would sort the arrays.
    """
    places = layout.where("stop_index < last_index").select("route_id", "stop_index", "stop_id", "last_index", "deps", "slots")
    arrivals = layout.where("stop_index > 0").select("route_id", F.col("stop_index").alias("to_index"), F.col("stop_id").alias("to_stop"), "arrs")
    size = layout.agg(F.sum(64 + 8 * F.size("deps"))).first()[0] or 0
    if size * LIKELY_ROUNDS <= SMALL_BYTES:
        return F.broadcast(places), F.broadcast(arrivals)
    n = max(8, size // BUCKET_BYTES)
    return bucketed(places, n, "stop_id"), bucketed(arrivals, n, "route_id", "to_index")


def stored(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as they are while they are small, else in buckets of ``key``, so that no round moves them again."""
    size = 8 * len(rows.columns) * rows.count()
    return rows if size <= SMALL_BYTES else bucketed(rows, max(8, size // BUCKET_BYTES), key)


def _scan(reached: DataFrame, places: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals by one more trip from newly improved stops: the least per query and stop.

    Who boards a rank at a place is aboard at all later places of the route;
    the least rank aboard at a place arrives first there.
    """
    board = reached.hint("shuffle_hash").join(places, "stop_id").withColumn("rank", catch("arr")).where("rank < size(deps)")
    aboard = board.select("query_id", "route_id", "rank", F.explode(F.sequence(F.col("stop_index") + 1, F.col("last_index"))).alias("to_index"))
    aboard = aboard.groupBy("query_id", "route_id", "to_index").agg(F.min("rank").alias("rank"))
    ride = aboard.hint("shuffle_hash").join(arrivals, ["route_id", "to_index"]).select("query_id", F.col("to_stop").alias("stop_id"), F.expr("arrs[rank]").alias("arr"))
    return ride.groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))


def _least(labels: DataFrame) -> DataFrame:
    return labels.groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))


class Best:
    """The best arrival per query and stop over the rounds; with ``targets`` also the bound that these set."""

    def __init__(self, first: DataFrame, targets: DataFrame | None):
        self.kept, self.since, self.targets = first, [], targets

    def table(self) -> DataFrame:
        out = self.kept
        for x in self.since:
            out = out.unionByName(x)
        return _least(out) if self.since else out

    def improved(self, new: DataFrame) -> DataFrame:
        """Rows of ``new`` that beat the best so far, which is ``old``, and the best at their query's target, which no later arrival can improve."""
        best = self.table()
        old = best.withColumnRenamed("arr", "old")
        out = new.join(old, ["query_id", "stop_id"], "left").where("old IS NULL OR arr < old").select("query_id", "stop_id", "arr", "old")
        if self.targets is not None:
            bound = best.join(self.targets, ["query_id", "stop_id"]).select("query_id", F.col("arr").alias("bound"))
            out = out.join(bound, "query_id", "left").where("bound IS NULL OR arr < bound").select("query_id", "stop_id", "arr", "old")
        return out

    def add(self, delta: DataFrame) -> None:
        self.since.append(delta)
        if len(self.since) == SETTLE_EVERY:
            self.kept, self.since = settle(self.table()), []


def raptor(queries: DataFrame, layout: DataFrame, footpaths: Walks, max_rounds: int | None = None, to_target: bool = False) -> DataFrame:
    """``query_id, trips, stop_id, arr``: for every number of trips the improved arrivals at all stops.

    ``queries`` has query_id, source, dep_s. A row (q, k, s, a) says that q can
    be at s at time a with k trips and not earlier with fewer. ``layout`` is
    ``layout.departures``; routes must be FIFO; the departures in it may already
    be lowered by a transfer buffer. Footpaths must be transitively closed, or
    a function that walks any way. Rounds go on until no arrival improves, or to ``max_rounds`` if given. With
    ``to_target`` labels later than the best arrival at the query's target go
    no further, and only those of targets are complete.
    """
    start = queries.select("query_id", F.col("source").alias("stop_id"), F.col("dep_s").cast("long").alias("arr"))
    delta = settle(_walk(start, footpaths))
    targets = queries.select("query_id", F.col("target").alias("stop_id")) if to_target else None
    places, arrivals = sides(layout)
    best, out = Best(delta, targets), [delta.withColumn("trips", F.lit(0))]
    for k in rounds_of(max_rounds):
        new = _walk(_scan(delta, places, arrivals), footpaths)
        delta = settle(best.improved(new).drop("old"))
        if delta.isEmpty():
            break
        out.append(delta.withColumn("trips", F.lit(k)))
        best.add(delta)
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.select("query_id", F.col("trips").cast("long").alias("trips"), "stop_id", "arr")


def at_targets(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, trips, arr``: the Pareto set of each query's target."""
    t = queries.select("query_id", F.col("target").alias("stop_id"))
    return improving(labels.join(t, ["query_id", "stop_id"]).select("query_id", "trips", "arr"))


def earliest(labels: DataFrame) -> DataFrame:
    """``query_id, stop_id, arr``: the earliest arrival whatever the number of trips."""
    return labels.groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr"))


def direct_connections(queries: DataFrame, events: DataFrame) -> DataFrame:
    """``query_id, arr``: earliest arrival at the target without changing and without walking."""
    e = events.select("trip_id", "stop_index", "stop_id", "arr", "dep")
    # only arrivals at some query's target move
    there = e.join(F.broadcast(queries.select(F.col("target").alias("stop_id")).distinct()), "stop_id", "left_semi")
    src = F.broadcast(queries).join(e.withColumnRenamed("stop_id", "source"), "source").where("dep >= dep_s").select("query_id", "target", "trip_id", F.col("stop_index").alias("i"))
    dst = there.select("trip_id", F.col("stop_id").alias("target"), F.col("stop_index").alias("j"), F.col("arr").alias("at"))
    return src.join(dst, ["trip_id", "target"]).where("i < j").groupBy("query_id").agg(F.min("at").alias("arr"))


def connection_scan(queries: DataFrame, connections: DataFrame, footpaths: Walks, max_rounds: int | None = None, to_target: bool = False) -> DataFrame:
    """``query_id, stop_id, arr``: earliest arrivals by connections alone.

    A connection is usable if its trip is already used or its departure stop is
    reached in time. One scan in order of departure finds these (``ordered_scan``).
    Both conditions grow monotonically, so rounds over the frontier end in the
    same set; they are the way with ``max_rounds``, with connections that take no
    time and for walks other than footpaths, a graph or hub labels. With
    ``to_target``, in rounds too, connections after the best arrival at the target are not
    scanned, and only targets are complete.
    """
    start = queries.select("query_id", F.col("source").alias("stop_id"), F.col("dep_s").cast("long").alias("arr"))
    first = settle(_walk(start, footpaths))
    walks = getattr(footpaths, "walks", None) if callable(footpaths) else (footpaths, None, False)
    if max_rounds is None and not to_target and walks and connections.where("arr <= dep").isEmpty():
        return _least(ordered_scan.scan(first, connections, *walks))
    best = Best(first, queries.select("query_id", F.col("target").alias("stop_id")) if to_target else None)
    _scan_connections(first, connections, best, lambda ride: _walk(settle(_least(ride)), footpaths), max_rounds)
    return best.table()


def connection_scan_between(queries: DataFrame, connections: DataFrame, cuts: DataFrame, near: DataFrame, egress: DataFrame) -> DataFrame:
    """``query_id, arr``: earliest arrivals at targets with any walk at both ends and only ``cuts`` between two connections.

    ``near`` and ``egress`` (query_id, stop_id, walk) are the walks from sources and to targets.
    """
    start = queries.select("query_id", F.col("dep_s").cast("long").alias("dep_s")).join(near, "query_id").select("query_id", "stop_id", (F.col("dep_s") + F.col("walk")).alias("arr"))
    first = settle(_least(start))
    if connections.where("arr <= dep").isEmpty():
        rode = ordered_scan.scan(first, connections, cuts).where("rode").drop("rode")
        return _least(first.unionByName(rode)).join(egress, ["query_id", "stop_id"]).groupBy("query_id").agg(F.min(F.col("arr") + F.col("walk")).alias("arr"))
    best = Best(first, None)
    # stops reached by riding alone: a cut and a last walk are never walked one after the other
    ridden = [first]

    def walk(ride: DataFrame) -> DataFrame:
        ridden.append(settle(_least(ride)))
        return _walk(ridden[-1], cuts)

    _scan_connections(first, connections, best, walk, None)
    rows = ridden[0]
    for x in ridden[1:]:
        rows = rows.unionByName(x)
    return _least(rows).join(egress, ["query_id", "stop_id"]).groupBy("query_id").agg(F.min(F.col("arr") + F.col("walk")).alias("arr"))


def _scan_connections(delta: DataFrame, connections: DataFrame, best: Best, walk: Callable[[DataFrame], DataFrame], max_rounds: int | None) -> None:
    """Rounds over the frontier; ``best`` takes what each round improves.

    A query boards and rides each connection once: at a stop only those that
    leave before the arrival that was best there till now, on a trip only
    those before the one from which it was used.
    """
    c = connections.select("dep_stop", "arr_stop", "dep", "arr", "trip_id")
    leaving, riding = stored(c, "dep_stop"), stored(c, "trip_id")
    used, delta = None, delta.withColumn("old", F.lit(None).cast("long"))
    for _ in rounds_of(max_rounds):
        first = delta.withColumnRenamed("arr", "at").hint("shuffle_hash").join(leaving, F.col("stop_id") == F.col("dep_stop")).where("dep >= at AND (old IS NULL OR dep < old)").groupBy("query_id", "trip_id").agg(F.min("dep").alias("since"))
        if used is not None:
            old = used.withColumnRenamed("since", "was")
            first = first.join(old, ["query_id", "trip_id"], "left").where("was IS NULL OR since < was").select("query_id", "trip_id", "since", "was")
        else:
            first = first.withColumn("was", F.lit(None).cast("long"))
        first = settle(first)
        if first.isEmpty():
            break
        before, since = used, first.select("query_id", "trip_id", "since")
        used = settle(since if used is None else used.unionByName(since).groupBy("query_id", "trip_id").agg(F.min("since").alias("since")))
        ride = first.hint("shuffle_hash").join(riding, "trip_id").where("dep >= since AND (was IS NULL OR dep < was)").select("query_id", F.col("arr_stop").alias("stop_id"), "arr")
        delta = settle(best.improved(walk(ride)))
        discard(first, *([] if before is None else [before]))
        if delta.isEmpty():
            break
        best.add(delta.drop("old"))
    if used is not None:
        discard(used)


def trip_based(queries: DataFrame, layout: DataFrame, transfers: DataFrame, footpaths: DataFrame, max_rounds: int | None = None, cells: DataFrame | None = None, near: DataFrame | None = None, egress: DataFrame | None = None) -> DataFrame:
    """``query_id, trips, arr`` at each target by trip segments and event transfers.

    ``near`` and ``egress`` (query_id, stop_id, walk) replace one footpath at the
    source and at the target, as where walks there are not the footpaths between rides.

    ``transfers``: from_route, from_rank, from_index, to_route, to_rank,
    to_index (and ``level`` when ``cells`` is given). A segment is a trip from a
    boarding index on; a later segment of the same route is dropped when an
    earlier one has rank and index no larger. With ``cells`` a transfer whose
    boarding cell differs from both ends' cells above its level is skipped.
    Rounds go on until there is no new segment, or to ``max_rounds`` if given.
    """
    places = layout.select("route_id", "stop_index", "stop_id", "last_index", "deps", "slots")
    if near is None:
        near = _walk(queries.select("query_id", F.col("source").alias("stop_id"), F.col("dep_s").cast("long").alias("arr")), footpaths)
    else:
        near = near.join(queries.select("query_id", "dep_s"), "query_id").select("query_id", "stop_id", (F.col("dep_s") + F.col("walk")).alias("arr"))
    if egress is None:
        egress = queries.select("query_id", F.col("target").alias("stop_id"), F.lit(0).cast("long").alias("walk"))
        more = queries.select("query_id", "target").join(footpaths, F.col("target") == F.col("dst")).select("query_id", F.col("src").alias("stop_id"), F.col("travel_s").alias("walk"))
        egress = settle(egress.unionByName(more))
    seg = near.join(places, "stop_id").where("stop_index < last_index").withColumn("rank", catch("arr")).where("rank < size(deps)")
    seg = seg.select("query_id", "route_id", F.col("rank").cast("long").alias("rank"), F.col("stop_index").alias("from_index"))
    walked = near.join(egress, ["query_id", "stop_id"]).groupBy("query_id").agg(F.min(F.col("arr") + F.col("walk")).alias("arr"))
    out = [walked.withColumn("trips", F.lit(0))]
    known = None
    if cells is not None:
        s, t = cells.select(F.col("stop_id").alias("source"), F.col("cell_id").alias("sc")), cells.select(F.col("stop_id").alias("target"), F.col("cell_id").alias("tc"))
        ends = settle(queries.join(s, "source").join(t, "target").select("query_id", "sc", "tc"))
    for k in rounds_of(max_rounds):
        seg = _undominated(seg, known)
        seg = settle(seg)
        if seg.isEmpty():
            break
        known = seg if known is None else settle(known.unionByName(seg))
        ride = seg.join(layout.select("route_id", "stop_index", "stop_id", "arrs"), "route_id").where("stop_index > from_index")
        ride = ride.withColumn("arr", F.expr("arrs[int(rank)]"))
        hit = ride.join(egress, ["query_id", "stop_id"]).groupBy("query_id").agg(F.min(F.col("arr") + F.col("walk")).alias("arr"))
        out.append(settle(hit.withColumn("trips", F.lit(k))))
        nxt = seg.join(transfers, (F.col("route_id") == F.col("from_route")) & (F.col("rank") == F.col("from_rank"))).where("t_from_index > from_index")
        if cells is not None:
            nxt = nxt.join(ends, "query_id").where("shiftright(to_cell ^ sc, level) = 0 OR shiftright(to_cell ^ tc, level) = 0")
        seg = nxt.select("query_id", F.col("to_route").alias("route_id"), F.col("to_rank").alias("rank"), F.col("to_index").alias("from_index")).distinct()
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return improving(rows.select("query_id", F.col("trips").cast("long").alias("trips"), "arr"))


def _undominated(seg: DataFrame, known: DataFrame | None) -> DataFrame:
    """Segments with no other, or earlier known, segment of the route at a rank and index no larger."""
    rows = seg.distinct().withColumn("new", F.lit(1))
    if known is not None:
        rows = rows.unionByName(known.withColumn("new", F.lit(0)))
    before = Window.partitionBy("query_id", "route_id").orderBy("rank", "from_index", "new").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("least", F.min("from_index").over(before)).where("new = 1 AND (least IS NULL OR from_index < least)")
    return rows.select("query_id", "route_id", "rank", "from_index")
