"""Text and CSV exports: timetable tables, DIMACS edge lists, METIS layout graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import format_seconds
from ..plans.iterate import settle
from .timetable import Timetable

#: Row numbers inside a partition are the low bits of ``monotonically_increasing_id``.
_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``no``: 0, 1, ... in order of ``by``, without gathering the rows in one task.

    Rows are range-partitioned and numbered where they are; only one count per
    partition is summed up and sent to all.
    """
    rows = settle(df.orderBy(by).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offset), "_part").withColumn("no", F.col("_id").bitwiseAND(F.lit(_IN_PARTITION)) + F.col("_offset")).drop("_id", "_part", "_offset")


def stop_table(t: Timetable, implicit_buffers: bool = False) -> DataFrame:
    """StopId, StopName, Latitude, Longitude, MinChangeTime (0 where buffers are already in the departures)."""
    change = F.lit(0).cast("long") if implicit_buffers else F.col("min_transfer_s")
    return t.stops.select(F.col("stop_id").alias("StopId"), F.col("name").alias("StopName"), (F.col("lat_e6") / 1e6).alias("Latitude"), (F.col("lon_e6") / 1e6).alias("Longitude"), change.alias("MinChangeTime"))


def csv_tables(t: Timetable) -> dict[str, DataFrame]:
    """The tables of a CSV export by file name."""
    return {
        "stops": stop_table(t),
        "trips": t.trips.select(F.col("trip_id").alias("TripId"), F.col("route_id").alias("LineId")),
        "stop_times": t.stop_events.select(F.col("trip_id").alias("TripId"), F.col("stop_index").alias("StopIndex"), F.col("stop_id").alias("StopId"), F.col("arr").alias("ArrivalTime"), F.col("dep").alias("DepartureTime")),
        "footpaths": t.footpaths.select(F.col("src").alias("FromStopId"), F.col("dst").alias("ToStopId"), F.col("travel_s").alias("TravelTime")),
        "partition": t.cells.select(F.col("stop_id").alias("StopId"), F.col("cell_id").alias("Cell")),
    }


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a folder of CSV part files with a header, written by all tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def dimacs(edges: DataFrame) -> DataFrame:
    """``line`` of a DIMACS shortest-path file: ``p sp vertices edges``, then ``a src dst weight`` from 1 on."""
    head = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("n"), F.count("*").alias("m"))
    arcs = edges.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, "travel_s").alias("line"))
    return head.select(F.concat_ws(" ", F.lit("p sp"), "n", "m").alias("line")).unionByName(arcs)


def metis(component: DataFrame, graph: DataFrame) -> DataFrame:
    """``line_no, line`` of a METIS file with vertex and edge weights.

    ``component`` (vertex, component) gives vertices, weighted by their stops;
    ``graph`` (src, dst, weight) has both directions of each edge. Line 0 is
    ``vertices edges 11``; line i holds the weight of vertex i, then its
    neighbours, counted from 1, each with the weight of its edge.
    """
    v = settle(numbered(component.groupBy("component").agg(F.count("*").alias("stops")), "component").withColumn("no", F.col("no") + 1))
    a, b = v.select(F.col("component").alias("src"), F.col("no").alias("a")), v.select(F.col("component").alias("dst"), F.col("no").alias("b"))
    links = settle(graph.join(a, "src").join(b, "dst").select("a", "b", "weight"))
    beside = links.groupBy(F.col("a").alias("no")).agg(F.sort_array(F.collect_list(F.struct("b", "weight"))).alias("e"))
    text = F.concat_ws(" ", F.transform("e", lambda x: F.concat_ws(" ", x["b"], x["weight"])))
    rows = v.join(beside, "no", "left").select(F.col("no").alias("line_no"), F.when(F.col("e").isNull(), F.col("stops").cast("string")).otherwise(F.concat_ws(" ", "stops", text)).alias("line"))
    head = v.agg(F.count("*").alias("n")).join(links.agg(F.expr("count(*) div 2").alias("m")))
    return head.select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", "n", "m", F.lit("11")).alias("line")).unionByName(rows)


def transfer_table(transfers: DataFrame, layout: DataFrame) -> DataFrame:
    """Event transfers by trip and place at both ends (and their level where there is one)."""
    to = layout.select(F.col("route_id").alias("to_route"), F.col("stop_index").alias("to_index"), F.posexplode("trip_ids").alias("to_rank", "to_trip")).withColumn("to_rank", F.col("to_rank").cast("long"))
    more = [F.col("level").cast("long").alias("Level")] if "level" in transfers.columns else []
    t = transfers.join(to, ["to_route", "to_index", "to_rank"])
    return t.select(F.col("from_trip").alias("FromTrip"), F.col("t_from_index").alias("FromIndex"), F.col("to_trip").alias("ToTrip"), F.col("to_index").alias("ToIndex"), *more)


def trip_based_tables(t: Timetable, layout: DataFrame, transfers: DataFrame) -> dict[str, DataFrame]:
    """The CSV tables and the event transfers."""
    return csv_tables(t) | {"transfers": transfer_table(transfers, layout)}


def hierarchy_tables(t: Timetable, layout: DataFrame, leveled: DataFrame, component: DataFrame) -> dict[str, DataFrame]:
    """The CSV tables, the components of stops, and the event transfers with their levels."""
    return trip_based_tables(t, layout, leveled) | {"components": component.select(F.col("vertex").alias("StopId"), F.col("component").alias("Root"))}


def edge_table(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("FromVertex"), F.col("dst").alias("ToVertex"), F.col("travel_s").alias("TravelTime"))


def graphml(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``line_no, line`` of a GraphML file: ``vertices`` (vertex, lon_e6, lat_e6) and directed ``edges``."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{on}" attr.name="{k}" attr.type="{kind}"/>' for k, on, kind in (("lon", "node", "double"), ("lat", "node", "double"), ("time", "edge", "long"))]
    head += ['<graph edgedefault="directed">']
    spark = vertices.sparkSession
    first = spark.createDataFrame(list(enumerate(head)), "line_no long, line string")
    node = F.format_string('<node id="n%d"><data key="lon">%.6f</data><data key="lat">%.6f</data></node>', "vertex", F.col("lon_e6") / 1e6, F.col("lat_e6") / 1e6)
    link = F.format_string('<edge source="n%d" target="n%d"><data key="time">%d</data></edge>', "src", "dst", "travel_s")
    n = numbered(vertices.withColumn("line", node), "vertex").select((F.col("no") + len(head)).alias("line_no"), "line")
    e = numbered(edges.withColumn("line", link).withColumn("key", F.struct("src", "dst")), "key")
    count = vertices.agg(F.count("*").alias("n"))
    e = e.crossJoin(F.broadcast(count)).select((F.col("no") + F.col("n") + len(head)).alias("line_no"), "line")
    total = count.crossJoin(edges.agg(F.count("*").alias("m")))
    last = total.select(F.explode(F.array(*[F.struct((F.col("n") + F.col("m") + len(head) + i).alias("line_no"), F.lit(x).alias("line")) for i, x in enumerate(("</graph>", "</graphml>"))])).alias("l")).select("l.*")
    return first.unionByName(n).unionByName(e).unionByName(last)


def hmetis(component: DataFrame, routes: DataFrame) -> DataFrame:
    """``line_no, line`` of an hMETIS file: a route (route_id, stop_id, weight) is a hyperedge over the components it serves.

    Line 0 is ``hyperedges vertices 11``, then ``weight vertices`` per route
    that serves two components or more, then the stops of each component.
    """
    v = settle(numbered(component.groupBy("component").agg(F.count("*").alias("stops")), "component").withColumn("no", F.col("no") + 1))
    at = component.select(F.col("vertex").alias("stop_id"), "component").join(v.select("component", "no"), "component")
    nets = routes.join(at, "stop_id").groupBy("route_id").agg(F.max("weight").alias("w"), F.sort_array(F.collect_set("no")).alias("pins")).where("size(pins) > 1")
    nets = settle(numbered(nets, "route_id"))
    m = nets.agg(F.count("*").alias("m"))
    head = m.crossJoin(v.agg(F.count("*").alias("n"))).select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", "m", "n", F.lit("11")).alias("line"))
    rows = nets.select((F.col("no") + 1).alias("line_no"), F.concat_ws(" ", "w", F.concat_ws(" ", F.transform("pins", lambda x: x.cast("string")))).alias("line"))
    weights = v.crossJoin(F.broadcast(m)).select((F.col("no") + F.col("m")).alias("line_no"), F.col("stops").cast("string").alias("line"))
    return head.unionByName(rows).unionByName(weights)


def journey_text(legs: DataFrame, stops: DataFrame) -> DataFrame:
    """``query_id, trips, text``: a journey's legs, one a line, with stop names and times of day."""
    a, b = stops.select(F.col("stop_id").alias("from_stop"), F.col("name").alias("_from")), stops.select(F.col("stop_id").alias("to_stop"), F.col("name").alias("_to"))
    how = F.when(F.col("kind") == "ride", F.format_string("trip %d", "trip_id")).otherwise(F.lit("walk"))
    line = F.concat_ws(" ", format_seconds(F.col("dep")), "_from", F.lit("->"), format_seconds(F.col("arr")), "_to", F.concat(F.lit("("), how, F.lit(")")))
    named = legs.join(a, "from_stop", "left").join(b, "to_stop", "left").withColumn("_line", line)
    one = named.groupBy("query_id", "trips").agg(F.sort_array(F.collect_list(F.struct("leg", "_line"))).alias("l"))
    return one.select("query_id", "trips", F.concat_ws("\n", F.transform("l", lambda x: x["_line"])).alias("text"))


def pattern_graph(prefixes: DataFrame, source: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, stop_id, kind`` and edges ``src, dst`` of one source's pattern graph; a node is a distinct beginning of a pattern."""
    own = prefixes.where(F.col("source") == source)
    text = lambda p: F.concat_ws(">", F.transform(p, lambda x: F.concat_ws(":", x["kind"], x["to_stop"].cast("string"))))
    last = F.element_at("prefix", -1)
    nodes = own.select(text(F.col("prefix")).alias("node"), last["to_stop"].alias("stop_id"), last["kind"].alias("kind"))
    edges = own.where("size(prefix) > 1").select(text(F.expr("slice(prefix, 1, size(prefix) - 1)")).alias("src"), text(F.col("prefix")).alias("dst"))
    return nodes, edges


def gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line`` of a GML file of ``pattern_graph``; nodes by number in order of their names."""
    no = settle(numbered(nodes, "node"))
    a, b = no.select(F.col("node").alias("src"), F.col("no").alias("a")), no.select(F.col("node").alias("dst"), F.col("no").alias("b"))
    n = no.select(F.format_string('node [ id %d label "%d" kind "%s" ]', "no", "stop_id", "kind").alias("line"))
    e = edges.join(a, "src").join(b, "dst").select(F.format_string("edge [ source %d target %d ]", "a", "b").alias("line"))
    ends = nodes.sparkSession.createDataFrame([("graph [",), ("directed 1",), ("]",)], "line string")
    return ends.where("line <> ']'").unionByName(n).unionByName(e).unionByName(ends.where("line = ']'"))
