"""Networks and graphs on disk: Parquet for every layout, and readers of the text formats that others write."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exports import numbered
from .timetable import Timetable

PARTS = ["stops", "trips", "stop_events", "footpaths", "cells"]


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table of a layout as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def save_timetable(t: Timetable, folder: str) -> None:
    save({n: getattr(t, n) for n in PARTS}, folder)


def load_timetable(spark: SparkSession, folder: str) -> Timetable:
    return Timetable(**load(spark, folder, PARTS))


def read_table(spark: SparkSession, path: str, columns: dict[str, str], header: bool = True, comment: str | None = None, overflow: str = "ignore") -> DataFrame:
    """A CSV file's ``columns`` (name -> type) by name, or by position without header; others are ignored, missing ones null.

    ``comment``: a character that starts lines to skip. ``overflow``: what
    rows with more cells than the header mean, ``ignore`` or ``raise``.
    """
    if overflow not in ("ignore", "raise"):
        raise ValueError(f"overflow: {overflow}")
    options = {"header": header, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "FAILFAST" if overflow == "raise" else "PERMISSIVE"}
    if comment:
        options["comment"] = comment
    df = spark.read.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).csv(path)
    have = {c.strip().lstrip("﻿").lower(): c for c in df.columns} if header else dict(zip(columns, df.columns, strict=False))
    return df.select(*[(F.nullif(F.trim(F.col(f"`{have[c.lower()]}`")), F.lit("")).try_cast(k) if c.lower() in have else F.lit(None).cast(k)).alias(c) for c, k in columns.items()])


def read_csv_tables(spark: SparkSession, folder: str) -> Timetable:
    """What ``exports.csv_tables`` and ``write_csv`` wrote; transfer times of stops come from MinChangeTime."""
    stops = read_table(spark, f"{folder}/stops", {"StopId": "long", "StopName": "string", "Latitude": "double", "Longitude": "double", "MinChangeTime": "long"})
    trips = read_table(spark, f"{folder}/trips", {"TripId": "long", "LineId": "long"}).select(F.col("TripId").alias("trip_id"), F.col("LineId").alias("route_id"))
    times = read_table(spark, f"{folder}/stop_times", {"TripId": "long", "StopIndex": "long", "StopId": "long", "ArrivalTime": "long", "DepartureTime": "long"})
    times = times.select(F.col("TripId").alias("trip_id"), F.col("StopIndex").alias("stop_index"), F.col("StopId").alias("stop_id"), F.col("ArrivalTime").alias("arr"), F.col("DepartureTime").alias("dep"))
    foot = read_table(spark, f"{folder}/footpaths", {"FromStopId": "long", "ToStopId": "long", "TravelTime": "long"})
    cells = read_table(spark, f"{folder}/partition", {"StopId": "long", "Cell": "long"})
    t0 = times.where("stop_index = 0").select("trip_id", F.col("arr").alias("t0"))
    e6 = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return Timetable(
        stops.select(F.col("StopId").alias("stop_id"), F.col("StopName").alias("name"), e6("Longitude").alias("lon_e6"), e6("Latitude").alias("lat_e6"), F.col("MinChangeTime").alias("min_transfer_s")),
        trips.join(t0, "trip_id").select("trip_id", "route_id", "t0"),
        times.join(trips, "trip_id").select("trip_id", "route_id", "stop_index", "stop_id", "arr", "dep"),
        foot.select(F.col("FromStopId").alias("src"), F.col("ToStopId").alias("dst"), F.col("TravelTime").alias("travel_s")),
        cells.select(F.col("StopId").alias("stop_id"), F.col("Cell").alias("cell_id")),
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``no, line``: a text file's lines, numbered from 0 on in their order.

    The file is read as one split per part, so the order inside a file holds.
    """
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    return numbered(lines, "_id").select("no", F.col("value").alias("line"))


def read_dimacs(spark: SparkSession, graph_path: str, coordinate_path: str | None = None, factor: float = 1e-6) -> tuple[DataFrame, DataFrame | None]:
    """``src, dst, travel_s`` of a DIMACS graph's arcs, and ``vertex, lon, lat`` of its coordinates; ids from 0 on."""
    part = F.split(F.trim("value"), r"\s+")
    arcs = spark.read.text(graph_path).where("value LIKE 'a %'").select((part[1].cast("long") - 1).alias("src"), (part[2].cast("long") - 1).alias("dst"), part[3].cast("long").alias("travel_s"))
    if coordinate_path is None:
        return arcs, None
    points = spark.read.text(coordinate_path).where("value LIKE 'v %'")
    return arcs, points.select((part[1].cast("long") - 1).alias("vertex"), (part[2].cast("double") * factor).alias("lon"), (part[3].cast("double") * factor).alias("lat"))


def read_vectors(spark: SparkSession, folder: str, weight: str = "travel_time") -> DataFrame:
    """``src, dst, travel_s`` from raw little-endian vectors first_out, head (u32) and a weight (i32), each after its length (u64)."""

    def vector(name: str, kind: str) -> DataFrame:
        def cut(parts):
            for pdf in parts:
                for data in pdf["content"]:
                    n = int(np.frombuffer(data, "<u8", 1)[0])
                    v = np.frombuffer(data, kind, n, 8).astype(np.int64)
                    yield pd.DataFrame({"i": np.arange(n), "v": v})

        return spark.read.format("binaryFile").load(f"{folder}/{name}").select("content").mapInPandas(cut, "i long, v long")

    first = vector("first_out", "<u4")
    nxt = first.select((F.col("i") - 1).alias("src"), F.col("v").alias("end"))
    out = first.select(F.col("i").alias("src"), F.col("v").alias("begin")).join(nxt, "src").where("begin < end").select("src", F.explode(F.expr("sequence(begin, end - 1)")).alias("i"))
    head, cost = vector("head", "<u4").withColumnRenamed("v", "dst"), vector(weight, "<i4").withColumnRenamed("v", "travel_s")
    return out.join(head, "i").join(cost, "i").select("src", "dst", "travel_s")


def read_partition(spark: SparkSession, path: str, component: DataFrame) -> DataFrame:
    """``stop_id, cell_id`` from a file of one cell a line, for the components in order of their least vertex."""
    cells = _lines(spark, path).select("no", F.col("line").cast("long").alias("cell_id"))
    return numbered(component.select("component").distinct(), "component").join(cells, "no").join(component, "component").select(F.col("vertex").alias("stop_id"), "cell_id")


def read_hub_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Out- and in-labels ``vertex, hub`` from counted lists: the number of vertices, then per vertex a line ``n hub dist ...`` for each direction, ids from 0 on."""
    lines = _lines(spark, path)
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.where("no > 0").select(F.expr("(no - 1) div 2").alias("vertex"), F.expr("(no - 1) % 2").alias("side"), F.transform(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda x: x.cast("long")).alias("v"), part[0].cast("long").alias("n"))
    bad = rows.where("size(v) <> 2 * n").limit(1).collect()
    if bad:
        raise ValueError(f"label line of vertex {bad[0]['vertex']} has not as many entries as it says")
    pairs = rows.where("n > 0").select("vertex", "side", F.inline(F.expr("transform(sequence(0, int(n) - 1), i -> struct(v[2 * i] AS hub, v[2 * i + 1] AS dist))")))
    return pairs.where("side = 0").drop("side"), pairs.where("side = 1").drop("side")


def read_path_hubs(spark: SparkSession, path: str) -> DataFrame:
    """``event, path, pos`` from lines of a path's events in order, both numbered from 0 on."""
    ids = F.split(F.trim("line"), r"\s+")
    return _lines(spark, path).where("trim(line) <> ''").select(F.col("no").alias("path"), F.posexplode(ids).alias("pos", "event")).select((F.col("event").cast("long") - 1).alias("event"), "path", F.col("pos").cast("long").alias("pos"))


def id_table(df: DataFrame, key: str) -> DataFrame:
    """``id, <key>``: 0, 1, ... for the distinct values of ``key`` in their order; the table that maps between names and numbers."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), key).select(F.col("no").alias("id"), key)
