"""GTFS feeds: nine readers, service days, frequencies and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_day, parse_seconds, weekday
from ..plans.iterate import settle
from .exports import numbered
from .store import id_table, load, save
from .timetable import Timetable

COLUMNS = {
    "agency": "agency_id agency_name agency_timezone",
    "calendar": "service_id sunday monday tuesday wednesday thursday friday saturday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "frequencies": "trip_id start_time end_time headway_secs",
    "routes": "route_id agency_id route_short_name route_long_name route_type route_color route_text_color",
    "stops": "stop_id stop_name stop_lat stop_lon",
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence",
    "transfers": "from_stop_id to_stop_id min_transfer_time transfer_type",
    "trips": "route_id service_id trip_id trip_short_name",
}


def read_raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file, all strings, trimmed; extra columns are ignored, missing ones and empty cells are null."""
    df = spark.read.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    # where a row stands: of rows with equal ids the first one holds
    df = df.withColumn("file_row", F.monotonically_increasing_id())
    have = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    cell = lambda c: F.nullif(F.trim(F.col(f"`{have[c]}`")), F.lit("")) if c in have else F.lit(None).cast("string")
    return df.select(*[cell(c).alias(c) for c in COLUMNS[name].split()], "file_row")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine tables typed and validated; a missing file gives an empty table."""
    raw = {}
    for name, cols in COLUMNS.items():
        try:
            raw[name] = read_raw(spark, folder, name)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raw[name] = spark.createDataFrame([], T.StructType([*[T.StructField(c, T.StringType()) for c in cols.split()], T.StructField("file_row", T.LongType())]))
    return clean(raw)


def clean(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw tables (all strings) typed and validated; of routes, stops and trips with one id the first row of the file holds."""
    raw = {n: df if "file_row" in df.columns else df.withColumn("file_row", F.monotonically_increasing_id()) for n, df in raw.items()}
    raw |= {n: first_rows(raw[n].where(F.col(k).isNotNull()), k, "file_row") for n, k in (("routes", "route_id"), ("stops", "stop_id"), ("trips", "trip_id"))}
    i = lambda c: F.col(c).try_cast("int")
    days = "sunday monday tuesday wednesday thursday friday saturday".split()
    return {
        "agency": raw["agency"].where("agency_id IS NOT NULL").select("agency_id", F.coalesce("agency_name", F.lit("NOT_NAMED")).alias("name"), F.col("agency_timezone").alias("timezone")),
        "calendar": raw["calendar"].select("service_id", F.array(*[F.coalesce(F.col(d) == "1", F.lit(False)) for d in days]).alias("runs"), parse_day(F.col("start_date")).alias("start_day"), parse_day(F.col("end_date")).alias("end_day")).where("service_id IS NOT NULL AND start_day <= end_day"),
        "calendar_dates": raw["calendar_dates"].select("service_id", parse_day(F.col("date")).alias("day"), (F.col("exception_type") == "1").alias("operates")).where("service_id IS NOT NULL AND day IS NOT NULL"),
        "frequencies": raw["frequencies"].select("trip_id", parse_seconds(F.col("start_time")).alias("start_s"), parse_seconds(F.col("end_time")).alias("end_s"), i("headway_secs").alias("headway_s")).where("trip_id IS NOT NULL AND start_s <= end_s AND headway_s > 0"),
        "routes": raw["routes"].where("route_id IS NOT NULL").select("route_id", "agency_id", F.concat(F.lit("["), F.coalesce("route_short_name", F.lit("")), F.lit("] "), F.coalesce("route_long_name", F.lit(""))).alias("name"), i("route_type").alias("type"), *[F.when(F.col(c).rlike("^[0-9A-Fa-f]{6}$"), F.col(c)).otherwise(F.lit(d)).alias(c) for c, d in (("route_color", "FFFFFF"), ("route_text_color", "000000"))]),
        "stops": raw["stops"].where("stop_id IS NOT NULL").select("stop_id", F.col("stop_name").alias("name"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon")),
        "stop_times": raw["stop_times"].select("trip_id", parse_seconds(F.col("arrival_time")).alias("arr"), parse_seconds(F.col("departure_time")).alias("dep"), "stop_id", i("stop_sequence").alias("seq")).where("trip_id IS NOT NULL AND stop_id IS NOT NULL AND arr <= dep"),
        "transfers": raw["transfers"].where("from_stop_id IS NOT NULL AND to_stop_id IS NOT NULL AND coalesce(transfer_type, '') <> '3'").select(F.col("from_stop_id").alias("src"), F.col("to_stop_id").alias("dst"), F.coalesce(i("min_transfer_time"), F.lit(0)).alias("travel_s")),
        "trips": raw["trips"].where("route_id IS NOT NULL AND service_id IS NOT NULL AND trip_id IS NOT NULL").select("route_id", "service_id", "trip_id", F.col("trip_short_name").alias("name")),
    }


def service_days(calendar: DataFrame, dates: DataFrame, first: str, last: str, ignore_days: bool = False) -> DataFrame:
    """``service_id, day`` (number, 0 = the first active day): weekdays in range, with exceptions applied.

    ``ignore_days`` makes every day of the range active. Services without an
    active day are absent.
    """
    lo, hi = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    own = calendar.select("service_id", "runs", F.greatest("start_day", lo).alias("a"), F.least("end_day", hi).alias("b"))
    if ignore_days:
        names = calendar.select("service_id").unionByName(dates.select("service_id")).distinct()
        active = names.select("service_id", F.explode(F.sequence(lo, hi)).alias("d"))
    else:
        ranged = own.where("a <= b").select("service_id", "runs", F.explode(F.sequence("a", "b")).alias("d"))
        ranged = ranged.where(F.element_at("runs", weekday(F.col("d")) + 1)).select("service_id", "d")
        inside = dates.where(F.col("day").between(lo, hi)).select("service_id", F.col("day").alias("d"), "operates")
        active = ranged.unionByName(inside.where("operates").drop("operates")).distinct().join(inside.where("NOT operates").drop("operates"), ["service_id", "d"], "left_anti")
    start = active.agg(F.min("d").alias("zero"))
    return active.join(F.broadcast(start)).select("service_id", F.datediff("d", "zero").cast("long").alias("day"))


def repaired(times: Column) -> Column:
    """An ordered array of (arr, dep): time stands still nowhere between events; null if a trip goes back in time.

    A running offset grows by a second wherever an event begins at the moment
    the one before it ends, and shifts all that follows.
    """
    init = F.expr("named_struct('offset', 0L, 'last', CAST(NULL AS bigint), 'ok', true, 'out', CAST(array() AS array<struct<arr:bigint,dep:bigint>>))")

    def step(s: Column, x: Column) -> Column:
        off = s["offset"] + F.when(s["last"] == x["arr"] + s["offset"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        arr, dep = x["arr"].cast("long") + off, x["dep"].cast("long") + off
        ok = s["ok"] & F.coalesce(s["last"] < arr, F.lit(True))
        return F.struct(off.alias("offset"), dep.alias("last"), ok.alias("ok"), F.concat(s["out"], F.array(F.struct(arr.alias("arr"), dep.alias("dep")))).alias("out"))

    return F.aggregate(times, init, step, lambda s: F.when(s["ok"], s["out"]))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each ``key`` by ``order``: duplicates of an id lose."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def trip_events(feed: dict[str, DataFrame], first: str, last: str, use_days: bool = True, use_frequencies: bool = True) -> DataFrame:
    """``trip, run, stop_index, stop_id, arr, dep``: every run of every trip on every active day.

    Trips need a known route and an active service, stop times a known stop.
    Frequency trips leave at start, start + headway, ... up to the end
    inclusive, and are dropped if frequencies are not used. The first arrival
    becomes a second before the first departure, the last departure a second
    after the last arrival.
    """
    days = service_days(feed["calendar"], feed["calendar_dates"], first, last, not use_days)
    trips = feed["trips"].join(feed["routes"].select("route_id").distinct(), "route_id", "left_semi")
    times = feed["stop_times"].join(feed["stops"].select("stop_id").distinct(), "stop_id", "left_semi")
    e = times.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "arr", "dep", "stop_id"))).alias("e"))
    fixed = e.select("trip_id", F.col("e.stop_id").alias("at"), repaired(F.col("e")).alias("times")).where("times IS NOT NULL AND size(times) > 1")
    t = trips.join(days, "service_id").join(fixed, "trip_id")
    f = feed["frequencies"]
    plain = t.join(f.select("trip_id").distinct(), "trip_id", "left_anti").select("trip_id", (F.col("day") * 86_400).alias("shift"), "at", "times")
    if use_frequencies:
        often = t.join(f, "trip_id").withColumn("start", F.explode(F.expr("sequence(start_s, end_s, headway_s)")))
        plain = plain.unionByName(often.select("trip_id", (F.col("day") * 86_400 + F.col("start") - F.col("times")[0]["dep"]).alias("shift"), "at", "times"))
    x = plain.select("trip_id", "shift", F.size("times").alias("n"), F.posexplode(F.arrays_zip("at", "times")).alias("stop_index", "z"))
    arr, dep = F.col("z.times.arr") + F.col("shift"), F.col("z.times.dep") + F.col("shift")
    arr2 = F.when(F.col("stop_index") == 0, dep - 1).otherwise(arr)
    dep2 = F.when(F.col("stop_index") == F.col("n") - 1, arr + 1).otherwise(dep)
    return x.select(F.col("trip_id").alias("trip"), F.col("shift").alias("run"), F.col("stop_index").cast("long").alias("stop_index"), F.col("z.at").alias("stop_id"), arr2.alias("arr"), dep2.alias("dep"))


def trip_runs(feed: dict[str, DataFrame], first: str, last: str, use_days: bool = True, use_frequencies: bool = True) -> dict[str, DataFrame]:
    """``trip_events`` and their trips, stops and transfers with dense numbers; names stay in ``stops`` and ``trip_names``.

    ``stops``: stop_id, name, lon_e6, lat_e6, min_transfer_s (the largest
    transfer of a stop to itself). ``footpaths``: transfers between two stops,
    both ways, the least time of a pair.
    """
    e = settle(trip_events(feed, first, last, use_days, use_frequencies))
    used = e.select("stop_id").distinct()
    ids = settle(id_table(used, "stop_id").withColumnRenamed("stop_id", "gtfs_stop"))
    runs = settle(id_table(e.select(F.struct("trip", "run").alias("key")), "key"))
    names = feed["stops"].withColumnRenamed("stop_id", "gtfs_stop").join(ids, "gtfs_stop")
    hops = feed["transfers"]
    self_ = hops.where("src = dst").groupBy(F.col("src").alias("gtfs_stop")).agg(F.max("travel_s").cast("long").alias("m"))
    stops = names.join(self_, "gtfs_stop", "left").select(F.col("id").alias("stop_id"), "name", F.round(F.col("lon") * 1e6).cast("long").alias("lon_e6"), F.round(F.col("lat") * 1e6).cast("long").alias("lat_e6"), F.coalesce("m", F.lit(0).cast("long")).alias("min_transfer_s"), "gtfs_stop")
    a, b = ids.select(F.col("gtfs_stop").alias("src"), F.col("id").alias("s")), ids.select(F.col("gtfs_stop").alias("dst"), F.col("id").alias("d"))
    foot = hops.where("src <> dst").join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("travel_s").cast("long").alias("travel_s"))
    both = foot.unionByName(foot.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "travel_s"))
    events = e.join(ids.withColumnRenamed("gtfs_stop", "stop_id").withColumnRenamed("id", "no"), "stop_id").join(runs.select(F.col("id").alias("trip_id"), F.col("key.trip").alias("trip"), F.col("key.run").alias("run")), ["trip", "run"])
    return {
        "stops": settle(stops),
        "trip_names": runs.select(F.col("id").alias("trip_id"), F.col("key.trip").alias("trip"), F.col("key.run").alias("run")),
        "events": settle(events.select("trip_id", "stop_index", F.col("no").alias("stop_id"), "arr", "dep")),
        "footpaths": settle(both.groupBy("src", "dst").agg(F.min("travel_s").alias("travel_s"))),
    }


def network(feed: dict[str, DataFrame], first: str, last: str, use_days: bool = True, use_frequencies: bool = True, routes: str = "fifo") -> Timetable:
    """A feed as the relations that every operator works on, with routes by the named rule and one cell for all stops."""
    from ..operators import layout

    got = trip_runs(feed, first, last, use_days, use_frequencies)
    events = got["events"].withColumn("route_id", F.lit(0).cast("long"))
    ways = settle(layout.routes(events, routes))
    lines = ways.select("first_trip", "route_no").distinct()
    lines = numbered(lines.withColumn("key", F.struct("first_trip", "route_no")), "key").select("first_trip", "route_no", F.col("no").alias("route_id"))
    of = settle(ways.join(lines, ["first_trip", "route_no"]).select("trip_id", "route_id"))
    events = settle(events.drop("route_id").join(of, "trip_id").select("trip_id", "route_id", "stop_index", "stop_id", "arr", "dep"))
    trips = events.where("stop_index = 0").select("trip_id", "route_id", F.col("arr").alias("t0"))
    return Timetable(got["stops"].drop("gtfs_stop"), trips, events, got["footpaths"], got["stops"].select("stop_id", F.lit(0).cast("long").alias("cell_id")))


def to_parquet(spark: SparkSession, folder: str, out: str) -> None:
    """A feed's nine tables, typed and validated, as Parquet."""
    save(read(spark, folder), out)


def from_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return load(spark, folder, list(COLUMNS))
