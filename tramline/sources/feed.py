"""A feed written from the star-schema test tables: the files that an agency would give, for the import to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timetable import customer_trips, project

DAYS = "sunday monday tuesday wednesday thursday friday saturday".split()


def _clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The files as tables of strings: a service from each nation, a trip from each customer, every 25th by frequency, stops from suppliers.

    Service n runs on the weekdays (Sunday 0) d for which bit d % 5 of n is 0, and on
    the n % 7-th day of January 2024 (from 0) if n is even, not on it if odd.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    t, e = project(spark, sf_dir), customer_trips(spark, sf_dir)
    n = read("nation").select(F.col("n_nationkey").cast("long").alias("n"))
    day = F.format_string("202401%02d", F.col("n") % 7 + 1)
    runs = [F.when(F.expr(f"shiftright(n, {d % 5}) & 1") == 0, "1").otherwise("0").alias(name) for d, name in enumerate(DAYS)]
    c = read("customer").select(F.col("c_custkey").cast("long").alias("trip_id"), F.col("c_nationkey").cast("string").alias("service_id"))
    often = c.where("trip_id % 25 = 0").select(F.col("trip_id").cast("string"), _clock(28_800 + F.col("trip_id") % 7 * 600).alias("start_time"), F.lit("10:00:00").alias("end_time"), F.lit("1200").alias("headway_secs"))
    lines = e.where("stop_index = 0").join(c, "trip_id")
    text = lambda c, name=None: F.col(c).cast("string").alias(name or c)
    return {
        "agency": read("region").select(text("r_regionkey", "agency_id"), F.col("r_name").alias("agency_name"), F.lit("UTC").alias("agency_timezone")),
        "calendar": n.select(text("n", "service_id"), *runs, F.lit("20240101").alias("start_date"), F.lit("20240107").alias("end_date")),
        "calendar_dates": n.select(text("n", "service_id"), day.alias("date"), (F.col("n") % 2 + 1).cast("string").alias("exception_type")),
        "frequencies": often,
        "routes": e.select(text("route_id")).distinct().select("route_id", F.lit("0").alias("agency_id"), F.col("route_id").alias("route_short_name"), F.lit("3").alias("route_type")),
        "stops": t.stops.select(text("stop_id"), F.col("name").alias("stop_name"), (F.col("lat_e6") / 1e6).cast("string").alias("stop_lat"), (F.col("lon_e6") / 1e6).cast("string").alias("stop_lon")),
        "stop_times": e.select(text("trip_id"), _clock(F.col("arr")).alias("arrival_time"), _clock(F.col("dep")).alias("departure_time"), text("stop_id"), (F.col("stop_index") * 2 + 1).cast("string").alias("stop_sequence")),
        "transfers": t.footpaths.select(text("src", "from_stop_id"), text("dst", "to_stop_id"), text("travel_s", "min_transfer_time"), F.lit("2").alias("transfer_type")),
        "trips": lines.select(text("route_id"), "service_id", text("trip_id")),
    }


def write(files: dict[str, DataFrame], folder: str) -> None:
    """Each table as a CSV file with a header (a folder of part files) that ``gtfs.read`` reads."""
    for name, df in files.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}.txt", header=True)


#: What the import of ``tables`` must give, behind the tables of ``sql``: days of services and events of the first day.
FEED = """, fa AS (SELECT CAST(n_nationkey AS BIGINT) AS n, i FROM nation, range(0, 7) t(i) WHERE (CAST(n_nationkey AS BIGINT) >> CAST((1 + i) % 7 % 5 AS INTEGER)) & 1 = 0 AND NOT (n_nationkey % 2 = 1 AND i = n_nationkey % 7)
        UNION SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) % 7 FROM nation WHERE n_nationkey % 2 = 0),
    fd AS (SELECT n, i, i - min(i) OVER () AS day FROM fa),
    fr AS (SELECT CAST(c_custkey AS BIGINT) AS trip_id, CAST(c_nationkey AS BIGINT) AS n, unnest(range(28800 + CAST(c_custkey AS BIGINT) % 7 * 600, 36001, 1200)) AS start FROM customer WHERE c_custkey % 25 = 0),
    fs AS (SELECT trip_id * 1000 + start // 60 AS trip_id, trip_id AS trip, n, start FROM fr UNION ALL SELECT CAST(c_custkey AS BIGINT) * 1000, CAST(c_custkey AS BIGINT), CAST(c_nationkey AS BIGINT), NULL FROM customer WHERE c_custkey % 25 <> 0),
    fe AS MATERIALIZED (SELECT fs.trip_id, route_id, stop_index, stop_id, arr + coalesce(start - first, 0) AS arr, dep + coalesce(start - first, 0) AS dep
        FROM fs JOIN ce ON ce.trip_id = fs.trip JOIN (SELECT trip_id, min(dep) AS first FROM ce GROUP BY 1) f ON f.trip_id = fs.trip WHERE n IN (SELECT n FROM fa WHERE i = 0))"""
