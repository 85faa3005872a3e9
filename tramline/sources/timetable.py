"""The timetable tables, and their deterministic projection from the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOPS_PER_TRIP = 8


@dataclass(frozen=True)
class Timetable:
    """The relations every operator works on.

    ``stops``: stop_id, name, lon_e6, lat_e6, min_transfer_s. ``trips``:
    trip_id, route_id, t0. ``stop_events``: trip_id, route_id, stop_index,
    stop_id, arr, dep (seconds). ``footpaths``: src, dst, travel_s.
    ``cells``: stop_id, cell_id.
    """

    stops: DataFrame
    trips: DataFrame
    stop_events: DataFrame
    footpaths: DataFrame
    cells: DataFrame


def _visits(trips: DataFrame) -> DataFrame:
    """``trips`` once for each ``stop_index``. A join, as the planner takes exploded rows to be no larger than what they came from, and broadcasts them."""
    return trips.crossJoin(F.broadcast(trips.sparkSession.range(STOPS_PER_TRIP).withColumnRenamed("id", "stop_index")))


def project(spark: SparkSession, sf_dir: str) -> Timetable:
    """Stops from suppliers, trips from orders; integer arithmetic only."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s"), "s_name")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("o"), F.col("o_custkey").cast("long").alias("c"))
    ns = supplier.count()
    p = max(4, ns * 2 // 5)
    stops = supplier.select(
        F.col("s").alias("stop_id"),
        F.col("s_name").alias("name"),
        (8_000_000 + (F.col("s") * 7919 % 1000) * 300).alias("lon_e6"),
        (49_000_000 + (F.col("s") * 6101 % 1000) * 300).alias("lat_e6"),
        F.lit(0).cast("long").alias("min_transfer_s"),
    )
    base = orders.select(F.col("o").alias("trip_id"), (F.col("c") % p).alias("pat"), (F.col("o") % 3).alias("slow"), (F.col("o") * 97 % 86_400).alias("t0"))
    trips = base.select("trip_id", (F.col("pat") * 3 + F.col("slow")).alias("route_id"), "t0", "pat", "slow")
    events = _visits(trips)
    arr = F.col("t0") + F.col("stop_index") * (240 + 60 * F.col("slow"))
    events = events.select(
        "trip_id",
        "route_id",
        "stop_index",
        ((F.col("pat") * 7 + F.col("stop_index") * (1 + F.col("pat") % 5) * 3) % ns).alias("stop_id"),
        arr.alias("arr"),
        (arr + 30).alias("dep"),
    )
    groups = supplier.select("s", F.expr("s div 3").alias("g"))
    other = groups.select(F.col("s").alias("d"), "g")
    foot = groups.join(other, "g").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst"), (120 * F.abs(F.col("s") - F.col("d"))).alias("travel_s"))
    cells = supplier.select(F.col("s").alias("stop_id"), F.expr(f"(s div 3) * 16 div ({ns + 2} div 3)").alias("cell_id"))
    return Timetable(stops, trips.select("trip_id", "route_id", "t0"), events, foot, cells)


#: Stops of one district: streets lead from each to the next, and none out of it.
DISTRICT = 8


def walking_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, travel_s``: streets between the stops of each district, both ways. Not closed: a crossing lies between each stop and the next, so walks have many edges."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s"))
    ns = supplier.count()
    to = supplier.where(f"s % {DISTRICT} < {DISTRICT - 1} AND s + 1 < {ns}").select("s", (F.col("s") + ns).alias("x"), (F.col("s") + 1).alias("n"), (60 + F.col("s") * 37 % 5 * 30).alias("a"), (60 + F.col("s") * 53 % 7 * 20).alias("b"))
    street = to.select(F.col("s").alias("src"), F.col("x").alias("dst"), F.col("a").alias("travel_s")).unionByName(to.select(F.col("x").alias("src"), F.col("n").alias("dst"), F.col("b").alias("travel_s")))
    return street.unionByName(street.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "travel_s"))


def customer_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop events like those of ``project``, a trip from each customer: the same stops and lines with a tenth of the trips."""
    ns = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    p = max(4, ns * 2 // 5)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("trip_id"), F.col("c_nationkey").cast("long").alias("n"))
    trips = c.select("trip_id", ((F.col("trip_id") * 31 + F.col("n")) % p).alias("pat"), (F.col("trip_id") % 3).alias("slow"), (F.col("trip_id") * 577 % 86_400).alias("t0"))
    e = _visits(trips)
    arr = F.col("t0") + F.col("stop_index") * (240 + 60 * F.col("slow"))
    stop = (F.col("pat") * 7 + F.col("stop_index") * (1 + F.col("pat") % 5) * 3) % ns
    return e.select("trip_id", (F.col("pat") * 3 + F.col("slow")).alias("route_id"), "stop_index", stop.alias("stop_id"), arr.alias("arr"), (arr + 30).alias("dep"))


def supplier_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop events like those of ``project`` of a thin service, four runs a day from each supplier: where one waits long, walks matter."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s"), F.col("s_nationkey").cast("long").alias("n"))
    ns = s.count()
    p = max(4, ns * 2 // 5)
    trips = s.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    trips = trips.select((F.col("s") * 4 + F.col("run")).alias("trip_id"), (F.col("s") * 31 + F.col("n")).alias("k"), (F.col("s") * 577 % 21_600 + F.col("run") * 21_600).alias("t0"))
    trips = trips.select("trip_id", (F.col("k") % p).alias("pat"), (F.col("k") % 3).alias("slow"), "t0")
    e = _visits(trips)
    arr = F.col("t0") + F.col("stop_index") * (240 + 60 * F.col("slow"))
    stop = (F.col("pat") * 7 + F.col("stop_index") * (1 + F.col("pat") % 5) * 3) % ns
    return e.select("trip_id", (F.col("pat") * 3 + F.col("slow")).alias("route_id"), "stop_index", stop.alias("stop_id"), arr.alias("arr"), (arr + 30).alias("dep"))


#: The events of ``customer_trips`` and ``supplier_trips`` and the shortest walks over ``walking_graph`` between all stops, behind the tables of ``sql``.
WALKERS = f""", ct AS (SELECT CAST(c_custkey AS BIGINT) AS trip_id, (CAST(c_custkey AS BIGINT) * 31 + CAST(c_nationkey AS BIGINT)) % p AS pat, CAST(c_custkey AS BIGINT) % 3 AS slow, CAST(c_custkey AS BIGINT) * 577 % 86400 AS t0 FROM customer, ns),
    ce AS MATERIALIZED (SELECT trip_id, pat * 3 + slow AS route_id, i AS stop_index, (pat * 7 + i * (1 + pat % 5) * 3) % ns AS stop_id, t0 + i * (240 + 60 * slow) AS arr, t0 + i * (240 + 60 * slow) + 30 AS dep FROM ct, ns, range(0, {STOPS_PER_TRIP}) t(i)),
    st AS (SELECT CAST(s_suppkey AS BIGINT) * 4 + run AS trip_id, CAST(s_suppkey AS BIGINT) * 31 + CAST(s_nationkey AS BIGINT) AS k, CAST(s_suppkey AS BIGINT) * 577 % 21600 + run * 21600 AS t0 FROM supplier, range(0, 4) r(run)),
    se AS MATERIALIZED (SELECT trip_id, k % p * 3 + k % 3 AS route_id, i AS stop_index, (k % p * 7 + i * (1 + k % p % 5) * 3) % ns AS stop_id, t0 + i * (240 + 60 * (k % 3)) AS arr, t0 + i * (240 + 60 * (k % 3)) + 30 AS dep FROM st, ns, range(0, {STOPS_PER_TRIP}) t(i)),
    streets AS (SELECT stop_id, sum(120 + stop_id * 37 % 5 * 30 + stop_id * 53 % 7 * 20) OVER (ORDER BY stop_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM stops),
    walks AS MATERIALIZED (SELECT a.stop_id AS src, b.stop_id AS dst, CAST(abs(coalesce(a.at, 0) - coalesce(b.at, 0)) AS BIGINT) AS travel_s FROM streets a JOIN streets b ON a.stop_id <> b.stop_id AND a.stop_id // {DISTRICT} = b.stop_id // {DISTRICT})"""


def query_table(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """``query_id, source, target, dep_s``: n deterministic queries."""
    ns = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    q = F.col("id")
    return spark.range(n).select(q.alias("query_id"), (q * 37 % ns).alias("source"), ((q * 53 + 11) % ns).alias("target"), (q * 7919 % 86_400).alias("dep_s"))


def sql(n_queries: int) -> str:
    """The same relations as common table expressions for the SQL twins."""
    return f"""
    ns AS (SELECT count(*) AS ns, greatest(4, count(*) * 2 // 5) AS p FROM supplier),
    stops AS (SELECT CAST(s_suppkey AS BIGINT) AS stop_id, s_name AS name, 8000000 + (CAST(s_suppkey AS BIGINT) * 7919 % 1000) * 300 AS lon_e6,
              49000000 + (CAST(s_suppkey AS BIGINT) * 6101 % 1000) * 300 AS lat_e6, CAST(0 AS BIGINT) AS min_transfer_s FROM supplier),
    trips AS (SELECT CAST(o_orderkey AS BIGINT) AS trip_id, CAST(o_custkey AS BIGINT) % p AS pat, CAST(o_orderkey AS BIGINT) % 3 AS slow,
              (CAST(o_custkey AS BIGINT) % p) * 3 + CAST(o_orderkey AS BIGINT) % 3 AS route_id, CAST(o_orderkey AS BIGINT) * 97 % 86400 AS t0 FROM orders, ns),
    stop_events AS MATERIALIZED (SELECT trip_id, route_id, i AS stop_index, (pat * 7 + i * (1 + pat % 5) * 3) % ns AS stop_id,
                    t0 + i * (240 + 60 * slow) AS arr, t0 + i * (240 + 60 * slow) + 30 AS dep FROM trips, ns, range(0, {STOPS_PER_TRIP}) t(i)),
    footpaths AS (SELECT a.stop_id AS src, b.stop_id AS dst, 120 * abs(a.stop_id - b.stop_id) AS travel_s
                  FROM stops a JOIN stops b ON a.stop_id // 3 = b.stop_id // 3 AND a.stop_id <> b.stop_id),
    cells AS (SELECT stop_id, (stop_id // 3) * 16 // ((ns + 2) // 3) AS cell_id FROM stops, ns),
    queries AS (SELECT q AS query_id, q * 37 % ns AS source, (q * 53 + 11) % ns AS target, q * 7919 % 86400 AS dep_s FROM range(0, {n_queries}) t(q), ns)
    """
