"""Events per vehicle and hour as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 16) -> DataFrame:
    """A stream of the event files that match ``pattern`` in ``folder``, at most ``files`` a micro-batch.

    A match that is a folder is a table of part files, and those are streamed.
    """
    where = f"{folder}/{pattern}"
    stream = spark.readStream.schema(spark.read.parquet(where).schema).option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    if any(f.isDirectory() for f in found):
        return stream.parquet(where)
    return stream.option("pathGlobFilter", pattern).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``user_id, hour, n``; an hour's state goes once the watermark, ``late`` behind the newest event, has passed it.

    Works on streams and on tables. The stores hold one row per vehicle and
    open hour, and events are counted before the shuffle.
    """
    kind = dict(events.dtypes)["ts"]
    # event time must be an instant; local times are read in the session's zone and given back in it
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = w.withWatermark("ts", late) if events.isStreaming else w
    n = w.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").cast(kind).alias("hour"), "n")


def run_available(counts: DataFrame, folder: str, keys: list[str], value: str = "n", report: dict | None = None) -> DataFrame:
    """Run a stream of growing counts over what is there and return the last count of each key.

    ``report`` gets ``late``: the rows (counts of a micro-batch's events, where
    they were counted before) that the watermark dropped.

    Each micro-batch overwrites a folder of its own number, so a batch that is
    run again after a failure leaves no second copy.
    """
    spark = counts.sparkSession
    path = f"{folder}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if report is not None:
        report["late"] = sum(int(op["numRowsDroppedByWatermark"]) for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(counts.schema).parquet(f"{path}/out/batch=*").groupBy(*keys).agg(F.max(value).alias(value))
