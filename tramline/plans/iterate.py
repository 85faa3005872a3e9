"""Cutting lineage between the rounds of a fixpoint loop."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rounds after which a loop that should have ended is taken to be wrong.
BOUND = 10_000
#: Bytes that a row of a broadcast table takes in the driver beside 8 for each column: its key, its header and its places in the hash table.
ROW_BYTES = 40
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``.

    Where none is set, a session whose only executor is the driver (tests)
    gets a temporary one; a cluster gets an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tramline-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and forget how: Parquet files that outlive any executor.

    The planner sees their size. A checkpoint passes on the estimate of its
    plan instead, which knows nothing of exploded rows and multiplies at every
    join, so that large tables were broadcast through the driver. Files are
    smaller than their rows, see ``_unpacked``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tramline/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _unpacked(out)
    return out


def _unpacked(table: DataFrame) -> None:
    """Have the session's planner multiply file sizes so that a table of many rows is not broadcast for its small files.

    Labels are packed to a byte or two a row, so that files below the limit for
    broadcasts held some hundred megabytes in the driver. The factor is the
    largest that a table has needed; one that fits in the driver needs none.
    """
    conf = table.sparkSession._jsparkSession.sessionState().conf()
    limit = conf.autoBroadcastJoinThreshold()
    planned = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned > limit:
        return
    # the files' footers have the number of rows
    size = table.count() * (ROW_BYTES + 8 * len(table.columns))
    if size > limit:
        table.sparkSession.conf.set(_FACTOR, str(conf.fileCompressionFactor() * (size / max(1, planned))))


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` as a table in ``n`` buckets of ``keys``: a join on just these moves only the other side."""
    spark = df.sparkSession
    name = f"tramline_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{checkpoint_folder(spark)}/tramline/{name}").saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``settle`` wrote and that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rounds_of(most: int | None) -> Iterator[int]:
    """1, 2, ... up to ``most``; without ``most`` until the caller's fixpoint, and an error if none comes."""
    if most is not None:
        yield from range(1, most + 1)
        return
    yield from range(1, BOUND + 1)
    raise RuntimeError(f"no fixpoint after {BOUND} rounds")
