"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a key filter, at most: 8 MB whatever the number of keys.
FILTER_WORDS = 1 << 20
#: Measured bytes up to which a table of keys goes to every task.
SMALL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that any of Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session whose only executor is the driver (tests)
    gets a temporary folder, and remembers it; a cluster gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tramline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive an executor, gives the planner a
    true size (so a broadcast is chosen by measured bytes), and lets both
    sides of a later join be plain exchanges, whose skewed partitions AQE
    splits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tramline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and that no later step reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``df`` whole as ``row`` beside ``columns``, so no name of theirs can clash with a user's."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def _word(keys: list[str], words: int) -> tuple[Column, Column]:
    h = F.xxhash64(*keys)
    return F.shiftright(h, 6).bitwiseAND(F.lit(words - 1)), h.bitwiseAND(F.lit(63)).cast("int")


def split_by(df: DataFrame, keys: list[str], held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``keys`` may be in ``held``, and rows whose keys surely are not.

    A filter of one bit per hash, sized by the measured number of keys and
    never beyond ``FILTER_WORDS``, goes to every task; so only the first part,
    a few rows more than those wanted, has to move in an exact join. With very
    many keys the filter lets more through and nothing is lost.
    """
    n = held.count()
    words = min(FILTER_WORDS, 1 << max(4, (n // 4).bit_length()))
    at, bit = _word(keys, words)
    bits = held.select(at.alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    dense = df.sparkSession.range(words).join(bits, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    one = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("_filter_words"))
    one = F.broadcast(materialize(one, "filter"))
    marked = F.call_function("shiftright", F.col("_filter_words")[at.cast("int")], bit).bitwiseAND(F.lit(1).cast("long"))
    return df.join(one, marked == 1).select(*df.columns), df.join(one, marked == 0).select(*df.columns)


def meet(df: DataFrame, keys: list[str], held: DataFrame, how: str, width: Column | None = None) -> DataFrame:
    """Join wide rows with a table of keys (inner, left or left_anti), moving as few of the wide rows as can be.

    ``held`` is written, its keys are unique, and ``width`` estimates a row's
    bytes. Up to ``SMALL_BYTES`` it is broadcast; beyond, only rows that pass
    the filter of ``split_by`` move.
    """
    size = held.agg(F.sum(F.lit(64) if width is None else width + 64).alias("n")).first()["n"] or 0
    if size <= SMALL_BYTES:
        return df.join(F.broadcast(held), keys, how)
    some, none = split_by(df, keys, held.select(*keys))
    found = some.join(held, keys, how)
    return found if how == "inner" else found.unionByName(none, allowMissingColumns=True)
