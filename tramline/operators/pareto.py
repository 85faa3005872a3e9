"""Skylines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def improving(rows: DataFrame, key: str = "query_id", first: str = "trips", second: str = "arr") -> DataFrame:
    """Rows whose ``second`` is less than that of every row of the key with a ``first`` no larger; one row of equals."""
    best = rows.groupBy(key, first).agg(F.min(second).alias(second))
    before = Window.partitionBy(key).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_least", F.min(second).over(before)).where(F.col("_least").isNull() | (F.col(second) < F.col("_least"))).drop("_least")


def skyline(rows: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """Rows of each key that no other row is at least as good as in all ``criteria``; equals count once.

    One criterion is a minimum, two are a sweep: in order of the first a row
    stays if the second is below all before it. With more, the least of the
    last criterion per value of the others is compared with the others pair by pair.
    """
    head, last = criteria[:-1], criteria[-1]
    rows = rows.groupBy(*keys, *head).agg(F.min(last).alias(last)).select(*keys, *criteria)
    if not head:
        return rows
    if len(head) == 1:
        before = Window.partitionBy(*keys).orderBy(head[0]).rowsBetween(Window.unboundedPreceding, -1)
        least = F.min(last).over(before)
        return rows.withColumn("_least", least).where(F.col("_least").isNull() | (F.col(last) < F.col("_least"))).drop("_least")
    other = rows.select(*[F.col(c).alias(f"_{c}") for c in keys + criteria])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    weak = [F.col(f"_{c}") <= F.col(c) for c in criteria]
    strict = reduce(lambda a, b: a | b, [F.col(f"_{c}") < F.col(c) for c in criteria])
    return rows.join(other, reduce(lambda a, b: a & b, same + weak) & strict, "left_anti")
