"""Scalar functions on strings and numbers, inside generated code but for the longest common part."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_number(text: Column) -> Column:
    """A sign, digits, and a fraction at most."""
    return F.coalesce(F.trim(text).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.lit(False))


def is_color(text: Column) -> Column:
    """Six hexadecimal digits, with or without a hash sign."""
    return F.coalesce(F.trim(text).rlike(r"^#?[0-9A-Fa-f]{6}$"), F.lit(False))


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` stands in a text, from left to right without overlap."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return (gone / len(part)).cast("int")


def last_index(text: Column, part: str) -> Column:
    """Place of the last ``part``, from 0 on; -1 without one."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - len(part) + 1)


def grouped(number: Column) -> Column:
    """A whole number with a comma after every three digits."""
    return F.format_number(number, 0)


def percent(part: Column, whole: Column) -> Column:
    """``12.34%``; of nothing it is ``0.00%``."""
    share = F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)
    return F.concat(F.format_string("%.2f", share), F.lit("%"))


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit of which there is one at least, to one decimal; halves go to the even one, as in C."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        whole, rest = F.call_function("div", n, F.lit(1 << (10 * i))), (n % (1 << (10 * i))) * 10
        tenths, over = whole * 10 + F.shiftright(rest, 10 * i), rest % (1 << (10 * i)) * 2 - (1 << (10 * i))
        tenths = tenths + F.when((over > 0) | ((over == 0) & (tenths % 2 == 1)), 1).otherwise(0)
        out = F.when(n >= 1 << (10 * i), F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest part that stands in both texts, the first in ``a``; null if either is."""

    def one(x: str | None, y: str | None) -> str | None:
        if x is None or y is None:
            return None
        best, end, row = 0, 0, [0] * (len(y) + 1)
        for i, c in enumerate(x, 1):
            new = [0] * (len(y) + 1)
            for j, d in enumerate(y, 1):
                if c == d:
                    new[j] = row[j - 1] + 1
                    if new[j] > best:
                        best, end = new[j], i
            row = new
        return x[end - best : end]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def two_smallest(values: Column) -> Column:
    """The two least elements of an array in order; fewer if it has fewer."""
    return F.slice(F.array_sort(values), 1, 2)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def percentile_of(values: Column, share: float) -> Column:
    """The element below which ``share`` of an array's elements lie at least: the nearest rank."""
    ordered = F.array_sort(values)
    at = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(share)).cast("int"))
    return F.when(F.size(values) > 0, F.element_at(ordered, at))


def packed_time(seconds: Column, trips: Column, bits: int = 8) -> Column:
    """A time and a number of trips in one number that orders by time, then trips."""
    return F.shiftleft(seconds.cast("long"), bits).bitwiseOR(trips.cast("long"))


def unpacked_time(packed: Column, bits: int = 8) -> tuple[Column, Column]:
    return F.shiftright(packed, bits), packed.bitwiseAND(F.lit((1 << bits) - 1))


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (lon min, lon max, lat min, lat max) share a point."""
    return (a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3])


def box_holds(box: tuple[Column, ...], x: Column, y: Column) -> Column:
    return x.between(box[0], box[1]) & y.between(box[2], box[3])


def line_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment in the plane, in the units of the coordinates."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(((x - x1) * dx + (y - y1) * dy) / square)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def planar_distance_cm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """An approximation of the great-circle distance for nearby points: degrees of longitude shortened by the mean latitude."""
    k = 637_813_700 * 3.141592653589793 / 180
    dx, dy = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * k, (lat2 - lat1) * k
    return F.sqrt(dx * dx + dy * dy)
