"""Scalar functions on columns: times, days, geography, bits. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
EARTH_RADIUS_CM = 637_813_700


def parse_seconds(text: Column) -> Column:
    """``HH:MM:SS`` to seconds; hours may exceed 24. Anything else is null."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"^(\d{1,3}):(\d{2}):(\d{2})$", i)
    return F.when(part(1) != "", part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int"))


def format_seconds(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS``; hours may exceed 24, a leading minus marks times before the first day."""
    s = F.abs(seconds)
    body = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), body)


def parse_day(text: Column) -> Column:
    """``YYYYMMDD`` to a date; anything else is null."""
    return F.try_to_date(F.trim(text), "yyyyMMdd")


def weekday(day: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(day) - 1


def distance_cm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by the spherical law of cosines, in centimetres."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * EARTH_RADIUS_CM


def in_box(lon: Column, lat: Column, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> Column:
    return lon.between(lon_min, lon_max) & lat.between(lat_min, lat_max)


def bit_width(x: Column) -> Column:
    """Number of bits up to the highest set one; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def lowest_common_level(cell: Column, source_cell: Column, target_cell: Column) -> Column:
    """Level from which on transfers at ``cell`` matter to a query between two cells."""
    return F.least(bit_width(cell.bitwiseXOR(source_cell)), bit_width(cell.bitwiseXOR(target_cell)))


def transfer_bucket(seconds: Column) -> Column:
    """Walking time in classes 0..4 with limits 0, 600, 1200, 2400 seconds."""
    return F.when(seconds <= 0, 0).when(seconds <= 600, 1).when(seconds <= 1200, 2).when(seconds <= 2400, 3).otherwise(4)
