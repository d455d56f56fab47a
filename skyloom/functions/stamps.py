"""Column builders for time stamps, names and text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

#: Microseconds from 0001-01-01 to 1970-01-01.
SER_EPOCH_US = 62135596800000000


def to_ser_ticks(t_us) -> Column:
    """Units of 100 ns since 0001-01-01, from microseconds since 1970."""
    return (c(t_us) + F.lit(SER_EPOCH_US)) * F.lit(10)


def from_ser_ticks(ticks) -> Column:
    return ((c(ticks) - c(ticks) % 10).cast("decimal(20,0)") / F.lit(10)).cast("long") - F.lit(SER_EPOCH_US)


def segment_stamp(ts) -> Column:
    return F.date_format(c(ts), "yyyyMMdd'T'HHmmssSSS'Z'")


def utc_stamp(ts) -> Column:
    return F.date_format(c(ts), "yyyyMMdd'T'HHmmss'Z'")


def utc_iso(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def offset_seconds(d, h, m, s) -> Column:
    return ((c(d) * 24 + c(h)) * 60 + c(m)) * 60 + c(s)


def parse_angle(text) -> Column:
    """Degrees from decimal or sexagesimal text (12 34 56, 12:34:56, 12d34m56s); null where it cannot be read."""
    t = F.trim(c(text))
    parts = r"^([+-]?)(\d+)[:d°h ]\s*(\d+)(?:[:m' ]\s*(\d+(?:\.\d+)?))?\s*[s\"]?$"
    number = lambda k: F.regexp_extract(t, parts, k).try_cast("double")
    size = number(2) + number(3) / 60 + F.coalesce(number(4), F.lit(0.0)) / 3600
    return F.coalesce(t.try_cast("double"), F.when(t.rlike(parts), F.when(F.regexp_extract(t, parts, 1) == "-", -size).otherwise(size)))


def target_url(source: str, *key) -> Column:
    """sky://source/key/..."""
    return F.concat_ws("/", F.lit(f"sky://{source}"), *[c(k).cast("string") for k in key])
