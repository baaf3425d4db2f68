"""Time columns: epoch microseconds, grid floors and ceilings, ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BUCKET_US


def to_us(column: str | Column) -> Column:
    """Microseconds of a timestamp without zone, or of a zoned one under a UTC session."""
    ts = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def from_us(column: str | Column) -> Column:
    """Naive UTC timestamp of microseconds."""
    us = F.col(column) if isinstance(column, str) else column
    return F.timestamp_add("MICROSECOND", us, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def bucket_floor(us: Column, grid_us: int | Column = BUCKET_US) -> Column:
    grid = F.lit(grid_us) if isinstance(grid_us, int) else grid_us
    return us - F.pmod(us, grid)


def bucket_ceil(us: Column, grid_us: int | Column = BUCKET_US) -> Column:
    grid = F.lit(grid_us) if isinstance(grid_us, int) else grid_us
    return us + F.pmod(-us, grid)


def seconds_us(seconds: Column) -> Column:
    """Seconds as whole microseconds, ties to even."""
    return F.rint(seconds * 1e6).cast("long")


def span_s(start_us: Column, end_us: Column) -> Column:
    return (end_us - start_us) / F.lit(1e6)


def iso_utc(us: Column) -> Column:
    """'2020-05-06T00:00:00Z'; fractions of a second are kept if there are any."""
    ts = from_us(us)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(F.lit("")), F.lit("Z"))


def parse_iso(text: Column, naive_is_utc: bool = False) -> Column:
    """Microseconds of ISO-8601 text with an offset or Z. Naive text raises, unless naive_is_utc."""
    zone = F.regexp_extract(text, r"([Zz]|[+-]\d\d:?\d\d)$", 1)
    local = to_us(F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(text, r"([Zz]|[+-]\d\d:?\d\d)$", ""), "T", " ")))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(F.regexp_replace(zone, ":", ""), 4, 2).try_cast("int")
    shift = F.when(zone.isin("Z", "z"), F.lit(0)).when(F.length(zone) > 0, sign * minutes)
    bad = F.lit(0) if naive_is_utc else F.raise_error(F.concat(F.lit("timestamp without a zone: "), text)).cast("int")
    return local - F.coalesce(shift, bad).cast("long") * 60_000_000
