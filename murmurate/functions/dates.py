"""Times, watermarks and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def watermark_epoch(c: Column) -> Column:
    """Seconds of a watermark kept as text: an epoch, an ISO time, one with a blank or a short zone; junk is null."""
    s = F.trim(c)
    iso = F.regexp_replace(F.regexp_replace(s, "^(\\S+) ", "$1T"), r"([+-]\d{2})$", "$1:00")
    return F.coalesce(s.try_cast("double"), F.unix_micros(iso.try_cast("timestamp")) / 1e6)


def duration_seconds(c: Column) -> Column:
    """Seconds of literals such as 30m, 6h, 900s, 2d."""
    n, unit = F.regexp_extract(c, r"^\s*(\d+)\s*([smhd])\s*$", 1), F.regexp_extract(c, r"^\s*(\d+)\s*([smhd])\s*$", 2)
    return n.try_cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def window_label(start: Column, end: Column) -> Column:
    """"Jan–Jun 2026", or both years where they differ."""
    same = F.year(start) == F.year(end)
    return F.when(same, F.concat(F.date_format(start, "MMM"), F.lit("–"), F.date_format(end, "MMM yyyy"))).otherwise(F.concat(F.date_format(start, "MMM yyyy"), F.lit("–"), F.date_format(end, "MMM yyyy")))
