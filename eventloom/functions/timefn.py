"""Time labels of grains (UTC) and buckets in local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ir import Grain

DAY = 86_400_000
#: Years 0001 to 9999; a time beyond them has the epoch's labels.
EARLIEST, LATEST = -62_135_596_800_000, 253_402_300_799_999


def instant(ts: Column) -> Column:
    """The timestamp of epoch milliseconds, the epoch where it is out of range."""
    return F.timestamp_millis(F.when(ts.between(EARLIEST, LATEST), ts).otherwise(F.lit(0)).cast("long"))


def label(ts: Column, grain: Grain) -> Column:
    """The group label of a grain. A week has its calendar year, not its ISO year."""
    t = instant(ts)
    year = F.year(t).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return {
        Grain.DAY: lambda: F.date_format(t, "yyyy-MM-dd"),
        Grain.CUSTOM: lambda: F.date_format(t, "yyyy-MM-dd"),
        Grain.WEEK: lambda: F.concat(year, F.lit("-W"), two(F.weekofyear(t))),
        Grain.MONTH: lambda: F.concat(year, F.lit("-"), two(F.month(t))),
        Grain.QUARTER: lambda: F.concat(year, F.lit("-Q"), F.quarter(t).cast("string")),
        Grain.YEAR: lambda: year,
        Grain.ALL_TIME: lambda: F.lit("all_time"),
    }[grain]()


def _shifted(ts: Column, offset_minutes: int) -> Column:
    """Local time; overflow keeps to the ends of the range."""
    off = offset_minutes * 60_000
    end = F.lit((1 << 63) - 1 if off > 0 else -(1 << 63)).cast("long")
    return F.coalesce(F.try_add(ts, F.lit(off).cast("long")), end)


def day_bucket(ts: Column, offset_minutes: int = 0) -> Column:
    """The local day's begin in UTC milliseconds; division truncates before 1970."""
    local = _shifted(ts, offset_minutes)
    return F.try_subtract(local - local % F.lit(DAY), F.lit(offset_minutes * 60_000).cast("long"))


def week_bucket(ts: Column, offset_minutes: int = 0) -> Column:
    """The local Monday's begin; days since it keep the sign of their remainder."""
    off = F.lit(offset_minutes * 60_000).cast("long")
    local = day_bucket(ts, offset_minutes) + off
    days = (local - local % F.lit(DAY)) / F.lit(DAY)
    # The epoch was a Thursday.
    since_monday = ((days.cast("long") + F.lit(3)) % F.lit(7)).cast("long")
    return local - since_monday * F.lit(DAY) - off


def month_bucket(ts: Column, offset_minutes: int = 0) -> Column:
    """The local month's first day; the day bucket where the time is out of range."""
    off = F.lit(offset_minutes * 60_000).cast("long")
    local = _shifted(ts, offset_minutes)
    inside = local.between(EARLIEST, LATEST)
    first = F.unix_millis(F.date_trunc("month", F.timestamp_millis(F.when(inside, local).otherwise(F.lit(0)).cast("long"))))
    return F.when(inside, first - off).otherwise(day_bucket(ts, offset_minutes))


def bucket(ts: Column, granularity: str, offset_minutes: int = 0) -> Column:
    return {"day": day_bucket, "week": week_bucket, "month": month_bucket}[granularity](ts, offset_minutes)
