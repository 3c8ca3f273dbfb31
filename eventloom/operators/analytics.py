"""Distribution, heatmap and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import DAY, day_bucket


def distribution(items: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Shares of the total in percent (floats), by falling value and then label."""
    total = items.agg(F.sum(F.col(value).cast("double"))).scalar()
    share = F.when(total > 0, F.col(value) / total * 100).otherwise(F.lit(0.0)).cast("float")
    return items.select(F.col(label).alias("label"), F.col(value).cast("float").alias("value"), share.alias("percentage")).orderBy(F.desc("value"), "label")


def heatmap_buckets(days: DataFrame, offset_minutes: int = 0, ts: str = "ts") -> DataFrame:
    """Counts by ready-made day buckets, with levels 1 to 4 by the share of the most."""
    n = days.groupBy(F.col(ts).alias("timestamp")).agg(F.count(F.lit(1)).alias("count"))
    # The days are few, and counted before they meet.
    ratio = F.col("count") / F.max("count").over(Window.partitionBy(F.lit(0)))
    level = F.when(ratio <= 0.25, 1).when(ratio <= 0.5, 2).when(ratio <= 0.75, 3).otherwise(4)
    date = F.date_format(F.timestamp_millis((F.col("timestamp") + F.lit(offset_minutes * 60_000)).cast("long")), "yyyy-MM-dd")
    return n.select("timestamp", date.alias("date"), "count", level.alias("level")).orderBy("timestamp")


def heatmap(events: DataFrame, offset_minutes: int = 0, ts: str = "ts") -> DataFrame:
    """Counts by local day."""
    return heatmap_buckets(events.select(day_bucket(F.col(ts), offset_minutes).alias("ts")), offset_minutes)


def streaks(events: DataFrame, now_ms: int, offset_minutes: int = 0, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of days with events: the current and the longest (the latest of equals).

    ``by``: columns whose groups have streaks of their own. Days are distinct before
    any window is taken over them. The current run is alive until two days after its
    last day, and no events give zeros and nulls (one row without ``by``).
    """
    keys = list(by)
    days = events.select(*keys, day_bucket(F.col(ts), offset_minutes).alias("day")).distinct()
    w = Window.partitionBy(*keys).orderBy("day") if keys else Window.partitionBy(F.lit(0)).orderBy("day")
    fresh = F.when(F.col("day") - F.lag("day").over(w) == DAY, 0).otherwise(1)
    islands = days.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    runs = islands.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("length"), F.min("day").alias("first"), F.max("day").alias("last"))
    best = F.max(F.struct("length", "last", "first")).alias("best")
    end = F.max(F.struct("last", "length")).alias("end")
    found = runs.groupBy(*keys).agg(best, end, F.sum("length").alias("total_days"))
    today = day_bucket(F.lit(now_ms).cast("long"), offset_minutes)
    alive = today - F.col("end.last") < 2 * DAY
    return found.select(
        *keys,
        F.when(alive, F.col("end.length")).otherwise(F.lit(0)).cast("long").alias("current_streak"),
        F.coalesce("best.length", F.lit(0)).cast("long").alias("longest_streak"),
        F.coalesce("total_days", F.lit(0)).cast("long").alias("total_days"),
        F.col("end.last").alias("last_day"),
        F.col("best.first").alias("longest_start"),
        F.col("best.last").alias("longest_end"),
    )
