"""Incremental ingest: raw events are validated and appended to a Parquet log.

Metrics stay batch queries over the log, so late events need no rule and event ids
are not made unique. Every batch reports how many events it added and the last to
arrive. A batch that runs again overwrites its own folder only, so that the log has
each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import derive, ensure_tracker
from ..operators.validate import check, with_fields
from ..plans import ir
from ..plans.ir import ErrorCode


def event_columns(tracker: ir.Tracker) -> list[str]:
    return ["event_id", "tracker_id", "ts", *[f.name for f in tracker.fields]]


def write_batch(tracker: ir.Tracker, raw: DataFrame, batch: int, log: str) -> None:
    """Append one batch: its checked rows (a folder each for events and quarantine, written
    in one go, so that every text is parsed once), then its delta."""
    checked = with_fields(tracker, check(tracker, raw.withColumn("arrival", F.monotonically_increasing_id())))
    kind = F.when(F.col("error_code").isNull(), "events").otherwise("quarantine").alias("kind")
    path = f"{log}/rows/batch={batch}"
    own = [c if c == "event_id" or c == "ts" else F.when(F.col("error_code").isNull(), F.col(f"`{c}`")).alias(c) for c in event_columns(tracker)]
    checked.select("arrival", *own, F.when(F.col("error_code").isNotNull(), F.col("json")).alias("json"), "error_code", "message", kind).write.mode("overwrite").partitionBy("kind").parquet(path)
    good = raw.sparkSession.read.parquet(path).where("kind = 'events'")
    delta = good.agg(F.count(F.lit(1)).alias("total_events_delta"), F.max(F.struct("arrival", "ts", "event_id")).alias("last"))
    delta.select("total_events_delta", F.col("last.ts").alias("last_event_ms"), F.col("last.event_id").alias("last_event_id")).write.mode("overwrite").parquet(f"{log}/deltas/batch={batch}")


def ingest(tracker: ir.Tracker, source: DataFrame, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream of raw JSON (column ``json``) into the log."""
    writer = source.writeStream.foreachBatch(lambda df, n: write_batch(tracker, df, n, log)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, tracker: ir.Tracker, log: str) -> DataFrame:
    return spark.read.parquet(f"{log}/rows").where("kind = 'events'").select(*event_columns(tracker))


def read_quarantine(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(f"{log}/rows").where("kind = 'quarantine'").select("json", "error_code", "message")


def apply(tracker: ir.Tracker, state: DataFrame, event: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with one more event and its derived values, and the delta. Metrics are not
    part of a delta. A log or an event of another tracker is refused."""
    ensure_tracker(tracker, event)
    ensure_tracker(tracker, state, ErrorCode.STATE_MISMATCH)
    derived, _ = derive(tracker, event)
    delta = event.select(F.lit(1).cast("long").alias("total_events_delta"), F.col("ts").alias("last_event_ms"), F.col("event_id").alias("last_event_id"))
    return state.unionByName(derived, allowMissingColumns=True), delta
