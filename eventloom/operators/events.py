"""Event frames: ``event_id, tracker_id, ts`` and a column for each payload field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import KINDS, Compiler
from ..plans import ir
from ..plans.ir import EngineError, ErrorCode


def field_kinds(tracker: ir.Tracker) -> dict[str, str]:
    return {f.name: KINDS[f.type.value] for f in tracker.fields}


def typed(tracker: ir.Tracker, df: DataFrame, event_id: str = "event_id", ts: str = "ts", raw: str | None = None, meta: str | None = None, window: ir.TimeWindow | None = None) -> DataFrame:
    """An event frame from a frame that has the payload's fields as columns; declared
    fields that it lacks are null. ``ts`` is a timestamp or epoch milliseconds.

    A stored timestamp stays beside its milliseconds, as ``event_time``, so that a
    window's condition reaches the scan. ``window``: keep its events alone; alerts and
    total counts want the frame without it.
    """
    kind = dict(df.dtypes)[ts]
    millis = F.col(ts).cast("long") if kind in ("bigint", "int") else F.unix_millis(F.col(ts).cast("timestamp"))
    own = {c.lower() for c in df.columns}
    fields = [(F.col(f"`{f.name}`") if f.name.lower() in own else F.lit(None)).cast(f.type.spark).alias(f.name) for f in tracker.fields if f.name not in ("event_id", "ts", "tracker_id")]
    more = [F.col(c) for c in (raw, meta) if c]
    if kind not in ("bigint", "int"):
        more.append(F.col(ts).alias(STORED))
    out = df.select(F.col(event_id).cast("string").alias("event_id"), F.lit(tracker.id).alias("tracker_id"), millis.alias("ts"), *fields, *more)
    return out.where(inside(window, out)) if window else out


#: A timestamp as it is stored, where the events have one.
STORED = "event_time"


def inside(window: ir.TimeWindow, events: DataFrame) -> Column:
    """Both ends belong to a window. (Milliseconds are floors, so a stored time's end is
    the whole millisecond.)"""
    kind = dict(events.dtypes).get(STORED)
    if kind is None:
        return F.col("ts").between(window.start, window.end)
    bound = lambda ms: F.timestamp_millis(F.lit(ms).cast("long")).cast(kind)
    return (F.col(STORED) >= bound(window.start)) & (F.col(STORED) < bound(window.end + 1))


def derive(tracker: ir.Tracker, events: DataFrame, strict: bool = False, raw: str | None = None, meta: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The frame with derived columns, in order of declaration, and all kinds.

    A derive shadows a payload field of its name. Those that read no other derive
    since the last projection share one.
    """
    kinds, pending = field_kinds(tracker), {}
    for d in tracker.derives:
        from ..plans.dsl import references

        if {p.removeprefix("payload.") for p in references(d.expr)} & pending.keys():
            events, pending = events.withColumns(pending), {}
        v = Compiler(kinds, "D", strict, raw, meta).value(d.expr)
        pending[d.name] = v.col
        kinds = {**kinds, d.name: v.kind}
    return (events.withColumns(pending) if pending else events), kinds


def assert_derivable(tracker: ir.Tracker, events: DataFrame, **columns: str) -> None:
    """Evaluate every derive of every event; raises where one cannot be."""
    df, _ = derive(tracker, events, strict=True, **columns)
    if tracker.derives:
        df.agg(*[F.count(f"`{d.name}`") for d in tracker.derives]).collect()


def ensure_tracker(tracker: ir.Tracker, events: DataFrame, code: ErrorCode = ErrorCode.TRACKER_MISMATCH) -> None:
    """Refuse a log with another tracker's events."""
    other = events.where(F.col("tracker_id") != tracker.id).select("tracker_id").limit(1).collect()
    if other:
        raise EngineError(f"{'state' if code is ErrorCode.STATE_MISMATCH else 'tracker'} mismatch: {other[0][0]}", code)


def derive_event(tracker: ir.Tracker, events: DataFrame, strict: bool = True, **columns: str | None) -> DataFrame:
    """Events of this tracker with their derived values."""
    ensure_tracker(tracker, events)
    return derive(tracker, events, strict, **columns)[0]
