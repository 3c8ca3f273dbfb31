"""Metrics, alerts and simulations over event frames.

All metrics are aggregated together, in one scan and one shuffle of partial results,
whatever their groupings: an event stands once under its key of each grouping. Results
are long: ``metric, group_key, value``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Compiler, Value, any_number, key_text, truthy
from ..functions.timefn import label
from ..functions.values import render_key, round2
from ..plans import ir
from ..plans.ir import EngineError, ErrorCode, Grain, MetricFilter, Query, TimeWindow
from .events import derive, ensure_tracker, inside

RESERVED = "window_event_count"
#: The place of an event in its log, where the source has one.
ARRIVAL = "arrival"


def target(metric: ir.Metric, compiler: Compiler) -> Value | None:
    """What is aggregated; a count ignores its target."""
    if metric.func == "count":
        return None
    if metric.target is None:
        raise EngineError(f"{metric.func} needs a target: {metric.name}", ErrorCode.METRIC_EVALUATION_FAILED)
    return compiler.value(metric.target)


def operand(metric: ir.Metric, compiler: Compiler) -> Column | None:
    """What is aggregated, as numbers; null where there is none to aggregate, none at all for a count."""
    v = target(metric, compiler)
    if v is None:
        return None
    if v.kind == "any":
        return any_number(v.col, bools=True)
    return v.col.cast("double") if v.kind in ("num", "bool") else F.lit(None).cast("double")


def aggregated(func: str, x: Column | None, when: Column | None = None) -> Column:
    """The aggregate of an operand; ``when`` restricts it to some rows."""
    if x is None:
        return F.count(F.lit(1) if when is None else F.when(when, F.lit(1)))
    x = x if when is None else F.when(when, x)
    if func == "sum":
        return round2(F.coalesce(F.sum(x), F.lit(0.0)))
    return round2({"avg": F.avg, "min": F.min, "max": F.max}[func](x))


def aggregate(metric: ir.Metric, compiler: Compiler, when: Column | None = None) -> Column:
    return aggregated(metric.func, operand(metric, compiler), when)


def dimension(name: str, compiler: Compiler) -> Column:
    """A group key's part: a time grain or a field."""
    if name in {g.value for g in Grain} and name not in compiler.kinds:
        return label(F.col("ts"), Grain(name))
    return key_text(compiler.ref(name))


def grouping(metric: ir.Metric, override: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """Dimensions: the override (none at all if it is empty), else the fields of
    ``by``, else the grain of ``over`` unless that is all of time."""
    if override is not None:
        return tuple(override)
    if metric.group_by:
        return metric.group_by
    return (metric.over.value,) if metric.over and metric.over is not Grain.ALL_TIME else ()


def group_key(dims: tuple[str, ...], compiler: Compiler) -> Column:
    return F.concat_ws("|", *[dimension(d, compiler) for d in dims])


def metric_filter(f: MetricFilter, compiler: Compiler) -> Column:
    ops = {"eq": "==", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    if f.op not in ops:
        raise EngineError(f"unsupported filter operator: {f.op}", ErrorCode.EXPRESSION_ERROR)
    if f.value is None or isinstance(f.value, (list, dict)):
        raise EngineError(f"unsupported filter value: {f.value!r}", ErrorCode.EXPRESSION_ERROR)
    return compiler.condition(ir.Compare(ops[f.op], ir.Ref(f.field), ir.Lit(f.value)))


@dataclass(frozen=True)
class Options:
    """``strict`` raises where an operand can't be calculated with; ``raw`` and
    ``meta`` name VARIANT columns for paths that are not declared."""

    strict: bool = False
    raw: str | None = None
    meta: str | None = None

    def columns(self) -> dict[str, str | None]:
        return {"raw": self.raw, "meta": self.meta}


def prepared(tracker: ir.Tracker, events: DataFrame, options: Options) -> tuple[DataFrame, Compiler]:
    df, kinds = derive(tracker, events, options.strict, **options.columns())
    return df, Compiler(kinds, "M", options.strict, **options.columns())


def metric_by_name(tracker: ir.Tracker, events: DataFrame, name: str, group_by: tuple[str, ...] | None = None, window: TimeWindow | None = None, filters: tuple[MetricFilter, ...] = (), options: Options = Options()) -> DataFrame:
    """One metric, as ``group_key, value`` (null and one row if it has no groups)."""
    metric = tracker.metric(name)
    df, c = prepared(tracker, events, options)
    for cond in ([inside(window, df)] if window else []) + [metric_filter(f, c) for f in filters]:
        df = df.where(cond)
    dims = grouping(metric, group_by)
    if not dims:
        return df.agg(aggregate(metric, c).alias("value")).select(F.lit(None).cast("string").alias("group_key"), "value")
    return df.groupBy(group_key(dims, c).alias("group_key")).agg(aggregate(metric, c).alias("value"))


def all_groups(df: DataFrame, metrics: list[ir.Metric], c: Compiler, more: dict[str, Column | None]) -> DataFrame:
    """``metric, group_key`` and the aggregate of every metric over the rows of each of
    ``more``'s conditions, as columns of its names; ``present`` is whether the first one
    has any row in the group. Groups are there if any row is; without groups there is a row in any case."""
    by: dict[tuple[str, ...], list[ir.Metric]] = {}
    for m in metrics:
        by.setdefault(grouping(m), []).append(m)
    sets = list(by)
    inputs = {m.name: operand(m, c) for m in metrics}
    names = {m.name: f"x{i}" for i, m in enumerate(metrics) if inputs[m.name] is not None}
    flags = {f"f{i}": cond for i, cond in enumerate(more.values()) if cond is not None}
    columns = {**{names[k]: inputs[k] for k in names}, **flags}
    # Metrics of one function and different groupings share an aggregate, whose operand depends on the grouping.
    slots: dict[tuple[str, int], dict[int, str]] = {}
    slot_of: dict[str, tuple[str, int]] = {}
    for i, dims in enumerate(sets):
        taken: dict[str, int] = {}
        for m in by[dims]:
            k = taken.get(m.func, 0) if m.name in names else 0
            taken[m.func], slot_of[m.name] = k + 1, (m.func, k)
            slots.setdefault((m.func, k), {})[i] = names.get(m.name, "")
    # Each row under its key of every grouping; one that has no groups has a row that counts for nothing, too.
    places = [F.struct(F.lit(i).alias("set"), (group_key(dims, c) if dims else F.lit(None).cast("string")).alias("key")) for i, dims in enumerate(sets)]
    slim = df.select(F.array(*places).alias("places"), F.lit(True).alias("real"), *[x.alias(k) for k, x in columns.items()])
    if () in sets:
        kinds = dict(slim.dtypes)
        none = F.array(F.struct(F.lit(sets.index(())).alias("set"), F.lit(None).cast("string").alias("key")))
        slim = slim.union(df.sparkSession.range(1).select(none, F.lit(False), *[F.lit(None).cast(kinds[k]) for k in columns]))
    each = slim.select(F.explode("places").alias("place"), "real", *columns)

    def chosen(own: dict[int, str]) -> Column:
        out = F.lit(None).cast("double")
        for x in dict.fromkeys(own.values()):
            out = F.when(F.col("place.set").isin(*[i for i, name in own.items() if name == x]), F.col(x)).otherwise(out)
        return out

    place = {slot: f"s{i}" for i, slot in enumerate(slots)}
    each = each.select("place.set", "place.key", "real", *flags, *[chosen(slots[slot]).alias(name) for slot, name in place.items() if slot[0] != "count"])
    aggs, conds = [], [(name, F.col("real") & F.col(f"f{j}") if cond is not None else F.col("real")) for j, (name, cond) in enumerate(more.items())]
    for slot, own in place.items():
        aggs += [aggregated(slot[0], None if slot[0] == "count" else F.col(own), when).cast("double").alias(f"{own}_{name}") for name, when in conds]
    wide = each.groupBy("set", "key").agg(*aggs, (F.count_if(conds[0][1]) > 0).alias("present"))
    rows = [F.array(*[F.struct(F.lit(m.name).alias("metric"), *[F.col(f"{place[slot_of[m.name]]}_{name}").alias(name) for name in more]) for m in by[dims]]) for dims in sets]
    picked = rows[-1]
    for i in range(len(sets) - 2, -1, -1):
        picked = F.when(F.col("set") == i, rows[i]).otherwise(picked)
    own = wide.select("key", "present", F.explode(picked).alias("r"))
    return own.select("r.metric", F.col("key").alias("group_key"), *[f"r.{name}" for name in more], "present")


def compute_metrics(tracker: ir.Tracker, events: DataFrame, window: TimeWindow | None = None, options: Options = Options()) -> DataFrame:
    """All metrics, ``metric, group_key, value``; with a window also the count of its events."""
    df, c = prepared(tracker, events, options)
    df = df.where(inside(window, df)) if window else df
    metrics = [m for m in tracker.metrics if not (window and m.name == RESERVED)]
    if window:
        metrics.append(ir.Metric(RESERVED, "count"))
    if not metrics:
        return events.sparkSession.createDataFrame([], "metric string, group_key string, value double")
    return all_groups(df, metrics, c, {"value": None}).select("metric", "group_key", "value")


def counts(events: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """``total_events, window_events``, in one scan."""
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.count(F.when(inside(window, events), 1) if window else F.lit(1)).alias("window_events"))


def alerts(tracker: ir.Tracker, events: DataFrame, options: Options = Options()) -> DataFrame:
    """``alert, event_id, value, ordinal`` where an alert's value counts, and ``arrival`` of
    events that have one. The query's window has no say in it. Values are text: numbers,
    true, a signal's JSON. Their order is that of arrival, then of declaration."""
    order = [ARRIVAL] if ARRIVAL in events.columns else []
    df, kinds = derive(tracker, events, options.strict, **options.columns())
    c = Compiler(kinds, "D", options.strict, **options.columns())
    rows = []
    for i, a in enumerate(tracker.alerts):
        v = c.value(a.expr)
        if v.kind != "any":
            text = F.to_json(v.col) if v.kind == "signal" else render_key(v.col, v.kind)
        else:
            text = F.when(F.schema_of_variant(v.col).rlike("^(OBJECT|ARRAY)"), F.to_json(v.col)).otherwise(key_text(v))
        rows.append(F.struct(F.lit(a.name).alias("alert"), F.lit(i).alias("ordinal"), text.alias("value"), truthy(v).alias("on")))
    if not rows:
        return events.sparkSession.createDataFrame([], "alert string, event_id string, value string, ordinal int" + ", arrival bigint" * len(order))
    return df.select("event_id", *order, F.explode(F.array(*rows)).alias("a")).where("a.on").select("a.alert", "event_id", "a.value", "a.ordinal", *order)


def simulate(tracker: ir.Tracker, events: DataFrame, hypothetical: DataFrame, query: Query = Query(), options: Options = Options()) -> DataFrame:
    """``metric, group_key, base, hypothetical, delta`` in one pass over both logs, inside
    the query's window, with the count of its events.

    A delta is the difference of ungrouped numbers, else the hypothetical value; a
    metric without groups is null before the first number.
    """
    flag = "is_hypothetical"
    both = events.withColumn(flag, F.lit(False)).unionByName(hypothetical.withColumn(flag, F.lit(True)))
    df, c = prepared(tracker, both, options)
    window = query.time_window
    df = df.where(inside(window, df)) if window else df
    metrics = [m for m in tracker.metrics if not (window and m.name == RESERVED)]
    if window:
        metrics.append(ir.Metric(RESERVED, "count"))
    if not metrics:
        return events.sparkSession.createDataFrame([], "metric string, group_key string, base double, hypothetical double, delta double")
    rows = all_groups(df, metrics, c, {"base": ~F.col(flag), "hypothetical": None})
    grouped = F.col("metric").isin(*[m.name for m in metrics if m.name != RESERVED and grouping(m)])
    base = F.when(~grouped | F.col("present"), F.col("base"))
    delta = F.when(grouped, F.col("hypothetical")).otherwise(F.coalesce(F.col("hypothetical") - F.col("base"), F.col("hypothetical")))
    return rows.select("metric", "group_key", base.alias("base"), "hypothetical", delta.alias("delta"))


@dataclass
class Output:
    """A result's envelope, on the driver."""

    total_events: int
    window_events: int
    metrics: dict[str, Any] = field(default_factory=dict)
    alerts: list[dict[str, Any]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


def envelope(tracker: ir.Tracker, rows: list[Any]) -> dict[str, Any]:
    """Long rows as an object: ungrouped metrics by value, grouped ones by key."""
    out: dict[str, Any] = {m.name: {} for m in tracker.metrics if grouping(m)}
    for r in sorted(rows, key=lambda r: (r["metric"], r["group_key"] or "")):
        if r["group_key"] is None:
            out[r["metric"]] = r["value"]
        else:
            out.setdefault(r["metric"], {})[r["group_key"]] = r["value"]
    return dict(sorted(out.items()))


def found_alerts(tracker: ir.Tracker, events: DataFrame, options: Options) -> list[dict[str, Any]]:
    found = alerts(tracker, events, options)
    rows = found.orderBy(*([ARRIVAL] if ARRIVAL in found.columns else ["event_id"]), "ordinal").collect()
    return [{"alert": r["alert"], "event_id": r["event_id"], "value": r["value"]} for r in rows]


def compute(tracker: ir.Tracker, events: DataFrame, query: Query = Query(), options: Options = Options()) -> Output:
    """Everything a query answers, on the driver: for logs whose groups and alerts fit
    there. ``compute_metrics``, ``alerts`` and ``counts`` give the same as frames."""
    ensure_tracker(tracker, events)
    n = counts(events, query.time_window).first()
    found = compute_metrics(tracker, events, query.time_window, options).collect()
    return Output(n["total_events"], n["window_events"], envelope(tracker, found), found_alerts(tracker, events, options))


def simulation(tracker: ir.Tracker, events: DataFrame, hypothetical: DataFrame, query: Query = Query(), options: Options = Options()) -> dict[str, Any]:
    """Outputs before and after the hypothetical events, and what changes, on the driver.
    Either log may hold no other tracker's events."""
    ensure_tracker(tracker, hypothetical)
    if ARRIVAL in events.columns and ARRIVAL in hypothetical.columns:
        n = events.agg(F.coalesce(F.max(ARRIVAL) + 1, F.lit(0))).first()[0]
        hypothetical = hypothetical.withColumn(ARRIVAL, F.col(ARRIVAL) + n)
    base = compute(tracker, events, query, options)
    future = compute(tracker, events.unionByName(hypothetical), query, options)

    def changed(name: str) -> Any:
        a, b = base.metrics.get(name), future.metrics[name]
        return b - a if all(isinstance(x, (int, float)) for x in (a, b)) else b

    delta = {"total_events_delta": future.total_events - base.total_events, "metrics": {k: changed(k) for k in future.metrics}}
    return {"base": base.__dict__, "hypothetical": future.__dict__, "delta": delta}
