"""View queries: planning, catalog enrichment, series, distributions, read models."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Compiler
from ..functions.values import normalize_key
from ..plans import ir
from ..plans.ir import EngineError, ErrorCode, MetricFilter
from .analytics import distribution
from .metrics import Options, aggregate, group_key, grouping, metric_by_name, metric_filter, prepared

def _bad(message: str) -> EngineError:
    return EngineError(message, ErrorCode.EVENT_VALIDATION_FAILED)


def accepts(type_ref: str, value: Any) -> bool:
    """Whether a parameter's value fits its type; types that aren't known accept all."""
    if type_ref.endswith("[]"):
        base = type_ref[:-2]
        return isinstance(value, list) and all(accepts(base, v) for v in value) if base in ("string", "number", "int", "float", "boolean", "json", "unknown") else True
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"string": isinstance(value, str), "number": number, "float": number, "int": isinstance(value, int) and not isinstance(value, bool), "boolean": isinstance(value, bool)}.get(type_ref, True)


@dataclass(frozen=True)
class ViewPlan:
    view: ir.View
    metric_key: str
    metric: str
    group_key: str
    group_field: str
    filters: tuple[MetricFilter, ...]
    values: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ReadModelPlan:
    model: ir.ReadModel
    params: dict[str, Any]


def plan(tracker: ir.Tracker, query: str | dict[str, Any]) -> ViewPlan | ReadModelPlan:
    """A query's plan; everything that can be refused is refused here."""
    q = json.loads(query) if isinstance(query, str) else dict(query)
    if not isinstance(q, dict):
        raise _bad("a query must be an object")
    if {"view", "metric", "group_by"} <= q.keys():
        return _plan_view(tracker, q)
    if "read_model" in q:
        return _plan_read_model(tracker, q)
    raise _bad("a query names a view, metric and group_by, or a read_model")


def _plan_view(tracker: ir.Tracker, q: dict[str, Any]) -> ViewPlan:
    name = (tracker.compat.get("view_aliases") or {}).get(q["view"], q["view"])
    view = next((v for v in tracker.views if v.name == name), None)
    if view is None:
        raise _bad(f"unknown view: {q['view']}")
    metrics, groups, filters = (view.config.get(k) or {} for k in ("metrics", "group_by", "filters"))
    # A metric is named by its key or by what it stands for.
    key = q["metric"] if q["metric"] in metrics else next((k for k, m in metrics.items() if m.get("metric") == q["metric"]), None)
    if key is None:
        raise _bad(f"unknown metric for view '{name}': {q['metric']}")
    if q["group_by"] not in groups:
        raise _bad(f"unknown group_by for view '{name}': {q['group_by']}")
    given = {k: v for k, v in q.items() if k not in ("view", "metric", "group_by")}
    if isinstance(given.get("filters"), dict) and "filters" not in filters:
        given |= given.pop("filters")
    if unknown := sorted(given.keys() - filters.keys()):
        raise _bad(f"unknown filter for view '{name}': {unknown[0]}")
    chosen = []
    for k, spec in filters.items():
        scope = spec.get("metrics") or []
        if k not in given or given[k] is None:
            if not spec.get("optional", False):
                raise _bad(f"missing required filter: {k}")
            continue
        if not accepts(spec.get("type", "unknown"), given[k]):
            raise _bad(f"filter '{k}' expects {spec.get('type')}")
        if scope and key not in scope:
            continue
        chosen.append(MetricFilter(spec.get("field", k), spec.get("op", "eq"), given[k]))
    return ViewPlan(view, key, metrics[key]["metric"], q["group_by"], groups[q["group_by"]].get("field", q["group_by"]), tuple(chosen), given)


def _plan_read_model(tracker: ir.Tracker, q: dict[str, Any]) -> ReadModelPlan:
    model = next((r for r in tracker.read_models if r.name == q["read_model"]), None)
    if model is None:
        raise _bad(f"unknown read model: {q['read_model']}")
    given = {k: v for k, v in q.items() if k != "read_model"}
    if isinstance(given.get("params"), dict) and "params" not in {p.name for p in model.params}:
        given |= given.pop("params")
    known = {p.name: p for p in model.params}
    if unknown := sorted(given.keys() - known.keys()):
        raise _bad(f"unknown parameter for read model '{model.name}': {unknown[0]}")
    for p in model.params:
        if p.name not in given:
            if not p.optional:
                raise _bad(f"missing parameter: {p.name}")
        elif not accepts(p.type, given[p.name]):
            raise _bad(f"parameter '{p.name}' expects {p.type}")
    return ReadModelPlan(model, given)


# Catalog joins.


def catalog_keys(catalog: DataFrame, fields: list[str], empty: bool = False) -> DataFrame:
    """Each entry with a ``key`` for every text of its fields, raw and normalized;
    empty keys only where they are asked for."""
    cols = [F.col(f"`{f}`").cast("string") for f in fields if f in catalog.columns]
    both = [c for x in cols for c in (x, normalize_key(x))]
    keys = F.array(*[F.struct((c if empty else F.when(c != "", c)).alias("key")) for c in both])
    return catalog.select("*", F.explode(keys).alias("k")).select("*", F.col("k.key").alias("key")).drop("k").where(F.col("key").isNotNull())


def _key(lookup: Column, salt: Column) -> Column:
    """A lookup's text; nulls, which find nothing, are dealt out instead of meeting in one task."""
    return F.when(lookup.isNotNull(), lookup).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(salt), F.lit(1024)).cast("string")))


def enrich(events: DataFrame, catalog: DataFrame, config: dict[str, Any], order: str | None = None, raw: str | None = None) -> DataFrame:
    """Copy catalog fields into events, by ``config["enrich_fields"]``.

    Outputs go in order of name, so that a later lookup may read an earlier output.
    An event's lookup text is taken raw; the first entry with the key wins, by
    ``order`` (else the catalog's row order). Events that have the output keep it, as
    they keep a null that is there where ``raw`` names the payload's VARIANT. The keyed
    catalog is small or large as Spark finds it when it runs.
    """
    ranked = catalog.withColumn("catalog_order", F.col(order).cast("long") if order else F.monotonically_increasing_id())
    for out, spec in sorted((config.get("enrich_fields") or {}).items()):
        fields, source = spec.get("lookup_fields") or [], spec.get("catalog_field", out)
        if not fields or source not in catalog.columns or spec["lookup_field"] not in events.columns:
            continue
        keyed = catalog_keys(ranked, fields).groupBy("key").agg(F.min_by(F.col(f"`{source}`"), "catalog_order").alias("catalog_value")).withColumnRenamed("key", "catalog_key")
        salt = F.col("event_id") if "event_id" in events.columns else F.monotonically_increasing_id()
        lookup = events.withColumn("catalog_lookup", _key(F.col(spec["lookup_field"]).cast("string"), salt))
        joined = lookup.join(keyed, F.col("catalog_lookup") == F.col("catalog_key"), "left")
        own = F.col(f"`{out}`") if out in events.columns else F.lit(None)
        there = own.isNotNull() | (F.try_variant_get(raw, f"$['{out}']", "variant").isNotNull() if raw else F.lit(False))
        events = joined.withColumn(out, F.when(there, own).otherwise(F.col("catalog_value"))).drop("catalog_lookup", "catalog_key", "catalog_value")
    return events


def catalog_misses(events: DataFrame, column: str, catalog: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Events whose text is in no entry, neither raw nor normalized; events without a
    text are no misses."""
    keys = catalog_keys(catalog, fields or ["slug", "display_name"], empty=True).select("key").distinct()
    some = events.where(F.col(column).isNotNull())
    raw = some.join(keys, some[column] == F.col("key"), "left_anti")
    return raw.join(keys, normalize_key(raw[column]) == F.col("key"), "left_anti")


# Execution.


def _bucket(key: Column) -> Column:
    """A group key as a bucket: an integer, else a finite number rounded."""
    number = F.expr("try_cast(group_key as double)")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float(1 << 63)))
    return F.coalesce(F.when(key.rlike(r"^[+-]?\d+$"), F.expr("try_cast(group_key as bigint)")), F.when(finite, F.round(number)).cast("long"))


def _value(tracker: ir.Tracker, name: str, c: Compiler, cond: Column | None = None) -> Column:
    return aggregate(tracker.metric(name), c, cond)


def _filtered(df: DataFrame, p: ViewPlan, c: Compiler) -> DataFrame:
    for f in p.filters:
        df = df.where(metric_filter(f, c))
    return df


def metric_series(tracker: ir.Tracker, events: DataFrame, p: ViewPlan, options: Options = Options()) -> DataFrame:
    """``label, value, count, bucket`` with values above zero, by bucket. Value and
    count come from one aggregation; without a ``count_metric`` the count is the value."""
    df, c = prepared(tracker, events, options)
    counted = p.view.config.get("count_metric", p.metric_key)
    names = {m.name for m in tracker.metrics}
    aggs = [_value(tracker, p.metric, c).alias("v"), (_value(tracker, counted, c) if counted in names else _value(tracker, p.metric, c)).alias("n")]
    grouped = _filtered(df, p, c).groupBy(group_key((p.group_field,), c).alias("group_key")).agg(*aggs)
    points = grouped.select(F.lit("").alias("label"), F.col("v").cast("float").alias("value"), F.expr("try_cast(n as int)").alias("count"), _bucket(F.col("group_key")).alias("bucket"))
    return points.where((F.col("value") > 0) & F.col("bucket").isNotNull()).orderBy("bucket")


def view_distribution(tracker: ir.Tracker, events: DataFrame, p: ViewPlan, options: Options = Options()) -> DataFrame:
    """``label, value, percentage`` of a view's groups with values above zero."""
    df, c = prepared(tracker, events, options)
    grouped = _filtered(df, p, c).groupBy(group_key((p.group_field,), c).alias("label")).agg(_value(tracker, p.metric, c).cast("double").alias("value"))
    return distribution(grouped.where(F.col("value").cast("float") > 0))


def _present(tracker: ir.Tracker, df: DataFrame, field: str, options: Options) -> Column:
    """A payload field's value as JSON, null only where the event doesn't have the field:
    a derive is in every event, and a null in the payload's VARIANT is there. Without
    that VARIANT a null column is a missing field."""
    own = None
    if field in df.columns:
        own = F.to_json(F.array(F.col(f"`{field}`")))
        own = F.substring(own, 2, F.length(own) - 2)
        if field in {d.name for d in tracker.derives}:
            return F.when(F.col(f"`{field}`").isNull(), F.lit("null")).otherwise(own)
        own = F.when(F.col(f"`{field}`").isNotNull(), own)
    if options.raw is None:
        return own if own is not None else F.lit(None).cast("string")
    v = F.try_variant_get(F.col(options.raw), f"$['{field}']", "variant")
    raw = F.when(v.isNotNull(), F.coalesce(F.to_json(v), F.lit("null")))
    return F.coalesce(raw, own) if own is not None else raw


def totals(tracker: ir.Tracker, events: DataFrame, config: dict[str, Any], options: Options = Options()) -> DataFrame:
    """A view's totals, ``total, group_key, value`` and whether it is ``whole``; neither filters nor windows apply.

    Kind ``metric_total`` has a metric (with its own grouping), ``distinct_count`` a
    payload field; ``coerce`` makes integers (half away from zero) or floats.
    """
    df, _ = prepared(tracker, events, options)
    parts = []
    for name, spec in (config.get("totals") or {}).items():
        kind, how = spec.get("kind"), spec.get("coerce")
        if how not in (None, "integer", "float"):
            raise _bad(f"unsupported totals coercion '{how}'")
        if kind == "metric_total" and spec.get("metric"):
            if how and grouping(tracker.metric(spec["metric"])):
                raise _bad(f"{how} total coercion requires numeric value")
            found = metric_by_name(tracker, events, spec["metric"], options=options)
        elif kind == "distinct_count" and spec.get("field"):
            found = df.agg(F.countDistinct(_present(tracker, df, spec["field"], options)).alias("value")).withColumn("group_key", F.lit(None).cast("string"))
        else:
            raise _bad(f"unsupported totals '{name}'")
        value = F.col("value").cast("double")
        parts.append(found.select(F.lit(name).alias("total"), "group_key", (F.round(value, 0) if how == "integer" else value).alias("value"), F.lit(how == "integer" or kind == "distinct_count" and how is None).alias("whole")))
    if not parts:
        return df.sparkSession.createDataFrame([], "total string, group_key string, value double, whole boolean")
    return reduce(DataFrame.unionByName, parts)


def qa(events: DataFrame, catalog: DataFrame, config: dict[str, Any]) -> DataFrame:
    """``check, misses`` for each of a view's checks of lookups."""
    parts = []
    for name, spec in (config.get("qa") or {}).items():
        if spec.get("kind") != "catalog_lookup_miss":
            raise _bad(f"unsupported qa kind '{spec.get('kind')}'")
        missed = catalog_misses(events, spec["event_field"], catalog, spec.get("lookup_fields"))
        parts.append(missed.agg(F.count(F.lit(1)).alias("misses")).select(F.lit(name).alias("check"), "misses"))
    return reduce(DataFrame.unionByName, parts)


ReadModelFn = Callable[..., DataFrame]


class Registry:
    """Host functions of read models: ``fn(events, offset_minutes, catalog, **params)``."""

    def __init__(self) -> None:
        self.models: dict[str, ReadModelFn] = {}

    def read_model(self, name: str) -> Callable[[ReadModelFn], ReadModelFn]:
        def add(fn: ReadModelFn) -> ReadModelFn:
            self.models[name] = fn
            return fn

        return add


@dataclass
class ViewResult:
    """A view's frames; ``echo`` has the response fields that come from filters, and
    ``kind`` says what the points are."""

    points: DataFrame
    totals: DataFrame | None = None
    qa: DataFrame | None = None
    echo: dict[str, Any] = field(default_factory=dict)
    kind: str = "metric_series"
    head: dict[str, str] = field(default_factory=dict)

    def answer(self) -> dict[str, Any]:
        """The view's answer on the driver: its points (or a distribution's items), totals
        by name and misses by the name of their check."""
        out: dict[str, Any] = dict(self.head)
        out["items" if self.kind == "distribution" else "points"] = [r.asDict() for r in self.points.collect()]
        if self.kind == "distribution":
            out["totals"] = {}
            for r in self.totals.collect() if self.totals is not None else ():
                value = int(r["value"]) if r["whole"] and r["value"] is not None else r["value"]
                if r["group_key"] is None:
                    out["totals"][r["total"]] = value
                else:
                    out["totals"].setdefault(r["total"], {})[r["group_key"]] = value
            out |= {r["check"]: r["misses"] for r in self.qa.collect()} if self.qa is not None else {}
        return out | {k: v for k, v in self.echo.items() if v is not None}


def run(tracker: ir.Tracker, events: DataFrame, query: str | dict[str, Any], catalog: DataFrame | None = None, offset_minutes: int = 0, registry: Registry | None = None, options: Options = Options()) -> ViewResult | DataFrame:
    """Answer a view or read-model query. Native views do not use the offset."""
    p = plan(tracker, query)
    if isinstance(p, ReadModelPlan):
        fn = (registry or Registry()).models.get(p.model.name)
        if fn is None:
            raise _bad(f"no function for read model: {p.model.name}")
        return fn(events, offset_minutes, catalog, **p.params)
    config = p.view.config
    if catalog is not None:
        events = enrich(events, catalog, config, "catalog_row" if "catalog_row" in catalog.columns else None, options.raw)
    echo = {k: p.values.get(spec["from_filter"]) for k, spec in (config.get("response_fields") or {}).items() if isinstance(spec, dict) and "from_filter" in spec}
    kind, head = config.get("result_kind", "metric_series"), {"metric": p.metric_key, "group_by": p.group_key}
    if kind not in ("metric_series", "distribution"):
        raise _bad(f"unsupported result_kind '{kind}'")
    if kind == "metric_series":
        return ViewResult(metric_series(tracker, events, p, options), echo=echo, head=head)
    checks = qa(events, catalog, config) if catalog is not None and config.get("qa") else None
    return ViewResult(view_distribution(tracker, events, p, options), totals(tracker, events, config, options) if config.get("totals") else None, checks, echo, kind, head)
