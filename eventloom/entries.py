"""The engine's queries over the test tables, each with its SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timefn import bucket, label
from .operators import analytics, catalog, metrics, views
from .operators.events import derive, typed
from .operators.metrics import Options
from .operators.validate import check, with_fields
from .plans import ir
from .plans.dsl import compile_tracker
from .plans.ir import Grain, Metric, MetricFilter, TimeWindow
from .sources import json_events, sqlite
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = """
tracker "site_events" v1 {
  fields {
    user_id: int
    event_type: text
    value: float optional
    k: int optional
    quality: int optional
    bucket: int optional
  }
  derive {
    score = if (value > 50) then value * 2 else value
    margin = score - value
    rest = k % 7
    is_error = event_type == "error"
    positive = quality > 0
  }
  metrics {
    total_score = sum(score) by event_type
    avg_value = avg(value) by event_type
    min_value = min(value) by event_type
    max_value = max(value) by event_type
    events = count() by event_type
    rated = count(quality) by event_type
    errors = sum(is_error) by user_id
    weekly = count() over week
    overall = sum(value) over all_time
    most = max(value) over all_time
    number = count() over all_time
    value_by_user = sum(value) by user_id
  }
  alerts {
    large = value > 200
    purchase_signal = if (event_type == "purchase" && value > 150) then event_type else ""
  }
  views {
    view "daily" {
      config = {"result_kind": "metric_series", "count_metric": "number",
                "group_by": {"day": {"field": "bucket"}},
                "filters": {"type": {"field": "event_type", "op": "eq", "type": "string", "optional": true}},
                "metrics": {"overall": {"metric": "overall", "label": "Value"}}}
    }
    view "types" {
      config = {"result_kind": "distribution",
                "group_by": {"type": {"field": "event_type"}},
                "metrics": {"number": {"metric": "number", "label": "Events"}},
                "totals": {"users": {"kind": "distinct_count", "field": "user_id", "coerce": "integer"},
                           "value": {"kind": "metric_total", "metric": "overall"}}}
    }
  }
}
"""

SALES = """
tracker "sales" v1 {
  fields {
    l_extendedprice: float
    l_discount: float
    l_returnflag: text
    l_linestatus: text
  }
  metrics {
    revenue = sum(l_extendedprice * (1 - l_discount)) by l_returnflag
    revenue_by_status = sum(l_extendedprice * (1 - l_discount)) by l_returnflag, l_linestatus
  }
}
"""

ORDERS = """
tracker "orders" v1 {
  fields { o_totalprice: float }
  metrics {
    by_day = sum(o_totalprice) over day
    by_week = sum(o_totalprice) over week
    by_month = sum(o_totalprice) over month
    by_quarter = sum(o_totalprice) over quarter
    by_year = sum(o_totalprice) over year
    by_all_time = sum(o_totalprice) over all_time
  }
}
"""

PARTS = """
tracker "parts" v1 {
  fields { p_size: int, p_retailprice: float }
  metrics { price = avg(p_retailprice) by p_size }
}
"""

#: 2024-01-08 to 2024-01-21, both ends included; "now" of the streaks; India's offset.
WINDOW, NOW, OFFSET = TimeWindow(1704672000000, 1705881599999), 1706745600000, 330


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share, in the checkpoint folder;
    a warehouse folder where there is none."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, labels: bool = False, window: TimeWindow | None = None) -> tuple[ir.Tracker, DataFrame]:
    t = compile_tracker(EVENTS)
    df = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    if labels:
        df = df.join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), "quality"), "event_id", "left")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return t, typed(t, df.withColumn("bucket", bucket(millis, "day", OFFSET)), window=window)


def events_inside(spark: SparkSession, sf_dir: str) -> tuple[ir.Tracker, DataFrame]:
    return events(spark, sf_dir, window=WINDOW)


def _metric(name: str, by: Callable[[SparkSession, str], tuple[ir.Tracker, DataFrame]] = events, **options: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, df = by(spark, sf_dir)
        return metrics.metric_by_name(t, df, name, **options)

    return run


def sales(spark: SparkSession, sf_dir: str) -> tuple[ir.Tracker, DataFrame]:
    t = compile_tracker(SALES)
    return t, typed(t, load(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate")


def orders(spark: SparkSession, sf_dir: str) -> tuple[ir.Tracker, DataFrame]:
    t = compile_tracker(ORDERS)
    return t, typed(t, load(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


def parts(spark: SparkSession, sf_dir: str) -> tuple[ir.Tracker, DataFrame]:
    t = compile_tracker(PARTS)
    return t, typed(t, load(spark, sf_dir, "part").withColumn("ts", F.lit(0).cast("long")), "p_partkey", "ts")


flagship = _metric("total_score")


def agg_count_ignores_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir, labels=True)
    return metrics.metric_by_name(t, df, "rated")


def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return metrics.compute_metrics(t.with_metrics(*[m for m in t.metrics if m.name in ("overall", "most", "number")]), df, TimeWindow(0, 1))


def filter_null_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir, labels=True)
    return metrics.metric_by_name(t.with_metrics(Metric("n", "count")), df, "n", group_by=("positive",))


def derive_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return derive(t, df)[0].select("event_id", "score", "is_error")


def derive_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches within branches, and an omitted else."""
    t = compile_tracker(SHAPES)
    return derive(t, _shapes(spark, sf_dir)[1])[0].select("event_id", "band", "only_large")


def derive_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return derive(t, df)[0].groupBy("event_type").agg((F.round(F.sum("margin") * 100, 0) / 100).alias("margin"))


def derive_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return derive(t, df)[0].groupBy(F.col("rest").cast("long").alias("rest")).agg(F.count(F.lit(1)).alias("n"))


def compute_multi_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return metrics.compute_metrics(t.with_metrics(*[m for m in t.metrics if m.name != "value_by_user"]), df)


def window_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return metrics.compute_metrics(t.with_metrics(t.metric("overall")), df, WINDOW)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, df = events(spark, sf_dir)
    return metrics.counts(df, WINDOW)


def alerts_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return metrics.alerts(t, df).select("alert", "event_id", "value")


def simulate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    own = F.col("event_id").cast("long") % 10 == 0
    chosen = t.with_metrics(*[m for m in t.metrics if m.name in ("events", "total_score", "overall", "number")])
    return metrics.simulate(chosen, df.where(~own), df.where(own))


def enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    items = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("slug"), "p_brand", "p_partkey")
    config = {"enrich_fields": {"brand": {"lookup_field": "part", "lookup_fields": ["slug"], "catalog_field": "p_brand"}}}
    return views.enrich(lines, items, config, order="p_partkey").groupBy("brand").agg(F.count(F.lit(1)).alias("lines"))


def qa_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("SRC-1", "src 2"), ("src3", "Src_4")], "slug string, display_name string")
    return views.catalog_misses(load(spark, sf_dir, "documents").select("source"), "source", known).groupBy("source").agg(F.count(F.lit(1)).alias("misses"))


def view_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    points = views.run(t, df, {"view": "daily", "metric": "overall", "group_by": "day", "type": "purchase"}).points
    return points.select("label", F.round(F.col("value").cast("double"), 0).alias("value"), "count", "bucket")


def view_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    items = views.run(t, df, {"view": "types", "metric": "number", "group_by": "type"}).points
    return items.select("label", F.col("value").cast("long").alias("value"), (F.round(F.col("percentage").cast("double") * 100, 0) / 100).alias("percentage"))


def totals_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    return views.totals(t, df, t.view("types").config).select("total", "value")


def _bucket(granularity: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, df = events(spark, sf_dir)
        return df.groupBy(bucket(F.col("ts"), granularity, OFFSET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    return run


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, df = events(spark, sf_dir)
    return analytics.heatmap(df, OFFSET)


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, df = events(spark, sf_dir)
    return analytics.streaks(df.where("value > 250"), NOW, OFFSET, by=("event_type",))


def _part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("display_name"),
        F.array("p_brand", "p_type").alias("tags"),
        F.map_from_arrays(F.array(F.lit("size")), F.array(F.col("p_size").cast("string"))).alias("attributes"),
        (F.col("p_size") % 5 == 0).alias("archived"),
        (F.col("p_size") % 7 == 0).alias("hidden"),
    )


def catalog_find_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_by_tag(_part_catalog(spark, sf_dir), "bRAND#13").select("id", "display_name")


def catalog_find_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_by_attribute(_part_catalog(spark, sf_dir), "size", "10").select("id", "display_name")


def catalog_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.visible(_part_catalog(spark, sf_dir)).select("id", "display_name")


def catalog_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", catalog.sanitize_slug(F.col("p_type")).alias("slug"), catalog.valid_slug(F.col("p_brand")).alias("valid"))


#: Raw events with faults, by the last digit of the id.
RAW_SPARK = """
CASE event_id % 10
  WHEN 0 THEN concat('{"event_id":"', event_id, '","ts":', event_id, ',"payload":{"user_id":"x","event_type":"', event_type, '"}}')
  WHEN 1 THEN concat('{"event_id":"","ts":', event_id, ',"payload":{}}')
  WHEN 2 THEN concat('{"event_id":"', event_id, '","ts":1.5,"payload":{"user_id":1,"event_type":"a"}}')
  WHEN 3 THEN concat('{"event_id":"', event_id, '","ts":', event_id, ',"payload":{"event_type":"a"}}')
  WHEN 4 THEN concat('{"event_id":"', event_id, '","ts":', event_id, ',"payload":[1]}')
  WHEN 5 THEN concat('{"event_id":"', event_id, '","ts":', event_id, ',"tracker_id":"other","payload":{"user_id":1,"event_type":"a"}}')
  ELSE concat('{"event_id":"', event_id, '","ts":', event_id, ',"payload":{"user_id":', user_id, ',"event_type":"', event_type, '","more":[1]}}')
END"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.expr(RAW_SPARK).alias("json"))


def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check(compile_tracker(EVENTS), raw_events(spark, sf_dir))
    code, message = F.coalesce("error_code", F.lit(0)).alias("error_code"), F.coalesce("message", F.lit("")).alias("message")
    return checked.groupBy(code, message).agg(F.count(F.lit(1)).alias("n"))


def week_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of days around each year's end, where calendar and ISO years differ."""
    days = spark.range(0, 40 * 12).select((F.unix_millis(F.expr("timestamp '1990-12-26 00:00:00'")) + (F.floor(F.col("id") / 12) * 365.25 + F.col("id") % 12).cast("long") * 86_400_000).alias("ts"))
    return days.select("ts", label(F.col("ts"), Grain.WEEK).alias("week"), label(F.col("ts"), Grain.QUARTER).alias("quarter"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events through the stream, then a metric over the log."""
    t, folder = compile_tracker(EVENTS), shared_folder(spark, "stream")
    raw_events(spark, sf_dir).withColumnRenamed("json", "value").write.text(f"{folder}/in")
    source = spark.readStream.format("text").load(f"{folder}/in").withColumnRenamed("value", "json")
    ingest.ingest(t, source, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return metrics.metric_by_name(t, ingest.read_log(spark, t, f"{folder}/log"), "events")


def sqlite_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out to a bundle and back."""
    t, df = events(spark, sf_dir)
    payload = F.to_json(F.struct("user_id", "event_type", "value"))
    rows = df.select("event_id", "tracker_id", "ts", payload.alias("payload_json"), F.lit(None).cast("string").alias("meta_json"))
    trackers = spark.createDataFrame([(t.id, t.dsl, "1.0.0", None)], sqlite.TABLES["trackers"][0])
    kv = spark.createDataFrame([("source", '"test"')], sqlite.TABLES["kv_meta"][0])
    back = sqlite.import_bundle(spark, sqlite.export_bundle(None, trackers, rows, kv))["events"]
    return back.groupBy(F.get_json_object("payload_json", "$.event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


#: Values below zero, null and missing ones, made from the events; what is written as it is given, and conditions of all kinds.
SHAPES = """
tracker "shapes" v1 {
  fields { user_id: int, event_type: text, value: float optional, level: float optional, k: int optional, quality: int optional }
  derive {
    balance = value - 250
    share = value / level
    minus = -k + 1
    band = if (value > 300) then "high" else if (value > 100) then "middle" else "low"
    only_large = if (value >= 400) then value
    odd = !(k % 2 == 0)
    rated = if (quality) then 1 else 0
    always = if (true && !(false)) then 1 else 2
    own = if (event.ts >= 1705000000000) then event.id else event_type
    ahead = late
    late = k
    note = {"a": 1}
  }
  metrics {
    net = sum(balance) by event_type
    rows = count()
    worst = min(balance) by band
    by_ahead = count() by ahead
  }
  alerts { told = if (value > 480) then signal(event_type, value) }
  views {
    view "net" {
      config = {"result_kind": "distribution", "group_by": {"user": {"field": "user_id"}}, "metrics": {"net": {"metric": "net"}},
                "totals": {"qualities": {"kind": "distinct_count", "field": "quality"}, "bands": {"kind": "distinct_count", "field": "only_large"}}}
    }
  }
}
"""


def _shapes(spark: SparkSession, sf_dir: str) -> tuple[ir.Tracker, DataFrame]:
    t = compile_tracker(SHAPES)
    df = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("level", F.col("k") % 3)
    return t, typed(t, df.join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), "quality"), "event_id", "left"))


def derive_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division (also by zero), unary minus, not, bare values, constants, event paths, a later derive, an object."""
    t, df = _shapes(spark, sf_dir)
    return derive(t, df)[0].select("event_id", "share", "minus", "odd", "rated", "always", "own", "ahead", "note")


def agg_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = _shapes(spark, sf_dir)
    return metrics.compute_metrics(t, df)


def alerts_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = _shapes(spark, sf_dir)
    return metrics.alerts(t, df).select("alert", "event_id", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.payload").cast("double").alias("payload")).where("payload IS NOT NULL")


def view_distribution_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups above zero alone are items of a distribution."""
    t, df = _shapes(spark, sf_dir)
    items = views.run(t, df, {"view": "net", "metric": "net", "group_by": "user"}).points
    return items.select("label", F.round(F.col("value").cast("double"), 0).alias("value"), F.round(F.col("percentage").cast("double"), 1).alias("percentage"))


def totals_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts: a missing field is no value, a derive's null is one."""
    t, df = _shapes(spark, sf_dir)
    return views.totals(t, df, t.view("net").config).select("total", "value")


def enrich_explicit_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have the output keep it, though it be null."""
    payload = "CASE event_id % 3 WHEN 0 THEN '{\"town\": null}' WHEN 1 THEN '{}' ELSE '{\"town\": \"own\"}' END"
    df = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.parse_json(F.expr(payload)).alias("payload_raw"))
    df = df.withColumn("town", F.try_variant_get("payload_raw", "$.town", "string"))
    known = spark.createDataFrame([("view", "Hill"), ("CLICK", "Port")], "slug string, place string")
    config = {"enrich_fields": {"town": {"lookup_field": "event_type", "lookup_fields": ["slug"], "catalog_field": "place"}}}
    return views.enrich(df, known, config, raw="payload_raw").groupBy("town").agg(F.count(F.lit(1)).alias("n"))


def simulate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, df = events(spark, sf_dir)
    own = F.col("event_id").cast("long") % 4 == 0
    chosen = t.with_metrics(*[m for m in t.metrics if m.name in ("events", "number")])
    return metrics.simulate(chosen, df.where(~own), df.where(own), ir.Query(WINDOW))


def apply_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after one event more: its derived values are in it."""
    t, df = events(spark, sf_dir)
    log, delta = ingest.apply(t, df.where("event_id != '7'"), df.where("event_id = '7'"))
    return log.agg(F.count(F.lit(1)).alias("total_events"), F.max("score").alias("score")).crossJoin(delta)


def validate_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults fill what is absent, never a null; enums have their members alone."""
    t = compile_tracker('''tracker "d" v1 { fields { n: int optional = 7, kind: enum("view", "click") optional } metrics { m = count() } }''')
    part = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',\"n\":null' ELSE concat(',\"n\":', user_id) END"
    raw = load(spark, sf_dir, "events").select(F.expr(f"""concat('{{"event_id":"', event_id, '","ts":1,"payload":{{"kind":"', event_type, '"', {part}, '}}}}')""").alias("json"))
    return with_fields(t, check(t, raw)).groupBy(F.col("error_code").isNull().alias("valid"), F.when(F.col("error_code").isNull(), F.coalesce(F.col("n").cast("string"), F.lit("null"))).alias("n")).agg(F.count(F.lit(1)).alias("rows"))


def labels_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that no calendar has get the epoch's labels."""
    ts = (F.col("event_id") - 500) * F.lit(10**12)
    return load(spark, sf_dir, "events").where("event_id < 1000").select("event_id", label(ts, Grain.DAY).alias("day"), label(ts, Grain.YEAR).alias("year"))


def json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a JSON array: ids by place, undeclared paths read from the payload."""
    t = compile_tracker('tracker "p" v1 { fields { a: float optional } metrics { deep = sum(more.n) by more.kind } }')
    text = json.dumps([{"ts": i, "payload": {"more": {"kind": ("x", i % 4, None, i % 2 == 0)[i % 4], "n": i if i % 5 else "no"}}} for i in range(40)])
    return metrics.metric_by_name(t, json_events.pack_events(spark, t, text), "deep", options=Options(raw="payload_raw"))


def catalog_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name")).alias("display_name"), F.when(F.col("p_size") % 3 == 0, "a b").otherwise(F.lower(F.translate("p_brand", "#", "_"))).alias("slug"), F.array("p_brand").alias("tags"), F.map_from_arrays(F.array(F.lit("size")), F.array(F.col("p_size").cast("string"))).alias("attributes"))
    return catalog.validate(c, required=("size",), allowed_tags=("BRAND#11", "brand#12", "Brand#13")).select("id", "error")


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _part_catalog(spark, sf_dir).select("id", "display_name", "attributes")
    changed = c.where("attributes['size'] = '10'").withColumn("display_name", F.lit("changed"))
    moved = catalog.rename_attribute("size", "measure").apply(catalog.remove(catalog.add(c, changed.union(changed)), "1"))
    return moved.select("id", "display_name", F.col("attributes")["measure"].alias("measure"))


def queries() -> dict[str, Query]:
    return {
        **{f.__name__: f for f in (derive_shapes, agg_negative, alerts_signal, view_distribution_signed, totals_missing, enrich_explicit_null, simulate_window, apply_event, validate_defaults, labels_out_of_range, json_pack, catalog_validate, catalog_upsert)},
        "flagship": flagship,
        "agg_sum": _metric("value_by_user"),
        "agg_avg": _metric("avg_value"),
        "agg_min": _metric("min_value"),
        "agg_max": _metric("max_value"),
        "agg_count": _metric("events"),
        "agg_count_ignores_target": agg_count_ignores_target,
        "agg_bool_sum": _metric("errors"),
        "agg_expr": _metric("revenue", sales),
        "agg_grouped": _metric("revenue", sales, group_by=("l_linestatus",)),
        "agg_multi_group": _metric("revenue_by_status", sales),
        "agg_numeric_key": _metric("price", parts),
        "agg_empty": agg_empty,
        **{f"agg_over_{g}": _metric(f"by_{g}", orders) for g in ("day", "week", "month", "quarter", "year", "all_time")},
        "agg_by_overrides_over": _metric("by_week", orders, group_by=()),
        "metric_override": _metric("total_score", group_by=("event_type", "week"), filters=(MetricFilter("value", "gte", 100),)),
        "filter_gt": _metric("number", filters=(MetricFilter("value", "gt", 100),)),
        "filter_time_window": _metric("events", events_inside, window=WINDOW),
        "filter_multi": _metric("events", events_inside, window=WINDOW, filters=(MetricFilter("value", "lte", 300), MetricFilter("event_type", "neq", "view"))),
        "filter_null_semantics": filter_null_semantics,
        "derive_project": derive_project,
        "derive_conditional": derive_conditional,
        "derive_chain": derive_chain,
        "derive_modulo": derive_modulo,
        "compute_multi_metric": compute_multi_metric,
        "window_event_count": window_event_count,
        "event_counts": event_counts,
        "alerts_truthy": alerts_truthy,
        "simulate_delta": simulate_delta,
        "enrich_left_join": enrich_left_join,
        "qa_anti_join": qa_anti_join,
        "view_metric_series": view_metric_series,
        "view_distribution": view_distribution,
        "totals_distinct": totals_distinct,
        **{f"bucket_{g}_offset": _bucket(g) for g in ("day", "week", "month")},
        "heatmap": heatmap,
        "streaks": streaks,
        "catalog_find_by_tag": catalog_find_by_tag,
        "catalog_find_by_attribute": catalog_find_by_attribute,
        "catalog_visible": catalog_visible,
        "catalog_slugs": catalog_slugs,
        "validate_events": validate_events,
        "week_labels": week_labels,
        "stream_ingest": stream_ingest,
        "sqlite_round_trip": sqlite_round_trip,
    }


# The same in SQL.

_MS = "(epoch_us(ts) // 1000)"
_R = "(round(({}) * 100) / 100)"
_SCORE = "CASE WHEN value > 50 THEN value * 2 ELSE value END"
_IN = f"{_MS} BETWEEN {WINDOW.start} AND {WINDOW.end}"
_DAY = f"(({_MS} + 19800000) // 86400000 * 86400000 - 19800000)"
_REVENUE = _R.format("sum(l_extendedprice * (1 - l_discount))")
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _grouped(value: str, key: str = "event_type", table: str = "events", where: str = "true") -> str:
    return f"SELECT {key} AS group_key, {value} AS value FROM {table} WHERE {where} GROUP BY 1"


def _week(d: str) -> str:
    return f"year({d}) || '-W' || lpad(CAST(weekofyear({d}) AS VARCHAR), 2, '0')"


def oracle_sql() -> dict[str, str]:
    total = _grouped(_R.format(f"sum({_SCORE})"))
    price = _R.format("sum(o_totalprice)")
    d = "o_orderdate"
    labels = {"day": f"strftime({d}, '%Y-%m-%d')", "week": _week(d), "month": f"strftime({d}, '%Y-%m')", "quarter": f"year({d}) || '-Q' || quarter({d})", "year": f"CAST(year({d}) AS VARCHAR)"}
    multi = {"total_score": (_R.format(f"sum({_SCORE})"), "event_type"), "avg_value": (_R.format("avg(value)"), "event_type"), "min_value": (_R.format("min(value)"), "event_type"), "max_value": (_R.format("max(value)"), "event_type"), "events": ("count(*)", "event_type"), "rated": ("count(*)", "event_type"), "errors": ("CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE)", "CAST(user_id AS VARCHAR) || '.0'"), "weekly": ("count(*)", _week("ts")), "overall": (_R.format("sum(value)"), None), "most": (_R.format("max(value)"), None), "number": ("count(*)", None)}
    long = " UNION ALL ".join(f"SELECT '{n}' AS metric, {k or 'CAST(NULL AS VARCHAR)'} AS group_key, CAST({v} AS DOUBLE) AS value FROM events" + (" GROUP BY 2" if k else "") for n, (v, k) in multi.items())
    base = "CASE WHEN CAST(event_id AS BIGINT) % 10 <> 0 THEN {} END"
    sim = lambda name, b, h, key: f"SELECT '{name}' AS metric, {key or 'CAST(NULL AS VARCHAR)'} AS group_key, CAST({b} AS DOUBLE) AS base, CAST({h} AS DOUBLE) AS hypothetical, CAST({h if key else f'{h} - {b}'} AS DOUBLE) AS delta FROM events" + (" GROUP BY 2" if key else "")
    local = f"make_timestamp(({_MS} + 19800000) * 1000)"
    buckets = {"day": _DAY, "week": f"(epoch_us(date_trunc('week', {local})) // 1000 - 19800000)", "month": f"(epoch_us(date_trunc('month', {local})) // 1000 - 19800000)"}
    user = "[" + ", ".join(["'" + c + "'" for c in ("SRC1", "src2", "src3", "Src4")]) + "]"
    joined = f"(SELECT e.*, quality, {_K} AS k, {_K} % 3 AS level, value - 250 AS balance FROM events e LEFT JOIN labels ON event_id = doc_id)"
    band = "CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'middle' ELSE 'low' END"
    by = lambda name, key, value: f"SELECT '{name}' AS metric, {key} AS group_key, CAST({value} AS DOUBLE) AS value FROM {joined} GROUP BY 2"
    inside = lambda name, key, b, h, d: f"SELECT '{name}' AS metric, {key} AS group_key, CAST({b} AS DOUBLE) AS base, CAST({h} AS DOUBLE) AS hypothetical, CAST({d} AS DOUBLE) AS delta FROM events WHERE {_IN} GROUP BY 2"
    own = "count(*) FILTER (WHERE event_id % 4 <> 0)"
    pack = {}
    for i in range(40):
        k = ("x", f"{i % 4}.0", "null", "true" if i % 2 == 0 else "false")[i % 4]
        pack[k] = pack.get(k, 0.0) + (i if i % 5 else 0)
    days = "CASE WHEN (event_id - 500) * 1000000000000 BETWEEN -62135596800000 AND 253402300799999 THEN make_timestamp((event_id - 500) * 1000000000000000) END"
    return {
        "derive_shapes": f"SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN level <> 0 THEN value / level END AS share, CAST(1 - k AS DOUBLE) AS minus, k % 2 <> 0 AS odd, CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS rated, 1.0::DOUBLE AS always, CASE WHEN {_MS} >= 1705000000000 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS own, CAST(NULL AS DOUBLE) AS ahead, '{{\"a\":1}}' AS note FROM {joined}",
        "derive_conditional": f"SELECT CAST(event_id AS VARCHAR) AS event_id, {band} AS band, CASE WHEN value >= 400 THEN value END AS only_large FROM events",
        "agg_negative": by("net", "event_type", _R.format("sum(balance)")) + " UNION ALL " + by("worst", band, _R.format("min(balance)")) + " UNION ALL " + by("by_ahead", "'null'", "count(*)") + " UNION ALL SELECT 'rows', NULL, CAST(count(*) AS DOUBLE) FROM events",
        "alerts_signal": "SELECT 'told' AS alert, CAST(event_id AS VARCHAR) AS event_id, event_type AS type, value AS payload FROM events WHERE value > 480",
        "view_distribution_signed": f"WITH g AS (SELECT CAST(user_id AS VARCHAR) || '.0' AS label, CAST({_R.format('sum(balance)')} AS FLOAT) AS v FROM {joined} GROUP BY 1) SELECT label, round(CAST(v AS DOUBLE)) AS value, round(CAST(CAST(CAST(v AS DOUBLE) / sum(CAST(v AS DOUBLE)) OVER () * 100 AS FLOAT) AS DOUBLE), 1) AS percentage FROM g WHERE v > 0",
        "totals_missing": f"SELECT 'qualities' AS total, CAST(count(DISTINCT quality) AS DOUBLE) AS value FROM {joined} UNION ALL SELECT 'bands', CAST(count(DISTINCT CASE WHEN value >= 400 THEN value ELSE -1 END) AS DOUBLE) FROM events",
        "enrich_explicit_null": "SELECT CASE event_id % 3 WHEN 1 THEN CASE event_type WHEN 'view' THEN 'Hill' WHEN 'click' THEN 'Port' END WHEN 2 THEN 'own' END AS town, count(*) AS n FROM events GROUP BY 1",
        "simulate_window": inside("events", "event_type", f"nullif({own}, 0)", "count(*)", "count(*)") + " UNION ALL " + inside("number", "CAST(NULL AS VARCHAR)", own, "count(*)", f"count(*) - {own}") + " UNION ALL " + inside("window_event_count", "CAST(NULL AS VARCHAR)", own, "count(*)", f"count(*) - {own}"),
        "apply_event": f"SELECT count(*) AS total_events, max({_SCORE}) FILTER (WHERE event_id = 7) AS score, CAST(1 AS BIGINT) AS total_events_delta, max({_MS}) FILTER (WHERE event_id = 7) AS last_event_ms, '7' AS last_event_id FROM events",
        "validate_defaults": "SELECT event_type IN ('view', 'click') AS valid, CASE WHEN event_type IN ('view', 'click') THEN CASE event_id % 3 WHEN 0 THEN '7' WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE 'null' END END AS n, count(*) AS rows FROM events GROUP BY 1, 2",
        "labels_out_of_range": f"SELECT event_id, strftime(coalesce({days}, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, CAST(year(coalesce({days}, TIMESTAMP '1970-01-01')) AS VARCHAR) AS year FROM events WHERE event_id < 1000",
        "json_pack": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in pack.items()) + ") t(group_key, value)",
        "catalog_validate": "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'display name is empty' WHEN p_size % 3 = 0 THEN 'slug is invalid' WHEN lower(p_brand) NOT IN ('brand#11', 'brand#12', 'brand#13') THEN 'tag is not allowed' END AS error FROM part",
        "catalog_upsert": "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size = 10 THEN 'changed' ELSE p_name END AS display_name, CAST(p_size AS VARCHAR) AS measure FROM part WHERE p_partkey <> 1",
        "flagship": total,
        "agg_sum": _grouped(_R.format("sum(value)"), "CAST(user_id AS VARCHAR) || '.0'"),
        "agg_avg": _grouped(_R.format("avg(value)")),
        "agg_min": _grouped(_R.format("min(value)")),
        "agg_max": _grouped(_R.format("max(value)")),
        "agg_count": _grouped("count(*)"),
        "agg_count_ignores_target": _grouped("count(*)"),
        "agg_bool_sum": _grouped("sum(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END)", "CAST(user_id AS VARCHAR) || '.0'"),
        "agg_expr": _grouped(_REVENUE, "l_returnflag", "lineitem"),
        "agg_grouped": _grouped(_REVENUE, "l_linestatus", "lineitem"),
        "agg_multi_group": _grouped(_REVENUE, "l_returnflag || '|' || l_linestatus", "lineitem"),
        "agg_numeric_key": _grouped(_R.format("avg(p_retailprice)"), "CAST(CAST(p_size AS DOUBLE) AS VARCHAR)", "part"),
        "agg_empty": "SELECT * FROM (VALUES ('overall', CAST(NULL AS VARCHAR), 0.0::DOUBLE), ('most', NULL, NULL), ('number', NULL, 0.0), ('window_event_count', NULL, 0.0)) t(metric, group_key, value)",
        **{f"agg_over_{g}": _grouped(price, key, "orders") for g, key in labels.items()},
        "agg_over_all_time": f"SELECT CAST(NULL AS VARCHAR) AS group_key, {price} AS value FROM orders",
        "agg_by_overrides_over": f"SELECT CAST(NULL AS VARCHAR) AS group_key, {price} AS value FROM orders",
        "metric_override": _grouped(_R.format(f"sum({_SCORE})"), f"event_type || '|' || {_week('ts')}", where="value >= 100"),
        "filter_gt": "SELECT CAST(NULL AS VARCHAR) AS group_key, count(*) AS value FROM events WHERE value > 100",
        "filter_time_window": _grouped("count(*)", where=_IN),
        "filter_multi": _grouped("count(*)", where=f"{_IN} AND value <= 300 AND event_type <> 'view'"),
        "filter_null_semantics": "SELECT CAST(coalesce(quality > 0, false) AS VARCHAR) AS group_key, count(*) AS value FROM events LEFT JOIN labels ON event_id = doc_id GROUP BY 1",
        "derive_project": f"SELECT CAST(event_id AS VARCHAR) AS event_id, {_SCORE} AS score, event_type = 'error' AS is_error FROM events",
        "derive_chain": f"SELECT event_type, {_R.format(f'sum({_SCORE} - value)')} AS margin FROM events GROUP BY 1",
        "derive_modulo": f"SELECT {_K} % 7 AS rest, count(*) AS n FROM events GROUP BY 1",
        "compute_multi_metric": long,
        "window_event_count": f"SELECT 'overall' AS metric, CAST(NULL AS VARCHAR) AS group_key, {_R.format('sum(value)')} AS value FROM events WHERE {_IN} UNION ALL SELECT 'window_event_count', NULL, CAST(count(*) AS DOUBLE) FROM events WHERE {_IN}",
        "event_counts": f"SELECT count(*) AS total_events, count(*) FILTER (WHERE {_IN}) AS window_events FROM events",
        "alerts_truthy": "SELECT 'large' AS alert, CAST(event_id AS VARCHAR) AS event_id, 'true' AS value FROM events WHERE value > 200 UNION ALL SELECT 'purchase_signal', CAST(event_id AS VARCHAR), event_type FROM events WHERE event_type = 'purchase' AND value > 150",
        "simulate_delta": " UNION ALL ".join([
            sim("total_score", _R.format(f"sum({base.format(_SCORE)})"), _R.format(f"sum({_SCORE})"), "event_type"),
            sim("events", f"count({base.format('1')})", "count(*)", "event_type"),
            sim("overall", _R.format(f"sum({base.format('value')})"), _R.format("sum(value)"), None),
            sim("number", f"count({base.format('1')})", "count(*)", None),
        ]),
        "enrich_left_join": "SELECT p_brand AS brand, count(*) AS lines FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
        "qa_anti_join": f"SELECT source, count(*) AS misses FROM documents WHERE lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) NOT IN (SELECT lower(unnest({user}))) GROUP BY 1",
        "view_metric_series": f"SELECT '' AS label, round(CAST(CAST({_R.format('sum(value)')} AS FLOAT) AS DOUBLE)) AS value, CAST(count(*) AS INTEGER) AS count, {_DAY} AS bucket FROM events WHERE event_type = 'purchase' GROUP BY 4 HAVING sum(value) > 0",
        "view_distribution": "SELECT event_type AS label, count(*) AS value, round(CAST(CAST(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS FLOAT) AS DOUBLE) * 100) / 100 AS percentage FROM events GROUP BY 1",
        "totals_distinct": f"SELECT 'users' AS total, CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM events UNION ALL SELECT 'value', {_R.format('sum(value)')} FROM events",
        **{f"bucket_{g}_offset": f"SELECT {b} AS bucket, count(*) AS n FROM events GROUP BY 1" for g, b in buckets.items()},
        "heatmap": f"WITH n AS (SELECT {_DAY} AS timestamp, count(*) AS count FROM events GROUP BY 1) SELECT timestamp, strftime(make_timestamp((timestamp + 19800000) * 1000), '%Y-%m-%d') AS date, count, CAST(CASE WHEN count / max(count) OVER () <= 0.25 THEN 1 WHEN count / max(count) OVER () <= 0.5 THEN 2 WHEN count / max(count) OVER () <= 0.75 THEN 3 ELSE 4 END AS INTEGER) AS level FROM n",
        "streaks": f"""
WITH d AS (SELECT DISTINCT event_type, {_DAY} AS day FROM events WHERE value > 250),
i AS (SELECT event_type, day, day - 86400000 * row_number() OVER (PARTITION BY event_type ORDER BY day) AS island FROM d),
r AS (SELECT event_type, count(*) AS n, min(day) AS a, max(day) AS b FROM i GROUP BY event_type, island)
SELECT event_type, CAST(CASE WHEN (({NOW} + 19800000) // 86400000 * 86400000 - 19800000) - max(b) < 2 * 86400000 THEN arg_max(n, b) ELSE 0 END AS BIGINT) AS current_streak,
       CAST(max(n) AS BIGINT) AS longest_streak, CAST(sum(n) AS BIGINT) AS total_days, max(b) AS last_day,
       arg_max(a, n * 1000000 + b // 86400000) AS longest_start, arg_max(b, n * 1000000 + b // 86400000) AS longest_end
FROM r GROUP BY event_type""",
        "catalog_find_by_tag": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS display_name FROM part WHERE (lower(p_brand) = 'brand#13' OR lower(p_type) = 'brand#13') AND p_size % 5 <> 0 AND p_size % 7 <> 0",
        "catalog_find_by_attribute": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS display_name FROM part WHERE p_size = 10",
        "catalog_visible": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS display_name FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0",
        "catalog_slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[ -]', '_', 'g'), '[^\\p{L}\\p{N}_]', '', 'g') AS slug, regexp_full_match(p_brand, '[\\p{L}\\p{N}_-]+') AS valid FROM part",
        "validate_events": """
SELECT code AS error_code, message, count(*) AS n FROM (
  SELECT CAST(CASE WHEN event_id % 10 > 5 THEN 0 WHEN event_id % 10 = 5 THEN 1101 ELSE 1100 END AS INTEGER) AS code,
         CASE event_id % 10 WHEN 0 THEN 'field ''user_id'' is not a valid int' WHEN 1 THEN 'event_id is required' WHEN 2 THEN 'ts is required'
              WHEN 3 THEN 'missing required field: user_id' WHEN 4 THEN 'payload must be an object' WHEN 5 THEN 'tracker mismatch' ELSE '' END AS message
  FROM events) GROUP BY 1, 2""",
        "week_labels": f"""
WITH d AS (SELECT TIMESTAMP '1990-12-26' + to_days(CAST(floor((i // 12) * 365.25 + i % 12) AS INTEGER)) AS t FROM range(480) r(i))
SELECT epoch_us(t) // 1000 AS ts, {_week('t')} AS week, year(t) || '-Q' || quarter(t) AS quarter FROM d""",
        "stream_ingest": _grouped("count(*)", where="event_id % 10 > 5"),
        "sqlite_round_trip": f"SELECT event_type, count(*) AS n, max({_MS}) AS last_ts FROM events GROUP BY 1",
    }
