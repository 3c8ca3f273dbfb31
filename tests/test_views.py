import json

import pytest
from pyspark.sql import functions as F

from eventloom import api
from eventloom.operators import analytics, catalog, views
from eventloom.plans.ir import EngineError
from eventloom.sources import json_events, sqlite
from eventloom.streaming import ingest
from eventloom.operators.metrics import Options
from eventloom.plans.dsl import compile_tracker, read_tracker

BAKERY = """
tracker "bakery" v3 {
  fields { shop: text optional, oven: int optional, price: float optional, loaves: int optional, town: text optional, refund: float optional }
  derive { takings = if (price >= 1) then price * loaves - refund else 0 - refund }
  metrics {
    batches = count() over all_time
    earned = sum(takings) over all_time
    dearest = max(price) over all_time
  }
  views {
    view "ovens" {
      config = {"result_kind": "metric_series", "count_metric": "batches", "group_by": {"by_oven": {"field": "oven"}},
        "filters": {"only": {"field": "shop", "op": "eq", "type": "string"}}, "response_fields": {"shown": {"from_filter": "only"}},
        "metrics": {"money": {"metric": "earned"}, "top": {"metric": "dearest"}}}
    }
    view "towns" {
      config = {"result_kind": "distribution", "group_by": {"town": {"field": "town"}}, "metrics": {"money": {"metric": "earned"}},
        "enrich_fields": {"town": {"lookup_field": "shop", "lookup_fields": ["slug"], "catalog_field": "place"}},
        "totals": {"shops": {"kind": "distinct_count", "field": "shop", "coerce": "integer"}, "refunds": {"kind": "distinct_count", "field": "refund"},
                   "all": {"kind": "metric_total", "metric": "earned"}},
        "qa": {"strangers": {"kind": "catalog_lookup_miss", "event_field": "shop"}}}
    }
  }
  read_models { read_model "heat" { params = {"oven": {"type": "number"}}
    fields = {"rows": {"type": "number"}} } }
}
"""
# Takings: 12.5, 7, 3, -4; the second north oven earns nothing.
ROWS = [
    {"shop": "North Lane", "oven": 7, "price": 2.5, "loaves": 5, "refund": 0}, {"shop": "North Lane", "oven": 7, "price": 1.0, "loaves": 8, "refund": 1},
    {"shop": "North Lane", "oven": 9, "price": 0.5, "loaves": 3, "refund": 0, "town": None}, {"shop": "quay", "oven": 7, "price": 3.0, "loaves": 2, "refund": 3, "town": "Own"},
    {"shop": "Elsewhere", "oven": 2, "price": 0.25, "loaves": 1, "refund": 4}, {"oven": 2, "price": 1.5, "loaves": 0, "refund": 0, "shop": None},
]
EVENTS = json.dumps([{"ts": 50 * i, "payload": r} for i, r in enumerate(ROWS)])
CATALOG = '[{"slug": "North Lane", "place": "Hill"}, {"slug": "quay", "place": "Port"}, {"slug": "northlane", "place": "Late"}]'


def ask(spark, **q):
    return json.loads(api.pack_query(spark, BAKERY, EVENTS, json.dumps(q)))


def test_series(spark):
    out = ask(spark, view="ovens", metric="money", group_by="by_oven", only="North Lane")["data"]
    assert out == {"metric": "money", "group_by": "by_oven", "shown": "North Lane", "points": [{"label": "", "value": 19.5, "count": 2, "bucket": 7}]}  # nothing without value
    out = ask(spark, view="ovens", metric="top", group_by="by_oven", only="North Lane")["data"]
    assert [(p["bucket"], p["value"], p["count"]) for p in out["points"]] == [(7, 2.5, 2), (9, 0.5, 1)]


def test_query_errors(spark):
    assert "metric" in ask(spark, view="ovens", metric="none", group_by="by_oven", only="a")["message"]
    assert "filter" in ask(spark, view="ovens", metric="top", group_by="by_oven", only="a", other=1)["message"]
    assert "missing required" in ask(spark, view="ovens", metric="top", group_by="by_oven")["message"]
    assert "expects" in ask(spark, view="ovens", metric="top", group_by="by_oven", only=5)["message"]
    assert ask(spark, read_model="heat", oven="x")["code"] == 1100


def test_distribution_totals_and_qa(spark):
    query = json.dumps({"view": "towns", "metric": "money", "group_by": "town"})
    out = json.loads(api.pack_query(spark, BAKERY, EVENTS, query, CATALOG))["data"]
    # Losses are no part of a whole; a town that is there, though null, is kept; "Elsewhere" finds none.
    assert [(p["label"], p["value"], round(p["percentage"], 2)) for p in out["items"]] == [("Hill", 19.5, 86.67), ("Own", 3.0, 13.33)]
    assert out["metric"] == "money" and out["totals"] == {"shops": 4, "refunds": 4, "all": 18.5} and out["strangers"] == 1


def test_distinct_counts_tell_nulls_from_what_is_missing(spark):
    t = compile_tracker('tracker "d" { fields { v: float optional, w: float optional } derive { twice = v * 2 } metrics { m = count() } }')
    spec = {"totals": {k: {"kind": "distinct_count", "field": k} for k in ("v", "twice", "other")}}
    rows = [{"v": 1}, {}, {"v": 2}, {"v": None}, {"v": 1, "other": [1]}, {"other": [1]}, {"other": "x"}]
    df = json_events.pack_events(spark, t, json.dumps([{"ts": 0, "payload": r} for r in rows]))
    found = {r["total"]: r["value"] for r in views.totals(t, df, spec, Options(raw="payload_raw")).collect()}
    assert found == {"v": 3, "twice": 3, "other": 2}
    assert {r["total"]: r["value"] for r in views.totals(t, df, spec).collect()}["v"] == 2  # columns alone: a null is missing


def test_read_model(spark):
    registry = views.Registry()

    @registry.read_model("heat")
    def heat(events, offset, cat, oven):
        return events.where(F.col("oven") == oven).agg(F.count(F.lit(1)).alias("rows"))

    assert json.loads(api.pack_query(spark, BAKERY, EVENTS, '{"read_model": "heat", "oven": 7}', registry=registry))["data"] == [{"rows": 3}]


def test_enrichment(spark):
    cat = spark.createDataFrame([(0, "Rye Loaf", "dark"), (1, "rye loaf", "other"), (2, "", "none")], "ord int, slug string, crumb string")
    events = spark.createDataFrame([(1, "Rye Loaf"), (2, "ryeloaf"), (3, "RYE LOAF"), (4, None), (5, "")], "id int, bread string")
    config = {"enrich_fields": {"crumb": {"lookup_field": "bread", "lookup_fields": ["slug"], "catalog_field": "crumb"}}}
    got = {r["id"]: r["crumb"] for r in views.enrich(events, cat, config, order="ord").collect()}
    assert got == {1: "dark", 2: "dark", 3: None, 4: None, 5: None}
    assert views.enrich(events, cat, {"enrich_fields": {"crumb": {"lookup_field": "bread", "lookup_fields": []}}}).columns == events.columns


def test_analytics(spark):
    day = 86_400_000
    ts = lambda xs: spark.createDataFrame([(x,) for x in xs], "ts bigint")
    assert [(r["count"], r["level"]) for r in analytics.heatmap(ts([0, 1000, day + 10, day + 1000, day + 2000])).collect()] == [(2, 3), (3, 4)]
    assert analytics.heatmap(ts([1772856000000]), 330).first()["date"] == "2026-03-07"
    base = 1704067200000
    run = lambda days, now: analytics.streaks(ts([base + d * day for d in days]), base + now * day).first()
    r = run([0, 1, 5, 6, 7], 8)
    assert (r["longest_streak"], r["current_streak"], r["total_days"], r["longest_start"], r["longest_end"]) == (3, 3, 5, base + 5 * day, base + 7 * day)
    r = run([0, 1, 4, 5], 20)
    assert (r["longest_streak"], r["current_streak"], r["longest_start"]) == (2, 0, base + 4 * day)
    r = run([], 0)
    assert (r["longest_streak"], r["current_streak"], r["total_days"], r["last_day"]) == (0, 0, 0, None)
    items = spark.createDataFrame([("arms", 20.0), ("legs", 50.0), ("chest", 30.0)], "label string, value double")
    got = analytics.distribution(items).collect()
    assert got[0]["label"] == "legs" and abs(sum(r["percentage"] for r in got) - 100) < 0.001
    assert {r["percentage"] for r in analytics.distribution(items.withColumn("value", F.lit(0.0))).collect()} == {0.0}


def test_catalog(spark):
    rows = [("1", "Test Entry", "test_entry", {"old": "v"}, ["Tag1"], False, False), ("2", "Other", "bad slug!", {}, [], False, False), ("3", "Gone", "gone", {"old": "v"}, ["tag1"], True, False), ("4", "", "x", None, None, None, None)]
    c = spark.createDataFrame(rows, "id string, display_name string, slug string, attributes map<string,string>, tags array<string>, archived boolean, hidden boolean")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(catalog.find_by_tag(c, "TAG1")) == ["1"] and ids(catalog.find_by_attribute(c, "old", "v")) == ["1", "3"] and ids(catalog.visible(c)) == ["1", "2", "4"]
    assert [r["error"] for r in catalog.validate(c, required=("old",)).orderBy("id").collect()] == [None, "slug is invalid", None, "display name is empty"]
    slugs = spark.createDataFrame([("Test Entry",), ("Test-Entry!",), ("Test 123",)], "s string").select(catalog.sanitize_slug(F.col("s"))).collect()
    assert [s[0] for s in slugs] == ["test_entry", "test_entry", "test_123"]
    m = catalog.Migrations()
    m.register(catalog.rename_attribute("old", "new"))
    moved = m.migrate(c, catalog.Version(1, 0, 0), catalog.Version(1, 1, 0)).where("id = '1'").first()
    assert moved["attributes"] == {"new": "v"}
    assert ids(catalog.add(c, c.where("id = '1'").withColumn("display_name", F.lit("z")))) == ["1", "2", "3", "4"] and ids(catalog.remove(c, "2")) == ["1", "3", "4"]
    tags = spark.createDataFrame([("a", ["ONE"]), (" ", ["two"]), ("c", ["É"]), ("", [])], "display_name string, tags array<string>").withColumns({"slug": F.lit("s"), "attributes": F.create_map().cast("map<string,string>")})
    assert [r["error"] for r in catalog.validate(tags, allowed_tags=("one", "Two", "é")).collect()] == [None, None, "tag is not allowed", "display name is empty"]
    twice = spark.createDataFrame([("1", "first"), ("1", "last"), ("9", "new")], "id string, display_name string")
    assert sorted((r["id"], r["display_name"]) for r in catalog.add(c, twice).where("id IN ('1', '9')").collect()) == [("1", "last"), ("9", "new")]
    with pytest.raises(EngineError):
        catalog.Version.parse("1.2")
    assert catalog.Version.parse("1.4.0").compatible(catalog.Version(1, 0, 9)) and str(catalog.Version(2, 0, 1)) == "2.0.1"
    n = catalog.Migrations()
    n.register(catalog.no_op(catalog.Version(1, 0, 0), catalog.Version(2, 0, 0)))
    assert n.migrate(c, catalog.Version(1, 0, 0), catalog.Version(2, 0, 0)).where("id = '1'").first()["attributes"] == {"old": "v"}
    kinds = spark.createDataFrame([("Custom", "A_b"), ("builtin", "x"), (None, "y")], "source string, slug string").select(catalog.editable(F.col("source")), catalog.id_from_slug(F.col("slug"))).collect()
    assert [tuple(k) for k in kinds] == [(True, "a_b"), (False, "x"), (False, "y")]
    store = json_events.MemoryCatalog(spark)
    store.save(spark.createDataFrame([], json_events.SCHEMA))
    assert not store.exists("1") and json_events.catalog_file(spark, "/nowhere.json").count() == 0
    with pytest.raises(EngineError):
        json_events.ReadOnlyCatalog(spark, "/nowhere.json").save()


def test_sqlite(spark, tmp_path):
    table = lambda rows, name: spark.createDataFrame(rows, sqlite.TABLES[name][0])
    kv, trackers = table([("k", "1")], "kv_meta"), table([("t", "dsl", None, None)], "trackers")
    path = sqlite.export_bundle(str(tmp_path / "a.sqlite"), trackers, table([("e", "t", 5, "{}", None)], "events"), kv)
    back = sqlite.import_bundle(spark, path)
    assert tuple(back["events"].first()) == ("e", "t", 5, "{}", None) and back["trackers"].count() == back["kv_meta"].count() == 1
    with pytest.raises(EngineError):
        sqlite.export_bundle(path, trackers, table([("e", "t", 5, "{}", None)] * 2, "events"), kv)
    bad = sqlite.export_bundle(str(tmp_path / "b.sqlite"), trackers, table([("e", "t", 5, "{bad", None)], "events"), kv)
    with pytest.raises(Exception, match="events.payload_json"):
        sqlite.import_bundle(spark, bad)["events"].collect()


def test_files(spark, tmp_path):
    (tmp_path / "t.dsl").write_text('tracker "f" { fields { slug: text } catalog { entry "e" { base_source = "main"\n fields = {"slug": {"type": "string"}} } } metrics { m = count() } }')
    (tmp_path / "base.json").write_text('[{"slug": "a", "size": 2}]')
    t = read_tracker(spark, str(tmp_path / "t.dsl"))
    assert [(r["slug"], r["size"]) for r in json_events.base_catalog(spark, t, {"main": str(tmp_path / "base.json")}).collect()] == [("a", "2")]
    for broken in (lambda: json_events.base_catalog(spark, t, {}), lambda: json_events.base_catalog(spark, t, {"main": "/none.json"}), lambda: read_tracker(spark, "/none.dsl")):
        with pytest.raises(EngineError):
            broken()
    none = compile_tracker('tracker "g" { fields { a: int } metrics { m = count() } }')
    assert json_events.base_catalog(spark, none, {}) is None
    two = compile_tracker('tracker "h" { fields { a: int } catalog { entry "x" { base_source = "p"\n fields = {} } entry "y" { base_source = "q"\n fields = {} } } }')
    with pytest.raises(EngineError, match="p, q"):
        json_events.base_catalog(spark, two, {"p": "x"})


def test_stream(spark, tmp_path):
    t = compile_tracker('tracker "s" { fields { v: float } metrics { m = sum(v) } }')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"event_id":"1","ts":9,"payload":{"v":1}}\n{"event_id":"2","ts":3,"payload":{"v":2}}\nbad\n')
    source = spark.readStream.format("text").load(str(tmp_path / "in")).withColumnRenamed("value", "json")
    log = str(tmp_path / "log")
    ingest.ingest(t, source, log, str(tmp_path / "c")).awaitTermination()
    assert ingest.read_log(spark, t, log).count() == 2
    delta = spark.read.parquet(f"{log}/deltas").first()
    assert (delta["total_events_delta"], delta["last_event_id"], delta["last_event_ms"]) == (2, "2", 3)
    assert [tuple(r) for r in ingest.read_quarantine(spark, log).collect()] == [("bad", 1100, "event must be an object")]
    more = ingest.read_log(spark, t, log).limit(1)
    both, delta = ingest.apply(t, ingest.read_log(spark, t, log), more)
    assert both.count() == 3 and delta.first()["total_events_delta"] == 1
    with pytest.raises(EngineError) as e:
        ingest.apply(t, more.withColumn("tracker_id", F.lit("other")), more)
    assert e.value.code == 1102
