import json
import random

import pytest
from tests.interpreter import cond as row_cond
from tests.interpreter import value as row_value
from pyspark.sql import functions as F

from eventloom import api
from eventloom.functions.expressions import Compiler
from eventloom.functions.timefn import bucket, label
from eventloom.functions.values import normalize_key, render_key, round2
from eventloom.operators import metrics
from eventloom.operators.events import assert_derivable, derive, derive_event, typed
from eventloom.operators.metrics import Options
from eventloom.operators.validate import validate
from eventloom.plans import ir
from eventloom.plans.dsl import compile_tracker, expression
from eventloom.plans.ir import EngineError, Grain, MetricFilter, Query, TimeWindow
from eventloom.sources import json_events

RACE = """
tracker "race" v1 {
  fields { speed: float optional, gear: int optional, lane: text optional, flag: bool optional }
  derive { effort = if (gear != 0) then speed / gear + 1 else speed }
  metrics {
    whole_effort = sum(effort) over all_time
    mean_speed = avg(speed)
    top_speed = max(speed)
    rows = count(speed)
    flags = sum(flag)
    by_lane = sum(speed) by lane over week
    daily = count() over day
  }
  alerts { big = speed > 70 }
}
"""


def frame(spark, rows):
    t = compile_tracker(RACE)
    df = spark.createDataFrame([(f"e{i}", ts, a, b, g, f) for i, (ts, a, b, g, f) in enumerate(rows)], "event_id string, ts bigint, speed double, gear bigint, lane string, flag boolean")
    return t, typed(t, df)


def one(df):
    return df.first()["value"]


def test_derive_and_sum(spark):
    t, df = frame(spark, [(1000, 90.0, 4, "a", True), (2000, 33.0, 3, "a", None)])
    assert one(metrics.metric_by_name(t, df, "whole_effort")) == 35.5
    out = metrics.compute(t, df, Query(TimeWindow(1000, 1000)))
    assert (out.total_events, out.window_events, out.metrics["whole_effort"], out.metrics["window_event_count"]) == (2, 1, 23.5, 1.0)
    assert [a["event_id"] for a in out.alerts] == ["e0"]  # alerts ignore the window
    assert out.metrics["daily"] == {"1970-01-01": 1.0}


def test_nulls_and_empty(spark):
    t, df = frame(spark, [(0, None, None, None, True), (1, 1.0, 1, "null", True), (2, 2.0, None, "b", None)])
    get = lambda n: one(metrics.metric_by_name(t, df, n))
    assert (get("mean_speed"), get("top_speed"), get("rows"), get("flags")) == (1.5, 2.0, 3, 2.0)
    assert {r["group_key"]: r["value"] for r in metrics.metric_by_name(t, df, "by_lane").collect()} == {"null": 1.0, "b": 2.0}  # null meets "null"; by drops over
    empty = df.where("false")
    assert [one(metrics.metric_by_name(t, empty, n)) for n in ("whole_effort", "mean_speed", "rows")] == [0.0, None, 0]
    assert metrics.metric_by_name(t, empty, "by_lane").collect() == []
    assert one(metrics.metric_by_name(t, df, "by_lane", group_by=())) == 3.0


def test_filters_and_errors(spark):
    t, df = frame(spark, [(0, 1.0, 1, "a", True), (1, 2.0, 2, "b", True)])
    assert one(metrics.metric_by_name(t, df, "rows", filters=(MetricFilter("lane", "neq", "a"),))) == 1
    with pytest.raises(EngineError):
        metrics.metric_by_name(t, df, "rows", filters=(MetricFilter("speed", "eq", None),))
    with pytest.raises(EngineError):
        metrics.metric_by_name(t, df, "nothing")
    with pytest.raises(EngineError):
        metrics.compute(t, df.withColumn("tracker_id", F.lit("other")))
    with pytest.raises(EngineError):
        Compiler({"x": "num"}, "M").value(expression("x % 2"))
    with pytest.raises(EngineError):
        Compiler({"x": "num"}, "D").value(expression("lower(x)"))


def test_strict_raises(spark):
    t = compile_tracker('tracker "s" { fields { a: float optional } derive { b = 1 / a } metrics { m = count() } }')
    df = typed(t, spark.createDataFrame([("e", 1, 0.0)], "event_id string, ts bigint, a double"))
    assert derive_event(t, df.withColumn("a", F.lit(4.0))).first()["b"] == 0.25
    with pytest.raises(EngineError):
        derive_event(t, df.withColumn("tracker_id", F.lit("other")))
    assert derive(t, df)[0].first()["b"] is None
    with pytest.raises(Exception, match="division by zero"):
        assert_derivable(t, df)


def test_dialects(spark):
    df = spark.createDataFrame([(None, 0.0, False)], "x double, z double, f boolean")
    kinds = {"x": "num", "z": "num", "f": "bool"}
    d = lambda s: df.select(Compiler(kinds, "D").value(expression(s)).col.alias("v")).first()["v"]
    m = lambda s: df.select(Compiler(kinds, "M").value(expression(s)).col.alias("v")).first()["v"]
    assert d("f + 1") is None and m("f + 1") == 1.0
    assert d("if (f) then 1 else 2") == 1.0 and m("if (f) then 1 else 2") == 1.0
    assert d("if (z) then 1 else 2") == 1.0 and m("if (z) then 1 else 2") == 2.0
    assert d("if (x) then 1 else 2") == 2.0 and m("if (x) then 1 else 2") == 1.0
    assert d("if (x > 0) then 1") is None and m("if (x > 0) then 1") == 0.0
    assert d('"b" > "a"') is False and d("x == null") is True
    assert tuple(d('signal("s", 2)')) == ("s", 2.0)


def test_random_expressions(spark):
    rng = random.Random(5)
    rows = [{"x": rng.choice([None, 0.0, 1.5, -2.0]), "y": rng.choice([None, 3.0, 0.0]), "f": rng.choice([None, True, False]), "t": rng.choice([None, "a", ""])} for _ in range(40)]
    df = spark.createDataFrame([(i, r["x"], r["y"], r["f"], r["t"]) for i, r in enumerate(rows)], "i int, x double, y double, f boolean, t string")
    kinds = {"x": "num", "y": "num", "f": "bool", "t": "text"}

    def num(depth):
        if depth == 0:
            return rng.choice([ir.Ref("x"), ir.Ref("y"), ir.Lit(2.0), ir.Lit(0.0)])
        return rng.choice([lambda: ir.Arith(rng.choice("+-*/%" if mode == "D" else "+-*/"), num(depth - 1), num(depth - 1)), lambda: ir.If(test(depth - 1), num(depth - 1), num(depth - 1))])()

    def test(depth):
        atoms = [lambda: ir.Compare(rng.choice(["==", "!=", ">", ">=", "<", "<="]), num(max(0, depth - 1)), rng.choice([num(0), ir.Ref("f"), ir.Ref("t"), ir.Lit(None)]))]
        if depth:
            atoms += [lambda: ir.Logic(rng.choice(["&&", "||"]), test(depth - 1), test(depth - 1)), lambda: ir.Not(test(depth - 1))]
        return rng.choice(atoms)()

    for mode in ("D", "M"):
        nodes = [num(3) for _ in range(15)] + [test(3) for _ in range(15)]
        c = Compiler(kinds, mode)
        got = df.orderBy("i").select(*[c.value(n).col.alias(f"c{i}") for i, n in enumerate(nodes)]).collect()
        for g, row in zip(got, rows, strict=True):
            for i, n in enumerate(nodes):
                want = row_value(n, row, mode) if i < 15 else row_cond(n, row, mode)
                assert g[i] == (None if want is None else pytest.approx(want)) or (want is not None and want != want), (mode, n, row, g[i], want)


def test_labels_and_buckets(spark):
    ms = {"2024-12-30": 1735516800000, "2021-01-01": 1609459200000}
    df = spark.createDataFrame([(v,) for v in ms.values()] + [(1 << 62,)], "ts bigint")
    weeks = [r[0] for r in df.select(label(F.col("ts"), Grain.WEEK)).collect()]
    assert weeks == ["2024-W01", "2021-W53", "1970-W01"]

    def day(ts, off):
        local = ts + off * 60000
        return int(local / 86400000) * 86400000 - off * 60000

    rng = random.Random(1)
    pairs = [(rng.randrange(-10**12, 2 * 10**12), rng.choice([0, 330, -480])) for _ in range(60)]
    for off in (0, 330, -480):
        own = [t for t, o in pairs if o == off]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in own], "ts bigint").select(bucket(F.col("ts"), "day", off)).collect()]
        assert got == [day(t, off) for t in own]
    top = spark.createDataFrame([((1 << 63) - 1,)], "ts bigint").select(bucket(F.col("ts"), "month", 330).alias("m"), bucket(F.col("ts"), "day", 330).alias("d")).first()
    assert top["m"] == top["d"]


def test_values(spark):
    df = spark.createDataFrame([(1.005,), (-0.001,), (5.0,), (1704067200000.0,), (None,)], "x double")
    assert [r[0] for r in df.select(round2(F.col("x"))).collect()] == [1.0, 0.0, 5.0, 1704067200000.0, None]
    assert [r[0] for r in df.select(render_key(F.col("x"), "num")).collect()][2:] == ["5.0", "1704067200000.0", "null"]
    assert spark.range(1).select(normalize_key(F.lit("Bench-Press é"))).first()[0] == "benchpress"


def test_validation(spark):
    t = compile_tracker('tracker "v" { fields { a: float, n: int = 7, e: enum("x", "y") optional } metrics { m = count() } }')
    good = ['{"event_id":"1","ts":1,"payload":{"a":1,"e":null}}', '{"event_id":"2","ts":2,"payload":{"a":1.5,"n":3,"other":[1]},"meta":null}']
    bad = ['{"event_id":"1","ts":1,"payload":{"a":"oops"}}', '{"event_id":"1","ts":1,"payload":{}}', '{"event_id":"1","ts":1,"payload":{"a":1,"n":5.0}}', '{"event_id":"1","ts":1,"payload":{"a":1,"n":null}}', '{"event_id":"1","ts":1,"payload":{"a":1,"e":"z"}}', "not json", '{"ts":1}', '{"event_id":"1","ts":"1"}', '{"event_id":"1","ts":1,"payload":[],"meta":{}}', None]
    ok, rest = validate(t, spark.createDataFrame([(x,) for x in good + bad], "json string"))
    assert [(r["event_id"], r["a"], r["n"], r["e"]) for r in ok.orderBy("event_id").collect()] == [("1", 1.0, 7, None), ("2", 1.5, 3, None)]
    assert rest.count() == len(bad) and {r["error_code"] for r in rest.collect()} == {1100}


def test_simulation(spark):
    t, base = frame(spark, [(0, 1.0, 1, "a", True)])
    _, more = frame(spark, [(1, 5.0, 1, "b", True)])
    rows = {(r["metric"], r["group_key"]): (r["base"], r["hypothetical"], r["delta"]) for r in metrics.simulate(t, base, more).collect()}
    assert rows["whole_effort", None] == (2.0, 8.0, 6.0)
    assert rows["by_lane", "b"] == (None, 5.0, 5.0) and rows["by_lane", "a"] == (1.0, 1.0, 1.0)


def test_json_calls(spark):
    dsl = 'tracker "w" { fields { value: float optional } metrics { whole_effort = sum(value) over all_time\n per_day = count() over day } alerts { any = value > 1 } }'
    assert json.loads(api.compute(spark, dsl, "[]", ""))["data"]["metrics"]["whole_effort"] == 0.0
    assert json.loads(api.compile_json("nonsense"))["code"] == 1000
    assert json.loads(api.validate_event(spark, dsl, '{"event_id":"e","ts":1,"payload":{"value":"x"}}'))["code"] == 1100
    event = json.loads(api.validate_event(spark, dsl, '{"event_id":"e","ts":1,"payload":{"value":2.5}}'))["data"]
    out = json.loads(api.compute(spark, dsl, json.dumps([event])))
    assert out["data"]["metrics"]["whole_effort"] == 2.5 and out["data"]["total_events"] == 1
    # Alerts come in order of arrival, whatever the ids.
    log = json.dumps([{**event, "event_id": f"e{i}", "ts": i} for i in (9, 10, 2)])
    assert [a["event_id"] for a in json.loads(api.compute(spark, dsl, log))["data"]["alerts"]] == ["e9", "e10", "e2"]
    out = json.loads(api.simulate(spark, dsl, log, json.dumps([{**event, "event_id": "h", "ts": 5}]), '{"time_window": {"start": 3, "end": 9}}'))["data"]
    assert (out["base"]["total_events"], out["base"]["window_events"], out["hypothetical"]["window_events"]) == (3, 1, 2)
    assert out["delta"] == {"total_events_delta": 1, "metrics": {"per_day": {"1970-01-01": 2.0}, "whole_effort": 2.5, "window_event_count": 1.0}}
    assert [a["event_id"] for a in out["hypothetical"]["alerts"]] == ["e9", "e10", "e2", "h"]
    assert json.loads(api.simulate(spark, dsl, log, json.dumps([{**event, "tracker_id": "other"}])))["code"] == 1101


def test_undeclared_paths(spark):
    """Numbers, texts, booleans and objects of payload and meta that nothing declares."""
    t = compile_tracker('''tracker "open" { fields { a: float optional } derive { deep = payload.more.kind
      is_x = more.kind == "x"
      flag = meta.ok
      ahead = later + 1
      later = a }
      metrics { by_kind = sum(more.n) by deep
        flags = sum(meta.ok) }
      alerts { object = more
        text = meta.note } }''')
    rows = [{"more": {"kind": "x", "n": 2}}, {"more": {"kind": 5, "n": True}}, {"more": {"kind": {"y": 1}, "n": "7"}}, {"a": 1, "more": None}]
    metas = [{"ok": True, "note": ""}, {"ok": 3, "note": "n"}, {"ok": "true"}, {}]
    text = json.dumps([{"event_id": str(i), "tracker_id": t.id, "ts": i, "payload": p, "meta": m} for i, (p, m) in enumerate(zip(rows, metas, strict=True))])
    df = json_events.parse_events(spark, t, text)
    options = Options(raw="payload_raw", meta="meta_raw")
    assert {r["group_key"]: r["value"] for r in metrics.metric_by_name(t, df, "by_kind", options=options).collect()} == {"x": 2.0, "5.0": 1.0, "null": 0.0}
    assert one(metrics.metric_by_name(t, df, "flags", options=options)) == 4.0
    got = derive(t, df, raw="payload_raw", meta="meta_raw")[0].orderBy("event_id").collect()
    assert [r["is_x"] for r in got] == [True, False, False, False] and [r["ahead"] for r in got] == [None] * 4 and got[3]["later"] == 1
    found = metrics.alerts(t, df, options).orderBy("arrival", "ordinal").collect()
    assert [(r["event_id"], r["alert"], r["value"]) for r in found] == [("0", "object", '{"kind":"x","n":2}'), ("1", "object", '{"kind":5,"n":true}'), ("1", "text", "n"), ("2", "object", '{"kind":{"y":1},"n":"7"}')]


def test_groupings_in_one_pass(spark):
    """All metrics are what each is by itself, and come from one scan."""
    rng = random.Random(3)
    t, df = frame(spark, [(rng.randrange(0, 10**9), rng.choice([None, 1.5, 2.5]), rng.choice([None, 0, 2]), rng.choice([None, "a", "b"]), rng.choice([None, True])) for _ in range(60)])
    for events in (df, df.where("false")):
        for window in (None, TimeWindow(0, 5 * 10**8)):
            got = {(r["metric"], r["group_key"]): r["value"] for r in metrics.compute_metrics(t, events, window).collect()}
            want = {(m.name, r["group_key"]): r["value"] for m in t.metrics for r in metrics.metric_by_name(t, events, m.name, window=window).collect()}
            if window:
                want["window_event_count", None] = events.where("ts <= 500000000").count()
            assert got == want
    plan = metrics.compute_metrics(t, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_windows_reach_the_scan(spark, tmp_path):
    spark.sql("SELECT string(id) AS event_id, timestamp_millis(id * 1000) AS ts, double(id) AS speed FROM range(100)").write.parquet(str(tmp_path / "e"))
    t = compile_tracker(RACE)
    df = metrics.metric_by_name(t, typed(t, spark.read.parquet(str(tmp_path / "e"))), "rows", window=TimeWindow(5000, 9999))
    assert one(df) == 5 and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in df._jdf.queryExecution().toString()
