"""The engine's calls over JSON texts: compile, validate, compute, simulate, export, import."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, views
from .operators.validate import check
from .plans.dsl import compile_tracker
from .plans.ir import MISSING, EngineError, ErrorCode, Query, TimeWindow
from .sources import json_events, sqlite


def parse_query(text: str | None) -> Query:
    """A blank or null query is the default one."""
    if text is None or not text.strip() or text.strip() == "null":
        return Query()
    try:
        q = json.loads(text)
    except ValueError as e:
        raise EngineError(f"query: {e}", ErrorCode.DESERIALIZATION_FAILED) from e
    w = q.get("time_window")
    return Query(TimeWindow(w["start"], w["end"]) if w else None, tuple(q.get("grains") or ()))


def _answer(fn: Any) -> str:
    try:
        return json.dumps({"success": True, "data": fn()}, sort_keys=True)
    except EngineError as e:
        return e.to_json()


def compile_json(dsl: str) -> str:
    def run() -> dict[str, Any]:
        t = compile_tracker(dsl)
        return {"tracker_id": t.id, "name": t.name, "version": list(t.version), "capabilities": t.capabilities()}

    return _answer(run)


def validate_event(spark: SparkSession, dsl: str, event: str) -> str:
    def run() -> dict[str, Any]:
        t = compile_tracker(dsl)
        r = check(t, spark.createDataFrame([(event,)], "json string")).select("event_id", "ts", "error_code", "message", F.to_json("payload_raw").alias("payload"), F.to_json("meta_raw").alias("meta")).first()
        if r["error_code"] is not None:
            raise EngineError(r["message"], ErrorCode(r["error_code"]))
        payload = json.loads(r["payload"] or "null") or {}
        for f in t.fields:
            if f.name not in payload and f.default is not MISSING:
                payload[f.name] = f.default
        return {"event_id": r["event_id"], "tracker_id": t.id, "ts": r["ts"], "payload": payload, "meta": json.loads(r["meta"] or "null") or {}}

    return _answer(run)


def _options() -> metrics.Options:
    return metrics.Options(strict=True, raw="payload_raw", meta="meta_raw")


def compute(spark: SparkSession, dsl: str, events: str, query: str | None = None) -> str:
    def run() -> dict[str, Any]:
        t = compile_tracker(dsl)
        return metrics.compute(t, json_events.parse_events(spark, t, events), parse_query(query), _options()).__dict__

    return _answer(run)


def simulate(spark: SparkSession, dsl: str, base: str, hypothetical: str, query: str | None = None) -> str:
    """Outputs of the base log and of both together, and the difference."""

    def run() -> dict[str, Any]:
        t = compile_tracker(dsl)
        frames = [json_events.parse_events(spark, t, x) for x in (base, hypothetical)]
        return metrics.simulation(t, *frames, parse_query(query), _options())

    return _answer(run)


def pack_query(spark: SparkSession, dsl: str, events: str, query: str, catalog: str | None = None, offset_minutes: int = 0, registry: views.Registry | None = None) -> str:
    def run() -> Any:
        t = compile_tracker(dsl)
        rows = json_events.catalog_rows(spark, catalog) if catalog else None
        found = views.run(t, json_events.pack_events(spark, t, events, "view"), query, rows, offset_minutes, registry, _options())
        return found.answer() if isinstance(found, views.ViewResult) else [r.asDict() for r in found.collect()]

    return _answer(run)


def export_bundle(path: str | None, trackers: DataFrame, events: DataFrame, kv_meta: DataFrame) -> str:
    """Write a bundle; the answer is its path."""
    return _answer(lambda: {"path": sqlite.export_bundle(path, trackers, events, kv_meta)})


def import_bundle(spark: SparkSession, path: str) -> str:
    """A bundle's tables as JSON; ``sqlite.import_bundle`` gives them as frames."""
    return _answer(lambda: {name: [r.asDict() for r in df.collect()] for name, df in sqlite.import_bundle(spark, path).items()})
