"""Events from JSON texts: engine arrays, pack arrays and catalog files."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import SCHEMA
from ..plans import ir
from ..plans.ir import EngineError, ErrorCode


def _array(text: str, what: str) -> list[dict]:
    try:
        found = json.loads(text)
    except ValueError as e:
        raise EngineError(f"{what}: {e}", ErrorCode.DESERIALIZATION_FAILED) from e
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise EngineError(f"{what} must be an array of objects", ErrorCode.DESERIALIZATION_FAILED)
    return found


def _typed(spark: SparkSession, tracker: ir.Tracker, rows: list[tuple[str, str, int, str, str]]) -> DataFrame:
    numbered = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "event_id string, tracker_id string, ts bigint, payload string, meta string, arrival bigint")
    df = df.withColumns({"payload_raw": F.parse_json("payload"), "meta_raw": F.parse_json("meta")})
    fields = [F.try_variant_get("payload_raw", f"$['{f.name}']", f.type.spark).alias(f.name) for f in tracker.fields]
    return df.select("event_id", "tracker_id", "ts", *fields, "payload_raw", "meta_raw", "arrival")


def parse_events(spark: SparkSession, tracker: ir.Tracker, text: str) -> DataFrame:
    """An array of normalized events; each needs all five members."""
    rows = []
    for e in _array(text, "events"):
        if missing := {"event_id", "tracker_id", "ts", "payload", "meta"} - e.keys():
            raise EngineError(f"event lacks {sorted(missing)}", ErrorCode.DESERIALIZATION_FAILED)
        rows.append((e["event_id"], e["tracker_id"], e["ts"], json.dumps(e["payload"]), json.dumps(e["meta"])))
    return _typed(spark, tracker, rows)


def pack_events(spark: SparkSession, tracker: ir.Tracker, text: str, prefix: str = "pack") -> DataFrame:
    """An array of ``{ts, payload}``; ids are ``pack-{index}-{ts}``."""
    rows = [(f"{prefix}-{i}-{e['ts']}", tracker.id, e["ts"], json.dumps(e.get("payload", {})), "{}") for i, e in enumerate(_array(text, "events"))]
    return _typed(spark, tracker, rows)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw events, a JSON object on each line, as column ``json``."""
    return spark.read.text(path).withColumnRenamed("value", "json")


def catalog_rows(spark: SparkSession, text: str) -> DataFrame:
    """A view's catalog argument: an array of objects with any fields, all as text."""
    rows = _array(text, "catalog")
    names = list(dict.fromkeys(k for r in rows for k in r)) or ["slug"]
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    schema = "catalog_row bigint, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, *[plain(r.get(n)) for n in names]) for i, r in enumerate(rows)], schema)


def base_catalog(spark: SparkSession, tracker: ir.Tracker, sources: dict[str, str]) -> DataFrame | None:
    """The catalog that a tracker's entries are based on, from the path under its source's
    name; None if it names none. A tracker has one source at most."""
    names = sorted({c.base_source for c in tracker.catalog if c.base_source})
    if len(names) > 1:
        raise EngineError(f"a tracker has one base catalog, not {len(names)}: {', '.join(names)}", ErrorCode.CATALOG_VALIDATION_FAILED)
    if not names:
        return None
    if names[0] not in sources:
        raise EngineError(f"no file for the base catalog '{names[0]}'", ErrorCode.CATALOG_ENTRY_NOT_FOUND)
    try:
        return catalog_rows(spark, spark.read.text(sources[names[0]], wholetext=True).first()[0])
    except AnalysisException as e:
        raise EngineError(f"no base catalog at {sources[names[0]]}", ErrorCode.FILE_IO_ERROR) from e


def catalog_file(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries of a JSON file; a missing file has none."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    df = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if "://" not in path:
        with open(path) as f:
            _array(f.read(), "catalog")
    return df


class ReadOnlyCatalog:
    """A catalog file that cannot be written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        return catalog_file(self.spark, self.path)

    def load_custom(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def exists(self, entry_id: str) -> bool:
        return False

    def save(self, *_: object) -> None:
        raise EngineError("the storage is read-only", ErrorCode.STORAGE_ERROR)

    delete = save


class MemoryCatalog:
    """Catalog entries in a frame; every load gives them all."""

    def __init__(self, spark: SparkSession) -> None:
        self.df = spark.createDataFrame([], SCHEMA)

    def load(self) -> DataFrame:
        return self.df

    load_custom = load_defaults = load

    def save(self, entries: DataFrame) -> None:
        from ..operators.catalog import add

        self.df = add(self.df, entries)

    def delete(self, entry_id: str) -> None:
        from ..operators.catalog import remove

        self.df = remove(self.df, entry_id)

    def exists(self, entry_id: str) -> bool:
        return bool(self.df.where(F.col("id") == entry_id).limit(1).collect())
