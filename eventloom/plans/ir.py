"""What a compiled tracker is made of, and the engine's errors."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field, replace
from enum import Enum, IntEnum
from typing import Any


class ErrorCode(IntEnum):
    """The error codes of the wire format."""

    SUCCESS = 0
    DSL_PARSE_ERROR = 1000
    DSL_SYNTAX_ERROR = 1001
    DSL_INVALID_VERSION = 1002
    DSL_UNKNOWN_TYPE = 1003
    DSL_INVALID_EXPRESSION = 1004
    DSL_UNCLOSED_DELIMITER = 1005
    DSL_UNEXPECTED_TOKEN = 1006
    EVENT_VALIDATION_FAILED = 1100
    TRACKER_MISMATCH = 1101
    STATE_MISMATCH = 1102
    FIELD_NOT_FOUND = 1103
    TYPE_MISMATCH = 1104
    REQUIRED_FIELD_MISSING = 1105
    INVALID_FIELD_VALUE = 1106
    SCHEMA_VALIDATION_FAILED = 1107
    INVALID_TIMESTAMP = 1108
    INVALID_EVENT_ID = 1109
    METRIC_EVALUATION_FAILED = 1200
    DIVISION_BY_ZERO = 1201
    AGGREGATION_ERROR = 1202
    EXPRESSION_ERROR = 1203
    CIRCULAR_DEPENDENCY = 1204
    INVALID_AGGREGATION = 1205
    INVALID_TIME_WINDOW = 1206
    CATALOG_ENTRY_NOT_FOUND = 1300
    CATALOG_ENTRY_EXISTS = 1301
    CATALOG_VALIDATION_FAILED = 1302
    CATALOG_MIGRATION_FAILED = 1303
    CATALOG_VERSION_MISMATCH = 1304
    PLANNING_NO_BASELINE = 1400
    PLANNING_INVALID_STRATEGY = 1401
    PLANNING_SIMULATION_FAILED = 1402
    PLANNING_NO_CANDIDATES = 1403
    SERIALIZATION_FAILED = 1500
    DESERIALIZATION_FAILED = 1501
    STORAGE_ERROR = 1502
    FFI_BINDING_ERROR = 1503
    SQLITE_ERROR = 1504
    FILE_IO_ERROR = 1505
    UNKNOWN = 65535

    @property
    def category(self) -> str:
        names = {10: "parsing", 11: "validation", 12: "evaluation", 13: "catalog", 14: "planning", 15: "storage"}
        return "success" if self == 0 else names.get(self // 100, "unknown")

    @property
    def severity(self) -> str:
        """How bad an error of the code is, unless it says so itself."""
        if self == 0:
            return "success"
        if self.name in ("FIELD_NOT_FOUND", "CATALOG_ENTRY_NOT_FOUND", "PLANNING_NO_CANDIDATES"):
            return "warning"
        return "fatal" if self.name in ("DIVISION_BY_ZERO", "CIRCULAR_DEPENDENCY", "STORAGE_ERROR", "SQLITE_ERROR", "FILE_IO_ERROR") else "error"


class EngineError(Exception):
    """An error with its code and, where known, its statement and context."""

    def __init__(self, message: str, code: ErrorCode = ErrorCode.UNKNOWN, *, line: int | None = None, context: dict[str, Any] | None = None, severity: str | None = None) -> None:
        super().__init__(message)
        self.message, self.code, self.line, self.severity = message, code, line, severity or code.severity
        self.context, self.timestamp_ms = dict(context or {}), time.time_ns() // 1_000_000

    def to_json(self) -> str:
        out: dict[str, Any] = {"code": int(self.code), "message": self.message, "context": self.context, "severity": self.severity, "timestamp_ms": self.timestamp_ms}
        if self.line is not None:
            out["source_location"] = {"line": self.line}
        return json.dumps(out)


def is_error_response(text: str) -> bool:
    """Whether a response is an error's JSON rather than a result's."""
    return text.lstrip().startswith("{") and '"code"' in text


def parse_error(message: str, line: int | None = None, text: str | None = None) -> EngineError:
    context = {k: v for k, v in (("line", line), ("text", text)) if v is not None}
    return EngineError(message, ErrorCode.DSL_PARSE_ERROR, line=line, context=context)


class Type(str, Enum):
    TEXT = "text"
    FLOAT = "float"
    INT = "int"
    BOOL = "bool"
    DURATION = "duration"
    TIMESTAMP = "timestamp"
    ENUM = "enum"

    @property
    def spark(self) -> str:
        return {"text": "string", "enum": "string", "float": "double", "duration": "double", "int": "bigint", "timestamp": "bigint", "bool": "boolean"}[self.value]


class Grain(str, Enum):
    DAY = "day"
    WEEK = "week"
    MONTH = "month"
    QUARTER = "quarter"
    YEAR = "year"
    ALL_TIME = "all_time"
    CUSTOM = "custom"


#: "No default" differs from a default of null.
MISSING = object()


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    optional: bool = False
    default: Any = MISSING
    variants: tuple[str, ...] = ()


# Expressions.


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    path: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class If:
    cond: Any
    then: Any
    other: Any = None  # an omitted else


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Derive:
    name: str
    expr: Any


@dataclass(frozen=True)
class Metric:
    name: str
    func: str
    target: Any = None
    group_by: tuple[str, ...] = ()
    over: Grain | None = None


@dataclass(frozen=True)
class Alert:
    name: str
    expr: Any


@dataclass(frozen=True)
class Strategy:
    name: str
    params: dict[str, Any]


@dataclass(frozen=True)
class View:
    name: str
    params: dict[str, Any]

    @property
    def config(self) -> dict[str, Any]:
        found = self.params.get("config")
        return found if isinstance(found, dict) else {}


@dataclass(frozen=True)
class SchemaField:
    name: str
    type: str
    optional: bool = False


@dataclass(frozen=True)
class CatalogEntryDef:
    name: str
    fields: tuple[SchemaField, ...]
    base_source: str | None = None
    compat: dict[str, str] = field(default_factory=dict)
    validate_helper: str | None = None


@dataclass(frozen=True)
class ReadModel:
    name: str
    fields: tuple[SchemaField, ...]
    params: tuple[SchemaField, ...] = ()
    filters: tuple[str, ...] = ()
    query_type: str | None = None
    response_type: str | None = None
    config: Any = None


@dataclass(frozen=True)
class TypeDef:
    name: str
    kind: str = "object"
    fields: tuple[SchemaField, ...] = ()
    variants: tuple[str, ...] = ()
    target: str | None = None
    emit_ts: bool = True
    emit_rust: bool = False
    contract: str | None = None


@dataclass(frozen=True)
class Function:
    """A host function: a helper or an import."""

    name: str
    params: tuple[SchemaField, ...]
    return_type: str
    fallible: bool = False


@dataclass(frozen=True)
class Tracker:
    """A compiled tracker definition."""

    name: str
    version: tuple[int, int, int]
    dsl: str
    fields: tuple[Field, ...]
    derives: tuple[Derive, ...] = ()
    metrics: tuple[Metric, ...] = ()
    alerts: tuple[Alert, ...] = ()
    planning: tuple[Strategy, ...] | None = None
    views: tuple[View, ...] = ()
    catalog: tuple[CatalogEntryDef, ...] = ()
    read_models: tuple[ReadModel, ...] = ()
    types: tuple[TypeDef, ...] = ()
    helpers: tuple[Function, ...] = ()
    imports: tuple[Function, ...] = ()
    extern_ts: dict[str, Any] = field(default_factory=dict)
    compat: dict[str, Any] = field(default_factory=dict)

    @property
    def id(self) -> str:
        given = self.compat.get("tracker_id_override")
        if isinstance(given, str) and given:
            return given
        slug = "".join(c.lower() if c.isalnum() else "_" for c in self.name)
        return f"{slug}_v{self.version[0]}_{hashlib.sha256(self.dsl.encode()).hexdigest()[:8]}"

    def metric(self, name: str) -> Metric:
        for m in self.metrics:
            if m.name == name:
                return m
        raise EngineError(f"unknown metric: {name}", ErrorCode.METRIC_EVALUATION_FAILED)

    def view(self, name: str) -> View:
        for v in self.views:
            if v.name == name:
                return v
        raise EngineError(f"unknown view: {name}", ErrorCode.METRIC_EVALUATION_FAILED)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def payload_schema(self) -> str:
        """The declared fields as a Spark struct type."""
        return "struct<" + ",".join(f"`{f.name}`:{f.type.spark}" for f in self.fields) + ">"

    def with_metrics(self, *metrics: Metric) -> Tracker:
        return replace(self, metrics=metrics)

    def capabilities(self) -> dict[str, Any]:
        """Views, catalog entries and read models, as a host would list them."""
        return {
            "tracker_id": self.id,
            "views": [{"name": v.name, "metrics": sorted(v.config.get("metrics", {})), "group_by": sorted(v.config.get("group_by", {})), "filters": sorted(v.config.get("filters", {})), "result_kind": v.config.get("result_kind", "metric_series")} for v in self.views],
            "catalog": [{"name": c.name, "fields": [f.name for f in c.fields], "base_source": c.base_source} for c in self.catalog],
            "read_models": [{"name": r.name, "params": [p.name for p in r.params], "fields": [f.name for f in r.fields]} for r in self.read_models],
        }


@dataclass(frozen=True)
class TimeWindow:
    """Epoch milliseconds, both ends included."""

    start: int
    end: int


@dataclass(frozen=True)
class MetricFilter:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Query:
    """``grains`` is accepted and has no effect."""

    time_window: TimeWindow | None = None
    grains: tuple[str, ...] = ()
