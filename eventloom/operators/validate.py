"""Raw JSON events to normalized ones, with the rest in quarantine.

Kinds are read from VARIANT values, so that one bad field does not hide the
others. The first failing check of a row gives its code and message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ir
from ..plans.ir import ErrorCode

_OBJECT, _INTEGER = "^OBJECT", "^(BIGINT|INT|SMALLINT|TINYINT)$"
_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _kind(v: Column) -> Column:
    """The kind of a VARIANT, ``VOID`` for JSON null, null if there is none."""
    return F.schema_of_variant(v)


def _fits(f: ir.Field, kind: Column, value: Column) -> Column:
    if f.type is ir.Type.TEXT:
        ok = kind == "STRING"
    elif f.type is ir.Type.ENUM:
        ok = (kind == "STRING") & F.try_variant_get(value, "$", "string").isin(*f.variants)
    elif f.type is ir.Type.BOOL:
        ok = kind == "BOOLEAN"
    elif f.type in (ir.Type.FLOAT, ir.Type.DURATION):
        ok = kind.rlike(_NUMBER)
    else:  # an integer as it is written: 5.0 is none
        ok = kind.rlike(_INTEGER)
    return ok | (F.lit(f.optional) & (kind == "VOID"))


def check(tracker: ir.Tracker, raw: DataFrame, column: str = "json") -> DataFrame:
    """``raw`` with the event's parts, ``error_code`` and ``message`` (null if valid).

    Parts, kinds, the number of the first fault and its texts are projections one
    after the other, so that nothing is parsed twice and the code stays small.
    """
    v = F.col("event")
    df = raw.withColumn("event", F.try_parse_json(F.col(column)))
    df = df.withColumns({
        "event_kind": _kind(v),
        "event_id": F.when(_kind(_at(v, "event_id")) == "STRING", F.try_variant_get(v, "$.event_id", "string")),
        "ts": F.when(_kind(_at(v, "ts")).rlike(_INTEGER), F.try_variant_get(v, "$.ts", "bigint")),
        "given_tracker": F.when(_kind(_at(v, "tracker_id")) == "STRING", F.try_variant_get(v, "$.tracker_id", "string")),
        "payload_raw": _at(v, "payload"),
        "meta_raw": _at(v, "meta"),
    })
    p = F.col("payload_raw")
    df = df.withColumns({"payload_kind": _kind(p), "meta_kind": _kind(F.col("meta_raw")), **{f"kind_{i}": _kind(_at(p, f.name)) for i, f in enumerate(tracker.fields)}})
    object_or_nothing = lambda c: F.coalesce(F.col(c).rlike(_OBJECT) | (F.col(c) == "VOID"), F.lit(True))
    failed = ErrorCode.EVENT_VALIDATION_FAILED
    checks = [
        (F.coalesce(~F.col("event_kind").rlike(_OBJECT), F.lit(True)), failed, "event must be an object"),
        (F.coalesce(F.col("event_id") == "", F.lit(True)), failed, "event_id is required"),
        (F.col("ts").isNull(), failed, "ts is required"),
        (F.coalesce(F.col("given_tracker") != tracker.id, F.lit(False)), ErrorCode.TRACKER_MISMATCH, "tracker mismatch"),
        (~object_or_nothing("payload_kind"), failed, "payload must be an object"),
        (~object_or_nothing("meta_kind"), failed, "meta must be an object"),
    ]
    for i, f in enumerate(tracker.fields):
        kind = F.col(f"kind_{i}")
        if not f.optional and f.default is ir.MISSING:
            checks.append((kind.isNull(), failed, f"missing required field: {f.name}"))
        checks.append((kind.isNotNull() & ~F.coalesce(_fits(f, kind, _at(p, f.name)), F.lit(False)), failed, f"field '{f.name}' is not a valid {f.type.value}"))
    fault = None
    for i, (bad, _, _) in enumerate(checks, 1):
        fault = F.when(bad, i) if fault is None else fault.when(bad, i)
    # A generator of one row: no filter on the fault is pushed below it, which would
    # write all checks out again.
    df = df.select("*", F.explode(F.array(fault.otherwise(0))).alias("fault"))
    codes, messages = (F.array(*[F.lit(x) for x in xs]) for xs in ([None, *(int(c) for _, c, _ in checks)], [None, *(m for _, _, m in checks)]))
    df = df.withColumns({"error_code": F.get(codes, F.col("fault")), "message": F.get(messages, F.col("fault"))})
    return df.drop("event_kind", "payload_kind", "meta_kind", "fault", *[f"kind_{i}" for i in range(len(tracker.fields))])


def with_fields(tracker: ir.Tracker, checked: DataFrame) -> DataFrame:
    """Checked rows with ``tracker_id`` and the payload's fields as columns."""
    fields = {}
    for f in tracker.fields:
        value = _at(F.col("payload_raw"), f.name)
        got = F.try_variant_get(F.col("payload_raw"), f"$['{f.name}']", f.type.spark)
        default = F.lit(None) if f.default is ir.MISSING else F.lit(f.default)
        # A default fills what is absent, never a null that is there.
        fields[f.name] = F.when(_kind(value).isNull(), default).otherwise(got).cast(f.type.spark)
    return checked.withColumns({"tracker_id": F.lit(tracker.id), **fields})


def validate(tracker: ir.Tracker, raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Valid events as an event frame (with ``payload_raw`` and ``meta_raw``), and the
    quarantine: the raw column, ``error_code`` and ``message``. They are two branches of
    one plan, so that what uses both does well to write ``check``'s rows once."""
    df = check(tracker, raw, column)
    good = with_fields(tracker, df.where(F.col("error_code").isNull()))
    valid = good.select("event_id", "tracker_id", "ts", *[f"`{f.name}`" for f in tracker.fields], "payload_raw", "meta_raw")
    return valid, df.where(F.col("error_code").isNotNull()).select(column, "error_code", "message")
