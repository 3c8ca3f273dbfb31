"""Tracker expressions as Spark columns.

There are two dialects. Derives and alerts (``D``) keep booleans out of arithmetic
and read null as nothing; metrics (``M``) count booleans as 1 and 0 and read a null
literal, and an omitted else, as 0. Kinds are static: a field's from its
declaration, a derive's from its expression.

An operand that cannot be calculated with gives null (lenient) or raises
(``strict``). Comparisons are two-valued: they are never null.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import ir
from ..plans.ir import EngineError, ErrorCode
from .values import render_key


@dataclass(frozen=True)
class Value:
    """A column and its kind: num, bool, text, null or signal, or any for a VARIANT."""

    col: Column
    kind: str


KINDS = {"text": "text", "enum": "text", "bool": "bool", "float": "num", "int": "num", "duration": "num", "timestamp": "num"}


def normalize_path(path: str) -> str:
    """Paths without a known prefix are the payload's."""
    return path if path.split(".", 1)[0] in ("payload", "meta", "event") and "." in path else f"payload.{path}"


class Compiler:
    """Expressions over a frame with ``event_id, tracker_id, ts`` and the payload's
    columns; ``kinds`` has the kinds of the payload's fields and derives.

    ``raw``: a VARIANT column for payload paths that are not declared, ``meta`` one
    for the meta's; where there is none such paths are null.
    """

    def __init__(self, kinds: dict[str, str], mode: str, strict: bool = False, raw: str | None = None, meta: str | None = None) -> None:
        self.kinds, self.mode, self.strict, self.raw, self.meta = kinds, mode, strict, raw, meta

    def value(self, node: Any) -> Value:
        if isinstance(node, ir.Lit):
            return self._literal(node.value)
        if isinstance(node, ir.Ref):
            return self.ref(node.path)
        if isinstance(node, ir.Arith):
            return self._arith(node)
        if isinstance(node, ir.If):
            return self._if(node)
        if isinstance(node, ir.Call):
            return self._call(node)
        if isinstance(node, (ir.Compare, ir.Logic, ir.Not, ir.Const)):
            return Value(self.condition(node), "bool")
        raise EngineError(f"unsupported expression: {node}", ErrorCode.DSL_INVALID_EXPRESSION)

    def _literal(self, value: Any) -> Value:
        if value is None:
            return Value(F.lit(0.0), "num") if self.mode == "M" else Value(F.lit(None).cast("double"), "null")
        if isinstance(value, bool):
            return Value(F.lit(value), "bool")
        if isinstance(value, (int, float)):
            return Value(F.lit(float(value)), "num")
        return Value(F.lit(str(value)), "text")

    def ref(self, path: str) -> Value:
        full = normalize_path(path)
        top, _, rest = full.partition(".")
        if top == "event":
            known = {"event.id": ("event_id", "text"), "event.tracker_id": ("tracker_id", "text"), "event.ts": ("ts", "num")}
            if full not in known:
                return Value(F.lit(None).cast("double"), "null")
            name, kind = known[full]
            return Value(F.col(name).cast("double") if kind == "num" else F.col(name), kind)
        if top == "payload" and rest in self.kinds:
            kind = self.kinds[rest]
            col = F.col(f"`{rest}`")
            return Value(col.cast("double") if kind == "num" else col, kind)
        source = self.raw if top == "payload" else self.meta
        if source is None:
            return Value(F.lit(None).cast("double"), "null")
        return Value(F.try_variant_get(F.col(source), "$" + "".join(f"['{p}']" for p in rest.split(".")), "variant"), "any")

    def _number(self, v: Value, what: str) -> Column:
        """An operand as a double."""
        if v.kind == "num":
            col = v.col
        elif v.kind == "any":
            col = any_number(v.col, self.mode == "M")
        elif v.kind == "bool" and self.mode == "M":
            col = v.col.cast("double")
        else:
            return self._bad(f"{what} needs numbers")
        return F.when(col.isNull(), self._bad(f"{what} of a missing value")).otherwise(col) if self.strict else col

    def _bad(self, message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("double") if self.strict else F.lit(None).cast("double")

    def _arith(self, node: ir.Arith) -> Value:
        if node.op == "%" and self.mode == "M":
            raise EngineError("% is not supported in metrics", ErrorCode.METRIC_EVALUATION_FAILED)
        a, b = (self._number(self.value(x), node.op) for x in (node.left, node.right))
        if node.op == "/":
            return Value(F.when(b == 0, self._bad("division by zero")).otherwise(F.try_divide(a, b)), "num")
        if node.op == "%":
            return Value(F.try_mod(a, b), "num")
        return Value({"+": a + b, "-": a - b, "*": a * b}[node.op], "num")

    def _if(self, node: ir.If) -> Value:
        cond, then, other = self.condition(node.cond), self.value(node.then), self.value(node.other if node.other is not None else ir.Lit(None))
        kinds = {then.kind, other.kind} - {"null"}
        if len(kinds) > 1:
            if self.mode == "M" and kinds == {"num", "bool"}:
                then, other = (Value(v.col.cast("double"), "num") for v in (then, other))
                kinds = {"num"}
            else:
                raise EngineError("both branches of an if need one kind of value", ErrorCode.TYPE_MISMATCH)
        kind = kinds.pop() if kinds else "null"
        null = F.lit(None)
        pick = lambda v: null if v.kind == "null" else v.col
        return Value(F.when(cond, pick(then)).otherwise(pick(other)), kind)

    def _call(self, node: ir.Call) -> Value:
        if node.name != "signal" or self.mode == "M":
            raise EngineError(f"unsupported function: {node.name}", ErrorCode.EXPRESSION_ERROR)
        args = [self.value(a) for a in node.args]
        name = F.coalesce(args[0].col, F.lit("signal")) if args and args[0].kind == "text" else F.lit("signal")
        payload = args[1].col if len(args) > 1 else F.lit(None).cast("double")
        return Value(F.struct(name.alias("type"), payload.alias("payload")), "signal")

    def condition(self, node: Any) -> Column:
        """A boolean that is never null. Sides that may raise come behind a CASE, as
        Spark does not promise an order of conjuncts."""
        if isinstance(node, ir.Const):
            return F.lit(node.value)
        if isinstance(node, ir.Not):
            return ~self.condition(node.of)
        if isinstance(node, ir.Logic):
            a, b = self.condition(node.left), self.condition(node.right)
            if self.strict:
                return F.when(a, b).otherwise(F.lit(False)) if node.op == "&&" else F.when(a, F.lit(True)).otherwise(b)
            return a & b if node.op == "&&" else a | b
        if isinstance(node, ir.Compare):
            return self._compare(node)
        v = self.value(node)
        return truthy(v)

    def _compare(self, node: ir.Compare) -> Column:
        a, b = self.value(node.left), self.value(node.right)
        if node.op in ("==", "!=") and "any" in (a.kind, b.kind):
            same = same_value(a, b, self.mode)
            return same if node.op == "==" else ~same
        if node.op in ("==", "!="):
            if "null" in (a.kind, b.kind):
                same = F.lit(True) if a.kind == b.kind else (b if a.kind == "null" else a).col.isNull()
            elif a.kind == b.kind:
                same = a.col.eqNullSafe(b.col)
            else:
                same = a.col.isNull() & b.col.isNull()
            return same if node.op == "==" else ~same
        a, b = (Value(any_number(v.col, self.mode == "M"), "num") if v.kind == "any" else v for v in (a, b))
        ok = ("num", "bool") if self.mode == "M" else ("num",)
        if a.kind not in ok or b.kind not in ok:
            return F.lit(False)  # text never orders
        x, y = a.col.cast("double"), b.col.cast("double")
        return F.coalesce({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[node.op], F.lit(False))


def truthy(v: Value) -> Column:
    """Whether an alert's value counts: null, zero, false and empty text do not."""
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "signal":
        return F.lit(True)
    if v.kind == "any":
        number, flag, text = (part(v.col) for part in (any_number, any_bool, any_text))
        return F.coalesce(number != 0, flag, text != "", F.schema_of_variant(v.col).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    col = {"bool": v.col, "num": v.col != 0, "text": v.col != ""}[v.kind]
    return F.coalesce(col, F.lit(False))


_NUMBERS = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


def any_number(v: Column, bools: bool = False) -> Column:
    """The number in a VARIANT, null for any other kind; texts that look like numbers stay
    texts, and booleans are numbers only where they are asked for."""
    number = F.when(F.schema_of_variant(v).rlike(_NUMBERS), F.try_variant_get(v, "$", "double"))
    return F.coalesce(number, any_bool(v).cast("double")) if bools else number


def any_text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def any_bool(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def same_value(a: Value, b: Value, mode: str) -> Column:
    """Equality where a side is a VARIANT: of kind and value, null being what is absent or
    null. Objects and arrays are compared by their JSON, or are null to metrics (``M``)."""

    def parts(v: Value) -> list[Column]:
        none = {"num": F.lit(None).cast("double"), "bool": F.lit(None).cast("boolean"), "text": F.lit(None).cast("string"), "json": F.lit(None).cast("string")}
        if v.kind == "any":
            nested = F.when(F.schema_of_variant(v.col).rlike("^(OBJECT|ARRAY)"), F.to_json(v.col)) if mode == "D" else none["json"]
            none |= {"num": any_number(v.col), "bool": any_bool(v.col), "text": any_text(v.col), "json": nested}
        elif v.kind in none:
            none[v.kind] = v.col
        return list(none.values())

    same = F.lit(True)
    for x, y in zip(parts(a), parts(b), strict=True):
        same = same & x.eqNullSafe(y)
    return same


def key_text(v: Value) -> Column:
    """A value as a group key's text."""
    if v.kind != "any":
        return render_key(v.col, v.kind)
    texts = [F.when(c.isNotNull(), render_key(c, k)) for c, k in ((any_number(v.col), "num"), (any_bool(v.col), "bool"), (any_text(v.col), "text"))]
    return F.coalesce(*texts, F.lit("null"))
