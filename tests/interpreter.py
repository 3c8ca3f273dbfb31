"""A row-at-a-time reading of expressions, to test the columns against."""

import math

from eventloom.plans import ir

NULL = None


def number(v, mode):
    if isinstance(v, bool):
        return float(v) if mode == "M" else None
    return float(v) if isinstance(v, (int, float)) else None


def value(node, row, mode):
    if isinstance(node, ir.Lit):
        return 0.0 if node.value is None and mode == "M" else node.value
    if isinstance(node, ir.Ref):
        return row.get(node.path.removeprefix("payload."))
    if isinstance(node, ir.If):
        other = node.other if node.other is not None else ir.Lit(None)
        return value(node.then if cond(node.cond, row, mode) else other, row, mode)
    if isinstance(node, ir.Arith):
        a, b = number(value(node.left, row, mode), mode), number(value(node.right, row, mode), mode)
        if a is None or b is None or node.op in "/%" and b == 0:
            return None
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[node.op]()
    return cond(node, row, mode)


def cond(node, row, mode):
    if isinstance(node, ir.Const):
        return node.value
    if isinstance(node, ir.Not):
        return not cond(node.of, row, mode)
    if isinstance(node, ir.Logic):
        a = cond(node.left, row, mode)
        return (a and cond(node.right, row, mode)) if node.op == "&&" else (a or cond(node.right, row, mode))
    a, b = value(node.left, row, mode), value(node.right, row, mode)
    if node.op in ("==", "!="):
        kind = lambda v: None if v is None else "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "t"
        same = kind(a) == kind(b) and (a is None or a == b)
        return same == (node.op == "==")
    x, y = number(a, mode), number(b, mode)
    if x is None or y is None:
        return False
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[node.op]
