"""Rounding, group keys and key normalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two decimals by scaling: half away from zero, and no negative zero."""
    return F.round(x * F.lit(100.0), 0) / F.lit(100.0) + F.lit(0.0)


def render_number(x: Column) -> Column:
    """A double as text: 5 is ``5.0``; whole numbers below 1e16 have no exponent."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e16))
    return F.when(whole, F.concat(F.when(x <= F.lit(1e16), x).cast("decimal(17,0)").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def render_key(x: Column, kind: str) -> Column:
    """A group key's text: null is ``null``, which a text ``null`` collides with."""
    text = {"num": render_number(x), "bool": F.when(x, "true").otherwise("false")}.get(kind, x.cast("string"))
    return F.when(x.isNull(), F.lit("null")).otherwise(text)


def normalize_key(x: Column) -> Column:
    """ASCII letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
