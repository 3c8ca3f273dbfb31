"""Catalog objects as DataFrames: lookups, validation, versions, migrations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ir import EngineError, ErrorCode

SCHEMA = "id string, display_name string, slug string, attributes map<string,string>, tags array<string>, version struct<major:int,minor:int,patch:int>, source string, created_at bigint, updated_at bigint, archived boolean, hidden boolean"


def _shown() -> Column:
    return ~F.coalesce("archived", F.lit(False)) & ~F.coalesce("hidden", F.lit(False))


def get(catalog: DataFrame, entry_id: str) -> DataFrame:
    return catalog.where(F.col("id") == entry_id)


def add(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those of their ids; of several with one id the last to be read stays."""
    order = "catalog_entry_order"
    last = entries.withColumn(order, F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in entries.columns if c != "id"]), order).alias("e"))
    entries = last.select("id", "e.*").select(*entries.columns)
    return catalog.join(entries.select("id"), "id", "left_anti").unionByName(entries, allowMissingColumns=True)


def remove(catalog: DataFrame, entry_id: str) -> DataFrame:
    return catalog.where(~F.col("id").eqNullSafe(F.lit(entry_id)))


def visible(catalog: DataFrame) -> DataFrame:
    return catalog.where(_shown())


def find_by_tag(catalog: DataFrame, tag: str) -> DataFrame:
    """Visible entries with the tag in any case."""
    return catalog.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()) & _shown())


def find_by_attribute(catalog: DataFrame, key: str, value: str) -> DataFrame:
    """Entries whose attribute has the value, hidden ones too."""
    kind = dict(catalog.dtypes)["attributes"]
    found = F.try_variant_get("attributes", f"$['{key}']", "string") if kind == "variant" else F.col("attributes")[key]
    return catalog.where(found == value)


def sanitize_slug(x: Column) -> Column:
    """Lower case, spaces and hyphens as underscores, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[ -]", "_"), r"[^\p{L}\p{N}_]", "")


def valid_slug(x: Column) -> Column:
    return F.coalesce((x != "") & x.rlike(r"^[\p{L}\p{N}_-]+$"), F.lit(False))


def id_from_slug(x: Column) -> Column:
    return F.lower(x)


def editable(source: Column) -> Column:
    """Custom entries can be edited, built-in ones cannot."""
    return F.coalesce(F.lower(source) == "custom", F.lit(False))


def validate(catalog: DataFrame, required: tuple[str, ...] = (), allowed_tags: tuple[str, ...] | None = None) -> DataFrame:
    """``catalog`` with ``error``: the first rule that an entry breaks, or null."""
    name = F.col("display_name")
    checks = [
        (F.coalesce(name == "", F.lit(True)), "display name is empty"),
        (F.octet_length(name) > 100, "display name is too long"),
        (F.coalesce(F.col("slug") == "", F.lit(True)), "slug is empty"),
        (~valid_slug(F.col("slug")), "slug is invalid"),
        *[(F.col("attributes")[a].isNull(), f"missing attribute: {a}") for a in required],
    ]
    if allowed_tags is not None:
        # Case counts for nothing in ASCII letters, and in no others.
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        allowed = F.array(*[F.translate(F.lit(t), upper, lower) for t in allowed_tags]).cast("array<string>")
        checks.append((F.coalesce(F.exists("tags", lambda t: ~F.array_contains(allowed, F.translate(t, upper, lower))), F.lit(False)), "tag is not allowed"))
    out = None
    for bad, message in checks:
        out = F.when(bad, message) if out is None else out.when(bad, message)
    return catalog.withColumn("error", out)


@dataclass(frozen=True, order=True)
class Version:
    major: int = 1
    minor: int = 0
    patch: int = 0

    @classmethod
    def parse(cls, text: str) -> Version:
        if not re.fullmatch(r"\d+\.\d+\.\d+", text):
            raise EngineError(f"invalid version: {text}", ErrorCode.CATALOG_VERSION_MISMATCH)
        return cls(*map(int, text.split(".")))

    def compatible(self, other: Version) -> bool:
        return self.major == other.major

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


@dataclass(frozen=True)
class Migration:
    source: Version
    target: Version
    apply: Callable[[DataFrame], DataFrame]


def no_op(source: Version, target: Version) -> Migration:
    return Migration(source, target, lambda df: df)


def rename_attribute(old: str, new: str, source: Version = Version(1, 0, 0), target: Version = Version(1, 1, 0)) -> Migration:
    def apply(df: DataFrame) -> DataFrame:
        kept = F.map_filter("attributes", lambda k, _: ~k.isin(old, new))
        moved = F.when(F.map_contains_key("attributes", old), F.map_concat(kept, F.create_map(F.lit(new), F.col("attributes")[old]))).otherwise(F.col("attributes"))
        return df.withColumn("attributes", moved)

    return Migration(source, target, apply)


class Migrations:
    """Registered migrations; those between the major versions apply in their order."""

    def __init__(self) -> None:
        self.known: list[Migration] = []

    def register(self, m: Migration) -> None:
        self.known.append(m)

    def migrate(self, df: DataFrame, source: Version, target: Version) -> DataFrame:
        for m in self.known:
            if m.source.major >= source.major and m.target.major <= target.major:
                df = m.apply(df)
        to = F.struct(*[F.lit(x).alias(n) for n, x in (("major", target.major), ("minor", target.minor), ("patch", target.patch))])
        return df.withColumn("version", to) if "version" in df.columns else df
