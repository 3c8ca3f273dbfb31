"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, marked, packing, quality, scoring, secrets, sharding, simhash, tokens, urls
from .common import load



def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(load(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, tau=3)
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_of().alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.tokenize(docs, vocabulary("byte_bpe_50k.json"), end=2)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE]))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(r.kind) for r in secrets.BASE],
        F.sha2(F.encode(secrets.joined(base), "UTF-8"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.score(docs, vocabulary("piece_bpe_32k.model"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end=1)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return marked.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, sharding.tree(24), sharding.tree(25))
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "|".join(rf"(^|[^a-z0-9]){'[^a-z0-9]+'.join(r.tokens)}([^a-z0-9]|$)" for r in urls.RULES if not r.explicit)

OP1_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(lower(host || path), '{_WORDS}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""

def _spans_sql(rule: secrets.Rule, order: int) -> str:
    """DuckDB's list of a rule's spans in column ``t``."""
    pattern = rule.pattern.replace("'", "''")
    part = f"list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x))"
    match = f"list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x))"
    group = f"list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x))"
    start = "CAST(list_sum(p[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT)"
    return f"""(SELECT list({{'start': {start}, 'ord': {order}, 'kind': '{rule.kind}', 'end': {start} + m[i]}} ORDER BY i)
      FROM (SELECT p, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {part} AS p, {match} AS m, {group} AS g)) WHERE g[i] >= {rule.least})"""


_LISTS = ", ".join(f"coalesce({_spans_sql(r, i)}, [])" for i, r in enumerate(secrets.RULES))
_JOINED = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || s.end), ',')"

OP6_SQL = f"""
WITH found AS (
  SELECT doc_id, list_sort(flatten([{_LISTS}])) AS spans
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id,
       CAST(len(list_filter(spans, lambda s: s.kind = 'assign')) AS BIGINT) AS n_assign,
       CAST(len(list_filter(spans, lambda s: s.kind = 'access')) AS BIGINT) AS n_access,
       CAST(len(list_filter(spans, lambda s: s.kind = 'hex')) AS BIGINT) AS n_hex,
       sha256({_JOINED.format("list_filter(spans, lambda s: s.ord < 3)")}) AS base_sha256,
       {_JOINED.format("spans")} AS spans
FROM found
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Query]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_simhash": op2_simhash,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_direct_codes": op5_direct_codes,
        "op6_secret_scans": op6_secret_scans,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op6_secret_scans": OP6_SQL}
