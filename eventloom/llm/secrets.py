"""Secret scans over an incremental blob ledger.

Texts are blobs, named by their SHA-256. The ledger, a Parquet table, says of each
blob which versions of which rules have been run on it, and what each found. A scan
reduces the documents at hand to their distinct blobs (before any shuffle in each
task, then over all), and runs on each just the rule versions that the ledger does
not have for it. Findings are then joined back, by blob, to all documents with the
blob (its paths). A rule's version is a hash of its pattern and limits, and every
span carries the version that found it: a changed rule alone runs again over history,
and what its former version found is left out.

Built-in functions only: a rule's spans come from the matches of its pattern and
the pieces between them.

Defined cases: a null text counts as empty and has no spans; repeated rows and
copies share one blob and all get its findings; spans of different kinds may
overlap; a text of any length is scanned whole; an empty table adds nothing to the
ledger; only the id and text columns are read in ``scan``, and ``redact`` keeps all
columns, the added names giving way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_path


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


#: A private key's first line; lines of base64 (engines bound the product of repetitions), and a padded last one, where no end line follows.
_KEY, _LINES, _LAST = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?:\s+[A-Za-z0-9+/=]{40,}){0,24}", r"(?:\s+[A-Za-z0-9+/]+={1,2})?"

#: The base kinds in their order, then the kinds that the method adds.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
ADDED = [
    Rule("pem", rf"{_KEY}(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----|{5 * _LINES}{_LAST})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
]
RULES = BASE + ADDED
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"
FOUND = "array<struct<version:string,start:int,end:int>>"
LEDGER = f"sha binary, versions array<string>, found {FOUND}"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points, with its version, in order of start."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("p"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"))
    zipped = zipped.cast("array<struct<m:string,p:string,g:string>>")
    nothing = F.array().cast(FOUND)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(rule.version).alias("version"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    all_spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), all_spans).otherwise(nothing)


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _blob(text_col: str) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256))


def update_ledger(docs: DataFrame, ledger: str, rules: list[Rule] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger lacks for the texts of ``docs`` and append it."""
    # Equal texts are one blob: whichever copy is read first.
    blobs = docs.select(_blob(text_col).alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    if _exists(docs, ledger):
        seen = docs.sparkSession.read.schema(LEDGER).parquet(ledger).groupBy("sha").agg(F.flatten(F.collect_set("versions")).alias("seen"))
        blobs = blobs.join(seen, "sha", "left").select("sha", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing"))
        blobs = blobs.where(F.size("missing") > 0)
    else:
        blobs = blobs.select("sha", "text", wanted.alias("missing"))
    nothing = F.array().cast(FOUND)
    found = [F.when(F.array_contains("missing", r.version), spans(F.col("text"), r)).otherwise(nothing) for r in rules]
    blobs.select("sha", F.col("missing").alias("versions"), F.concat(*found).alias("found")).write.mode("append").parquet(ledger)


def found_in(spark: SparkSession, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """``sha, spans`` of the blobs in which these very rules have found something; spans by start and kind."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.struct(F.lit(i).alias("ord"), F.lit(r.kind).alias("kind")))])
    versions = F.array(*[F.lit(r.version) for r in rules])
    current = spark.read.schema(LEDGER).parquet(ledger).select("sha", F.filter("found", lambda s: F.array_contains(versions, s["version"])).alias("found")).where(F.size("found") > 0)
    by_blob = current.groupBy("sha").agg(F.flatten(F.collect_list("found")).alias("found"))

    def named(s: Column) -> Column:
        rule = F.element_at(place, s["version"])
        return F.struct(s["start"].alias("start"), rule["ord"].alias("ord"), rule["kind"].alias("kind"), s["end"].alias("end"))

    # Two scans at a time may have run a rule twice.
    return by_blob.select("sha", F.array_sort(F.array_distinct(F.transform("found", named))).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` for every row; without a ledger's path, a new one in the shared folder."""
    ledger = ledger or new_path(docs.sparkSession, "ledger")
    update_ledger(docs, ledger, rules, text_col)
    paths = docs.select(F.col(id_col).alias("id"), _blob(text_col).alias("sha"))
    return paths.join(found_in(docs.sparkSession, ledger, rules), "sha", "left").select("id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def joined(of: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, of: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    return F.when(F.size(of) == 0, text).otherwise(F.aggregate(of, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def redact(docs: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with its secrets replaced by marks; every row and column stays."""
    sha, found = free_name(docs, "sha", "found")
    ledger = ledger or new_path(docs.sparkSession, "ledger")
    update_ledger(docs, ledger, rules, text_col)
    hits = found_in(docs.sparkSession, ledger, rules).select(F.col("sha").alias(sha), F.col("spans").alias(found))
    both = docs.withColumn(sha, _blob(text_col)).join(hits, sha, "left")
    clean = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col(found)))
    return both.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
