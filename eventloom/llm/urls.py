"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled to a regular expression over ``host + path`` (host or url
rules) and has literal tokens that each url it fits must contain as whole
tokens. Token counts over the urls at hand tell the rarest of them, and the rule
is filed under that one. A url's tokens fetch the rules filed under them, and
only these rules' expressions run on it. Rules without a whole literal token are
tried on every url, ``LOOSE`` at a time.

Only built-in functions are used. Each distinct host and path is judged once, and
pages get their verdicts back by it. The rules are a parameter of the plan: up to
``BROADCAST`` of them are broadcast, more are joined by their tokens.

Defined cases: a null url or one without ``://`` has empty host and path, no
rule, and the default verdict; repeated rows are each judged; equal longest rules
are settled by the rule's text; a very long url is parsed and matched whole; an empty
table gives no rows; other columns of ``pages`` pass through by their own names in
``filter_urls`` and may clash with nothing, as the added names give way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

BROADCAST, LOOSE = 100_000, 64
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for what ``regex`` finds in ``host + path``.

    ``tokens``: lower-case words of letters and digits of which each fitting url
    has all as whole tokens. ``explicit`` rules go before the method's patterns.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    explicit: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path-prefix``: it fits the host and its subdomains where the path begins so."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    # The last token of a path may go on in the url, if it isn't closed.
    whole = path if not path or not re.match("[A-Za-z0-9]", path[-1]) else re.sub("[A-Za-z0-9]+$", "", path)
    tokens = tuple(dict.fromkeys(re.findall(TOKEN, host.lower()) + re.findall(TOKEN, whole.lower())))
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{_quoted(host.lower())}{'(?=/|$)' if not path else _quoted(path)}", tokens)


def word_rule(verdict: str, *words: str) -> Rule:
    """The words one after the other, as whole tokens, anywhere in host and path."""
    return Rule("-".join(words), verdict, "(?i)(?<![a-z0-9])" + "[^a-z0-9]+".join(map(_quoted, words)) + "(?![a-z0-9])", tuple(words), explicit=False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(of: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(of, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TOKEN), F.lit(0)))


def rarest(urls: DataFrame, rules: list[Rule], target: str) -> dict[str, list[Rule]]:
    """The rules under their rarest tokens; under ``""`` those that have none.

    The counts cover all urls and come to the driver for the rules' own tokens alone.
    """
    spark, own = urls.sparkSession, sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if own:
        listed = spark.createDataFrame([(t,) for t in own], "token string")
        found = urls.select(F.explode(_tokens(F.col(target))).alias("token")).join(F.broadcast(listed), "token").groupBy("token").count()
        counts = {r["token"]: r["count"] for r in found.collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The rule is the longest explicit one that fits, else null; the verdict is the
    rule's, or else block if any pattern that blocks fits, or else ``default``.
    """
    spark = pages.sparkSession
    host, path, rule, verdict, target = free_name(pages, "host", "path", "rule", "verdict", "target")
    parsed = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))}).withColumn(target, F.concat(host, path))
    index = rarest(parsed, rules, target)
    loose = index.pop("", [])
    each = parsed.select(F.col(target).alias("target")).where("target != ''").distinct()
    schema = "r_name string, r_verdict string, r_regex string, r_explicit boolean, r_length int"
    row = lambda r: (r.name, r.verdict, r.regex, r.explicit, len(r.name))
    filed = spark.createDataFrame([(t, *row(r)) for t, under in index.items() for r in under], f"token string, {schema}")
    filed = F.broadcast(filed) if len(rules) <= BROADCAST else filed
    fits = each.select("target", F.explode(_tokens(F.col("target"))).alias("token")).join(filed, "token").drop("token")
    for i in range(0, len(loose), LOOSE):
        part = F.array(*[F.struct(*[F.lit(v).cast(k.split()[1]).alias(k.split()[0]) for v, k in zip(row(r), schema.split(", "), strict=True)]) for r in loose[i : i + LOOSE]])
        fits = fits.union(each.select("target", F.explode(part).alias("r")).select("target", "r.*"))
    # Partial aggregation leaves one row for a url that some rule fits.
    best = fits.where(F.expr("target rlike r_regex")).groupBy(F.col("target").alias("of_target")).agg(
        F.max(F.when(F.col("r_explicit"), F.struct("r_length", "r_name", "r_verdict"))).alias("best"),
        F.coalesce(F.max((~F.col("r_explicit")) & (F.col("r_verdict") == "block")), F.lit(False)).alias("bad"),
    )
    of_target, found, bad = free_name(parsed, "of_target", "best", "bad")
    joined = parsed.join(best.toDF(of_target, found, bad), F.col(target) == F.col(of_target), "left")
    return joined.select(
        *[F.col(c) for c in pages.columns],
        F.col(host),
        F.col(path),
        F.col(found)["r_name"].alias(rule),
        F.coalesce(F.col(found)["r_verdict"], F.when(F.col(bad), F.lit("block")), F.lit(default)).alias(verdict),
    )


#: The method's own patterns: words that stand for themselves, and words that do so with the one before.
ALONE = "casino casinos poker roulette jackpot blackjack slots betting porn porno xxx nsfw escorts camgirls hentai viagra cialis tramadol xanax warez keygen torrents malware phishing".split()
PAIRS = {
    "cheap": "pills meds viagra followers backlinks", "buy": "pills followers backlinks essays replica", "online": "casino pharmacy poker gambling", "free": "bets spins money iphone vbucks",
    "adult": "x videos chat dating cams", "payday": "loans loan", "quick": "loans cash", "easy": "money", "spam": "farm mail", "link": "farm scheme", "content": "farm", "click": "farm bait track",
    "ads": "track tracker server", "ad": "track tracker server click", "casino": "win bonus", "sports": "betting bets", "replica": "watches bags", "weight": "loss", "miracle": "cure diet", "hot": "singles girls",
}

#: The rules of the query, then the method's own word patterns.
RULES = [
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
    *[word_rule("block", w) for w in ALONE],
    *[word_rule("block", first, second) for first, others in PAIRS.items() for second in others.split()],
]
