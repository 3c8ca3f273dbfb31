"""Quality rules: fixed limits, then robust multivariate outliers.

Each text gives a few counts, and these a vector of transformed statistics on a fixed
lattice. Documents are counted by language, source and lattice point before anything
else, so that the estimates come from tables whose size is that of the lattice's used
part and not of the corpus. For each language and source a minimum-covariance-
determinant estimate of centre and scatter stands up to junk in just under half of a
group: concentration steps start from several centres, the group's quartiles, and each
takes the (n + p + 1) / 2 documents of the smallest Mahalanobis distances as the next
estimate's subset, until no determinant falls any more; of a group's starts the one of
the least determinant stays. Scatter is made consistent with that of all rows of a
normal distribution. A document whose distance from the estimate is beyond the cutoff
is an outlier and rejected. Groups of fewer than ``min_group`` documents use their
language's estimate.

Quantiles are read from exact counts in fixed bins, so that verdicts do not depend on
how rows were dealt to tasks.

Built-in functions only. The statistics go to a table in the shared folder, so the
texts are read once; the estimates, one row a group, are joined back, broadcast where
their counted number allows.

Defined cases: a null, empty or blank text has no words and fails the base rules;
null languages and sources are groups of their own; repeated rows are each judged
and each count in the estimates, and all documents of one lattice point share a
verdict; ties at the subset's bound are all in the subset; a document that is alone in
its language is its own estimate and stays; a text of any length is read whole; an
empty table gives no rows; added columns give way to those of ``docs``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, exp, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

SPACE = r"\x20\x09-\x0D"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = ["x0", "x1", "x2"]


@dataclass(frozen=True)
class Limits:
    """Base rules and the method's parameters.

    ``starts``: quantiles of the statistics that concentration steps start from;
    ``falls``: a determinant that falls by a smaller share has converged; ``floor``:
    least standard deviation of each statistic, far below what sets prose apart, so that
    statistics that are constant in a group do not make scatter singular; ``step``: the
    lattice's, far below the floor; ``cutoff``: squared distance of an outlier
    (chi-squared with three degrees of freedom exceeds 60 once in 10^12).
    """

    min_words: int = 10
    repeat_percent: int = 20
    starts: tuple[float, ...] = (0.25, 0.5, 0.75)
    falls: float = 0.01
    prior_words: float = 50.0
    floor: tuple[float, float, float] = (0.12, 0.06, 0.06)
    step: float = 0.01
    cutoff: float = 60.0
    min_group: int = 30


#: Estimates that are broadcast at most; bins of a distance for each doubling.
BROADCAST, BINS = 100_000, 32


def stats(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with the counts of a text, by the given names.

    Windows of five words are compared by 64-bit hashes. Sorted with their places,
    equal ones stand side by side; the places that repeat are sorted, and each
    covers its words up to the next. Steps are columns of their own, so that each
    is evaluated once.
    """
    text, words, hashed, windows, lines, order, places = free_name(docs, *(f"stat_{n}" for n in ("text", "words", "hashed", "windows", "lines", "order", "places")))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    c = F.col
    df = df.withColumns({
        words: F.filter(F.split(c(text), f"[{SPACE}]+", -1), lambda w: w != ""),
        lines: F.filter(F.split(c(text), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
        names["word_chars"]: (F.length(text) - F.regexp_count(c(text), F.lit(f"[{SPACE}]"))).cast("long"),
        names["n_symbols"]: F.regexp_count(c(text), F.lit(r"[#*$%&|<>]")).cast("long"),
    })
    df = df.withColumns({
        names["n_words"]: F.size(words).cast("long"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(c(lines)))).cast("long"),
        hashed: F.transform(words, lambda w: F.xxhash64(w)),
    }).drop(text, words, lines)
    ahead = lambda i, k: F.get(c(hashed), i + k)
    df = df.withColumn(windows, F.when(F.size(hashed) > 5, F.transform(F.slice(c(hashed), F.lit(1), F.size(hashed) - 4), lambda h, i: F.xxhash64(h, ahead(i, 1), ahead(i, 2), ahead(i, 3), ahead(i, 4))))).drop(hashed)
    # Most texts repeat no window and end here.
    df = df.withColumn(order, F.when(F.size(F.array_distinct(c(windows))) < F.size(windows), F.array_sort(F.transform(c(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(windows)
    same = lambda i, k: F.get(c(order), i + k)["h"]
    df = df.withColumn(places, F.when(c(order).isNotNull(), F.sort_array(F.transform(F.filter(c(order), lambda x, i: F.coalesce(same(i, -1) == x["h"], F.lit(False)) | F.coalesce(same(i, 1) == x["h"], F.lit(False))), lambda x: x["i"])))).drop(order)
    covered = F.aggregate(F.transform(c(places), lambda p, i: F.least(F.lit(5), F.coalesce(F.get(c(places), i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn(names["n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long")).drop(places)


def vector(names: dict[str, str], limits: Limits) -> list[Column]:
    """Mean word length, share of symbols and share of repeated lines and words, each
    drawn towards a fixed value by ``prior_words`` words, so that short texts do not
    stray by chance, and rounded to the lattice."""
    n, k = F.col(names["n_words"]), F.lit(limits.prior_words)
    free = [
        F.log((F.col(names["word_chars"]) + 5 * k) / (n + k)),
        F.sqrt((F.col(names["n_symbols"]) + F.lit(0.01) * k) / (n + k)),
        F.sqrt((F.col(names["n_dup_lines"]) + F.col(names["n_repeat_words"]) + F.lit(0.01) * k) / (n + k)),
    ]
    return [F.round(x / limits.step) * limits.step for x in free]


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_ESTIMATE = ["m0", "m1", "m2", *[f"q{i}{j}" for i, j in _PAIRS]]


#: Shares of a group's rows in a subset, by hundredths: (n + p + 1) / 2 of n is a half or more.
SHARES = [k / 100 for k in range(50, 101)]


def consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal rows in three dimensions is less by."""
    if share >= 1:
        return 1.0
    three = lambda x: erf(sqrt(x / 2)) - sqrt(2 * x / pi) * exp(-x / 2)
    low, high = 0.0, 100.0  # the chi-squared quantile by bisection
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if three(x) < share else (low, x)
    return share / (three(x) - sqrt(2 / pi) * x**1.5 * exp(-x / 2) / 3)


def _estimate(cells: DataFrame, keys: list[str], floor: tuple[float, ...]) -> DataFrame:
    """Centre, inverse scatter and determinant of each group's subset ``near``, as columns
    ``m*``, ``q*`` and ``det``; ``n`` counts all documents of the group, ``was`` is their ``best``."""
    w = F.when(F.col("near"), F.col("w").cast("double")).otherwise(F.lit(0.0))
    sums = cells.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("best").alias("was"), F.sum(w).alias("in"), *[F.sum(w * F.col(d)).alias(f"s{i}") for i, d in enumerate(DIMS)], *[F.sum(w * F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i, j in _PAIRS])
    moments = sums.withColumn("share", F.col("in") / F.col("n")).withColumns({f"m{i}": F.col(f"s{i}") / F.col("in") for i in range(3)})
    # The factor between those of the hundredths around the subset's share.
    at = F.greatest(F.lit(0.0), F.least(F.lit(50.0), 100 * F.col("share") - 50))
    factor = lambda k: F.element_at(F.array(*[F.lit(consistency(x)) for x in SHARES]), F.least(F.lit(len(SHARES)), k.cast("int") + 1))
    moments = moments.withColumn("factor", factor(F.floor(at)) + (at - F.floor(at)) * (factor(F.floor(at) + 1) - factor(F.floor(at))))
    # Scatter plus the floor's variances, and its inverse by cofactors.
    cov = lambda i, j: F.col(f"s{i}{j}") / F.col("in") - F.col(f"m{i}") * F.col(f"m{j}")
    moments = moments.withColumns({f"c{i}{j}": F.col("factor") * (F.greatest(cov(i, j), F.lit(0.0)) if i == j else cov(i, j)) + F.lit(floor[i] ** 2 if i == j else 0.0) for i, j in _PAIRS})
    v = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    minor = lambda i, j: (lambda a, b: v(a[0], b[0]) * v(a[1], b[1]) - v(a[0], b[1]) * v(a[1], b[0]))([x for x in range(3) if x != i], [x for x in range(3) if x != j])
    det = sum((v(0, j) * minor(0, j) * (-1) ** j for j in range(1, 3)), v(0, 0) * minor(0, 0))
    inverse = {f"q{i}{j}": minor(i, j) * (-1) ** (i + j) / det for i, j in _PAIRS}
    return moments.select(*keys, "n", "m0", "m1", "m2", *[e.alias(k) for k, e in inverse.items()], det.alias("det"), "was")


def distance(dims: list[str] = DIMS, estimate: str | None = None) -> Column:
    """The squared Mahalanobis distance, of a row joined with its group's estimate."""
    of = lambda k: F.col(estimate)[k] if estimate else F.col(k)
    d = [F.col(x) - of(f"m{i}") for i, x in enumerate(dims)]
    return sum((d[i] * d[j] * of(f"q{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS[1:]), d[0] * d[0] * of("q00"))


def _bin(of: Column) -> Column:
    """The fixed bin of a distance, in steps of its logarithm."""
    return F.floor(BINS * F.log2(F.greatest(of, F.lit(0.0)) + F.lit(2.0**-20)))


def _joined(rows: DataFrame, estimate: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``estimate`` of the same keys, null keys too."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"on_{k}"))
    return rows.join(estimate.withColumnsRenamed({k: f"on_{k}" for k in keys}), same, how).drop(*[f"on_{k}" for k in keys])


def _reached(counts: DataFrame, keys: list[str], of: str, wanted: Column) -> DataFrame:
    """``counts`` (``of``, ``w`` for each of ``keys``) with ``total``, where ``w`` up to and with ``of`` reaches ``wanted``."""
    own = Window.partitionBy(*keys)
    upto = counts.withColumns({"upto": F.sum("w").over(own.orderBy(of)), "total": F.sum("w").over(own)})
    return upto.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("w") < wanted))


def mcd(cells: DataFrame, keys: list[str], limits: Limits) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group of ``keys``.

    ``cells`` has the group columns, the vector and ``w``, the documents that have it.
    """
    # The quantiles of each statistic: lattice points where its counts reach them.
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.lit(q).alias("q")) for k, q in enumerate(limits.starts)]))
    now = None
    for i, d in enumerate(DIMS):
        counts = cells.groupBy(*keys, d).agg(F.sum("w").alias("w")).withColumn("s", starts).select(*keys, "s.start", "s.q", d, "w")
        found = _reached(counts, [*keys, "start"], d, F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1))).select(*keys, "start", F.col(d).alias(f"m{i}"))
        now = found if now is None else _joined(now, found, [*keys, "start"], "inner")
    now = now.select("*", *[F.lit(1.0 / limits.floor[i] ** 2 if i == j else 0.0).alias(f"q{i}{j}") for i, j in _PAIRS], F.lit(float("inf")).alias("best"))
    now = written(now, "estimates")
    each = [*keys, "start"]
    spread = cells.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(len(limits.starts))])))
    while True:
        near = _joined(spread, _small(now.select(*each, *_ESTIMATE, "best")), each).withColumn("bin", _bin(distance())).select(*each, *DIMS, "w", "bin", "best")
        counts = near.groupBy(*each, "bin").agg(F.sum("w").alias("w"))
        bound = _reached(counts, each, "bin", F.floor((F.col("total") + len(DIMS) + 1) / 2)).select(*each, F.col("bin").alias("most"))
        # A group of fewer documents than the subset's least size is its own subset.
        inside = _joined(near, bound, each).withColumn("near", F.coalesce(F.col("bin") <= F.col("most"), F.lit(True)))
        # The bins' width can raise a determinant: falls below all before count, and they end.
        now = written(_estimate(inside, each, limits.floor).withColumns({"falls": F.col("det") < (1 - limits.falls) * F.col("was"), "best": F.least("det", "was")}).drop("was"), "estimates")
        if not now.where("falls").limit(1).count():
            break
    least = now.groupBy(*keys).agg(F.min_by(F.struct("n", *_ESTIMATE), F.struct("det", "start")).alias("e"))
    return written(least.select(*keys, "e.*"), "estimates")


def _small(estimates: DataFrame) -> DataFrame:
    """The (written) estimates, to be broadcast if their number allows."""
    return F.broadcast(estimates) if estimates.count() <= BROADCAST else estimates


def _judged(docs: DataFrame, limits: Limits, keep: list[str], text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of every row with its counts, ``base_failed``, ``distance`` and
    ``kept``, and the names of these."""
    added = [*COUNTS, *DIMS, "lang", "source", "base_failed", "distance", "kept"]
    names = dict(zip(added, free_name(docs.select(*keep), *added), strict=True))
    (text,) = free_name(docs, "stats_of")
    slim = docs.select(*keep, F.col(lang_col).alias(names["lang"]), F.col(source_col).alias(names["source"]), F.col(text_col).alias(text))
    counted = stats(slim, text, names).drop(text)
    counted = counted.withColumns({names[d]: x for d, x in zip(DIMS, vector(names, limits), strict=True)})
    failed = (F.col(names["n_words"]) < limits.min_words) | (100 * F.col(names["n_repeat_words"]) > limits.repeat_percent * F.col(names["n_words"]))
    counted = written(counted.withColumn(names["base_failed"], failed), "quality")
    # Estimates come from what the base rules let through.
    group = [F.col(names[k]).alias(k) for k in ("lang", "source", *DIMS)]
    cells = written(counted.where(~F.col(names["base_failed"])).select(*group).groupBy("lang", "source", *DIMS).agg(F.count(F.lit(1)).alias("w")), "cells")
    own = mcd(cells, ["lang", "source"], limits).select("lang", "source", "n", F.struct(*_ESTIMATE).alias("own"))
    wide = mcd(cells.groupBy("lang", *DIMS).agg(F.sum("w").alias("w")), ["lang"], limits).select("lang", F.struct(*_ESTIMATE).alias("wide"))
    chosen = _joined(own, _small(wide), ["lang"]).select("lang", "source", F.when(F.col("n") >= limits.min_group, F.col("own")).otherwise(F.col("wide")).alias("e"))
    chosen = written(chosen.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.col("e").alias("of_estimate")), "estimates")
    taken = free_name(counted, *chosen.columns)
    of_lang, of_source, estimate = taken
    same = F.col(names["lang"]).eqNullSafe(F.col(of_lang)) & F.col(names["source"]).eqNullSafe(F.col(of_source))
    both = counted.join(_small(chosen.toDF(*taken)), same, "left")
    both = both.withColumn(names["distance"], distance([names[d] for d in DIMS], estimate)).drop(*taken)
    kept = ~F.col(names["base_failed"]) & (F.col(names["distance"]) <= limits.cutoff)
    return both.withColumn(names["kept"], F.coalesce(kept, F.lit(False))), names


def judge(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed, distance`` and ``kept`` for every row. The distance
    is null where no document of the language and source passes the base rules."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    out, _ = _judged(slim, limits or Limits(), ["doc_id"], "text", "lang", "source")
    return out.select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def keep(docs: DataFrame, limits: Limits | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    out, names = _judged(docs, limits or Limits(), docs.columns, text_col, lang_col, source_col)
    return out.where(names["kept"]).select(*docs.columns)
