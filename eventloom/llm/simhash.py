"""Near-duplicates by SimHash fingerprints and the general pigeonhole principle.

A document's fingerprint has a bit for each of 64 that is set in over half of the
hashes of its word shingles. Two fingerprints within ``tau`` bits are found by
partitions of the 64 bits with thresholds that sum to ``tau - m + 1`` for m
partitions: some partition then differs by no more than its threshold, or the
whole pair by more than tau.

* Correlated bits go into the same partition: pair counts over all distinct
  fingerprints give correlations, partitions are filled greedily by them.
* Thresholds are unequal: a dynamic program over the partitions allocates them at
  the least estimated number of probes and candidates, the candidates coming from
  the bits' frequencies; partition counts are compared by the same estimate.
* Where a Jaccard similarity of the shingles is asked for (``similarity``), it alone
  makes a link, between distinct texts, at any distance of their fingerprints. A first
  round takes one near partner for each filed value of a fingerprint and a hub of each
  shared prefix shingle, verifies these and joins their components; a second round
  takes every pair with a shared prefix shingle that is still in two components. In
  any one order of all shingles, two sets of the similarity share one among the first
  of each (prefix filter), so no link is lost, and a group of near copies is not
  written out as pairs. The order puts shingles last that a sample finds frequent:
  it decides on the work, not on the links.
* A fingerprint is filed under its value in each partition and probes all values
  within the threshold. Tasks verify whole groups by vectorised popcounts and
  return a spanning forest of the true links, never all pairs of a group. A value or
  shingle of more rows than ``LARGE`` is dealt to pairs of blocks (or to parts, where
  any partner will do), so that no group has to fit in a task.

Components come from distributed rounds of star contraction over distinct
fingerprints; documents get theirs by a join, so copies cost nothing more.

Defined cases: a null, empty or blank text has fingerprint zero, which links like
any other; fewer words than a shingle has give one shingle of all words; repeated
rows get the same fingerprint and component; a text of any length counts whole; a null doc_id takes no part in the
smallest id of its component; an empty table gives no rows; only the id and text
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, free_name, map_arrow, numbered, row_id, slices, text_of, written

BITS, SEED = 64, 42
#: What a candidate pair costs, in probes: a popcount against a row that is shuffled
#: and sorted. Pairs that are compared at a time.
PAIR_COST, BLOCK = 0.03, 2_000_000
#: Rows of a key that one task takes; beyond, they are dealt to blocks. Large keys that are broadcast at most.
LARGE, BROADCAST = 16_384, 100_000
#: Texts of a prefix shingle beyond which their pairs are sifted by profiles at once, and pairs that are sifted at a time.
BUSY, PROFILED = 64, 4_096
#: One text in so many is looked at for frequent shingles, which are there so often,
#: and no more than so many of them are told apart.
SAMPLED, OFTEN, MOST = 16, 6, 1 << 17


def fingerprint(words: list[bytes], shingle: int) -> int:
    return int(fingerprints([words], shingle)[0])


def fingerprints(docs: list[list[bytes]], shingle: int, profiles: list[bytes] | None = None) -> np.ndarray:
    """64-bit fingerprints of documents that are given as lists of words; ``profiles``
    gets how many distinct shingles of each have each first byte of their hashes."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(docs), np.uint64)
    hashes: list[int] = []
    at = [0]
    for words in docs:
        n = len(words)
        if n > shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes += [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        elif n:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
        at.append(len(hashes))
    sizes = np.diff(at)
    some = np.flatnonzero(sizes)
    h = np.array(hashes, "<u8")
    if profiles is not None:
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = np.bincount((np.unique(h[a:b]) >> np.uint64(56)).astype(np.int64), minlength=256)
            profiles.append(n.astype("u1" if n.max() < 256 else "<u4").tobytes())
    if len(some):
        starts = np.array(at[:-1])[some]
        # By blocks of documents, so that the unpacked bits stay small.
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + 500_000)))
            end = starts[j] if j < len(some) else len(h)
            bits = np.unpackbits(h[starts[i] : end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts[i:j] - starts[i], axis=0, dtype=np.int64)
            out[some[i:j]] = np.packbits(2 * ones > sizes[some[i:j], None], axis=1, bitorder="little").view("<u8")[:, 0]
            i = j
    return out


def document_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, nodes: bool = False, row_col: str | None = None) -> DataFrame:
    """``id, row, fp`` for every row; ``row`` is ``row_col``, or a number of this result
    alone. With ``nodes`` also ``node``, a hash of the text's words, and its ``profile``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = [t.encode().lower().split() for t in text_of(batch).to_pylist()]
            profiles: list[bytes] | None = [] if nodes else None
            cols = {"id": batch.column("id"), "row": batch.column("row"), "fp": pa.array(fingerprints(words, shingle, profiles).view(np.int64), pa.int64())}
            if nodes:
                cols |= {"node": pa.array(_nodes(words), pa.int64()), "profile": pa.array(profiles, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(row_col) if row_col else row_id()).alias("row"), F.col(text_col).alias("text"))
    return map_arrow(keyed, run, "id long, row long, fp long" + ", node long, profile binary" * nodes)


def _nodes(docs: list[list[bytes]]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b" ".join(w), SEED) for w in docs], np.uint64).view(np.int64)


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = _unpacked(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(BITS * BITS + 1), pa.int64()), "c": pa.array(np.append(both.ravel(), n), pa.float64())})

    rows = map_arrow(fps, run, "i long, c double").groupBy("i").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["i"]] = r["c"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of nearly equal width, correlated bits together."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        own = [max(left, key=lambda i: (corr[i, sorted(left)].sum(), -i))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda i: (corr[i, own].sum(), -i)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def within(p: np.ndarray, most: int) -> np.ndarray:
    """The chance that two fingerprints differ in at most e of these bits, e = 0..most."""
    at = np.zeros(most + 1)
    at[0] = 1
    for q in 2 * p * (1 - p):
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    return np.cumsum(at)


@dataclass(frozen=True)
class Plan:
    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def plan(n: int, both: np.ndarray, tau: int) -> Plan:
    """Partitions and thresholds of the least estimated cost."""
    p, best = both.diagonal() / max(n, 1), None
    for m in range(1, tau + 2):
        parts = correlated_partitions(n, both, m)
        total = tau - m + 1
        # A threshold of -1 leaves a partition out.
        costs = []
        for own in parts:
            chance = within(p[own], tau)
            probes = np.cumsum([_choose(len(own), e) for e in range(tau + 1)])
            costs.append({-1: 0.0} | {e: n * (1.0 + probes[e]) + PAIR_COST * n * n / 2 * chance[e] for e in range(tau + 1)})
        # The dynamic program: the least cost of the first partitions by the sum of their thresholds.
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in costs:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, chosen) in table.items():
                for e, more in c.items():
                    if s + e <= total + m and (s + e not in nxt or cost + more < nxt[s + e][0]):
                        nxt[s + e] = (cost + more, (*chosen, e))
            table = nxt
        if total in table and (best is None or table[total][0] < best.cost):
            best = Plan(tuple(map(tuple, parts)), table[total][1], table[total][0])
    return best


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def signatures(fps: np.ndarray, bits: tuple[int, ...], threshold: int) -> np.ndarray:
    """A row of masks to flip for each probe: the partition's values within the threshold."""
    flips = [0]
    for e in range(1, threshold + 1):
        flips += [sum(1 << b for b in c) for c in combinations(bits, e)]
    mask = np.uint64(sum(1 << b for b in bits))
    return (fps & mask)[:, None] ^ np.array(flips, np.uint64)[None, :]


def _mixed(values: np.ndarray, k: int) -> np.ndarray:
    """A key from a partition's value and number; equal keys only ever add candidates."""
    x = values ^ np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over the links that a task has seen."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(fps: DataFrame, found: Plan, tau: int) -> DataFrame:
    """Links ``a, b`` (distinct fingerprints, as longs) that keep every component of
    the graph of all pairs within tau bits."""
    parts = [(k, b, t) for k, (b, t) in enumerate(zip(found.partitions, found.thresholds, strict=True)) if t >= 0]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, bits, t in parts:
                step = max(1, 200_000 // max(1, sum(_choose(len(bits), e) for e in range(t + 1))))
                for i in range(0, len(all_fps), step):
                    own = all_fps[i : i + step]
                    sig = signatures(own, bits, t)
                    keys = _mixed(sig, k)
                    fp = np.repeat(own, sig.shape[1])
                    # The first signature, with nothing flipped, is where the fingerprint is filed.
                    filed = np.zeros(sig.shape, bool)
                    filed[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64), pa.int64()), pa.array(fp.view(np.int64), pa.int64()), pa.array(filed.ravel(), pa.bool_())], names=["key", "fp", "filed"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for keys, fps, filed in _whole_keys(batches, ["key", "fp", "filed"]):
            edges = [e for block in _pairs(keys, fps.view(np.uint64), filed, tau) for e in block if forest.join(*e)]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

    schema = "key long, fp long, filed boolean"
    some = map_arrow(fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0), emit, schema)
    dealt = _in_blocks(map_arrow(fps, emit, schema), _large(some, SAMPLED, F.count_if("filed").alias("n_filed")))
    return map_arrow(dealt.repartition("key").sortWithinPartitions("key"), verify, "a long, b long")


def _large(rows: DataFrame, share: int, *counts: F.Column) -> DataFrame | None:
    """The keys that more than ``LARGE`` rows have, with their number ``many`` and further
    counts; None if there are none. ``rows`` are one in ``share`` of all: which keys are
    dealt to several tasks, and to how many, decides on the work, not on the result."""
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), *counts).where(F.col("many") * share > LARGE)
    large = written(large.select("key", *[(F.col(c) * share).alias(c) for c in large.columns[1:]]), "large-keys")
    n = large.count()
    return None if not n else F.broadcast(large) if n <= BROADCAST else large


def _in_blocks(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """``rows`` (``key, fp, filed``), those of large keys dealt to pairs of a block of
    filed rows and a block of all rows: every filed row still meets every row."""
    if large is None:
        return rows
    n_filed, n_all = (F.ceil(F.col(c) / F.lit(LARGE)).cast("int") for c in ("n_filed", "many"))
    n_filed = F.greatest(n_filed, F.lit(1))
    own_filed, own = F.pmod(F.xxhash64("fp"), n_filed), F.pmod(F.xxhash64("fp", F.lit(1)), n_all)
    cell = lambda f, p, filed: F.struct(F.xxhash64("key", f.cast("long"), p.cast("long")).alias("key"), filed.alias("filed"))
    as_filed = F.transform(F.filter(F.sequence(F.lit(0), n_all - 1), lambda p: F.col("filed")), lambda p: cell(own_filed, p, F.lit(True)))
    as_other = F.transform(F.filter(F.sequence(F.lit(0), n_filed - 1), lambda f: ~F.col("filed") | (f != own_filed)), lambda f: cell(f, own, F.lit(False)))
    here = F.array(F.struct("key", "filed"))
    dealt = rows.join(large, "key", "left").select("fp", F.explode(F.when(F.col("many").isNull(), here).otherwise(F.concat(as_filed, as_other))).alias("c"))
    return dealt.select("c.key", "fp", "c.filed")


def _pairs(keys: np.ndarray, fps: np.ndarray, filed: np.ndarray, tau: int) -> Iterator[list[tuple[int, int]]]:
    """True links between the filed and all other rows of each key, in blocks."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    n_filed = np.add.reduceat(filed.astype(np.int64), begin)
    some = (size > 1) & (n_filed > 0)
    rows = np.repeat(some, size)
    keys, fps, filed = keys[rows], fps[rows], filed[rows]
    if not len(keys):
        return
    order = np.lexsort((~filed, keys))  # filed rows first
    fps, size, n_filed = fps[order], size[some], n_filed[some]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    # Each row against the filed rows of its key.
    first, count = np.repeat(begin, size), np.repeat(n_filed, size)
    total = np.cumsum(count)
    i = 0
    while i < len(fps):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, side="right")))
        if j == i + 1 and count[i] > BLOCK:
            # A single row with very many partners: its own blocks.
            for a in range(0, int(count[i]), BLOCK):
                other = fps[first[i] + a : first[i] + min(a + BLOCK, int(count[i]))]
                near = other[(np.bitwise_count(other ^ fps[i]) <= tau) & (other != fps[i])]
                yield [(int(fps[i]), int(x)) for x in near]
        else:
            n = count[i:j]
            left = np.repeat(np.arange(i, j), n)
            right = np.repeat(first[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = fps[left], fps[right]
            near = (a < b) & (np.bitwise_count(a ^ b) <= tau) | (a > b) & (np.bitwise_count(a ^ b) <= tau)
            pairs = np.unique(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])], axis=1), axis=0) if near.any() else np.zeros((0, 2), np.uint64)
            yield list(map(tuple, pairs.tolist()))
        i = j


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links; the root is the smallest node reachable.

    Alternating large and small stars: every round halves what stands between a
    node and its root, so the rounds grow with the logarithm of a component's size.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a < b").distinct()
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b").select("m", "a", "b")
        hooked = small.select(F.col("m").alias("a"), "b").union(small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = written(hooked.distinct(), "links")
        stat = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if seen == tuple(stat):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = tuple(stat)


def _whole_keys(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first, cut between its values."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if held else cols
        whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
        if whole:
            yield [h[:whole] for h in held]
            held = [h[whole:] for h in held]
    if held:
        yield held


def _as_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c]), pa.int64()) for c in (0, 1)], names=["a", "b"])


def _candidates(frame: DataFrame, found: Plan, tau: int) -> DataFrame:
    """Pairs ``a, b`` of texts (``node, fp``) within tau bits: one for each value that
    a text's fingerprint is filed under."""
    parts = [(k, b, t) for k, (b, t) in enumerate(zip(found.partitions, found.thresholds, strict=True)) if t >= 0]
    names = ["key", "fp", "node", "filed"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            for k, bits, t in parts:
                step = max(1, 200_000 // sum(_choose(len(bits), e) for e in range(t + 1)))
                for i in range(0, len(fps), step):
                    sig = signatures(fps[i : i + step].view(np.uint64), bits, t)
                    filed = np.zeros(sig.shape, bool)
                    filed[:, 0] = True
                    n = sig.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(sig, k).ravel().view(np.int64)), pa.array(np.repeat(fps[i : i + step], n)), pa.array(np.repeat(nodes[i : i + step], n)), pa.array(filed.ravel())], names=names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, nodes, filed in _whole_keys(batches, names):
            fps = fps.view(np.uint64)
            for left, right in _blocks(keys, filed):
                near = np.flatnonzero((np.bitwise_count(fps[left] ^ fps[right]) <= tau) & (nodes[left] != nodes[right]))
                if not len(near):
                    continue
                a, b = nodes[left[near]], nodes[right[near]]
                order = np.lexsort((b, a))  # the smallest partner of each filed row
                a, b = a[order], b[order]
                first = np.concatenate([[True], a[1:] != a[:-1]])
                yield _as_pairs(a[first], b[first])

    schema, own = "key long, fp long, node long, filed boolean", frame.select("fp", "node")
    rows = map_arrow(own, emit, schema)
    large = _large(map_arrow(own.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0), emit, schema), SAMPLED)
    if large is not None:  # one partner is asked for, so a part of a large key will do
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / F.lit(LARGE)))
        rows = rows.join(large, "key", "left").select(F.when(F.col("many").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)).alias("key"), "fp", "node", "filed")
    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), verify, "a long, b long").distinct()


def _blocks(keys: np.ndarray, filed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The filed rows of each key against all rows of that key, a block of pairs at a
    time. A filed row's pairs are in one block, unless they are more than a block."""
    order = np.lexsort((~filed, keys))  # filed rows first
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    first, count = np.repeat(begin, size), np.where(filed[order], np.repeat(np.where(size > 1, size, 0), size), 0)
    for left, right in _ranges(first, count):
        yield order[left], order[right]


def _ranges(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the ``count`` rows from ``first`` on, a block of pairs at a time."""
    total, i = np.cumsum(count), 0
    while i < len(count):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + BLOCK, side="right")))
        n = count[i:j]
        pairs = int(n.sum())
        for skip in range(0, pairs, BLOCK):  # more than once for a row with very many partners
            at = np.arange(skip, min(skip + BLOCK, pairs))
            row = np.searchsorted(np.cumsum(n), at, side="right")
            yield i + row, first[i + row] + at - (np.cumsum(n) - n)[row]
        i = j


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64).view(np.int64))


def _frequent(docs: DataFrame, text_col: str, row_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are often in a sample of the texts, sorted, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_of(batch).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.encode().lower().split(), shingle), pa.int64())], names=["key"])

    some = docs.where(F.pmod(F.xxhash64(row_col), F.lit(SAMPLED)) == 0).select(F.col(text_col).alias("text"))
    counts = map_arrow(some, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "key").limit(MOST).toPandas()
    keys, n = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(own: np.ndarray, keys: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, of which every similar set has one among its own
    first: by hash, but the frequent ``keys`` last, by their counts ``n``."""
    many = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        late = keys[at] == own
        if late.any():
            last = own[late]
            own = np.concatenate([own[~late], last[np.lexsort((last, n[at[late]]))]])
    return own[:many]


def _postings(docs: DataFrame, text_col: str, row_col: str, shingle: int, similarity: float) -> tuple[DataFrame, np.ndarray]:
    """``key, part, node, size, place`` of the prefix shingles that several texts have, and the split keys.
    ``part`` is the key, but for a shingle that the sample says is very frequent: its
    texts are dealt to several parts."""
    keys, n = _frequent(docs, text_col, row_col, shingle)
    large = n * SAMPLED > LARGE
    large_keys, parts = keys[large], (-(-n[large] * SAMPLED // LARGE)).astype(np.uint64)
    names = ["key", "part", "node", "size", "place"]

    def part_of(key: np.ndarray, node: np.ndarray) -> np.ndarray:
        if not len(large_keys):
            return key
        at = np.minimum(np.searchsorted(large_keys, key), len(large_keys) - 1)
        salt = np.where(large_keys[at] == key, _mixed(node.view(np.uint64), 1) % parts[at], np.uint64(0))
        return np.where(salt > 0, _mixed(key.view(np.uint64) + salt, 2).view(np.int64), key)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = [t.encode().lower().split() for t in text_of(batch).to_pylist()]
            sets = [shingle_set(w, shingle) for w in words]
            firsts = [prefix(x, keys, n, similarity) for x in sets]
            many = [len(x) for x in firsts]
            key, node = np.concatenate(firsts), np.repeat(_nodes(words), many)
            cols = [key, part_of(key, node), node, np.repeat([len(x) for x in sets], many), np.concatenate([np.arange(m) for m in many])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, *rest in _whole_keys(batches, ["part", "key", "node", "size", "place"]):
            cols = [key, part, *rest]
            order = np.lexsort((cols[2], part))
            part, node = part[order], cols[2][order]
            fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (node[1:] != node[:-1])])  # rows of a text once
            order, part = order[fresh], part[fresh]
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            size = np.diff(np.append(begin, len(part)))
            order = order[np.repeat(size > 1, size) | np.isin(cols[0][order], large_keys)]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in cols], names=names)

    schema = "key long, part long, node long, size int, place int"
    dealt = map_arrow(docs.select(F.col(text_col).alias("text")), emit, schema).repartition("part").sortWithinPartitions("part")
    return written(map_arrow(dealt, shared, schema), "postings"), large_keys


def _may_be(size: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that share the shingle at these places, and none before, can be similar."""
    a, b = size[left].astype(np.int64), size[right].astype(np.int64)
    most = np.minimum(a - place[left], b - place[right])
    return most >= similarity * (a + b - most) - 1e-9


def _hubs(postings: DataFrame, large_keys: np.ndarray, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of each text with one other of each of its keys' parts (of four in a
    uniform group), and of the parts' hubs in a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, node, size, place in _whole_keys(batches, ["part", "key", "node", "size", "place"]):
            order = np.lexsort((_mixed(node.view(np.uint64) + (key & 3).view(np.uint64), 0), part))
            part, key, node, size, place = (c[order] for c in (part, key, node, size, place))
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            hub = np.repeat(begin, np.diff(np.append(begin, len(part))))
            row = np.flatnonzero(hub != np.arange(len(part)))
            row = row[_may_be(size, place, hub[row], row, similarity)]
            if len(row):
                pairs = _as_pairs(node[hub[row]], node[row])
                yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(len(pairs), pa.int64())], names=["a", "b", "key"])
            split = begin[np.isin(key[begin], large_keys)]
            if len(split):  # a hub of a split key, as a pair of itself
                yield pa.RecordBatch.from_arrays([pa.array(node[split]), pa.array(node[split]), pa.array(key[split])], names=["a", "b", "key"])

    found = written(map_arrow(postings.repartition("part").sortWithinPartitions("part"), run, "a long, b long, key long"), "hubs")
    hubs = Window.partitionBy("key").orderBy("a")
    chain = found.where("a = b").select("a", F.lead("a").over(hubs).alias("b")).where("b IS NOT NULL AND a != b")
    return found.where("a != b").select("a", "b").union(chain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _unjoined(postings: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a, b`` of texts that share a key, have different labels and can be
    similar. Rows of a busy key bring their text's profile along, so that its pairs are
    sifted where they meet and hardly any but similar ones leave the task; rows of a large
    one are dealt to pairs of blocks, too (``side`` 0 and 1; 2 within a block)."""
    names = ["key", "label", "node", "size", "place", "side"]

    def pairs(busy: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, label, node, size, place, side, *more in _whole_keys(batches, [*names, "profile"] if busy else names):
                order = np.lexsort((label, side, key))
                key, label, node, size, place, side = (c[order] for c in (key, label, node, size, place, side))
                new = np.concatenate([[True], key[1:] != key[:-1]])
                begin = np.flatnonzero(new)
                many = np.diff(np.append(begin, len(key)))
                end = np.repeat(begin + many, many)
                runs = np.flatnonzero(new | np.concatenate([[True], (label[1:] != label[:-1]) | (side[1:] != side[:-1])]))
                after = np.repeat(np.append(runs[1:], len(key)), np.diff(np.append(runs, len(key))))
                other = np.repeat(begin + np.add.reduceat((side == 0).astype(np.int64), begin), many)  # where side 1 begins
                first = np.where(side == 2, after, other)
                for left, right in _ranges(first, np.where(side == 1, 0, end - first)):
                    ok = _may_be(size, place, left, right, similarity) & (label[left] != label[right])
                    left, right = left[ok], right[ok]
                    for i in range(0, len(left), PROFILED if busy else max(1, len(left))):
                        x, y = left[i : i + PROFILED] if busy else left, right[i : i + PROFILED] if busy else right
                        if busy:
                            near = _share_enough(more[0][order[x]], more[0][order[y]], similarity)
                            x, y = x[near], y[near]
                        if len(x):
                            yield _as_pairs(node[x], node[y])

        return run

    # Keys whose texts are all joined have no pair left.
    open_keys = written(postings.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key", "many"), "open-keys")
    rows = written(postings.join(open_keys, "key").select("key", "label", "node", "size", "place", "many"), "open-rows")
    few_rows = rows.where(F.col("many") <= BUSY).select("key", "label", "node", "size", "place", F.lit(2).alias("side"))
    n = F.ceil(F.col("many") / F.lit(LARGE)).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.xxhash64("key", F.least(own, x), F.greatest(own, x)).alias("key"), F.when(own == x, 2).when(own < x, 0).otherwise(1).alias("side")))
    here = F.array(F.struct(F.col("key"), F.lit(2).alias("side")))
    busy_rows = rows.where(F.col("many") > BUSY).join(texts.select("node", "profile"), "node")
    busy_rows = busy_rows.select("label", "node", "size", "place", "profile", F.explode(F.when(n == 1, here).otherwise(cells)).alias("c")).select("c.key", "label", "node", "size", "place", "c.side", "profile")
    found = [map_arrow(x.repartition("key").sortWithinPartitions("key"), pairs(b), "a long, b long") for x, b in ((few_rows, False), (busy_rows, True))]
    return found[0].union(found[1]).distinct()


def _share_enough(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts' profiles leave room for the similarity: shared shingles are in the
    same bytes, so this drops no similar pair."""
    x, y = (np.array([np.frombuffer(v, "u1" if len(v) == 256 else "<u4") for v in c], np.int64).reshape(-1, 256) for c in (x, y))
    both = np.minimum(x, y).sum(axis=1)
    return both >= similarity * (x.sum(axis=1) + y.sum(axis=1) - both) - 1e-9


def _possible(edges: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The edges whose texts' profiles leave room for the similarity, which spares reading most others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(_share_enough(batch.column("x").to_pylist(), batch.column("y").to_pylist(), similarity), pa.bool_()))

    left, right = (texts.select(F.col("node").alias(k), F.col("profile").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return map_arrow(edges.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _shingle_sets(docs: DataFrame, reps: DataFrame, text_col: str, row_col: str, shingle: int) -> DataFrame:
    """``node, shingles``: the sorted distinct hashes of each text of ``reps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingle_set(t.encode().lower().split(), shingle) for t in text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    return map_arrow(rows.join(reps, "row").select("node", "text"), run, "node long, shingles array<long>")


def _similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the edges whose texts' shingles have the Jaccard similarity or more, a forest from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if forest.root(a) == forest.root(b):
                    keep.append(False)
                    continue
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9 and forest.join(a, b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return map_arrow(edges.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def similar_links(docs: DataFrame, texts: DataFrame, tau: int, text_col: str, row_col: str, shingle: int, similarity: float) -> DataFrame:
    """Links of distinct texts (``node, fp, row, profile``) that keep every component of the graph
    of all pairs of the similarity or more."""
    n, both = bit_counts(texts.select("fp"))
    postings, large_keys = _postings(docs, text_col, row_col, shingle, similarity)
    first = _candidates(texts, plan(n, both, tau), tau).union(_hubs(postings, large_keys, similarity)).distinct()
    first = written(_possible(first, texts, similarity), "candidates")

    def verified(edges: DataFrame) -> DataFrame:
        some = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        some = written(texts.join(some, "node").select("row", "node"), "looked-at")
        sets = written(_shingle_sets(docs, few(some), text_col, row_col, shingle), "shingles")
        return written(_similar(edges, sets, similarity), "similar")

    good = verified(first)
    roots = components(good)
    labelled = written(postings.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("label"), "node", "size", "place"), "labelled")
    rest = written(_possible(_unjoined(labelled, texts, similarity).join(first, ["a", "b"], "left_anti"), texts, similarity), "candidates")
    return good.union(verified(rest))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3, similarity: float | None = None, row_col: str | None = None) -> DataFrame:
    """``id, row, fp, component_id`` for every row; fp as a long. Nodes are fingerprints,
    or distinct texts where a similarity is asked for, which needs a ``row_col`` of data."""
    node = "fp" if similarity is None else "node"
    own = written(document_fingerprints(docs, id_col, text_col, shingle, similarity is not None, row_col), "fingerprints")
    if similarity is None:
        nodes = written(own.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
        n, both = bit_counts(nodes.select("fp"))
        edges = links(nodes.select("fp"), plan(n, both, tau), tau)
    else:
        nodes = written(own.groupBy("node").agg(F.min("fp").alias("fp"), F.min("row").alias("row"), F.min("id").alias("least_id"), F.first("profile").alias("profile")), "distinct-texts")
        edges = similar_links(docs, nodes.select("node", "fp", "row", "profile"), tau, text_col, row_col, shingle, similarity)
    roots = components(edges).select(F.col("node").alias("of"), "root")
    rooted = nodes.join(roots, nodes[node] == roots["of"], "left").select(node, "least_id", F.coalesce("root", node).alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select(node, "root", "component_id")
    return own.select("id", "row", *dict.fromkeys(["fp", node])).join(named, node).select("id", "row", "fp", "root", "component_id")


def hex_of(fp: str = "fp") -> F.Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tau: int = 10, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the first row of the smallest id.

    By default near copies are all texts that share 0.8 or more of their five-word
    shingles; ``tau`` bits bound the first candidates alone, unless there is no similarity."""
    (row,) = free_name(docs, "row")
    rows = numbered(docs, row)
    groups = near_groups(rows, id_col, text_col, shingle, tau, similarity, row)
    groups = written(groups.select("root", F.struct(F.col("id").isNull().alias("null"), "id", "row").alias("k")), "groups")
    stay = groups.groupBy("root").agg(F.min("k").alias("first"))
    gone = written(groups.join(stay, "root").where("k.row != first.row").select(F.col("k.row").alias(row)), "gone")
    return rows.join(few(gone), row, "left_anti").select(*docs.columns)
