"""Exact deduplication over a cuckoo-filter index of live digests.

Rows are reduced to content records (SHA-256, bytes, 64-bit hash of the text) and
dealt into partitions by digest, more of them the more digests there are. Each has a
cuckoo filter of the digests that are live; beside every fingerprint its bucket holds
the content record it stands for, and nothing else is kept. A digest that the filter
does not know is new and is inserted without a look at any content. A hit is only a
hint: it is verified against the content under its fingerprint, and a hit that fails
is a false positive and inserted too. When an insertion runs out of kicks, the filter
is rebuilt at twice the size from the stored keys.

Defined cases: a null text counts as empty; of equal texts the row with the
largest doc_id stays, nulls below all numbers, and of repeated rows of that id
any one; a very long text is hashed whole and never leaves its scan; an empty table
gives no rows; columns of ``docs`` beside the id and the text are not read, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, free_name, map_arrow, numbered, row_id, written

#: Entries to a bucket of the filter, kicks until it is called full, mask of a fingerprint.
SLOTS, KICKS, MASK = 4, 200, 0xFFFF
#: Digests to a partition at most, on average: what an index in a worker holds.
INDEXED = 200_000


class CuckooIndex:
    """A cuckoo filter with the content behind each fingerprint: digest -> record.

    A fingerprint has 16 bits, from the digest's bytes 8 and 9; the first bucket
    comes from bytes 0 to 7, the second from the first and the fingerprint.
    """

    def __init__(self, capacity: int = 64) -> None:
        self.size = self.hits = self.false_hits = self.resizes = 0
        self._reset(capacity)

    def _reset(self, capacity: int) -> None:
        self.buckets = 1
        while self.buckets * SLOTS * 0.9 < max(capacity, SLOTS):
            self.buckets *= 2
        # A bucket is nothing until it is used: its fingerprints, and their content in the same order.
        self.marks: list[list[int] | None] = [None] * self.buckets
        self.content: list[list[tuple[bytes, object]] | None] = [None] * self.buckets

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "big") & MASK or 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._print(digest)
        first = int.from_bytes(digest[:8], "big") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def may_hold(self, digest: bytes) -> bool:
        """What the filter alone says: no is certain, yes is a hint."""
        mark, a, b = self._places(digest)
        return any(mark in (self.marks[at] or ()) for at in (a, b))

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """The bucket and slot of a live digest: hits of the filter, verified."""
        mark, a, b = self._places(digest)
        hint = False
        for at in (a, b) if a != b else (a,):
            marks = self.marks[at]
            if marks and mark in marks:
                hint = True
                for slot, (m, (key, _)) in enumerate(zip(marks, self.content[at], strict=True)):
                    if m == mark and key == digest:
                        self.hits += 1
                        return at, slot
        self.hits += hint
        self.false_hits += hint
        return None

    def get(self, digest: bytes) -> object | None:
        """The live record of a digest."""
        place = self._find(digest)
        return None if place is None else self.content[place[0]][place[1]][1]

    def insert(self, digest: bytes, record: object) -> None:
        """Make a digest live; the caller has seen that it is not."""
        self.size += 1
        left = self._put((digest, record))
        if left:
            self._grow(left)

    def _add(self, at: int, mark: int, entry: tuple[bytes, object]) -> bool:
        marks = self.marks[at]
        if marks is None:
            self.marks[at], self.content[at] = [mark], [entry]
        elif len(marks) < SLOTS:
            marks.append(mark)
            self.content[at].append(entry)
        else:
            return False
        return True

    def _put(self, entry: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """Place an entry; one that is left over when the kicks run out is given back."""
        mark, a, b = self._places(entry[0])
        if self._add(a, mark, entry) or self._add(b, mark, entry):
            return None
        at = a
        for kick in range(KICKS):
            slot, marks, content = kick % SLOTS, self.marks[at], self.content[at]
            marks[slot], mark = mark, marks[slot]
            content[slot], entry = entry, content[slot]
            at = self._other(at, mark)
            if self._add(at, mark, entry):
                return None
        return entry

    def _grow(self, left: tuple[bytes, object]) -> None:
        """Rebuild from the stored keys, at twice the size until all fit."""
        entries = [*self.records(), left]
        capacity = self.buckets * SLOTS
        while True:
            capacity *= 2
            self.resizes += 1
            self._reset(capacity)
            if not any(self._put(e) for e in entries):
                return

    def replace(self, digest: bytes, record: object) -> None:
        """Another record for a live digest."""
        at, slot = self._find(digest)
        self.content[at][slot] = (digest, record)

    def delete(self, digest: bytes) -> bool:
        """End a digest's life; False if it was not live."""
        place = self._find(digest)
        if place is None:
            return False
        at, slot = place
        del self.marks[at][slot], self.content[at][slot]
        self.size -= 1
        return True

    def records(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content:
            yield from held or ()


RECORD = "sha binary, n_bytes long, hash long, keep_id long, keep_row long, group_size long"


def _as_key(sha: bytes, n_bytes: int, hash_: int) -> bytes:
    return sha + n_bytes.to_bytes(8, "big") + (hash_ & (1 << 64) - 1).to_bytes(8, "big")


def _newer(a: tuple, b: tuple) -> bool:
    """Whether (id, row) ``a`` goes before ``b``: the larger id, then the earlier row."""
    ida, idb = (-(1 << 63) - 1 if x[0] is None else x[0] for x in (a, b))
    return ida > idb or ida == idb and a[1] < b[1]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of digests through one index. Equal digests are in one
    partition, and each came once from a task, so that hot texts stay small."""
    index = CuckooIndex()
    for batch in batches:
        for sha, n_bytes, hash_, keep_id, keep_row, n in zip(*(batch.column(c).to_pylist() for c in ("sha", "n_bytes", "hash", "keep_id", "keep_row", "group_size")), strict=True):
            key, mine = _as_key(sha, n_bytes, hash_), (keep_id, keep_row)
            live = index.get(key)
            if live is None:
                index.insert(key, (*mine, n))
            else:
                index.replace(key, (*(mine if _newer(mine, live) else live[:2]), live[2] + n))
    records = index.records()
    while part := list(islice(records, 50_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[:32] for k, _ in part], pa.binary()), pa.array([r[0] for _, r in part], pa.int64()), pa.array([r[1] for _, r in part], pa.int64()), pa.array([r[2] for _, r in part], pa.int64())],
            names=["sha", "keep_id", "keep_row", "group_size"],
        )


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's digests, each once for every run of ``LIMIT`` of them."""
    limit, found = 200_000, {}

    def out() -> pa.RecordBatch:
        keys, rows = list(found), list(found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[:32] for k in keys], pa.binary()), pa.array([int.from_bytes(k[32:40], "big") for k in keys], pa.int64()), pa.array([int.from_bytes(k[40:], "big", signed=True) for k in keys], pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3))],
            names=["sha", "n_bytes", "hash", "keep_id", "keep_row", "group_size"],
        )

    for batch in batches:
        for sha, n_bytes, hash_, id_, row in zip(*(batch.column(c).to_pylist() for c in ("sha", "n_bytes", "hash", "id", "row")), strict=True):
            key, mine = _as_key(sha, n_bytes, hash_), (id_, row)
            held = found.get(key)
            if held is None:
                found[key] = (id_, row, 1)
            else:
                found[key] = (*(mine if _newer(mine, held) else held[:2]), held[2] + 1)
        if len(found) >= limit:
            yield out()
            found.clear()
    if found:
        yield out()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``id, row, sha, keep_id, group_size, kept`` for every row of ``docs``.

    ``row`` is ``row_col``, or else a number that only this result has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(row_col) if row_col else row_id()).alias("row"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("hash"),
    )
    digests = written(digests, "digests")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // INDEXED))
    partial = map_arrow(digests, _partial, RECORD)
    kept = map_arrow(partial.repartition(n, "sha"), _index, "sha binary, keep_id long, keep_row long, group_size long")
    return digests.join(kept, "sha").select("id", "row", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    (row,) = free_name(docs, "row")
    own = numbered(docs, row)
    gone = written(exact_groups(own, id_col, text_col, row).where("NOT kept").select(F.col("row").alias(row)), "gone")
    return own.join(few(gone), row, "left_anti").select(*docs.columns)
