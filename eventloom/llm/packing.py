"""Vector best-fit packing of documents into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of squared lengths). Pieces go in order of decreasing length; of the open
sequences in which a piece fits under every constraint, the one is taken with the
smallest weighted norm of what would be left (``norm``), or with the largest
weighted dot product of residuals and demand (``dot``).

Only documents longer than a sequence are cut. Pieces are dealt by a hash of
their row into groups of about ``GROUP``, of the same size at any scale, and each group
is packed by itself. What lies in sequences that are left less full than ``FULL`` is
taken out and packed again with what the other groups leave, until there is one group
or hardly anything gains from it: the part-filled sequences are those of the last
groups, however many there were.

Defined cases: a null text counts as empty and is a piece of the end id alone;
equal lengths go in order of row; repeated rows are each packed; a very long text is
encoded whole and cut; an empty table gives no rows; only the id and text columns are
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encoder, with_end
from .common import map_arrow, row_id, slices, text_of, written

#: Pieces that are packed together; a sequence that is full enough to stay, as a share of its tokens.
GROUP, FULL = 16_384, 0.99


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; by default only the tokens ever bind."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    select: str = "norm"


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the sequence and the offset there."""
    n = len(lengths)
    lengths = np.asarray(lengths, np.int64)
    if n and (lengths.max() > cap.tokens or cap.documents < 1 or lengths.max() ** 2 > cap.attention):
        raise ValueError("a piece is larger than a sequence's capacity")
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    order = np.argsort(-lengths, kind="stable")
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual, name, used = np.zeros((0, 3)), np.zeros(0, np.int64), 0
    residual, name = np.empty((64, 3)), np.empty(64, np.int64)
    n_open, smallest = 0, int(lengths.min()) if n else 0
    for k, i in enumerate(order):
        need = np.array([lengths[i], 1, lengths[i] ** 2], float)
        r = residual[:n_open]
        fits = np.flatnonzero((r[:, 0] >= need[0]) & (r[:, 1] >= need[1]) & (r[:, 2] >= need[2]))
        if len(fits):
            left = (r[fits] - need) / full if cap.select == "norm" else -(r[fits] * need) / full**2
            score = (left * left) @ weights if cap.select == "norm" else left @ weights
            b = fits[np.argmin(score)]
        else:
            if n_open == len(residual):
                residual, name = np.concatenate([residual, np.empty_like(residual)]), np.concatenate([name, np.empty_like(name)])
            b = n_open
            residual[b], name[b] = full, used
            n_open, used = n_open + 1, used + 1
        seq[i], offset[i] = name[b], cap.tokens - int(residual[b, 0])
        residual[b] -= need
        if residual[b, 0] < smallest or residual[b, 1] < 1:  # nothing fits any more
            n_open -= 1
            residual[b], name[b] = residual[n_open], name[n_open]
    return seq, offset


def cut(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's texts (``id, row, text``), a megabyte of texts at a time: ids, chunks
    and their places take many times the bytes of the texts they come from."""
    for batch in (part for whole in batches for part in slices(whole, whole.num_rows)):
        ids, at = with_end(*encoder(vocabulary).ids(text_of(batch)), end)
        ids = ids.astype("<u4", copy=False)
        n = np.diff(at)
        count = -(-n // tokens)
        doc = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * tokens
        length = np.minimum(n[doc] - start, tokens)
        a = at[doc] + start
        crcs = [zlib.crc32(ids[x:y].data) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), batch.column("row").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, vocabulary: str, end: int, tokens: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, piece, start, length, ids_crc32``."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), row_id().alias("row"), F.col(text_col).alias("text"))
    return map_arrow(keyed, lambda batches: cut(batches, vocabulary, end, tokens), "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def _best_fit(cap: Capacity, level: int) -> Callable[[pa.Table], pa.Table]:
    """Packs a group; its sequences' numbers are those of no other group or level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        length = table.column("length").to_numpy()
        seq, offset = pack(length, cap)
        filled = np.bincount(seq, length).astype(np.int64)[seq]
        first = (level << 56) + (table.column("pack_group")[0].as_py() << 24)
        out = table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(first + seq, pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64())).append_column("filled", pa.array(filled, pa.int64()))

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end: int, cap: Capacity | None = None, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    cap = cap or Capacity()
    found = written(pieces(docs, vocabulary, end, cap.tokens, id_col, text_col), "pieces")
    left, done, level = found, [], 0
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"
    n = found.count()
    while True:
        groups = max(1, -(-n // group))

        dealt = left.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(groups)))
        packed = dealt.groupBy("pack_group").applyInArrow(_best_fit(cap, level), schema)
        if groups == 1:
            done.append(packed)
            break
        packed = written(packed, "packed")
        open_ = packed.where(F.col("filled") < FULL * cap.tokens)
        more = open_.count()
        # A level that leaves most of its pieces open has no use for a further one.
        if not more or more > n // 2:
            done.append(packed)
            break
        done.append(packed.where(F.col("filled") >= FULL * cap.tokens))
        left, n, level = open_.select(*found.columns), more, level + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
