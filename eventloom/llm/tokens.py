"""Token files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunks
of all ids that have one, a bitmap that tells which of them go on in level k+1,
and a rank directory (set bits before each block of 512). Any id is read by
following ranks down the levels; nothing else is decoded.

A file (segment) has the ids of whole documents, in order of doc_id, with the
documents' ids and offsets before them. Texts are dealt by ranges of (doc_id,
place in the scan), so that ties and hot ids spread, and each task writes its
segments to the shared folder under names of its own attempt: a task that runs
again leaves no mixed files, as readers take the names that the committed task
returned.

Defined cases: a null text counts as empty and has the end id only; a very long text
is encoded whole and may make a segment longer; a null doc_id
goes first; repeated rows are each written; an empty table has no segments; only
the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import encoder, with_end
from .common import map_arrow, new_path, row_id, text_of, written

MAGIC = b"DACv1\0\0\0"
BLOCK = 512
#: A segment is closed at so many ids.
SEGMENT_IDS = 1_000_000
_HEAD = struct.Struct("<8sQQQ")
_NULL = -(1 << 63)


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level."""
    out, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = (rest >> 8) > 0
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
        padded[: len(more)] = more
        per_block = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(per_block)])[:-1].astype(np.uint64)
        out.append(((rest & 0xFF).astype(np.uint8), np.packbits(padded, bitorder="little"), ranks))
        if not more.any():
            return out
        rest = rest[more] >> 8


def encode(doc_ids: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, documents' ids and offsets, levels."""
    levels = levels_of(ids)
    out = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(at, "<u8").tobytes()]
    for low, bits, ranks in levels:
        out += [struct.pack("<Q", len(low)), low.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class Segment:
    """A segment's bytes, opened for reading any id or document."""

    def __init__(self, data: bytes) -> None:
        magic, docs, self.n, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        pos = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(data, kind, n, pos)
            pos += out.nbytes
            return out

        self.doc_ids, self.at = take("<i8", docs), take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK // 8), take("<u8", blocks)))

    def __getitem__(self, i: int) -> int:
        """The i-th id, from one chunk, one bit and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            first = block * BLOCK // 8
            inside = int.from_bytes(bits[first : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
            i = int(ranks[block]) + inside.bit_count()
            shift += 8
        raise ValueError("a bitmap points below the last level")

    def all(self) -> np.ndarray:
        """All ids."""
        deeper = None
        for low, bits, _ in reversed(self.levels):
            value = low.astype(np.uint32)
            if deeper is not None:
                more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
                value[more] |= deeper << 8
            deeper = value
        return deeper

    def document(self, k: int) -> np.ndarray:
        return np.array([self[i] for i in range(self.at[k], self.at[k + 1])], np.uint32)


def _open(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where, name


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the segments under ``path`` (a URI); one row for each, in table form:
    ``part, seq, file, n_docs, n_ids``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, have = TaskContext.get().partitionId(), 0, [], 0
        where, base = _open(path)

        def close() -> pa.RecordBatch:
            nonlocal seq, held, have
            ids, n = np.concatenate([h[2] for h in held]), np.concatenate([np.diff(h[1]) for h in held])
            at = np.concatenate([[0], np.cumsum(n)])
            name = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            where.create_dir(base, recursive=True)
            with where.open_output_stream(f"{base}/{name}") as f:
                f.write(encode(np.concatenate([h[0] for h in held]), at, ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [f"{path}/{name}"], "n_docs": pa.array([len(n)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})
            seq, held, have = seq + 1, [], 0
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = with_end(*encoder(vocabulary).ids(text_of(batch)), end)
            held.append((batch.column("id").fill_null(_NULL).to_numpy(zero_copy_only=False), at, ids))
            have += len(ids)
            if have >= segment_ids:
                yield close()
        if held:
            yield close()

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), row_id().alias("row"), F.col(text_col).alias("text"))
    dealt = keyed.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    return written(map_arrow(dealt, write, "part int, seq int, file string, n_docs long, n_ids long"), "segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, file`` from the segments' files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                where, name = _open(file)
                with where.open_input_stream(name) as f:
                    seg = Segment(f.read())
                ids, at = seg.all().astype("<u4"), seg.at
                crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(seg.doc_ids, pa.int64(), mask=seg.doc_ids == _NULL), "start": pa.array(start + at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "file": pa.array([file] * len(crcs), pa.string())})

    # Starts: segments within a part, and parts by their sums.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = segments.withColumn("inside", inside).join(parts, "part").select("file", (F.col("before") + F.col("inside")).alias("start"))
    n = max(segments.sparkSession.sparkContext.defaultParallelism, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(placed.repartition(n), read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def tokenize(docs: DataFrame, vocabulary: str, end: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` and read them back."""
    path = path or new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, vocabulary, end, id_col, text_col))
