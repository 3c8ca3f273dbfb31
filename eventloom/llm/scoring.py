"""Scores of texts by language models of the corpus.

Two models learn from the documents that are not held out: the base, a smoothed unigram
of words, and the causal self-attention model of ``attention`` over subword ids. Texts
are read once, and in blocks of bounded bytes:

* A block is a row: its documents as places in the list of its distinct words, the
  words' pieces, and which documents are held out. Each word is cut into pieces once a
  block.
* A block's distinct words and their counts in training documents go to buckets by hash,
  a row for each bucket of a block, so that no word's rows gather under one key. A bucket
  adds up its words over all blocks and gives each block its words' counts back.
* Piece counts over all training documents give the model its classes. Every training
  document is learned from with all its tokens, in one of the rounds: in each, every task
  runs Adam from the same weights over windows that follow each other, and the weights
  are averaged by tokens. Weights, and so scores, depend on how blocks are dealt to tasks.
* A text's score is the sum over its pieces and its end, each scored in one of the
  overlapping windows.

Defined cases: a null or empty text is the end alone; the fold of a null doc_id is
that of the empty text; repeated rows are each scored and each learned from; with
no training documents all counts are zero and the weights stay where they begin; a very
long text is a block of its own; an empty table gives no rows; only the id and text
columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .chunks import flat, with_end
from .common import bytes_of, give_back, map_arrow, text_of, written
from .marked import piece_encoder

#: Bytes of text in a block; bytes of all texts to a bucket of words; rounds of training,
#: windows in a step, its size; sums that meet before the driver adds them up.
BLOCK_BYTES, BUCKET_BYTES, ROUNDS, BATCH, RATE, SUMS = 6 << 20, 32 << 20, 3, 128, 0.01, 16
#: The folds that documents are dealt into, and the one that is held out.
FOLDS, HELD_OUT = 5, 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()], bool)


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in lower case (A-Z), and where each text's begin and end."""
    raw, off = bytes_of(texts)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = off[:-1][off[:-1] < len(raw)]
    first[begins] = solid[begins]
    # Words stand one after the other once the spaces are gone.
    kept = np.ascontiguousarray(_LOWER[raw[solid]])
    starts = np.flatnonzero(first[solid])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(kept)).astype(np.int32)), pa.py_buffer(kept)])
    return words, np.searchsorted(np.flatnonzero(first), off)


def listed(words: pa.StringArray) -> list[str]:
    """The words, none of which has a line feed, by one split: a tenth of the time of a value at a time."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().split("\n") if len(words) else []


def buckets_of(words: pa.StringArray, buckets: int) -> np.ndarray:
    """The bucket of each word, from its first and last eight bytes and its length."""
    raw, off = bytes_of(words)
    raw, eight, n = np.append(raw, np.zeros(8, np.uint8)), np.arange(8), np.diff(off)
    first = np.where(eight < n[:, None], raw[off[:-1, None] + eight], 0).astype(np.uint8).view("<u8")[:, 0]
    last = np.where(eight >= 8 - n[:, None], raw[off[1:, None] - 8 + eight], 0).astype(np.uint8).view("<u8")[:, 0]
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ last * np.uint64(0xC2B2AE3D27D4EB4F) ^ n.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


BLOCKS = "block long, bucket int, words binary, lengths binary, counts binary, ids binary, held binary, sizes binary, places binary, ends binary, pieces binary, piece_counts binary"
_NULL = -(1 << 63)


def blocks_of(docs: DataFrame, model: str, buckets: int) -> DataFrame:
    """Rows of three kinds: blocks (``bucket`` null), the words of a block that go to a
    bucket, and a task's piece counts (``block`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number = piece_encoder(model), TaskContext.get().partitionId() << 32
        counted = np.zeros(enc.sp.vocab_size(), np.int64)
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = {"block": pa.int64(), "bucket": pa.int32()}

        def rows(n: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[c], kinds.get(c, pa.binary())) if c in cols else pa.nulls(n, kinds.get(c, pa.binary())) for c in names], names=names)

        def block(ids: list[pa.Array], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, texts = pa.concat_arrays(ids), pa.concat_arrays(texts)
            words, at = words_of(texts)
            coded = words.dictionary_encode()
            # Words in the order of their buckets.
            bucket = buckets_of(coded.dictionary, buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            distinct, bucket, places = coded.dictionary.take(pa.array(order)), bucket[order], place[coded.indices.to_numpy()]
            held, sizes = held_out(ids), np.diff(at)
            learned = np.repeat(~held, sizes)
            n = np.bincount(places[learned], minlength=len(distinct)).astype("<i8")
            raw, off = bytes_of(distinct)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)).tolist() if len(bucket) else [0]
            lengths = np.diff(off).astype("<i4")
            for i in range(0, len(cuts) - 1, 1000):
                part = list(zip(cuts[i : i + 1000], cuts[i + 1 : i + 1001], strict=False))
                cut = lambda v, part=part: [v[a:b].tobytes() for a, b in part]
                yield rows(len(part), block=[number] * len(part), bucket=[int(bucket[a]) for a, _ in part], words=[raw[off[a] : off[b]].tobytes() for a, b in part], lengths=cut(lengths), counts=cut(n))
            pieces, many = flat(enc.sp.encode(listed(distinct), num_threads=1))
            ends = np.concatenate([[0], np.cumsum(many)])
            counted[:] += np.bincount(pieces, weights=np.repeat(n, many), minlength=len(counted)).astype(np.int64)
            counted[enc.sp.eos_id()] += int((~held).sum())
            numbers = ids.fill_null(_NULL).to_numpy(zero_copy_only=False).astype("<i8")
            yield rows(1, block=[number], ids=[numbers.tobytes()], held=[held.tobytes()], sizes=[sizes.astype("<i4").tobytes()], places=[places.astype("<i4").tobytes()], ends=[ends.astype("<i4").tobytes()], pieces=[pieces.astype("<u2" if len(counted) <= 1 << 16 else "<u4").tobytes()])
            number += 1

        ids, texts, have = [], [], 0
        for batch in batches:
            text, i = text_of(batch), 0
            size = np.cumsum(np.diff(bytes_of(text)[1]))
            while i < len(text):
                done = int(size[i - 1]) if i else 0
                j = min(len(text), max(i + 1, int(np.searchsorted(size, done + BLOCK_BYTES - have, side="right"))))
                ids.append(batch.column("id").slice(i, j - i))
                texts.append(text.slice(i, j - i))
                have, i = have + int(size[j - 1]) - done, j
                if have >= BLOCK_BYTES or i < len(text):
                    yield from block(ids, texts)
                    ids, texts, have = [], [], 0
        if ids:
            yield from block(ids, texts)
        if counted.any():
            yield rows(1, piece_counts=[counted.tobytes()])

    return written(map_arrow(docs, run, BLOCKS), "blocks")


def summed(vectors: DataFrame, column: str, kind: str) -> np.ndarray | None:
    """The sum of the vectors in a binary column, added up in a few tasks before the driver; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total = np.frombuffer(v, kind) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({column: pa.array([total.astype(kind).tobytes()], pa.binary())})

    # Each task has made one vector; a second Python step in its stage would be a second worker.
    parts = map_arrow(vectors.where(F.col(column).isNotNull()).select(column).repartition(SUMS), run, f"{column} binary").collect()
    return sum(np.frombuffer(r[column], kind) for r in parts) if parts else None


def word_counts(words: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, counts`` over all blocks for the words of each row of ``words``, and
    each bucket's sum and number of training words (``total``, ``distinct``; ``block`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, bytes]] = []
        at = None

        def bucket() -> pa.RecordBatch:
            length = np.frombuffer(b"".join(h[3] for h in held), "<i4")
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(h[1] for h in held))])
            off = np.concatenate([[0], np.cumsum([len(h[3]) // 4 for h in held])]).tolist()
            coded = words.dictionary_encode().indices.to_numpy()
            n = np.frombuffer(b"".join(h[2] for h in held), "<i8")
            order = np.argsort(coded, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(coded[order]) > 0]))
            total = np.add.reduceat(n[order], begin)  # whole numbers, however large
            c = total[coded].astype("<i8")
            blocks = [h[0] for h in held]
            return pa.RecordBatch.from_pydict({"block": pa.array([*blocks, None], pa.int64()), "bucket": pa.array([at] * (len(held) + 1), pa.int32()), "counts": pa.array([*(c[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)), None], pa.binary()), "total": pa.array([*[None] * len(held), int(total.sum())], pa.int64()), "distinct": pa.array([*[None] * len(held), int((total > 0).sum())], pa.int64())})

        for batch in batches:
            for b, k, w, c, n in zip(*(batch.column(x).to_pylist() for x in ("block", "bucket", "words", "counts", "lengths")), strict=True):
                if k != at and held:
                    yield bucket()
                    held = []
                at = k
                held.append((b, w, c, n))
        if held:
            yield bucket()

    dealt = words.select("block", "bucket", "words", "counts", "lengths").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return written(map_arrow(dealt, run, "block long, bucket int, counts binary, total long, distinct long"), "word-counts")


class Block:
    """A block's documents as pieces, from its row."""

    def __init__(self, row: dict, wide: bool) -> None:
        self.ids, self.held = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["held"], bool)
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.places = np.frombuffer(row["places"], "<i4")
        self.ends, self.pieces = np.frombuffer(row["ends"], "<i4").astype(np.int64), np.frombuffer(row["pieces"], "<u4" if wide else "<u2")

    def tokens(self, first: int, last: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these documents with their ends, and where each document's begin and end."""
        at = self.at[first : last + 1]
        places = self.places[at[0] : at[-1]]
        begin = self.ends[places]
        n = self.ends[places + 1] - begin
        after = np.concatenate([[0], np.cumsum(n)])
        return with_end(self.pieces[np.repeat(begin - after[:-1], n) + np.arange(after[-1])], after[at - at[0]], end)

    def runs(self, first: int = 0, last: int | None = None, words: int = 80_000) -> Iterator[tuple[int, int]]:
        """Documents whose words are about so many at a time."""
        i, last = first, len(self.ids) if last is None else last
        while i < last:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + words, side="right")) - 1)
            yield i, min(j, last)
            i = j


def training_windows(ids: np.ndarray, at: np.ndarray, chosen: np.ndarray, shape: attention.Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the chosen texts that follow each other: what each token sees before it
    (-1 at a text's begin), the tokens, and which places are there."""
    before = np.concatenate([[-1], ids[:-1].astype(np.int64)])[: len(ids)]
    before[at[:-1]] = -1  # no text is without its end
    n = np.where(chosen, np.diff(at), 0)
    count = -(-n // shape.window)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    where = (at[doc] + k * shape.window)[:, None] + np.arange(shape.window)
    there = where < at[doc + 1][:, None]
    where = np.where(there, where, 0)
    return np.where(there, before[where], -1), ids[where], there


def train(blocks: DataFrame, model: str, vocab: attention.Vocabulary, shape: attention.Shape) -> dict[str, np.ndarray]:
    """Rounds of local Adam and averaging; each training document is used in one round."""
    weights = attention.begin(vocab, shape)
    names = sorted(weights)
    end, wide = piece_encoder(model).sp.eos_id(), piece_encoder(model).sp.vocab_size() > 1 << 16
    for turn in range(ROUNDS):
        start = {k: v.copy() for k, v in weights.items()}

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            w, seen = {k: v.copy() for k, v in start.items()}, 0
            adam, mix = attention.Adam(w, RATE), np.random.default_rng(1)
            input_row = np.append(vocab.row, 0)  # the last, -1, is a text's begin
            for batch in batches:
                for k in range(batch.num_rows):
                    block = Block({c: batch.column(c)[k].as_py() for c in batch.schema.names}, wide)
                    # Each third of a block's documents has its round; which comes first differs by block.
                    third = (turn + int(block.at[-1])) % ROUNDS
                    bounds = [len(block.ids) * x // ROUNDS for x in (third, third + 1)]
                    for i, j in block.runs(*bounds):
                        ids, at = block.tokens(i, j, end)
                        before, ids, there = training_windows(ids, at, ~block.held[i:j], shape)
                        order = mix.permutation(len(ids))
                        for x in range(0, len(ids), BATCH):
                            part = order[x : x + BATCH]
                            adam.step(attention.step(w, input_row[before[part]], vocab.cls[ids[part]], there[part], with_loss=False)[1])
                        seen += int(there.sum())
            if seen:
                vector = np.concatenate([*(w[k].ravel() for k in names), [1.0]]).astype("<f8") * seen
                yield pa.RecordBatch.from_pydict({"w": pa.array([vector.tobytes()], pa.binary())})

        total = summed(map_arrow(blocks.select("held", "ids", "sizes", "places", "ends", "pieces"), run, "w binary"), "w", "<f8")
        if total is not None:
            vector = (total[:-1] / total[-1]).astype(np.float32)
            cuts = np.cumsum([weights[k].size for k in names])[:-1]
            weights = {k: x.reshape(weights[k].shape).copy() for k, x in zip(names, np.split(vector, cuts), strict=True)}
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", shape: attention.Shape | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    shape, spark = shape or attention.Shape(), docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    found = blocks_of(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model, buckets)
    blocks = found.where("block IS NOT NULL AND bucket IS NULL")
    # The base's counts: training words, and an end for each training document.
    known = word_counts(found.where("bucket IS NOT NULL"), buckets)
    sums = known.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    enc = piece_encoder(model)
    counted = summed(found, "piece_counts", "<i8")
    counts = np.zeros(enc.sp.vocab_size()) if counted is None else counted.astype(float)
    end, wide = enc.sp.eos_id(), len(counts) > 1 << 16
    ends = int(counts[end])
    n_train, distinct = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
    below = log10(n_train + 0.5 * (distinct + 1))
    vocab = attention.Vocabulary(counts, shape)
    weights = train(blocks, model, vocab, shape)

    def run(key: tuple, own: pa.Table, words: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block = Block(row, wide)
        c = np.frombuffer(b"".join(words.sort_by("bucket").column("counts").to_pylist()), "<i8")
        value, is_known = np.log10(c + 0.5) - below, c > 0
        doc, many = np.repeat(np.arange(len(block.ids)), np.diff(block.at)), len(block.ids)
        base = np.bincount(doc, value[block.places], many) + log10(ends + 0.5) - below
        seen = np.bincount(doc, is_known[block.places], many).astype(np.int64) + (ends > 0)
        scores = [attention.log10_probability(weights, vocab, *block.tokens(i, j, end), shape) for i, j in block.runs()]
        n = np.diff(block.at) + 1
        give_back()
        return pa.table({"doc_id": pa.array(block.ids, pa.int64(), mask=block.ids == _NULL), "held_out": pa.array(block.held), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array(np.full(len(n), n_train), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(scores), pa.float64())})

    own = blocks.select("block", "ids", "held", "sizes", "places", "ends", "pieces")
    return own.groupBy("block").cogroup(known.where("block IS NOT NULL").select("block", "bucket", "counts").groupBy("block")).applyInArrow(run, SCORES)
