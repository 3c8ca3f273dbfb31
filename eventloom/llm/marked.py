"""SentencePiece encoding and decoding by distinct-chunk tables.

No piece of the model crosses a white-space marker (checked when the model is
loaded), so a text is cut before the first marker of each run. Each distinct
marked word is segmented once, and the ids are joined back by position. Where a
model has pieces across markers, texts go to the library whole.

Defined cases: a null or empty text has the end id only and decodes to an empty
text; a text that begins with a space goes to the library whole, as its first
marker is not the one that the library adds; a very long text is cut
and encoded whole; an empty table gives no rows; repeated rows are each encoded; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, before_markers, flat
from .common import map_arrow, text_of

MARK = "▁"


class PieceEncoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        sp = self.sp
        pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
        crosses = any(MARK in p.lstrip(MARK) for p in pieces)
        # The library adds a marker in front and keeps all others.
        plain = sp.encode("a b  c") == [*sp.encode("a"), *sp.encode("b"), *sp.encode(" c")] and sp.encode("  ") != sp.encode(" ")
        self.by_chunk = plain and not crosses
        self.table = ChunkTable(self._encode, before_markers)

    def _encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        # A space at a text's end is a marker alone; the library adds none to an empty text.
        alone = [self.sp.piece_to_id(MARK)]
        coded = self.sp.encode([c[1:] if c[:1] == " " else c for c in chunks], num_threads=1)
        return chunks, *flat([alone if c == " " else ids for c, ids in zip(chunks, coded, strict=True)])

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin and end."""
        listed = texts.to_pylist()
        odd = [i for i, t in enumerate(listed) if t[:1] in (" ", MARK)] if self.by_chunk else range(len(listed))
        if not len(odd):
            return self.table.ids(texts)
        whole = {i: np.array(self.sp.encode(listed[i], num_threads=1), np.uint32) for i in odd}
        ids, at = self.table.ids(pa.array(["" if i in whole else t for i, t in enumerate(listed)], pa.string()))
        each = [whole[i] if i in whole else ids[at[i] : at[i + 1]] for i in range(len(listed))]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, the ids
    themselves and the decoded text, for every row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model)
        end = enc.sp.eos_id()
        digits = [str(i) for i in range(enc.sp.vocab_size())]
        for batch in batches:
            ids, at = enc.ids(text_of(batch))
            n, id_hash, text_hash, lists, texts = [], [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[a:b].tolist()
                own.append(end)
                decoded = enc.sp.decode(own)
                n.append(len(own))
                id_hash.append(hashlib.sha256(" ".join([digits[i] for i in own]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    lists.append(own)
                    texts.append(decoded)
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)
