"""Distinct-chunk tables: encode each distinct chunk of a batch of texts once and
join the ids back by position.

A text is cut where no token or piece can cross: before a space, between a letter
and the ASCII symbol after it, around a single line break. The chunks of a batch
are dictionary-encoded (Arrow), only chunks that the table does not hold are encoded
by the tokenizer's own library, and the ids of all occurrences come from one gather.
A table lives in one worker; when it is full it forgets what was met once only, so that
memory does not depend on the input; a very long text is cut into chunks a few megabytes at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import bytes_of

#: A table forgets beyond so many chunks or bytes of chunks.
MAX_CHUNKS, MAX_CHUNK_BYTES = 400_000, 16 << 20
#: Bytes of text that are cut and dictionary-encoded at a time, new chunks that are encoded at a time, and joined;
#: occurrences whose ids are gathered at a time.
STEP, NEW, JOINED, GATHER = 4 << 20, 20_000, 500, 1 << 18


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: ASCII letters; other visible ASCII characters but digits; second bytes of the letters U+00C0 to U+00FF.
_LETTER = _bytes((0x41, 0x5A), (0x61, 0x7A))
_SYMBOL = _bytes((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_LATIN = _bytes((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: Bytes that surely begin a character that isn't white space.
_SOLID = _bytes((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))


def before_words(raw: np.ndarray) -> np.ndarray:
    """Cuts of the byte-level and word vocabularies, whose pre-tokenizers begin a token
    there, whatever stands on either side:

    * before each space with a solid character after it;
    * between a letter (ASCII or Latin-1, which no normaliser takes apart) and the
      ASCII symbol after it;
    * around a line break that stands alone between such a letter or an ASCII symbol
      and a solid character.
    """
    cut = np.zeros(len(raw), bool)
    if len(raw) < 2:
        return cut
    cut[:-1] = (raw[:-1] == 0x20) & _SOLID[raw[1:]]
    letter, symbol = _LETTER[raw], _SYMBOL[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    cut[1:] |= letter[:-1] & symbol[1:]
    alone = (raw[1:-1] == 0x0A) & (letter | symbol)[:-2] & _SOLID[raw[2:]]
    cut[1:-1] |= alone
    cut[2:] |= alone
    return cut


def before_markers(raw: np.ndarray) -> np.ndarray:
    """Cuts before each first space of a run.

    A space is a piece's white-space marker (U+2581, whose last byte is 0x81);
    pieces hold markers at their start only, or are runs of markers.
    """
    cut = np.zeros(len(raw), bool)
    if len(raw) > 1:
        cut[1:] = (raw[1:] == 0x20) & (raw[:-1] != 0x20) & (raw[:-1] != 0x81)
    return cut


class ChunkTable:
    """``encode`` gives some distinct chunks in an order of its own, their ids one after
    the other, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], cut: Callable[[np.ndarray], np.ndarray], max_chunks: int = MAX_CHUNKS, max_bytes: int = MAX_CHUNK_BYTES) -> None:
        self.encode, self.cut, self.max_chunks, self.max_bytes = encode, cut, max_chunks, max_bytes
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.ends, self.held = array("I"), array("q", [0]), 0
        self.again = np.zeros(1024, bool)  # chunks that were met again

    def forget(self) -> None:
        """Keep the chunks that were met again since the last time, but half of the table at most."""
        names, kept = list(self.slots), np.flatnonzero(self.again[: len(self.slots)])
        if len(kept) > self.max_chunks // 2:
            kept = kept[:0]
        ids, at = self.gather(kept, np.arange(len(kept) + 1))
        self.clear()
        own = [names[i] for i in kept.tolist()]
        self.slots = dict(zip(own, range(len(own)), strict=True))
        self.flat.frombytes(ids.tobytes())
        self.ends.frombytes(at[1:].astype(np.int64).tobytes())
        self.held = sum(map(len, own))

    def _slots_of(self, words: list[str]) -> np.ndarray:
        known = self.slots
        out = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        there = out >= 0
        missing = np.flatnonzero(~there)
        if len(known) > len(self.again):
            self.again = np.append(self.again, np.zeros(len(known), bool))
        self.again[out[there]] = True
        new = [words[i] for i in missing.tolist()]
        for i in range(0, len(new), NEW):
            part, ids, n = self.encode(new[i : i + NEW])
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.ends.frombytes((self.ends[-1] + np.cumsum(n, dtype=np.int64)).tobytes())
            self.flat.frombytes(ids.astype(np.uint32).tobytes())
            self.held += sum(map(len, part))
        out[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        return out

    def occurrences(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each chunk of the texts, and where each text's chunks begin and end."""
        if len(self.slots) > self.max_chunks or self.held > self.max_bytes:
            self.forget()
        raw, off = bytes_of(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        mask = np.empty(len(raw), bool)
        for i in range(0, len(raw), STEP):  # a cut depends on two bytes to either side
            j, before = min(i + STEP, len(raw)), min(i, 2)
            mask[i:j] = self.cut(raw[i - before : j + 2])[before : before + j - i]
        mask[off[:-1][off[:-1] < len(raw)]] = True
        starts = np.flatnonzero(mask)
        del mask
        out, i = np.empty(len(starts), np.int32), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP)))
            end = starts[j] if j < len(starts) else len(raw)
            part = (np.append(starts[i:j], end) - starts[i]).astype(np.int32)
            col = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(part), pa.py_buffer(np.ascontiguousarray(raw[starts[i] : end]))])
            coded = col.dictionary_encode()
            out[i:j] = self._slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            i = j
        return out, np.searchsorted(starts, off)

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin and end."""
        slots, at = self.occurrences(texts)
        return self.gather(slots, at)

    def gather(self, slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        after = np.concatenate([[0], np.cumsum((ends[1:] - ends[:-1])[slots])]).astype(np.int64)
        out = np.empty(after[-1], np.uint32)
        for i in range(0, len(slots), GATHER):
            part = slots[i : i + GATHER]
            own = after[i : i + len(part) + 1]
            out[own[0] : own[-1]] = flat[np.repeat(ends[part] - own[:-1], np.diff(own)) + np.arange(own[0], own[-1])]
        del flat, ends  # the arrays cannot grow while they are looked at
        return out, after[at]


def flat(coded: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each has."""
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.fromiter(chain.from_iterable(coded), np.uint32, n.sum()), n


class WordEncoder:
    """Ids of texts by the ``tokenizers`` library, without special tokens added.

    Chunks of a space and letters go to the library ``JOINED`` at a time, one after
    the other, as each begins a token of its own; where each ends is told by the
    vocabulary's word ends, or by the bytes of the ids' strings.

    Texts that hold the string of an added token go to the library whole, as it
    cuts them before anything else.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.get_vocab()
        # What ends a word, or else the bytes of each id: a byte-level string has a character for each.
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.measure = np.zeros(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            self.measure[i] = token.endswith(self.suffix) if self.suffix else len(token)
        self.table = ChunkTable(self._encode, before_words)

    def _encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        words, rest = [], []
        for c in chunks:
            (words if c[:1] == " " and c[1:].isalpha() else rest).append(c)
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        coded = self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)
        done, ids, n = [], [], []
        for part, e in zip(parts, coded, strict=True):
            own = np.array(e.ids, np.int64)
            reached = np.cumsum(self.measure[own])
            size = np.ones(len(part), np.int64) if self.suffix else np.fromiter((len(c.encode()) for c in part), np.int64, len(part))
            if reached[-1] != size.sum():  # a chunk that the normaliser makes several words of
                rest += part
                continue
            ends = np.searchsorted(reached, np.cumsum(size)) + 1
            done += part
            ids.append(own)
            n.append(np.diff(ends, prepend=0))
        own, many = flat([e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
        return done + rest, np.concatenate([*ids, own]), np.concatenate([*n, many])

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        raw, _ = bytes_of(texts)
        whole = raw.tobytes() if len(raw) else b""
        if not any(t.encode() in whole for t in self.added):
            return self.table.ids(texts)
        each = []
        for t in texts.to_pylist():
            if any(a in t for a in self.added):
                each.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                each.append(self.table.ids(pa.array([t], pa.string()))[0])
        return (np.concatenate(each) if each else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at each text's end."""
    n = len(at) - 1
    out = np.empty(len(ids) + n, np.uint32)
    last = at[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep], out[last] = ids, end
    return out, at + np.arange(n + 1)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file; workers are used again by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
