"""Parts that need no session."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import attention, scoring, sharding, simhash, tokens
from eventloom.llm.chunks import WordEncoder
from eventloom.llm.exact import CuckooIndex
from eventloom.llm.marked import PieceEncoder
from eventloom.llm.packing import Capacity, pack

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ENCODERS = {p: WordEncoder(p) for p in (BYTES, WORDS)}
PIECE = PieceEncoder(PIECES)
ALPHABET = st.text(st.sampled_from(list("ab's.,!  \n\t\r  　é́ßΣ1२中😀▁<|>\x00\x85")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_chunks_equal_the_libraries(texts):
    col = pa.array(texts, pa.string())
    for path, enc in ENCODERS.items():
        ids, at = enc.ids(col)
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want, path
    ids, at = PIECE.ids(col)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == PIECE.sp.encode(texts)


def test_every_letter_with_each_mark():
    """Also letters that a normaliser changes, takes apart or composes."""
    import unicodedata

    odd = ["İ", "ß", "Σ", "ς", "ſ", "K", "Å", "ﬁ", "①", "²", "ª", "÷", "÷a", "a\u0301", "क़", "\u1100\u1161", "가", "\u0345"]
    letters = [chr(i) for i in (*range(0x41, 0x2C00), *range(0xA640, 0xAB70), *range(0xFB00, 0xFB50)) if unicodedata.category(chr(i))[0] in "LMN"]
    texts = [f"su{c}{m}x {c}{m} {c}\n{c}" for m in ",'<&0" for c in letters[:: 1 if m == "," else 7]] + [f"{a}{m}{b} {a}" for a in odd for b in odd for m in (" ", ".", "\n", " \n", "'s")]
    col = pa.array(texts, pa.string())
    for path, enc in ENCODERS.items():
        ids, at = enc.ids(col)
        want = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in want], path


def test_added_tokens_and_full_tables():
    enc = WordEncoder(BYTES)
    enc.table.max_chunks = 3
    for t in ("a <|endoftext|> b", "many words, in. one text here", "many other words, again.", ""):
        assert enc.ids(pa.array([t]))[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(0, 10))
def test_direct_codes(ids, k):
    ids = np.array(ids, np.uint32)
    cut = min(k, len(ids))
    seg = tokens.Segment(tokens.encode(np.array([3, 9]), np.array([0, cut, len(ids)]), ids))
    assert seg.all().tolist() == ids.tolist() and [seg[i] for i in range(len(ids))] == ids.tolist()
    assert seg.document(1).tolist() == ids[cut:].tolist()
    with pytest.raises(IndexError):
        seg[len(ids)]


def test_direct_codes_across_rank_blocks():
    ids = np.random.default_rng(0).integers(0, 70_000, 20_000).astype(np.uint32)
    seg = tokens.Segment(tokens.encode(np.array([1]), np.array([0, len(ids)]), ids))
    assert len(seg.levels) == 3 and (seg.all() == ids).all()
    assert all(seg[i] == ids[i] for i in range(0, len(ids), 97))


def test_cuckoo_index():
    rng = random.Random(3)
    index, live = CuckooIndex(4), {}
    keys = [rng.randbytes(48) for _ in range(3000)]
    for step in range(12_000):
        k = rng.choice(keys)
        if k in live and rng.random() < 0.4:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            assert index.get(k) is None
            index.insert(k, step)
            live[k] = step
        else:
            assert index.get(k) == live[k]
    assert index.resizes > 0 and index.size == len(live) and dict(index.records()) == live
    assert not index.delete(rng.randbytes(48)) and all(index.may_hold(k) for k in live)


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_packing_under_every_constraint(select):
    lengths = np.random.default_rng(1).integers(1, 101, 800)
    cap = Capacity(100, 5, 6000, select=select) if select == "dot" else Capacity(100, 5, 10_000)
    if select == "dot":
        lengths = np.minimum(lengths, 77)
    seq, off = pack(lengths, cap)
    for s in range(seq.max() + 1):
        own = np.flatnonzero(seq == s)
        own = own[np.argsort(off[own])]
        assert lengths[own].sum() <= cap.tokens and len(own) <= cap.documents and (lengths[own] ** 2).sum() <= cap.attention
        assert off[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()
    assert pack(np.array([], int), cap)[0].tolist() == []
    with pytest.raises(ValueError, match="larger"):
        pack(np.array([101]), cap)


def test_packing_is_tight():
    lengths = np.random.default_rng(2).integers(1, 4000, 2000)
    assert pack(lengths, Capacity())[0].max() + 1 <= -(-lengths.sum() // 4096) * 1.02 + 1


def test_fingerprints():
    from xxhash import xxh64_intdigest

    docs = [[], [b"a"], [b"a", b"b", b"c"], [bytes([97 + i % 7]) for i in range(50)]]
    for words, got in zip(docs, simhash.fingerprints(docs, 3), strict=True):
        sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxh64_intdigest(s, 42) for s in sh]
        assert int(got) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tau", [1, 3, 6])
def test_plan_keeps_the_pigeonhole(tau):
    fps = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    bits = simhash._unpacked(fps).astype(float)
    for n in (100, 10**5, 10**8):
        p = simhash.plan(n, bits.T @ bits * (n / len(fps)), tau)
        assert sorted(b for part in p.partitions for b in part) == list(range(64))
        assert sum(p.thresholds) == tau - len(p.partitions) + 1


def plain(w, rows):
    """log P(class) of the attention model, in double precision and step by step."""
    w = {k: x.astype(float) for k, x in w.items()}
    out = []
    for row in rows:
        x = w["embed"][row] + w["place"][: len(row)]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        each = []
        for t in range(len(row)):
            s = k[: t + 1] @ q[t] / np.sqrt(q.shape[1])
            s = np.exp(s - s.max())
            y = x[t] + (s / s.sum()) @ v[: t + 1] @ w["o"]
            z = y + np.maximum(y @ w["up"] + w["up_b"], 0) @ w["down"]
            logits = z @ w["out"] + w["out_b"]
            each.append(logits - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
        out.append(each)
    return np.array(out)


def test_attention_gradients_and_scores():
    shape = attention.Shape(6, 4, 4, 5, 4, 16)
    r = np.random.default_rng(0)
    vocab = attention.Vocabulary(r.integers(0, 50, 30), shape)
    w = {k: x.astype(float) + 0.1 * r.standard_normal(x.shape) for k, x in attention.begin(vocab, shape).items()}
    rows, cls, weight = r.integers(0, 16, (3, 6)), r.integers(0, 4, (3, 6)), r.integers(0, 2, (3, 6)).astype(float)
    for grow in (1, 300):  # small weights, and exponents that need their largest taken off
        w["q"] *= grow
        w["out"] *= grow
        loss, g = attention.step(w, rows, cls, weight)
        assert loss == pytest.approx(-(plain(w, rows)[np.arange(3)[:, None], np.arange(6)[None], cls] * weight).sum() / weight.sum())
        for k in w:
            i = (rows[0, 0], 0) if k == "embed" else tuple(0 for _ in w[k].shape)
            was, h = w[k][i], 1e-5 / grow
            w[k][i] = was + h
            up = attention.step(w, rows, cls, weight)[0]
            w[k][i] = was - h
            down = attention.step(w, rows, cls, weight)[0]
            w[k][i] = was
            assert (up - down) / (2 * h) == pytest.approx(g[k][i], rel=1e-3, abs=1e-6 * grow), k
    w["q"], w["out"] = w["q"] / 300, w["out"] / 300
    # A later token changes nothing before it, and the probabilities of all ids sum to one.
    a, b = (plain(w, x) for x in (rows, np.concatenate([rows[:, :-1], rows[:, -1:] ^ 1], axis=1)))
    assert np.allclose(a[:, :-1], b[:, :-1])
    w32 = {k: x.astype(np.float32) for k, x in w.items()}
    total = sum(10 ** attention.log10_probability(w32, vocab, np.array([i], np.uint32), np.array([0, 1]), shape)[0] for i in range(30))
    assert total == pytest.approx(1, abs=1e-4)
    # Windows score each token once, with the probabilities that training sees, whatever the weights' size.
    ids, at = r.integers(0, 30, 60).astype(np.uint32), np.array([0, 0, 1, 7, 60])
    for grow in (1, 400):
        w32["q"] *= grow
        w32["out"] *= grow
        got = attention.log10_probability(w32, vocab, ids, at, shape)
        for d in range(4):
            own, want = ids[at[d] : at[d + 1]], 0.0
            for _, s, first in zip(*attention.windows(np.array([0, len(own)]), shape), strict=True):
                seen = own[s : s + shape.window]
                before = [[0 if s + i == 0 else vocab.row[own[s + i - 1]] for i in range(len(seen))]]
                p = plain(w32, np.array(before))[0]
                want += sum(p[i, vocab.cls[x]] + vocab.log_within[x] for i, x in enumerate(seen) if i >= first)
            assert got[d] == pytest.approx(want / np.log(10), rel=1e-4, abs=1e-3 * grow)


def test_attention_step_works_in_parts():
    # A step's arrays fit a core's cache, whatever its batch, and its gradients are those of the whole batch.
    shape, r = attention.Shape(), np.random.default_rng(1)
    vocab = attention.Vocabulary(r.integers(0, 50, 3000), shape)
    w = {k: x.astype(float) + 0.1 * r.standard_normal(x.shape) for k, x in attention.begin(vocab, shape).items()}
    w32 = {k: x.astype(np.float32) for k, x in w.items()}
    rows, cls = r.integers(0, shape.inputs, (128, shape.window)), r.integers(0, shape.classes, (128, shape.window))
    weight = r.random(rows.shape) < 0.9
    tracemalloc.start()
    attention.step(w32, rows, cls, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 << 20
    loss, g = attention.step(w, rows, cls, weight)
    each = [(weight[i : i + 1].sum() / weight.sum(), *attention.step(w, rows[i : i + 1], cls[i : i + 1], weight[i : i + 1])) for i in range(128)]
    assert loss == pytest.approx(sum(share * x for share, x, _ in each))
    for k in w:
        assert np.allclose(g[k], sum(share * x[k] for share, _, x in each), rtol=1e-9, atol=1e-12), k


class Counted(np.ndarray):
    """Arrays whose products count their multiplications."""

    done = 0

    def __array_function__(self, func, types, args, kw):
        got = super().__array_function__(func, types, args, kw)
        return got.view(Counted) if isinstance(got, np.ndarray) else got

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kw):
        plain = lambda xs: tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in xs)
        got = getattr(ufunc, method)(*plain(inputs), **({"out": plain(out)} if out else {}), **kw)
        if ufunc is np.matmul:
            Counted.done += got.size * inputs[0].shape[-1]
        return got.view(Counted) if isinstance(got, np.ndarray) else got


def test_attention_multiplies_no_more_than_it_must():
    # Queries, keys, values and output are two matrices between tokens. With four, a step took 12,224 multiplications a token, scoring 4,561.
    shape, r = attention.Shape(), np.random.default_rng(1)
    vocab = attention.Vocabulary(r.integers(0, 50, 3000), shape)
    w = {k: x.view(Counted) for k, x in attention.begin(vocab, shape).items()}
    rows, cls = r.integers(0, shape.inputs, (128, shape.window)), r.integers(0, shape.classes, (128, shape.window))
    Counted.done = 0
    attention.step(w, rows, cls, np.ones(rows.shape))
    assert 0 < Counted.done / rows.size < 11_200
    ids = r.integers(0, 3000, 32 + 24 * 50).astype(np.uint32)
    Counted.done = 0
    attention.log10_probability(w, vocab, ids, np.array([0, len(ids)]), shape)
    assert 0 < Counted.done / len(ids) < 3_900


def test_words_as_a_list():
    words = pa.array(["a", "\x00", "\x1c\x85\u2028\xa0", "é" * 5, "\U0001f600", "b"])
    assert scoring.listed(words) == words.to_pylist()
    assert scoring.listed(words.slice(2, 2)) == words.slice(2, 2).to_pylist()
    assert scoring.listed(words[:0]) == []


def test_adam():
    r = np.random.default_rng(2)
    w = {"a": r.standard_normal((3, 4)), "b": r.standard_normal(5)}
    plain_w, m, v = {k: x.copy() for k, x in w.items()}, dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0)
    adam = attention.Adam(w, 0.01)
    for t in range(1, 6):
        g = {k: r.standard_normal(x.shape) for k, x in w.items()}
        adam.step(g)
        for k, x in g.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x**2
            plain_w[k] -= 0.01 * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
            assert np.allclose(w[k], plain_w[k]), k


def test_tree():
    t = sharding.tree(25)
    assert [len(r.children) for r in t.children] == [3, 3, 1] and t.weight == 25
    with pytest.raises(ValueError, match="weight"):
        sharding.Node("x", 0, 1)
    with pytest.raises(ValueError, match="least one"):
        sharding.tree(0)
