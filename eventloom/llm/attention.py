"""A causal self-attention language model in numpy.

Ids fall into classes of about equal frequency; the model predicts a token's class
from its window by one masked attention block, and the class's own unigram gives
the id: ``P(id | context) = P(class | context) * P(id | class)``, a proper
distribution over the vocabulary. Frequent ids have a class each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """``window`` tokens are seen at once; in scoring, windows begin every ``stride``
    tokens, so that a token behind a text's first window sees ``window - stride`` or more."""

    window: int = 32
    stride: int = 24
    width: int = 16
    hidden: int = 32
    classes: int = 64
    inputs: int = 2048


class Vocabulary:
    """Classes and input rows of ids, from their counts over the training texts."""

    def __init__(self, counts: np.ndarray, shape: Shape) -> None:
        p = (counts + 0.5) / (counts + 0.5).sum()
        order = np.lexsort((np.arange(len(p)), -p))
        # Ids by falling frequency, classes cut where the mass passes each share of what is left.
        self.cls = np.zeros(len(p), np.int64)
        left, k, mass = 1.0, 0, 0.0
        for i in order:
            self.cls[i] = k
            mass += p[i]
            if k < shape.classes - 1 and mass >= left / (shape.classes - k):
                left, k, mass = left - mass, k + 1, 0.0
        self.n_classes = shape.classes
        in_class = np.bincount(self.cls, weights=p, minlength=shape.classes)
        self.class_p = np.maximum(in_class, 1e-12)
        self.log_within = np.log(p / in_class[self.cls])
        # Frequent ids have an input row each, others share rows; row 0 is the text's begin.
        own = shape.inputs // 2
        rank = np.empty(len(p), np.int64)
        rank[order] = np.arange(len(p))
        shared = own + (np.arange(len(p)) * 2654435761 % (1 << 32)) % (shape.inputs - own)
        self.row = np.where(rank < own - 1, rank + 1, shared)


def begin(vocab: Vocabulary, shape: Shape, seed: int = 7) -> dict[str, np.ndarray]:
    r, d = np.random.default_rng(seed), shape.width
    make = lambda *size: (r.standard_normal(size) / np.sqrt(size[0])).astype(np.float32)
    return {
        "embed": (0.3 * r.standard_normal((shape.inputs, d))).astype(np.float32),
        "place": (0.1 * r.standard_normal((shape.window, d))).astype(np.float32),
        "q": make(d, d), "k": make(d, d), "v": make(d, d), "o": make(d, d),
        "up": make(d, shape.hidden), "up_b": np.zeros(shape.hidden, np.float32),
        "down": make(shape.hidden, d),
        "out": np.zeros((d, shape.classes), np.float32),
        "out_b": np.log(vocab.class_p / vocab.class_p.sum()).astype(np.float32),
    }


#: Sums of exponentials between these are taken as they are; beyond them each row's largest is taken off first.
LEAST, MOST = np.exp(-60), np.exp(60)
#: Tokens that go through the layers together: what they need stays in a core's cache, and
#: their products are small enough (a million multiplications) for BLAS to take them as they lie.
#: Scoring keeps less of them.
PART, SCORED = 900, 1400


def _exp(s: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials, zero where the mask is; the sums of the last axis, and what has been
    taken off each row before, so that none is too large or all too small."""
    e = np.exp(s)
    if mask is not None:
        e *= mask
    flat, ones = e.reshape(-1, s.shape[-1]), np.ones(s.shape[-1], s.dtype)
    total, off = flat @ ones, 0.0
    if total.size and not (total.min() > LEAST and total.max() < MOST):  # nor where one is no number
        if mask is not None:
            s = s + np.where(mask > 0, np.float32(0), np.float32(-1e30))
        off = s.max(axis=-1, keepdims=True)
        np.exp(s - off, out=e)
        total, off = flat @ ones, off[..., 0]
    return e, total.reshape(s.shape[:-1]), off


class _Layers:
    """The weights as the layers use them. There is one head as wide as a token, so queries
    and keys meet as one matrix between tokens (``near``), values and output as another
    (``take``): what is compared and gathered is the tokens themselves. Every token has a one
    behind its numbers, for the biases, so that whole arrays are added."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        kind, d = w["q"].dtype, w["q"].shape[0]
        column, row = lambda x, one: np.concatenate([x, np.full((len(x), 1), one, kind)], axis=1), lambda x, one: np.concatenate([x, one[None]])
        self.embed, self.place = column(w["embed"], 1), column(w["place"], 0)
        self.near = w["q"] @ w["k"].T * kind.type(d**-0.5)
        self.take, self.down = column(w["v"] @ w["o"], 0), column(w["down"], 0)
        self.up, self.out = row(w["up"], w["up_b"]), row(w["out"], w["out_b"])

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        x = np.take(self.embed, rows.ravel(), axis=0).reshape(*rows.shape, self.embed.shape[1])
        x += self.place[: rows.shape[1]]
        return x

    def rest(self, x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the layers behind the attention make of tokens and what they have gathered."""
        y = a @ self.take
        y += x
        h = y @ self.up
        np.maximum(h, np.zeros_like(h), out=h)  # with one zero it is four times slower
        z = h @ self.down
        z += y
        return y, h, z


def _turned(x: np.ndarray) -> np.ndarray:
    """Each window's tokens as columns: products with a copy are faster than with them as they lie."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _parts(n: int, length: int, size: int) -> list[tuple[int, int]]:
    """Windows with so many tokens each, in parts of about equal size."""
    k = max(1, -(-n // max(1, size // length)))
    return [(n * i // k, n * (i + 1) // k) for i in range(k)] if n else []


def step(w: dict[str, np.ndarray], rows: np.ndarray, cls: np.ndarray, weight: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean of -log P(class) over windows of input rows (batch, length), if
    asked for, and its gradients: sums over parts of the batch."""
    (b, n), d, kind, layers = rows.shape, w["q"].shape[0], w["q"].dtype, _Layers(w)
    share = (weight / max(weight.sum(), 1)).astype(kind)
    mask = np.tril(np.ones((n, n), kind))  # no token sees a later one
    loss, gx = 0.0, np.empty((b, n, d), kind)
    sums = [np.zeros(x.shape, kind) for x in (layers.near, w["o"], layers.up, layers.down[:, :d], layers.out)]
    with np.errstate(over="ignore", invalid="ignore"):
        for i, j in _parts(b, n, PART):
            part_loss, own = _part(layers, mask, rows[i:j], cls[i:j], share[i:j], gx[i:j], with_loss)
            loss += part_loss
            for total, x in zip(sums, own, strict=True):
                total += x
    near, take, up, down, out = sums
    near *= kind.type(d**-0.5)
    g = {"q": near @ w["k"], "k": near.T @ w["q"], "v": take @ w["o"].T, "o": w["v"].T @ take, "up": up[:-1], "up_b": up[-1], "down": down, "out": out[:-1], "out_b": out[-1]}
    g["place"] = np.zeros_like(w["place"])
    g["place"][:n] = gx.sum(axis=0)
    # Sums by input row, a column at a time.
    at, g["embed"] = rows.ravel(), np.empty_like(w["embed"])
    for k, x in enumerate(np.ascontiguousarray(gx.reshape(b * n, d).T, float)):
        g["embed"][:, k] = np.bincount(at, x, len(w["embed"]))
    return loss, g


def _part(layers: _Layers, mask: np.ndarray, rows: np.ndarray, cls: np.ndarray, share: np.ndarray, gx: np.ndarray, with_loss: bool) -> tuple[float, tuple[np.ndarray, ...]]:
    """A part's loss and gradients of ``near``, ``take``, ``up``, ``down`` and ``out``; those of the inputs go to ``gx``."""
    (b, n), d = rows.shape, gx.shape[2]
    m, kind = b * n, gx.dtype
    x = layers.inputs(rows)
    seen, turned, x = x[:, :, :d], _turned(x), x.reshape(m, d + 1)
    q = (x[:, :d] @ layers.near).reshape(b, n, d)
    s, total, _ = _exp(q @ turned[:, :d], mask)
    part = (1 / total).reshape(m, 1)
    a = (s @ seen).reshape(m, d)
    a *= part
    y, h, z = layers.rest(x, a)
    logits = z @ layers.out
    e, total, off = _exp(logits)
    target, share = np.arange(0, e.size, e.shape[1]) + cls.ravel(), share.ravel()
    loss = float(-(share * (logits.ravel()[target] - off - np.log(total))).sum()) if with_loss else 0.0
    # Probabilities are e over total; the division goes where there are fewer numbers.
    e.reshape(-1)[target] -= total
    share = (share / total)[:, None]
    z *= share
    g_out = (e.T @ z).T  # faster than z.T @ e
    gz = np.matmul(e, layers.out[:-1].T, out=gx.reshape(m, d))
    gz *= share
    g_down = h.T @ gz
    gh = gz @ layers.down[:, :-1].T
    gh *= h > 0
    g_up = (gh.T @ y).T
    gz += gh @ layers.up[:-1].T
    g_take = a.T @ gz
    # Behind a gradient of what is gathered stands what its exponents lose together, its product with what is gathered.
    ga = np.empty((m, d + 1), kind)
    np.matmul(gz, layers.take[:, :-1].T, out=ga[:, :d])
    ga[:, d] = (ga[:, :d] * a) @ np.full(d, -1, kind)
    ga *= part
    ga = ga.reshape(b, n, d + 1)
    gs = ga @ turned
    gs *= s
    gq = (gs @ seen).reshape(m, d)
    gx += gs.transpose(0, 2, 1) @ q
    gx += s.transpose(0, 2, 1) @ ga[:, :, :d]
    gz += gq @ layers.near.T
    return loss, (x[:, :d].T @ gq, g_take, g_up, g_down, g_out)


class Adam:
    """The weights become views of one vector, which a step passes over once."""

    def __init__(self, w: dict[str, np.ndarray], rate: float) -> None:
        self.names, self.rate, self.t = list(w), rate, 0
        self.w = np.concatenate([w[k].ravel() for k in self.names])
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)
        cuts = np.cumsum([w[k].size for k in self.names])[:-1]
        w |= {k: x.reshape(w[k].shape) for k, x in zip(self.names, np.split(self.w, cuts), strict=True)}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        x = np.concatenate([g[k].ravel() for k in self.names])
        self.m *= 0.9
        self.m += 0.1 * x
        x *= x
        x *= 0.01
        self.v *= 0.99
        self.v += x
        np.divide(self.v, 1 - 0.99**self.t, out=x)
        np.sqrt(x, out=x)
        x += 1e-8
        np.divide(self.m, x, out=x)
        x *= self.rate / (1 - 0.9**self.t)
        self.w -= x


def windows(at: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts whose tokens are ``at[i]`` to ``at[i + 1]``: the
    text, the place of the first token, and the first place in the window that is
    scored there, so that each token is scored once."""
    n = np.diff(at)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - shape.window) // shape.stride)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, k * shape.stride, np.where(k > 0, shape.window - shape.stride, 0)


def log_class(layers: _Layers, mask: np.ndarray, rows: np.ndarray, cls: np.ndarray, first: int) -> np.ndarray:
    """log P(class) of the targets from ``first`` on: what ``step`` learns, with nothing
    calculated for what is context alone."""
    (b, n), m = rows.shape, rows.shape[1] - first
    x = layers.inputs(rows)
    d = x.shape[2] - 1
    seen, turned, x = x[:, :, :d], _turned(x[:, :, :d]), np.ascontiguousarray(x[:, first:]).reshape(b * m, d + 1)
    s, total, _ = _exp((x[:, :d] @ layers.near).reshape(b, m, d) @ turned, mask[first:n, :n])
    a = s @ seen
    a *= (1 / total)[:, :, None]
    logits = layers.rest(x, a.reshape(b * m, d))[2] @ layers.out
    target = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + cls.ravel()]
    _, total, off = _exp(logits)
    return (target - off - np.log(total)).reshape(b, m)


def log10_probability(w: dict[str, np.ndarray], vocab: Vocabulary, ids: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """The log10 probability of each text."""
    n_ids = len(ids)
    if not n_ids:
        return np.zeros(len(at) - 1)
    layers, mask = _Layers(w), np.tril(np.ones((shape.window, shape.window), np.float32))
    # What a token sees before it and its class, with room behind the last text.
    room = np.zeros(shape.window, np.int32)
    before = np.concatenate([[0], vocab.row[ids[:-1]], room]).astype(np.int32)
    before[at[:-1][np.diff(at) > 0]] = 0
    cls = np.concatenate([vocab.cls[ids], room]).astype(np.int32)
    within = np.concatenate([[0], np.cumsum(vocab.log_within[ids])])
    out = within[at[1:]] - within[at[:-1]]
    doc, start, first = windows(at, shape)
    begin, left = at[doc] + start, at[doc + 1] - at[doc] - start
    before, places = np.lib.stride_tricks.sliding_window_view(before, shape.window), np.arange(shape.window)
    for f in np.unique(first).tolist():
        chosen, after = np.flatnonzero(first == f), np.lib.stride_tricks.sliding_window_view(cls[f:], shape.window - f)
        for i, j in _parts(len(chosen), shape.window - f, SCORED):
            part = chosen[i:j]
            with np.errstate(over="ignore", invalid="ignore"):
                value = log_class(layers, mask, before[begin[part]], after[begin[part]], f)
            value *= places[f:] < left[part][:, None]
            out += np.bincount(doc[part], weights=value.sum(axis=1, dtype=np.float64), minlength=len(out))
    return out / np.log(10)
