"""A small causal self-attention language model in numpy.

A window has CONTEXT ids that are only looked at and SPAN ids that are scored, so each id of a
text is scored once, with CONTEXT to CONTEXT + SPAN - 1 ids before it.  Ids before the start of a
text are masked.  An id is predicted in two parts, its high and its low digit in base DIGIT.  Models that
were trained apart from the same start are averaged.

There is one head, as wide as an id's vector, so a score is e q k' e' and what is attended to is e v o:
the products q k' and v o are made once for all places, and keys and values are the vectors themselves.
All parameters lie in one vector, and so does the gradient.
"""

from __future__ import annotations


import math

import numpy as np

CONTEXT, SPAN = 16, 32
WIDTH = 16
DIGIT = 32
WINDOW = CONTEXT + SPAN
#: Windows that go through the model at once, and of a step in training.
BATCH = 64

#: Bounds of a logit, and of the norm of a gradient.
_MOST, _NORM = 40, 1
_ONES = np.ones(max(DIGIT, WINDOW), np.float32)
_SCALE = np.float32(1 / np.sqrt(WIDTH))
_CAUSAL = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)


def windows(ids: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts.

    ids: the texts' ids, one text after another; at: their offsets; start: the id that stands before a text.
    Returns the inputs (n, WINDOW), with -1 before a text, the first scored place of each window and how many it scores.
    """
    counts = np.diff(at)
    n = -(-counts // SPAN)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = at[:-1][text] + k * SPAN
    scored = np.minimum(SPAN, at[1:][text] - first)
    # The input at a place is the id before it; a text's first place has start.
    place = first[:, None] - CONTEXT + np.arange(WINDOW)[None, :] - 1
    low = at[:-1][text][:, None]
    out = ids[np.clip(place, 0, max(0, len(ids) - 1))].astype(np.int32) if len(ids) else np.zeros(place.shape, np.int32)
    out[place < low] = -1
    out[place == low - 1] = start
    return out, first, scored


def _sums_by(ids: np.ndarray, rows: np.ndarray, n: int, room: np.ndarray | None = None) -> np.ndarray:
    """The sum of the rows of each id below n.  room: takes the rows in the order of their ids."""
    ids = ids.astype(np.uint16) if n <= 1 << 16 else ids
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(first):
        out[ids[first]] = np.add.reduceat(np.take(rows, order, axis=0, mode="clip", out=room), first, axis=0)
    return out


class Attention:
    """p: views of the parameters in the vector flat; each digit's offsets are the last row of its weights."""

    def __init__(self, flat: np.ndarray):
        d, self.vector, self.p, self.rooms, at = WIDTH, flat, {}, {}, 0
        for name, shape in (("e", (DIGIT * DIGIT, d)), ("pos", (WINDOW, d)), *((n, (d, d)) for n in "qkvo"), ("high", (d + 1, DIGIT)), ("low", (DIGIT, d + 1, DIGIT))):
            size = int(np.prod(shape))
            self.p[name] = flat[at : at + size].reshape(shape)
            at += size
        self.high, self.low = self.p.pop("high"), self.p.pop("low")
        self.p |= {"a": self.high[:d], "ba": self.high[d], "b": self.low[:, :d], "t": self.low[:, d]}

    def __reduce__(self):
        return Attention, (self.vector,)

    @classmethod
    def zeros(cls) -> Attention:
        return cls(np.zeros((DIGIT * DIGIT + WINDOW + 4 * WIDTH) * WIDTH + (DIGIT + 1) * (WIDTH + 1) * DIGIT, np.float32))

    @classmethod
    def new(cls, seed: int = 0) -> Attention:
        r, d, v, out = np.random.default_rng(seed), WIDTH, DIGIT * DIGIT, cls.zeros()
        w = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0] if s[0] < 100 else 1)).astype(np.float32)
        for name, value in {"e": w(v, d), "pos": w(WINDOW, d) * 0.1, "q": w(d, d), "k": w(d, d), "v": w(d, d), "o": w(d, d), "a": w(d, DIGIT), "b": w(d, DIGIT, DIGIT).transpose(1, 0, 2)}.items():
            out.p[name][:] = value
        return out

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array in a place that stays from batch to batch, and is shared by arrays that are not needed at once.

        The system takes about as long to hand out fresh pages as it takes to fill them, and what is
        used again soon is still in the processor's cache.
        """
        size = math.prod(shape)
        if (a := self.rooms.get(name)) is None or len(a) < size:
            a = self.rooms[name] = np.empty(size, np.float32)
        return a[:size].reshape(shape)

    def _forward(self, x: np.ndarray):
        p, n, room = self.p, len(x), self._room
        e, et, eq = room("e", n, WINDOW, WIDTH), room("et", n, WIDTH, WINDOW), room("eq", n * SPAN, WIDTH)
        np.take(p["e"], x, axis=0, mode="clip", out=e)  # -1 takes the first id's, and gets no weight
        e += p["pos"]
        et[:] = e.transpose(0, 2, 1)
        eq.reshape(n, SPAN, WIDTH)[:] = e[:, CONTEXT:]
        q = np.matmul(eq, p["q"] @ p["k"].T * _SCALE, out=room("q", n * SPAN, WIDTH)).reshape(n, SPAN, WIDTH)
        s = np.matmul(q, et, out=room("s", n, SPAN, WINDOW))
        np.exp(s, out=s)
        s *= _CAUSAL
        starts = np.flatnonzero(x[:, 0] < 0)  # of texts
        if len(starts):
            s[starts] *= (x[starts] >= 0)[:, None, :]
        w = (s.reshape(-1, WINDOW) @ _ONES[:WINDOW])[:, None]
        z = np.matmul(s, e, out=room("z", n, SPAN, WIDTH)).reshape(-1, WIDTH)
        z /= w
        h = room("h", n * SPAN, WIDTH + 1)
        np.add(eq, np.matmul(z, p["v"] @ p["o"], out=room("one", n * SPAN, WIDTH)), out=h[:, :WIDTH])
        h[:, WIDTH] = 1
        return e, et, eq, q, s, w, z, h

    def _digits(self, h: np.ndarray, y: np.ndarray):
        """exp of the logits of the high and of the low digit and their sums, for places in the order of their high digit.

        Each high digit has weights of its own for the low one, so places that share it lie next to each other.
        Also where the digits of y are in them.
        """
        hi = y // DIGIT
        order = np.argsort(hi.astype(np.uint8), kind="stable")
        at = np.append(0, np.cumsum(np.bincount(hi, minlength=DIGIT))).tolist()
        hs, both = self._room("hs", *h.shape), self._room("both", 2, len(y), DIGIT)
        np.take(h, order, axis=0, mode="clip", out=hs)
        np.matmul(hs, self.high, out=both[0])
        for k, (lo, up) in enumerate(zip(at, at[1:])):
            if up > lo:
                np.dot(hs[lo:up], self.low[k], out=both[1, lo:up])
        np.clip(both, -_MOST, _MOST, out=both)  # exp() can't overflow
        np.exp(both, out=both)
        ys, n = y[order], np.arange(0, y.size * DIGIT, DIGIT)
        high = ys // DIGIT
        return order, at, hs, both, both.reshape(-1, DIGIT) @ _ONES[:DIGIT], np.concatenate([n + high, n + (y.size * DIGIT) + ys - high * DIGIT])

    def log10(self, x: np.ndarray, y: np.ndarray, starts: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities at the scored places of windows x: of the ids y (n, SPAN), and of any id whose high digit is starts or more."""
        out, begins = np.empty(y.size, np.float32), np.empty(y.size, np.float32)
        for i in range(0, len(x), BATCH):
            order, _, _, both, total, won = self._digits(self._forward(x[i : i + BATCH])[-1], y[i : i + BATCH].ravel())
            to = order + i * SPAN
            out[to] = np.log(both.ravel()[won] / total).reshape(2, -1).sum(axis=0)
            begins[to] = np.log(both[0, :, starts:] @ _ONES[starts:DIGIT] / total[: len(to)])
        scale = np.float32(1 / np.log(10))
        return (out * scale).reshape(y.shape), (begins * scale).reshape(y.shape)

    def gradient(self, x: np.ndarray, y: np.ndarray, good: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss in nats over the good places, and its gradient."""
        g = Attention.zeros()
        order, log = self._gradient(x, y, good, g, True)
        m = good.ravel()[order]
        return float(-log[m].sum() / max(1, m.sum())), g.p

    def _gradient(self, x: np.ndarray, y: np.ndarray, good: np.ndarray, to: Attention, logs: bool = False):
        """Puts the gradient into to; gives the log chances of y, in the order that comes first, if they are asked for."""
        p, g, room = self.p, to.p, self._room
        e, et, eq, q, s, w, z, h = self._forward(x)
        order, at, hs, both, total, won = self._digits(h, y.ravel())
        flat = both.reshape(-1)
        log = np.log(flat[won] / total).reshape(2, -1).sum(axis=0) if logs else None
        m = good.ravel()[order].astype(np.float32)
        m /= max(1.0, m.sum())
        both *= (m / total.reshape(2, -1))[..., None]
        flat[won] -= np.concatenate([m, m])
        da, db = both
        np.matmul(hs.T, da, out=to.high)
        dhs, low = np.matmul(da, p["a"].T, out=room("one", *z.shape)), room("two", *z.shape)
        to.low[:] = 0
        for c, (lo, hi) in enumerate(zip(at, at[1:])):
            if hi > lo:
                np.dot(hs[lo:hi].T, db[lo:hi], out=to.low[c])
                np.dot(db[lo:hi], p["b"][c].T, out=low[lo:hi])
        dhs += low
        dh = room("h", *z.shape)
        dh[order] = dhs
        # h = eq + z (v o)
        vo = p["v"] @ p["o"]
        dvo = z.T @ dh
        np.matmul(dvo, p["o"].T, out=g["v"])
        np.matmul(p["v"].T, dvo, out=g["o"])
        # With z = u / w, w the sum of weights: what the weights and the vectors get.
        du = np.matmul(dh, vo.T, out=room("one", *z.shape))
        du /= w
        dw = np.einsum("bd,bd->b", du, z).reshape(*q.shape[:2], 1)
        du = du.reshape(q.shape)
        ds = np.matmul(du, et, out=room("both", *s.shape))
        ds -= dw
        ds *= s
        de = np.matmul(s.transpose(0, 2, 1), du, out=room("et", *e.shape))
        de += np.matmul(ds.transpose(0, 2, 1), q, out=room("rows", *e.shape))
        # Scores are eq (q k') e'.
        dq = np.matmul(ds, e, out=room("one", *q.shape)).reshape(-1, WIDTH)
        dqk = eq.T @ dq * _SCALE
        np.matmul(dqk, p["k"], out=g["q"])
        np.matmul(dqk.T, p["q"], out=g["k"])
        dh += np.matmul(dq, p["k"] @ p["q"].T * _SCALE, out=room("two", *z.shape))
        de[:, CONTEXT:] += dh.reshape(q.shape)
        np.sum(de, axis=0, out=g["pos"])
        # What stands before a text has no weight, so nothing is added for it.
        g["e"][:] = _sums_by(np.maximum(x, 0).ravel(), de.reshape(-1, WIDTH), len(p["e"]), room("rows", de.size // WIDTH, WIDTH))
        return order, log

    def train(self, x: np.ndarray, y: np.ndarray, good: np.ndarray, adam: Adam) -> None:
        """A step for every BATCH of the windows, in random order."""
        order, g = adam.random.permutation(len(x)), Attention.zeros()
        for k in range(0, len(x), BATCH):
            i = order[k : k + BATCH]
            self._gradient(x[i], y[i], good[i], g)
            adam.step(self.vector, g.vector)
            # Scores stay where exp() can't overflow.
            top = np.abs(self.p["e"]).max() + np.abs(self.p["pos"]).max()
            scale = top * top * np.sqrt(WIDTH)
            if scale * np.linalg.norm(self.p["q"]) * np.linalg.norm(self.p["k"]) <= 80:  # no less than with the norms below
                continue
            reach = scale * np.sqrt(np.prod([np.linalg.eigvalsh(w.T @ w)[-1] for w in (self.p["q"], self.p["k"])]))
            if reach > 80:
                self.p["q"] *= np.float32(np.sqrt(80 / reach))
                self.p["k"] *= np.float32(np.sqrt(80 / reach))

    def flat(self) -> np.ndarray:
        return self.vector.copy()

    def filled(self, flat: np.ndarray) -> Attention:
        """A model of this one's shape with other parameters."""
        return Attention(flat.astype(np.float32))


class Adam:
    def __init__(self, rate: float, seed: int):
        self.rate, self.n, self.random = rate, 0, np.random.default_rng(seed)
        self.m = self.v = self.d = np.zeros(0, np.float32)

    def step(self, p: np.ndarray, g: np.ndarray) -> None:
        """Moves p by the gradient g, which it may scale."""
        if not self.n:
            self.m, self.v, self.d = (np.zeros_like(p) for _ in range(3))
        self.n += 1
        m, v, d = self.m, self.v, self.d
        norm = np.sqrt(float(np.vdot(g, g)))
        if norm > _NORM:
            g *= np.float32(_NORM / norm)
        lr = np.float32(self.rate * np.sqrt(1 - 0.995**self.n) / (1 - 0.9**self.n))
        np.subtract(g, m, out=d)
        d *= np.float32(0.1)
        m += d
        np.multiply(g, g, out=d)
        d -= v
        d *= np.float32(0.005)
        v += d
        np.sqrt(v, out=d)
        d += np.float32(1e-8)
        np.divide(m, d, out=d)
        d *= lr
        p -= d
