"""Causal self-attention over subword ids, in numpy.

One attention layer with a learned bias per distance, a residual ReLU layer and
a softmax in two levels: ids are split into classes, a class is predicted from
the hidden state and the id from hidden state and class. Ids that begin a word
(and the end mark) have classes of their own, so the probability that a word is
over is a sum of class probabilities.

A text is read in overlapping windows of ``LENGTH`` ids. Only the last
``STRIDE`` ids of a window are scored, so each id is scored once, with
LENGTH - STRIDE ids before it at least where the text has them; windows go
through masked attention in batches. As there is one layer, keys, queries and
values are functions of the id and are looked up.
"""

from __future__ import annotations

import numpy as np

LENGTH, STRIDE, DIM, HEAD, HIDDEN, MEMBERS = 48, 32, 16, 16, 24, 64
CONTEXT = LENGTH - STRIDE
#: Windows that go through the output layer, and through the attention, at once.
BATCH, ATTENTION = 256, 32
#: Logits are cut off here when scoring, where one could be above 80, and taken relative to a row's largest beyond it when learning, so that no exponential overflows or vanishes; trained ones are far below.
TOP = np.float32(60)


def _exp(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of rows of logits, in place: (the logits at flat places ``at``, sums of the rows). Where a logit is beyond ``TOP`` each row's largest is taken off first, so that no exponential overflows and no row vanishes."""
    if max(x.max(initial=0), -x.min(initial=0)) > TOP:
        x -= x.max(axis=-1, keepdims=True)
    hit = x.ravel().take(at)
    np.exp(x, out=x)
    return hit, x @ np.ones(x.shape[-1], x.dtype)


class Model:
    """``leading`` marks ids that begin a word; ``counts`` orders the ids of a class by use and starts the biases."""

    def __init__(self, leading: np.ndarray, counts: np.ndarray, seed: int = 1):
        self.n = len(leading)
        rng = np.random.default_rng(seed)
        self.cls, self.member, at = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), 0
        for kind in (True, False):
            ids = np.flatnonzero(leading == kind)
            ids = ids[np.argsort(-counts[ids], kind="stable")]
            self.cls[ids], self.member[ids] = at + np.arange(len(ids)) // MEMBERS, np.arange(len(ids)) % MEMBERS
            at += -(-len(ids) // MEMBERS)
            if kind:
                self.leading_classes = at
        self.classes = at
        smooth = counts + 0.5
        by = np.bincount(self.cls, smooth, minlength=at)
        mb = np.full((at, MEMBERS), -30.0)
        mb[self.cls, self.member] = np.log(smooth / by[self.cls])
        g = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {
            "E": g(self.n, DIM, scale=0.4), "Wq": g(DIM, HEAD, scale=0.3), "Wk": g(DIM, HEAD, scale=0.3), "Wv": g(DIM, DIM, scale=0.2), "rel": np.zeros(LENGTH, np.float32),
            "W1": g(DIM, HIDDEN, scale=0.3), "b1": np.zeros(HIDDEN, np.float32), "W2": g(HIDDEN, DIM, scale=0.2),
            "Wc": g(DIM, at, scale=0.1), "bc": np.log(by / by.sum()).astype(np.float32), "Wm": g(at, DIM, MEMBERS, scale=0.05), "bm": mb.astype(np.float32),
        }

    def bias(self) -> np.ndarray:
        """(STRIDE, LENGTH): by distance, and none of what is ahead."""
        d = np.arange(LENGTH - STRIDE, LENGTH)[:, None] - np.arange(LENGTH)[None, :]
        return np.where(d >= 0, self.p["rel"][np.maximum(d, 0)], np.float32(-1e9)).astype(np.float32)

    def prepare(self) -> None:
        """Tables for scoring; row n stands for no id."""
        p = self.p
        pad = lambda x: np.ascontiguousarray(np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), np.float32)
        # A last component of 1 makes the attention's weighted sum of values give the sum of the weights too.
        values = np.concatenate([p["E"] @ p["Wv"], np.ones((self.n, 1), np.float32)], axis=1)
        self.tables = pad(p["E"] @ p["Wq"] / np.float32(HEAD**0.5)), pad(p["E"] @ p["Wk"]), pad(values), pad(p["E"])
        self.distance = np.exp(self.bias())
        lead = (np.arange(self.classes) < self.leading_classes).astype(np.float32)
        self.sums = np.stack([np.ones(self.classes, np.float32), lead], axis=1)
        # A last component of 1 in the states makes the products give the biases too.
        self.to_class = np.ascontiguousarray(np.concatenate([p["Wc"], p["bc"][None, :]]), np.float32)
        self.to_member = np.ascontiguousarray(np.concatenate([p["Wm"], p["bm"][:, None, :]], axis=1), np.float32)
        # By Cauchy and Schwarz no logit is further from its bias than the product of the norms; where that is small, nothing need be cut off.
        norm = lambda x, axis: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=axis)).max(initial=1e-9))
        self.far = norm(self.tables[0], 1) * norm(self.tables[1], 1) > TOP
        self.reach = max(80 - max(np.abs(p["bc"]).max(), np.abs(p["bm"]).max()), 0) / max(norm(p["Wc"], 0), norm(p["Wm"], 1))

    def hidden(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """States of a run of blocks: ``ids`` are ``CONTEXT`` places and then STRIDE for each block; ``first`` marks blocks that begin a text."""
        q, k, v, e = (t.take(ids[at:], axis=0, mode="clip") for t, at in zip(self.tables, (CONTEXT, 0, 0, CONTEXT)))
        n = len(first)
        # A window is a block with the places before it: views, so that nothing is looked up or copied twice.
        view = lambda x: np.lib.stride_tricks.as_strided(x, (n, LENGTH, x.shape[1]), (STRIDE * x.strides[0], *x.strides))
        a = q.reshape(n, STRIDE, HEAD) @ view(k).transpose(0, 2, 1)
        if self.far:
            np.clip(a, -TOP, TOP, out=a)
        np.exp(a, out=a)
        a *= self.distance
        a[first, :, :CONTEXT] = 0
        h = (a @ view(v)).reshape(n * STRIDE, DIM + 1)
        e += h[:, :DIM] / h[:, DIM:]
        return e

    def score(self, ids: np.ndarray, first: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log p(target), log p(a word begins or the text ends)) for each place of a run of blocks that has a target, in order; a target of -1 is none."""
        p, n = self.p, len(first)
        h = np.concatenate([self.hidden(ids[a * STRIDE : min(a + ATTENTION, n) * STRIDE + CONTEXT], first[a : a + ATTENTION]) for a in range(0, n, ATTENTION)]) if n else np.zeros((0, DIM), np.float32)
        real = np.flatnonzero(targets >= 0)
        t = targets.take(real)
        if len(real) < len(h):
            h = h.take(real, axis=0)
        r = h @ p["W1"]
        r += p["b1"]
        np.maximum(r, 0, out=r)
        s = np.empty((len(t), DIM + 1), np.float32)
        np.matmul(r, p["W2"], out=s[:, :DIM])
        s[:, :DIM] += h
        s[:, DIM] = 0
        far = float(np.einsum("ij,ij->i", s, s).max(initial=0)) ** 0.5 > self.reach
        s[:, DIM] = 1
        c = s @ self.to_class
        if far:
            np.clip(c, -TOP, TOP, out=c)
        at = self.cls.take(t)
        lp = c.ravel().take(np.arange(len(t)) * self.classes + at)
        np.exp(c, out=c)
        total = np.log(c @ self.sums + np.float32(1e-30))
        lp -= total[:, 0]
        lead = total[:, 1] - total[:, 0]
        order = np.argsort(at.astype(np.uint8 if self.classes < 256 else np.int32), kind="stable")
        ends, sorted_s, mine = np.cumsum(np.bincount(at, minlength=self.classes)), s.take(order, axis=0), self.member.take(t.take(order))
        hit, sums, one, start = np.empty(len(t), np.float32), np.empty(len(t), np.float32), np.ones(MEMBERS, np.float32), 0
        mine += np.arange(len(t)) * MEMBERS
        for k, end in enumerate(ends.tolist()):
            if end > start:
                m = sorted_s[start:end] @ self.to_member[k]
                if far:
                    np.clip(m, -TOP, TOP, out=m)
                m.ravel().take(mine[start:end] - start * MEMBERS, out=hit[start:end], mode="clip")
                np.exp(m, out=m)
                np.matmul(m, one, out=sums[start:end])
            start = end
        lp[order] += hit - np.log(sums)
        return lp, lead

    def gradients(self, ids: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows and its gradients."""
        p, s = self.p, np.float32(HEAD**-0.5)
        e = np.concatenate([p["E"], np.zeros((1, DIM), p["E"].dtype)]).take(ids, axis=0)
        own = np.ascontiguousarray(e[:, LENGTH - STRIDE :])
        flat, windowed = lambda x: x.reshape(-1, x.shape[-1]), lambda x: x.reshape(len(ids), -1, x.shape[-1])
        q, k, v = windowed(flat(own) @ p["Wq"] * s), windowed(flat(e) @ p["Wk"]), windowed(flat(e) @ p["Wv"])
        a = q @ k.transpose(0, 2, 1)
        a += self.bias()
        none = ids == self.n
        padded = np.flatnonzero(none.any(axis=1))
        a[padded] += np.where(none[padded], np.float32(-1e9), np.float32(0))[:, None, :]
        a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
        a /= (a @ np.ones(LENGTH, a.dtype))[..., None]
        h0 = flat(a @ v + own)
        z = h0 @ p["W1"] + p["b1"]
        r = np.maximum(z, 0)
        h = h0 + r @ p["W2"]
        t = targets.ravel()
        real, t = (t >= 0).astype(np.float32), np.maximum(t, 0)
        c = h @ p["Wc"] + p["bc"]
        at, mem, rows = self.cls.take(t), self.member.take(t), np.arange(len(t))
        n = max(real.sum(), 1)
        weight = real / n
        hit, total = _exp(c, rows * self.classes + at)
        loss = ((hit - np.log(total)) * real).sum()
        c *= (weight / total)[:, None]
        c[rows, at] -= weight
        g = {"Wc": h.T @ c, "bc": c.sum(axis=0), "Wm": np.zeros_like(p["Wm"]), "bm": np.zeros_like(p["bm"])}
        dh = c @ p["Wc"].T
        # The rows of a class are laid together once, so each class is one product of views.
        order = np.argsort(at.astype(np.uint8 if self.classes < 256 else np.int32), kind="stable")
        ends, start = np.cumsum(np.bincount(at, minlength=self.classes)), 0
        states, shares, aims, back = h.take(order, axis=0), weight.take(order), mem.take(order), np.empty_like(h)
        hits, sums, one = np.empty(len(t), h.dtype), np.empty(len(t), h.dtype), np.ones(len(t), h.dtype)
        for x, end in enumerate(ends.tolist()):
            if end > start:
                i = slice(start, end)
                m, aim = states[i] @ p["Wm"][x], rows[: end - start] * MEMBERS + aims[i]
                m += p["bm"][x]
                hits[i], sums[i] = _exp(m, aim)
                m *= (shares[i] / sums[i])[:, None]
                m.ravel()[aim] -= shares[i]
                np.matmul(states[i].T, m, out=g["Wm"][x])
                g["bm"][x] = one[i] @ m
                np.matmul(m, p["Wm"][x].T, out=back[i])
            start = end
        loss = -float((loss + ((hits - np.log(sums)) * real.take(order)).sum()) / n)
        dh[order] += back
        dz = (dh @ p["W2"].T) * (z > 0)
        g |= {"W2": r.T @ dh, "W1": h0.T @ dz, "b1": dz.sum(axis=0)}
        dh0 = (dh + dz @ p["W1"].T).reshape(len(ids), STRIDE, DIM)
        da, dv = dh0 @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dh0
        da *= a
        ds = da - a * da.sum(axis=-1, keepdims=True)
        d = np.arange(LENGTH - STRIDE, LENGTH)[:, None] - np.arange(LENGTH)[None, :]
        g["rel"] = np.bincount(np.maximum(d, 0).ravel(), np.where(d >= 0, ds.sum(axis=0), 0).ravel(), minlength=LENGTH).astype(np.float32)
        dq, dk = ds @ k * s, ds.transpose(0, 2, 1) @ q
        g |= {"Wq": flat(own).T @ flat(dq), "Wk": flat(e).T @ flat(dk), "Wv": flat(e).T @ flat(dv)}
        de = windowed(flat(dk) @ p["Wk"].T + flat(dv) @ p["Wv"].T)
        de[:, LENGTH - STRIDE :] += windowed(flat(dq) @ p["Wq"].T) + dh0
        flat_ids, rows_of = ids.ravel(), np.ascontiguousarray(flat(de).T)
        g["E"] = np.stack([np.bincount(flat_ids, x, minlength=self.n + 1)[: self.n] for x in rows_of], axis=1).astype(de.dtype)
        return loss, g

    def train(self, ids: np.ndarray, targets: np.ndarray, steps: int, batch: int = 64, rate: float = 0.006, seed: int = 1) -> float:
        """Adam over random batches of the windows given; returns the last losses' mean."""
        rng, adam, last = np.random.default_rng(seed), Adam(self), []
        for i in range(1, steps + 1 if len(ids) else 1):
            pick = rng.integers(0, len(ids), min(batch, len(ids)))
            last = [*last[-49:], adam.step(ids[pick], targets[pick], rate * min(1.0, 2 * (1 - (i - 1) / steps)))]
        return float(np.mean(last)) if last else 0.0


class Adam:
    """Steps of Adam on the parameters of a model."""

    def __init__(self, model: Model):
        self.model, self.i, self.m, self.v = model, 0, {}, {}

    def step(self, ids: np.ndarray, targets: np.ndarray, rate: float) -> float:
        loss, g = self.model.gradients(ids, targets)
        self.i += 1
        m, v, i = self.m, self.v, self.i
        for k, x in g.items():
            m[k] = 0.9 * m.get(k, 0) + 0.1 * x
            v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
            self.model.p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss


def windows(ids: np.ndarray, sizes: np.ndarray, end: int, pad: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [first, last) of a run of texts.

    ``ids`` are the texts' ids one after the other, each text led by the end
    mark; ``sizes`` counts both. Returns inputs (B, LENGTH), targets (B, STRIDE)
    and the place in ``ids`` of each target's input.
    """
    per = -(-sizes // STRIDE)
    begin = np.cumsum(sizes) - sizes
    upto = np.cumsum(per)
    w = np.arange(first, upto[-1] if last is None else min(last, upto[-1]))
    doc = np.searchsorted(upto, w, side="right")
    start = begin[doc] + (w - (upto[doc] - per[doc])) * STRIDE
    place = start[:, None] + np.arange(-(LENGTH - STRIDE), STRIDE)
    low, high = begin[doc][:, None], (begin + sizes)[doc][:, None]
    x = np.where((place >= low) & (place < high), ids[np.clip(place, 0, len(ids) - 1)], pad)
    own = place[:, LENGTH - STRIDE :]
    follow = np.where(own + 1 < high, ids[np.minimum(own + 1, len(ids) - 1)], end)
    return x, np.where(own < high, follow, -1), own


def blocks(ids: np.ndarray, sizes: np.ndarray, end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid out in blocks of STRIDE places, each text from a block of its own on: (ids with ``CONTEXT`` places ahead, targets, blocks that begin a text, place of each id)."""
    per = -(-sizes // STRIDE)
    begin = np.cumsum(per) - per
    total = int(per.sum())
    place = np.arange(len(ids)) + np.repeat(begin * STRIDE - (np.cumsum(sizes) - sizes), sizes)
    laid, targets = np.full(total * STRIDE + CONTEXT, pad, np.int32), np.full(total * STRIDE, -1, np.int32)
    laid[place + CONTEXT] = ids
    follow = np.empty(len(ids), np.int32)
    follow[:-1] = ids[1:]
    follow[np.cumsum(sizes) - 1] = end
    targets[place] = follow
    first = np.zeros(total, bool)
    first[begin] = True
    return laid, targets, first, place


def score_texts(model: Model, ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place of ``ids`` the log probabilities of what follows it, and that a word begins or the text ends there."""
    laid, targets, first, _ = blocks(ids, sizes, end, model.n)
    out = [model.score(laid[a * STRIDE : (a + BATCH) * STRIDE + CONTEXT], first[a : a + BATCH], targets[a * STRIDE : (a + BATCH) * STRIDE]) for a in range(0, len(first), BATCH)]
    # Places with a target are those of the ids, in their order.
    lp, lead = (np.concatenate([x[i] for x in out] or [np.zeros(0)]).astype(np.float64) for i in (0, 1))
    return lp, lead
