"""A causal self-attention language model over subword ids, forward and backward in numpy.

One head, one hidden layer, no normalisation. An id is written with three digits
of base K, and the model gives the probabilities of the first digit, of the
second after the first, and of the third after both, so that they sum to one
over all ids without a softmax over each. What the counts of a corpus say about
the digits is added to the scores; the network learns what the context adds.
"""

from __future__ import annotations

import copy

import numpy as np

# Positions of a window, and how many of them a window after the first one scores.
WINDOW, STRIDE = 28, 24
DIM, HIDDEN = 16, 32
# Added to every id's count.
SMOOTHING = 0.1
# Windows that are computed at a time.
BATCH = 192
# Scores are held below this bound and sums above this one, where float32 has both.
FAR, LEAST = np.float32(40), np.float32(1e-30)


def digit_base(vocabulary: int) -> int:
    base = 1
    while base**3 < vocabulary:
        base += 1
    return base


def spectral_order(windows: list[list[int]], vocabulary: int, buckets: int = 192) -> np.ndarray:
    """The ids in an order that puts those near which follow the same ids.

    By the second and third singular vectors of the table of followed ids; ids
    that ``windows`` lack come last.
    """
    flat = [np.array(w, np.int64) for w in windows if len(w) > 1]
    if not flat:
        return np.arange(vocabulary)
    before = np.concatenate([w[:-1] for w in flat])
    after = np.concatenate([w[1:] for w in flat])
    common = np.argsort(-np.bincount(before, minlength=vocabulary), kind="stable")[: buckets - 1]
    bucket = np.full(vocabulary, buckets - 1)
    bucket[common] = np.arange(len(common))
    seen, row = np.unique(after, return_inverse=True)
    table = np.zeros((len(seen), buckets), np.float32)
    np.add.at(table, (row, bucket[before]), 1)
    table = np.sqrt(table)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(table.T @ table)
    first, second = table @ vectors[:, -2], table @ vectors[:, -3]
    base = digit_base(vocabulary)
    order = np.argsort(first, kind="stable")
    group = np.arange(len(seen)) // base**2
    order = order[np.lexsort((second[order], group))]
    rest = np.setdiff1d(np.arange(vocabulary), seen)
    return np.concatenate([seen[order], rest])


class Codes:
    """The digits of each id, and what counts of the ids say about them."""

    def __init__(self, order: np.ndarray, counts: np.ndarray) -> None:
        self.base = k = digit_base(len(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place.astype(np.int32)
        mass = np.zeros(k**3)
        mass[place] = counts + SMOOTHING
        mass = mass.reshape(k, k, k)
        with np.errstate(divide="ignore", invalid="ignore"):
            pairs, firsts = mass.sum(axis=2), mass.sum(axis=(1, 2))
            self.first = np.log(firsts / firsts.sum())
            self.second = np.log(pairs / firsts[:, None])
            self.third = np.log(mass / pairs[:, :, None]).reshape(k * k, k)
        for name in ("first", "second", "third"):
            table = np.nan_to_num(getattr(self, name), nan=0.0, neginf=-1e9)
            setattr(self, name, table.astype(np.float32))

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, k = self.place.take(ids), self.base
        return place // (k * k), place // k % k, place % k


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


class Attention:
    """The model's weights, its log probabilities and their gradients."""

    def __init__(self, codes: Codes, vocabulary: int, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        d, k = DIM, codes.base
        normal = lambda scale, *shape: draw.normal(0, scale, shape).astype(np.float32)
        self.codes = codes
        self.weights = {
            "e": normal(0.3, vocabulary, d),
            "p": normal(0.1, WINDOW, d),
            "q": normal(d**-0.5, d, d),
            "k": normal(d**-0.5, d, d),
            "v": normal(d**-0.5, d, d),
            "o": normal(d**-0.5, d, d),
            "in": normal(d**-0.5, d, HIDDEN),
            "in_b": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN**-0.5, HIDDEN, d),
            "s1": normal(0.1, d, k),
            "s2": normal(0.1, d, k),
            "s3": normal(0.1, d, k),
            "g2": np.ones((k, d), np.float32),
            "g3": np.ones((k * k, d), np.float32),
        }
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def _body(self, ids: np.ndarray) -> tuple:
        """The state at each position of windows ``ids`` (B, T), with what the gradients need."""
        w, length = self.weights, ids.shape[1]
        x = w["e"][ids] + w["p"][:length]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        q *= DIM**-0.5
        scores = q @ k.swapaxes(1, 2)
        scores += self.mask[:length, :length]
        a = _softmax(scores)
        z = a @ v
        h = x + z @ w["o"]
        r = np.maximum(h @ w["in"] + w["in_b"], 0)
        return h + r @ w["out"], (x, q, k, v, a, z, h, r)

    def _levels(self, states: np.ndarray, targets: np.ndarray) -> list[tuple]:
        """For each digit: name, gate and its row, gated states, digit, log scores' softmax."""
        w, codes = self.weights, self.codes
        d1, d2, d3 = codes.digits(targets)
        pair = d1 * codes.base + d2
        levels = [("s1", None, None, states, d1, states @ w["s1"] + codes.first)]
        for name, gate, row, digit, prior in (
            ("s2", "g2", d1, d2, codes.second),
            ("s3", "g3", pair, d3, codes.third),
        ):
            gated = w[gate].take(row, axis=0)
            gated *= states
            scores = gated @ w[name]
            scores += prior.take(row, axis=0)
            levels.append((name, gate, row, gated, digit, scores))
        return levels

    def _states(self, ids: np.ndarray) -> np.ndarray:
        """The states of ``_body``, with sums and divisions left to two matrix products."""
        w, length = self.weights, ids.shape[1]
        x = w["e"].take(ids, axis=0)
        x += w["p"][:length]
        every = x @ self.qkv
        q, k, v = every[..., :DIM], every[..., DIM : 2 * DIM], every[..., 2 * DIM :]
        v = v + self.one
        scores = q @ k.swapaxes(1, 2)
        np.minimum(scores, FAR, out=scores)
        np.exp(scores, out=scores)
        scores *= self.seen[:length, :length]
        z = scores @ v
        x += (z[..., :DIM] / np.maximum(z[..., DIM:], LEAST)) @ w["o"]
        r = x @ w["in"]
        r += w["in_b"]
        np.maximum(r, 0, out=r)
        x += r @ w["out"]
        return x

    def ready(self) -> Attention:
        """Prepare for ``log_probs``, after which the weights must not change."""
        w = self.weights
        self.qkv = np.concatenate([w["q"] * DIM**-0.5, w["k"], w["v"], np.zeros((DIM, 1))], axis=1)
        self.qkv = self.qkv.astype(np.float32)
        # The column after the values is one: it sums what attention weighs by.
        self.one = np.append(np.zeros(DIM, np.float32), np.float32(1))
        self.seen = (self.mask == 0).astype(np.float32)
        return self

    def log_probs(self, ids: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the ``targets`` that are ``scored``."""
        at = np.flatnonzero(scored)
        states = self._states(ids).reshape(-1, DIM).take(at, axis=0)
        out = np.zeros(len(states), np.float64)
        k = self.codes.base
        own, ones = np.arange(len(states)) * k, np.ones(k, np.float32)
        for *_, digit, scores in self._levels(states, targets.ravel().take(at)):
            np.minimum(scores, FAR, out=scores)
            out += scores.ravel().take(own + digit)
            np.exp(scores, out=scores)
            out -= np.log(np.maximum(scores @ ones, LEAST))
        return out

    def gradients(self, ids: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, dict]:
        """Mean negative log probability of the scored targets, and its gradients."""
        w = self.weights
        y, (x, q, k, v, a, z, h, r) = self._body(ids)
        states = y[scored]
        row, n = np.arange(len(states)), len(states)
        grads = {name: np.zeros_like(value) for name, value in w.items()}
        loss, d_states = 0.0, np.zeros_like(states)
        for name, gate, gate_row, inputs, digit, scores in self._levels(states, targets[scored]):
            p = _softmax(scores)
            loss -= float(np.log(np.maximum(p[row, digit], 1e-30)).sum()) / n
            p[row, digit] -= 1
            p /= n
            grads[name] += inputs.T @ p
            d_inputs = p @ w[name].T
            if gate is None:
                d_states += d_inputs
            else:
                _add_rows(grads[gate], gate_row, d_inputs * states)
                d_states += d_inputs * w[gate][gate_row]
        dy = np.zeros_like(y)
        dy[scored] = d_states
        flat = lambda t: t.reshape(-1, t.shape[-1])
        grads["out"] += flat(r).T @ flat(dy)
        dr = (dy @ w["out"].T) * (r > 0)
        grads["in"] += flat(h).T @ flat(dr)
        grads["in_b"] += flat(dr).sum(axis=0)
        dh = dy + dr @ w["in"].T
        grads["o"] += flat(z).T @ flat(dh)
        dz = dh @ w["o"].T
        da = dz @ v.swapaxes(1, 2)
        dv = a.swapaxes(1, 2) @ dz
        ds = a * (da - (da * a).sum(axis=-1, keepdims=True))
        dq = (ds @ k) * DIM**-0.5
        dk = ds.swapaxes(1, 2) @ q
        dx = dh.copy()
        for name, dt in (("q", dq), ("k", dk), ("v", dv)):
            grads[name] += flat(x).T @ flat(dt)
            dx += dt @ w[name].T
        grads["p"][: ids.shape[1]] += dx.sum(axis=0)
        _add_rows(grads["e"], ids.ravel(), flat(dx))
        return loss, grads

    def copy(self) -> Attention:
        """The same model with weights of its own."""
        out = copy.copy(self)
        out.weights = {name: w.copy() for name, w in self.weights.items()}
        return out

    def fit(self, windows: list[list[int]], steps: int, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over windows drawn at random; every position of a window counts."""
        windows = [w[: WINDOW + 1] for w in windows if len(w) > 1]
        if not windows:
            return
        draw = np.random.default_rng(seed)
        adam = Adam(self.weights)
        for step in range(steps):
            chosen = [windows[i] for i in draw.integers(0, len(windows), batch)]
            _, grads = self.gradients(*padded(chosen))
            adam.step(grads, rate * (1 - step / steps))

    def learn(self, adam: Adam, ids: np.ndarray, sizes: np.ndarray, begin: int, rate: float, batch: int = 512) -> None:
        """One pass of ``adam`` over all ids of the sequences that ``ids`` holds one after the other.

        Every id is a target once, in windows side by side whose order is drawn
        at random; the context of a sequence starts with ``begin``.
        """
        starts, inputs = _shifted(ids, sizes, begin)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), counts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
        order = np.random.default_rng(len(owner)).permutation(len(owner))
        place = np.arange(WINDOW)
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            at = first[some][:, None] + place
            there = at < sizes[owner[some]][:, None]
            flat = np.where(there, starts[owner[some]][:, None] + at, 0)
            _, grads = self.gradients(inputs[flat], ids[flat], there)
            adam.step(grads, rate)


class Adam:
    """Adam's moments of some weights, which its steps change in place."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights, self.steps = weights, 0
        self.first = {name: np.zeros_like(value) for name, value in weights.items()}
        self.second = {name: np.zeros_like(value) for name, value in weights.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for name, g in grads.items():
            first, second = self.first[name], self.second[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            slope = first / (1 - 0.9**self.steps)
            self.weights[name] -= rate * slope / (np.sqrt(second / (1 - 0.99**self.steps)) + 1e-8)


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each of ``values`` to its row of ``out``; rows may repeat."""
    if not len(rows):
        return
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    begin = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1))
    out[rows[begin]] += np.add.reduceat(values[order], begin, axis=0)


def _shifted(ids: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each sequence starts, and the id before every id."""
    starts = np.cumsum(sizes) - sizes
    inputs = np.empty_like(ids)
    inputs[1:] = ids[:-1]
    inputs[starts[sizes > 0]] = begin
    return starts, inputs


def padded(windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and whether there is one, (B, T) each."""
    length = max(len(w) for w in windows) - 1
    ids = np.zeros((len(windows), length + 1), np.int64)
    sizes = np.array([len(w) for w in windows])
    for i, w in enumerate(windows):
        ids[i, : len(w)] = w
    return ids[:, :-1], ids[:, 1:], np.arange(length) < sizes[:, None] - 1


def score_streams(model: Attention, ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """Log10 probability of each id of the sequences that ``ids`` holds one after the other.

    The model must be ``ready``. The context of a sequence starts with ``begin``. Windows of WINDOW positions
    overlap: the first of a sequence scores all its positions, a later one its
    last STRIDE, so that every id is scored once and, but at the start, after
    WINDOW - STRIDE ids at least.
    """
    out = np.zeros(len(ids))
    if not len(ids):
        return out
    starts, inputs = _shifted(ids, sizes, begin)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(WINDOW)
    for low in range(0, len(owner), BATCH):
        own, k = owner[low : low + BATCH], nth[low : low + BATCH]
        at = k[:, None] * STRIDE + place
        there = at < sizes[own][:, None]
        scored = there & ((k == 0)[:, None] | (place >= WINDOW - STRIDE))
        flat = np.where(there, starts[own][:, None] + at, 0)
        out[flat[scored]] = model.log_probs(inputs[flat], ids[flat], scored)
    return out / np.log(10)
