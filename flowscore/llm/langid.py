"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network is trained here, in numpy, by backpropagation through time. It
labels every byte of a text; a document's probabilities are the mean of those
of its bytes. Texts are read whole, in windows of WINDOW bytes that start from
a blank state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm.hashing import text_chunks
from flowscore.llm.scratch import returning

HIDDEN = 8
WINDOW = 64
# What the fit sees: windows of at most so many documents of each language.
TRAIN_DOCS = 1500
TRAIN_CHARS = 256
STEPS = 300
BATCH = 192
_BLOCK = 2048
UNDETERMINED = "und"


class Network:
    """Two gated layers, one for each direction, and a softmax over their states.

    ``x`` (2, 257, 3H) holds what a byte adds to update gate, reset gate and
    candidate; row 256 is the blank after a text's end. Gates are half of
    ``1 + tanh``.
    """

    def __init__(self, classes: int, seed: int = 7, hidden: int = HIDDEN) -> None:
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {
            "x": draw.normal(0, 0.3, (2, 257, 3 * hidden)).astype(np.float32),
            "u": draw.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32),
            "v": draw.normal(0, 0.3, (2, hidden, classes)).astype(np.float32),
            "c": np.zeros(classes, np.float32),
        }

    def states(self, data: np.ndarray, keep: bool = False):
        """States (T, 2, B, H) of windows ``data`` (B, T); with what training needs."""
        w, h_size = self.weights, self.hidden
        count, length = data.shape
        h = np.zeros((2, count, h_size), np.float32)
        out = np.empty((length, 2, count, h_size), np.float32)
        tape = []
        both = np.stack([data.T, data.T[::-1]], axis=1)
        for t in range(length):
            given = np.stack([w["x"][0][both[t, 0]], w["x"][1][both[t, 1]]])
            from_h = np.matmul(h, w["u"])
            gates = np.tanh(given[..., : 2 * h_size] + from_h[..., : 2 * h_size])
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :h_size], gates[..., h_size:]
            n = np.tanh(given[..., 2 * h_size :] + r * from_h[..., 2 * h_size :])
            if keep:
                tape.append((h, gates, from_h[..., 2 * h_size :], n))
            h = n + z * (h - n)
            out[t] = h
        return (out, tape, both) if keep else out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, B, classes): the backward states read from the end."""
        w = self.weights
        logits = states[:, 0] @ w["v"][0] + states[::-1, 1] @ w["v"][1] + w["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes, through time."""
        w, h_size = self.weights, self.hidden
        states, tape, both = self.states(data, keep=True)
        wrong = self.probabilities(states)
        wrong[:, np.arange(len(labels)), labels] -= 1
        real = (data.T < 256)[..., None]
        wrong *= real / max(1, real.sum())
        back = states[::-1, 1]
        grads = {name: np.zeros_like(value) for name, value in w.items()}
        grads["v"][0] = np.einsum("tbh,tbc->hc", states[:, 0], wrong)
        grads["v"][1] = np.einsum("tbh,tbc->hc", back, wrong)
        grads["c"] = wrong.sum(axis=(0, 1))
        from_out = np.stack([wrong @ w["v"][0].T, (wrong @ w["v"][1].T)[::-1]], axis=1)
        carried = np.zeros_like(tape[0][0])
        for t in range(len(tape) - 1, -1, -1):
            h, gates, h_part, n = tape[t]
            z, r = gates[..., :h_size], gates[..., h_size:]
            g = from_out[t] + carried
            g_n = g * (1 - z) * (1 - n * n)
            g_z = g * (h - n) * 2 * z * (1 - z)
            g_r = g_n * h_part * 2 * r * (1 - r)
            g_in = np.concatenate([g_z, g_r, g_n], axis=-1)
            g_h = np.concatenate([g_z, g_r, g_n * r], axis=-1)
            grads["u"] += np.matmul(h.transpose(0, 2, 1), g_h)
            for side in (0, 1):
                np.add.at(grads["x"][side], both[t, side], g_in[side])
            carried = g * z + np.matmul(g_h, w["u"].transpose(0, 2, 1))
        return grads


def fit(texts: list[bytes], labels: list[int], classes: int, seed: int = 7) -> Network:
    """Train on random windows of the texts, each class as often as any other."""
    network = Network(classes, seed)
    draw = np.random.default_rng(seed)
    of_class = [[t for t, k in zip(texts, labels, strict=True) if k == c and t] for c in range(classes)]
    mean = {k: np.zeros_like(v) for k, v in network.weights.items()}
    square = {k: np.zeros_like(v) for k, v in network.weights.items()}
    usable = [c for c in range(classes) if of_class[c]]
    for step in range(1, (STEPS if usable else 0) + 1):
        data = np.full((BATCH, WINDOW), 256, np.int64)
        chosen = np.array(usable)[draw.integers(0, len(usable), BATCH)]
        for row, c in enumerate(chosen):
            text = of_class[c][draw.integers(0, len(of_class[c]))]
            at = draw.integers(0, max(1, len(text) - WINDOW + 1))
            window = np.frombuffer(text[at : at + WINDOW], np.uint8)
            data[row, : len(window)] = window
        rate = 0.03 * (1 - step / (STEPS + 1)) + 0.001
        for name, grad in network.gradients(data, chosen).items():
            mean[name] = 0.9 * mean[name] + 0.1 * grad
            square[name] = 0.99 * square[name] + 0.01 * grad * grad
            m, s = mean[name] / (1 - 0.9**step), square[name] / (1 - 0.99**step)
            network.weights[name] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return network


def document_probabilities(
    network: Network, data: np.ndarray, bounds: np.ndarray, classes: int
) -> np.ndarray:
    """(rows, classes): mean over all bytes of each text; zeros for empty ones."""
    sizes = np.diff(bounds)
    counts = -(-sizes // WINDOW)
    row_of = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = bounds[:-1][row_of] + nth * WINDOW
    held = np.minimum(WINDOW, bounds[1:][row_of] - begins)
    total = np.zeros((len(sizes), classes))
    padded = np.concatenate([data.astype(np.int16), np.full(WINDOW, 256, np.int16)])
    for low in range(0, len(begins), _BLOCK):
        own = slice(low, low + _BLOCK)
        length = int(held[own].max())
        windows = padded[begins[own][:, None] + np.arange(length)]
        inside = np.arange(length) < held[own][:, None]
        windows[~inside] = 256
        p = network.probabilities(network.states(windows))
        p *= inside.T[..., None]
        np.add.at(total, row_of[own], p.sum(axis=0))
    return total / np.maximum(sizes, 1)[:, None]


def training_rows(docs: DataFrame) -> tuple[list[str], list[tuple[int, str]]]:
    """Languages, and a window of at most TRAIN_DOCS documents of each, by hash of id."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], []
    limits = F.create_map(
        *[F.lit(x) for name in names for x in (name, min(1.0, 1.3 * TRAIN_DOCS / counts[name]))]
    )
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) / F.lit(1 << 30)
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1)))
    window = F.substring("text", start.cast("int") + 1, F.lit(TRAIN_CHARS))
    rows = labelled.where(drawn <= limits[F.col("lang")]).select("lang", window.alias("w"), "doc_id")
    seen: dict[str, int] = {}
    out = []
    for row in sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["w"])):
        seen[row["lang"]] = seen.get(row["lang"], 0) + 1
        if seen[row["lang"]] <= TRAIN_DOCS:
            out.append((names.index(row["lang"]), row["w"]))
    return names, out


def train(docs: DataFrame) -> tuple[list[str], Network]:
    """Learn from ``doc_id, text, lang``; the id only decides which rows are drawn."""
    names, rows = training_rows(docs)
    return names, fit([w.encode() for _, w in rows], [k for k, _ in rows], max(1, len(names)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that are never learned from. A null id is never held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, names: list[str], network: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as all are if
    no language was learned. Other columns, repeated rows and null ids are
    passed through; columns named ``lang_pred`` or ``score`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    weights = docs.sparkSession.sparkContext.broadcast(network.weights)
    classes, hidden = max(1, len(names)), network.hidden
    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network.__new__(Network)
        model.weights, model.hidden = weights.value, hidden
        for batch in batches:
            parts = [
                document_probabilities(model, data, bounds, classes)
                for _, data, bounds in text_chunks(batch.column(len(fields)))
            ]
            found = np.concatenate(parts) if parts else np.zeros((0, classes))
            letters = batch.column(len(fields) + 1).to_numpy(zero_copy_only=False)
            best = found.argmax(axis=1) if len(found) else np.zeros(0, int)
            known = letters & bool(names)
            label = [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            score = np.where(known, found[np.arange(len(best)), best], 0.0)
            columns = [batch.column(i) for i in range(len(fields))]
            columns += [pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text"), letter.alias("_letter"))
    return given.mapInArrow(run, schema)
