"""The attention model's gradients and probabilities; word counts against brute force; defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from conftest import DATA
from flowscore.llm import attention as A
from flowscore.llm import lmscore as L
from flowscore.llm.bpe import read_ranks
from flowscore.llm.queries import RANK_FILE

PATH, PATTERN = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
NAMES = {rank: token for token, rank in read_ranks(PATH).items()}
DOCS = "doc_id bigint, text string, held_out string, word string, kind string, score string"


def small_model(vocabulary=50, exact=True):
    draw = np.random.default_rng(0)
    codes = A.Codes(draw.permutation(vocabulary), draw.integers(0, 9, vocabulary))
    model = A.Attention(codes, vocabulary)
    if exact:
        model.weights = {name: w.astype(np.float64) for name, w in model.weights.items()}
    return model, draw


def test_gradients_equal_differences():
    model, draw = small_model()
    ids, targets = draw.integers(0, 50, (2, 3, 10))
    scored = draw.random((3, 10)) < 0.8
    loss, grads = model.gradients(ids, targets, scored)
    for name, w in model.weights.items():
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in w.shape)
            was, step, ends = w[at], 1e-5, []
            for sign in (1, -1):
                w[at] = was + sign * step
                ends.append(model.gradients(ids, targets, scored)[0])
            w[at] = was
            assert (ends[0] - ends[1]) / (2 * step) == pytest.approx(grads[name][at], abs=1e-7)
    assert loss == pytest.approx(-model.ready().log_probs(ids, targets, scored).mean(), rel=1e-5)


def test_probabilities_sum_to_one_and_look_back_only():
    model, draw = small_model()
    model.ready()
    ids = draw.integers(0, 50, (1, 12))
    every = np.ones((1, 12), bool)
    logs = np.array([model.log_probs(ids, np.full((1, 12), k), every) for k in range(50)])
    assert np.exp(logs).sum(axis=0) == pytest.approx(np.ones(12), abs=1e-4)
    other = ids.copy()
    other[0, 6:] = 3
    again = np.array([model.log_probs(other, np.full((1, 12), k), every) for k in range(50)])
    assert again[:, :6] == pytest.approx(logs[:, :6])


def test_every_id_is_scored_once_in_overlapping_windows():
    model, draw = small_model(exact=False)
    model.ready()
    sizes = np.array([0, 1, A.WINDOW, A.WINDOW + 1, 0, 200, 7])
    ids = draw.integers(0, 50, int(sizes.sum()))
    got = A.score_streams(model, ids, sizes, 49)
    for n, low in zip(sizes, np.cumsum(sizes) - sizes, strict=True):
        own = ids[low : low + n]
        before = np.concatenate([[49], own[:-1]]) if n else own
        for t in range(n):
            nth = 0 if t < A.WINDOW else 1 + (t - A.WINDOW) // A.STRIDE
            first, last = nth * A.STRIDE, t + 1
            scored = np.zeros((1, last - first), bool)
            scored[0, -1] = True
            want = model.log_probs(before[None, first:last], own[None, first:last], scored)[0]
            assert got[low + t] == pytest.approx(want / math.log(10), rel=1e-4, abs=1e-6)


def test_words_end_at_ascii_white_space_only():
    texts = ["  A\tbÉ\x0b\x0c\r\nÉx\x1c1 y ", None, "", " \n", "one"]
    want = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert L.text_words(pa.array(texts)).to_pylist() == want
    assert L.text_words(pa.array(texts).slice(3)).to_pylist() == want[3:]


def tokens_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [" "]


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text)."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for h, (_, text) in zip(held, rows, strict=True) if not h for t in tokens_of(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for h, (i, text) in zip(held, rows, strict=True):
        tokens = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        out.append((i, h, len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    return sorted(out, key=repr)


def check(rows, found):
    got = sorted([tuple(r)[:6] for r in found], key=repr)
    for ours, want in zip(got, brute(rows), strict=True):
        assert ours[:5] == want[:5]
        assert ours[5] == pytest.approx(want[5], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_null_empty_long_and_repeated_rows(spark):
    rows = [(1, "One two\ttwo"), (None, "one TWO"), (None, None), (1, "One two\ttwo"), (2, ""), (3, " \n ")]
    rows += [(i, f"word{i % 7} the of") for i in range(4, 60)]
    rows += [(60, "a" * 5000 + " b" * 3000), (61, "ünï 漢字 🙂 " * 50)]
    df = spark.createDataFrame([(*r, "x", "y", "doc", "z") for r in rows], DOCS)
    found = L.lm_scores(df, PATH, PATTERN).collect()
    check(rows, found)
    equal = {r.score for r in found if r.doc_id == 1}
    assert len(equal) <= 2 and max(equal) == pytest.approx(min(equal), rel=1e-4)


def test_nothing_learned_and_no_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held, "a b"), (held, None)]
    df = spark.createDataFrame([(*r, "x", "y", "doc", "z") for r in rows], DOCS)
    check(rows, L.lm_scores(df, PATH, PATTERN).collect())
    assert L.lm_scores(df.limit(0), PATH, PATTERN).count() == 0


def test_held_out_texts_are_likelier_than_by_either_part(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    found = L.lm_scores(docs, PATH, PATTERN).collect()
    check([tuple(r) for r in docs.collect()], found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.network_score for r in held)
    # Single ids give 5.6 nats each, some 2.4 ids a word.
    assert sum(r.network_score for r in held) / sum(r.n_tokens for r in held) > -5.6 * 2.43 / math.log(10)


def test_every_id_is_learned_once(monkeypatch):
    model, draw = small_model(exact=False)
    sizes = np.array([1, A.WINDOW, A.WINDOW + 1, 0, 200, 7])
    ids = draw.integers(0, 50, int(sizes.sum()))
    asked, real = [], model.gradients
    monkeypatch.setattr(model, "gradients", lambda i, t, s: asked.append((i[s], t[s])) or real(i, t, s))
    model.learn(A.Adam(model.weights), ids, sizes, 49, 0.01, batch=3)
    want = []
    for n, low in zip(sizes, np.cumsum(sizes) - sizes, strict=True):
        own = ids[low : low + n].tolist()
        want += zip([49, *own[:-1]], own, strict=True) if n else []
    got = zip(*(np.concatenate(x).tolist() for x in zip(*asked, strict=True)), strict=True)
    assert sorted(got) == sorted(want)


def test_the_network_learns_from_every_document(spark):
    subwords = L.Subwords(PATH, PATTERN)
    # Each text has a subword id that no other text has; 128 of them would be one window learned.
    rare = [i for i in range(1000, 20000) if re.fullmatch(" [a-z]{5,}", name_of(i))][:130]
    rows = [(i, f"{name_of(token).strip()} the end") for i, token in enumerate(rare)]
    learned = spark.createDataFrame([*rows, (None, None)], "doc_id bigint, text string").repartition(3)
    model = A.Attention(A.Codes(np.arange(subwords.end + 1), np.ones(subwords.end + 1)), subwords.end + 1)
    before = {name: w.copy() for name, w in model.weights.items()}
    after = L.refined(learned, model, subwords).weights
    assert (after["e"][rare] != before["e"][rare]).any(axis=1).all()
    unseen = np.setdiff1d(np.arange(subwords.end), [i for _, text in rows for w in text.split() for i in subwords.ids(w)])
    assert after["e"][unseen] == pytest.approx(before["e"][unseen])
    assert all(np.isfinite(w).all() for w in after.values())


def name_of(token):
    return NAMES.get(token, b"").decode("utf-8", "replace")
