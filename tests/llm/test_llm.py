"""The training-data operators on small tables: defined cases and brute force."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from flowscore.llm import bpe, chat, decontam, langid, linededup, minhash, pii, scratch, topk, toxicity, warc
from flowscore.llm import queries as Q
from flowscore.llm.graph import components
from flowscore.llm.hashing import ALNUM, SPACED, mix, shingle_sets, span_hashes, words

RANKS = bpe.read_ranks(public_tokenizers.path(Q.RANK_FILE))
DOCS = "doc_id bigint, text string, lang string, component_id string"
ODD = [
    (1, "One two three four", "en", "x"),
    (2, None, None, None),
    (3, "", "en", None),
    (None, "one TWO three four", "en", "y"),
    (1, "One two three four", "en", "x"),
    (5, "a" * 3000 + " " + "word " * 2000, None, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- hashes of words and lines -------------------------------------------------


def thue_morse(n: int, one: str, other: str) -> str:
    return "".join(one if bin(i).count("1") % 2 == 0 else other for i in range(n))


def test_patterned_words_and_lines_stay_apart(spark):
    tail = " ".join(f"w{i}" for i in range(9))
    patterns = {}
    for i, size in enumerate((1024, 2048, 4096)):
        patterns[10 * i] = thue_morse(size, "a", "b")
        patterns[10 * i + 1] = thue_morse(size, "b", "a")
    for table in (SPACED, ALNUM):
        data = np.frombuffer(" ".join(patterns.values()).encode(), np.uint8)
        assert len(set(words(data, np.array([0, len(data)]), table)[0].tolist())) == 6
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(i, f"{t} {tail}") for i, t in patterns.items()], schema)
    assert all(r.kept for r in minhash.near_duplicates(docs, minhash.NearRule()).collect())
    items = [(str(i), f"{t} {tail}") for i, t in patterns.items() if i % 10 == 0]
    items = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.contamination(docs, items).where("size(covered) > 0").collect()
    assert sorted(r.doc_id for r in found) == [0, 10, 20]
    lines = [(i, "\n".join([t] * 60)) for i, t in patterns.items()]
    kept = linededup.dedup_lines(spark.createDataFrame(lines, schema)).collect()
    assert all(patterns[r.doc_id] in r.text for r in kept) and len(kept) == 6


def test_span_hashes_take_every_byte_place_and_length():
    draw = random.Random(9)
    spans = [bytes(draw.randrange(2) for _ in range(draw.randrange(40))) for _ in range(4000)]
    ends = np.cumsum([len(x) for x in spans])
    first = np.concatenate([[0], ends[:-1]])
    got = span_hashes(np.frombuffer(b"".join(spans), np.uint8), first, ends)
    assert len(set(got.tolist())) == len(set(spans))
    assert len({(x, int(h)) for x, h in zip(spans, got, strict=True)}) == len(set(spans))
    assert len(span_hashes(np.zeros(0, np.uint8), first[:0], ends[:0])) == 0


# --- 1, byte-level BPE ---------------------------------------------------------


def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
    )


def test_bpe_equals_the_library_and_comes_back(spark, odd, documents, none):
    strange = ["    x\t\n\n y", "I'll don't 12 ½ ٣ ß漢字かな 🙂‍🙂", "<|endoftext|>", "a\r\nb  "]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(strange)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(extra).unionByName(documents.select("doc_id", "text"))
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    at_once = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, rows))
    want = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    encode = library().encode_ordinary
    assert len(rows) == len(want)
    expected = sorted((i, encode(t), t.encode()) for i, t in want)
    assert sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in rows) == expected
    for r in rows:
        assert bytes(r.packed) == b"".join(struct.pack("<I", i) for i in r.ids)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_repeated_letters_long_words_and_many_chunks(spark, monkeypatch):
    # A chunk of a few words, few kept: the numbering begins anew many times.
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 60)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 200)
    draw = random.Random(5)
    texts = ["z" * 100_000, "ab" * 250 + " " + "é" * 400, "x" * 512, "x" * 513, "", None]
    texts.append(" ".join(f"w{draw.randrange(4000):x}q" for _ in range(20_000)))
    texts += [" ".join(f"k{draw.randrange(60)}vz" for _ in range(12)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    encode = library().encode_ordinary
    assert got == {i: encode(t or "") for i, t in rows}


def test_a_task_merges_a_word_once_and_forgets_beyond_its_bound():
    tokens = bpe._Tokens(bpe.token_arrays(RANKS, bpe.ranked_pairs(RANKS)))
    first, new = tokens.numbered([b"qzqzq", b"the", b"xqxqxq"])
    assert new == [b"qzqzq", b"xqxqxq"] and first[1] == RANKS[b"the"]
    again, new = tokens.numbered([b"xqxqxq", b"qzqzq"])
    assert new == [] and list(again) == [first[2], first[0]]
    tokens.forget()
    assert tokens.kept == 0 and tokens.numbered([b"qzqzq"])[1] == [b"qzqzq"]
    assert list(bpe._cuts(np.array([5, 90, 0, 0]), 90)) == [(0, 1), (1, 4)]
    assert list(bpe._cuts(np.array([], int), 90)) == []


def test_kept_words_take_little_more_than_their_bytes():
    tokens = bpe._Tokens(bpe.token_arrays(RANKS, bpe.ranked_pairs(RANKS)))
    tracemalloc.start()
    for low in range(0, 200_000, 20_000):
        tokens.numbered([b"qz%dxv" % i for i in range(low, low + 20_000)])
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert tokens.kept == 200_000 and taken < 40 * tokens.kept + tokens.kept_bytes


@pytest.mark.parametrize("hashes", [4, 1 << 16, 1 << 62])
def test_numbers_of_words_that_share_a_hash(monkeypatch, hashes):
    own = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *spans: own(*spans) % np.uint64(hashes))
    draw = random.Random(9)
    numbers = bpe._Numbers([b"a", b"", b"bc", b"\0", b"\0\0"])
    known = {b"a": 0, b"bc": 2, b"\0": 3, b"\0\0": 4}
    copied, count = numbers.copy(), 5
    for _ in range(30):
        words = list({draw.choice([b"a", b"\0" * draw.randrange(1, 20), b"w%d" % draw.randrange(300)]) for _ in range(40)})
        new = [w for w in words if w not in known]
        known |= {w: count + i for i, w in enumerate(new)}
        count += len(new)
        got, first = numbers.numbered(words)
        assert first == new and got.tolist() == [known[w] for w in words]
    assert numbers.numbered([])[1] == []
    assert copied.numbered([b"bc", b"w1", b"a"])[0].tolist() == [2, 5, 0]


def test_first_merges_are_those_of_the_fold():
    pairs = bpe.ranked_pairs(RANKS)
    tokens = bpe._Tokens(bpe.token_arrays(RANKS, pairs))
    draw = random.Random(6)
    sizes = [1, 2, bpe.FOLD_BYTES, bpe.FOLD_BYTES + 1, 3] + [draw.randrange(1, 14) for _ in range(300)]
    words = [bytes(draw.choice(b"abeinst\xc3\xa9") for _ in range(n)) for n in sizes] + [b"aaaa", b"aaaaaaa"]
    for word, got in zip(words, tokens.pieces(words).to_pylist(), strict=True):
        ids = [RANKS[bytes([b])] for b in word]
        if len(word) > bpe.FOLD_BYTES:
            ids = bpe.merge_long_word(ids, pairs)
        for _ in range(bpe.FIRST_MERGES):
            rank, i = min(((pairs[p], i) for i, p in enumerate(itertools.pairwise(ids)) if p in pairs), default=(0, -1))
            ids[i : i + 2] = [rank] if i >= 0 else ids[i : i + 2]
        assert [p & bpe._ID for p in got] == ids
        ranks = [pairs.get(p, bpe._NONE) for p in itertools.pairwise(ids)] + [bpe._NONE]
        assert [p >> bpe._RANK_AT for p in got] == ranks
    assert len(tokens.pieces([])) == 0


def test_heap_merges_equal_the_library():
    pairs = bpe.ranked_pairs(RANKS)
    draw = random.Random(3)
    for _ in range(20):
        word = "".join(draw.choice("abcdeño") for _ in range(700))
        ids = [RANKS[bytes([b])] for b in word.encode()]
        assert bpe.merge_long_word(ids, pairs) == library().encode_ordinary(word)


# --- 2, decontamination --------------------------------------------------------


def test_contamination_cases(spark, odd, none):
    items = spark.createDataFrame(
        [(7, "ONE, two three"), (None, "three four"), (8, None), (9, "")], "item_id bigint, text string"
    )
    rows = {(r.doc_id, r.n_words): (r.covered, r.items) for r in decontam.contamination(odd, items).collect()}
    assert rows[1, 4] == ([0, 1, 2, 3], ["7", "null"]) == rows[None, 4]
    assert rows[2, 0] == rows[3, 0] == ([], [])
    assert decontam.contamination(odd, items).count() == len(ODD)
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).where("size(covered) > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y y b"), (2, "a x x x b")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "A b")], "query_id bigint, text string")
    rows = decontam.proximity_matches(docs, asked, 3).collect()
    assert [(r.doc_id, r.last_pos) for r in rows] == [(1, 2)]


# --- 3, surrogates -------------------------------------------------------------


def test_surrogates_keep_kind_format_and_identity(spark):
    text = (
        "Mr. Smith wrote to Mrs Jones; Mr Smith of a.b@mail.example.com, A.B@mail.example.com, "
        "4000-1234-5678-9010 or 4000123456789010, +1 (202) 555-0100, 10.1.2.3, 123-45-6789, г-н Петров"
    )
    rows = [(1, text, 3), (2, None, 4), (3, "", 5), (None, "Mr. Brown", 6), (1, text, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kinds int")
    out = {r.doc_id: r for r in pii.replace_entities(docs, "key").collect()}
    one = out[1]
    assert one.kinds == [
        "man", "woman", "man", "email", "email", "card", "card", "phone", "ip", "ssn", "man",
    ]
    s = one.surrogates
    assert s[0].removeprefix("Mr. ") == s[2].removeprefix("Mr ") != "Smith"
    assert s[3] == s[4].lower() and s[4][0].isupper() and s[3].endswith(".com")
    assert s[5].replace("-", "") == s[6] and s[6][0] == "4" and re.fullmatch(r"\d{16}", s[6])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", s[7])
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", s[9]) and re.fullmatch(r"г-н [А-Я][а-я]+", s[10])
    assert out[None].surrogates[0] != s[0] and (out[2].text, out[3].text) == (None, "")
    assert pii.replace_entities(docs, "key").count() == len(rows)


def test_secrets_of_any_case_and_spelling(spark):
    values = ["9233A8ECBB01D2F4", "a1b2c3d4e5f60718", "hunter2hunter2", "Zx9Zx9Zx9", "abcdefgh", "Q1w2e3r4t5"]
    text = (
        f'TOKEN = "{values[0]}" and "token": "{values[1]}", PASSWORD: {values[2]}; secret =  \'{values[3]}\' '
        f"password={values[4]} API_KEY={values[5]}, the secret: everything, password=me@mail.example.com"
    )
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = pii.replace_entities(docs, "key").head()
    assert row.kinds == ["secret"] * 6 + ["email"] and not any(v in row.text for v in values)
    shape = lambda v: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v)))
    assert re.fullmatch("[0-9A-F]{16}", row.surrogates[0]) and re.fullmatch("[0-9a-f]{16}", row.surrogates[1])
    assert [shape(v) for v in row.surrogates[2:6]] == [shape(v) for v in values[2:]]
    blank = lambda t, found: [t := t.replace(v, "") for v in found][-1]
    assert blank(row.text, row.surrogates) == blank(text, [*values, "me@mail.example.com"])


def test_surrogates_end_where_a_format_has_too_few_values(spark):
    real = [f"{i}@{j}.co" for i in range(8) for j in range(8)]
    entities = spark.createDataFrame([("email", x) for x in real], "kind string, entity string")
    drawn = {r.entity: r.drawn for r in pii.draw_surrogates(entities, "key").collect()}
    assert sorted(drawn) == sorted(real) and len(set(drawn.values())) == 64
    assert not set(drawn.values()) & set(real)
    row = spark.createDataFrame([("email", "1@2.CO", "ab3@4.co")], "k string, m string, d string")
    assert row.select(pii.rendered(F.col("k"), F.col("m"), F.col("d")).alias("x")).head().x == "ab3@4.co"


def test_surrogates_are_distinct_and_not_real(spark):
    names = [chr(65 + i // 20) + "abcdefghijklmnopqrst"[i % 20] for i in range(300)] + ["Adam", "Hugo"]
    entities = spark.createDataFrame([("man", n) for n in names], "kind string, entity string")
    rows = pii.draw_surrogates(entities, "key").collect()
    drawn = {r.drawn for r in rows}
    assert len(rows) == len(names) == len(drawn) and not drawn & set(names)


# --- 4, languages --------------------------------------------------------------


def test_gradients_equal_differences():
    network = langid.Network(3, seed=1, hidden=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    data = np.array([[1, 2, 3, 4], [5, 1, 256, 256]])
    labels = np.array([0, 2])

    def loss():
        p = network.probabilities(network.states(data).astype(np.float64))
        real = data.T < 256
        return -np.log(p[:, np.arange(2), labels])[real].sum() / real.sum()

    grads = network.gradients(data, labels)
    for name, place in [("x", (0, 1, 2)), ("x", (1, 3, 7)), ("u", (1, 2, 4)), ("v", (0, 1, 2)), ("c", (1,))]:
        w = network.weights[name]
        old = w[place]
        w[place] = old + 1e-2
        up = loss()
        w[place] = old - 1e-2
        down = loss()
        w[place] = old
        assert abs((up - down) / 2e-2 - grads[name][place]) < 2e-3


def test_languages(spark, documents, odd, none):
    names, network = langid.train(documents.where(~langid.held_out()))
    rows = langid.predict(documents, names, network).where(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = {r.doc_id: r for r in langid.predict(odd, names, network).collect()}
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[2].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].component_id == "z"
    assert langid.predict(none, *langid.train(none)).count() == 0


# --- 5, near duplicates --------------------------------------------------------


def brute_components(rows, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
        grams = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
        sets[i] = grams or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(5)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(150):
        # A crowd of drifting copies: links, chains and pairs just apart.
        copy = list(base)
        for _ in range(draw.randrange(12)):
            copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        if i % 25 == 0:
            base = copy
    rows += [(200, "Two words"), (201, "two  WORDS"), (202, ""), (203, None), (204, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rule = minhash.NearRule(size=3, percent=85, block_bytes=20_000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, rule).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_cases(odd, none):
    rows = minhash.near_duplicates(odd, minhash.NearRule(size=3)).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {
        (1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (5, 5, True),
    }
    assert minhash.near_duplicates(none, minhash.NearRule()).count() == 0


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(1)
    every = draw.integers(0, 2**63, 300).astype(np.uint64)
    a, b = minhash.sketch(every[:200], 192), minhash.sketch(every[100:], 192)
    assert abs((a == b).mean() - 1 / 3) < 0.12
    assert (minhash.sketch(every[:1], 192) != minhash._EMPTY).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(41)} | {(50, 50), (100, 50)}


# --- 6, toxicity ---------------------------------------------------------------


def test_toxicity(spark, none):
    draw = random.Random(2)
    rows, marks = [], []
    for i in range(1500):
        text = [f"w{draw.randrange(200)}" for _ in range(60)]
        if i % 5 == 0:
            text[draw.randrange(60)] = draw.choice(["vile", "nasty"])
        rows.append((i, " ".join(text)))
        marks.append((i, 0, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (3, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model, curve = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, curve).where(toxicity.held_out()).collect()
    good = sum(r.predicted == int(r.doc_id % 5 == 0) for r in scored)
    assert good >= 0.95 * len(scored)
    odd_rows = spark.createDataFrame(ODD, DOCS)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd_rows, model, curve).collect())
    assert toxicity.score(none, *toxicity.train(none, labels)).count() == 0


def test_toxicity_counts_are_those_of_the_expression(spark):
    # "vile" and "so bad" are toxic; others share 20 bits of the hash of the word or of the pair.
    rows = [(i, f"w{i % 7} w{i % 11} " + ("vile so bad" if i % 2 else "bad so fine"), i % 2) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model, curve = toxicity.train(docs, docs)
    text = " ".join(["vile", "so", "bad", *(f"q{i}" for i in range(4_000_000))]).encode()
    hashes, first, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)
    low = hashes >> np.uint64(34)
    pair = mix(np.concatenate([low[:1] * np.uint64(0), low[:-1]]) << np.uint64(30) | low) & np.uint64((1 << 20) - 1)
    same = lambda at, values, i: 4 + np.flatnonzero(values[4:] & np.uint64((1 << 20) - 1) == at)[i]
    at = [same(low[0] & np.uint64((1 << 20) - 1), low, 0), same(pair[2], pair, 0)]
    word = lambda i: f"q{i - 3}"
    asked = [(1, word(at[0])), (2, f"{word(at[1] - 1)} {word(at[1])}"), (3, "vile"), (4, "unseen so bad")]
    scored = toxicity.score(spark.createDataFrame(asked, "doc_id bigint, text string"), model, curve)
    got = {r.doc_id: r.ratio for r in scored.collect()}
    assert got[1] == got[2] == 0 and got[3] > 0 and got[4] > 0


def test_toxicity_entries_are_joined_as_they_are_broadcast(spark, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 11} " + ("vile so bad" if i % 2 else "bad so fine"), i % 2) for i in range(2000)]
    docs = spark.createDataFrame([*rows, (None, "", 1), (5, None, 0)], "doc_id bigint, text string, toxic int")
    got = []
    for hot in (1, 4096):
        monkeypatch.setattr(toxicity, "HOT", hot)
        model, curve = toxicity.train(docs, docs)
        got.append(sorted((r.doc_id or -1, round(r.ratio, 9)) for r in toxicity.score(docs, model, curve).collect()))
    assert got[0] == got[1] and len(got[0]) == len(rows) + 2 and len({x for _, x in got[0]}) > 2


def brute_ratios(rows, asked):
    """Log-likelihood ratios a word of Kneser-Ney bigrams, from the counts of (text, toxic)."""
    tokens = lambda text: re.findall(r"[a-z0-9]+", text.lower())
    pairs = [Counter(), Counter()]
    for text, toxic in rows:
        pairs[toxic].update(itertools.pairwise([None, *tokens(text)]))
    both = set(pairs[0]) | set(pairs[1])
    after = Counter(w for _, w in both)
    d = toxicity.DISCOUNT

    def chance(c, v, w):
        own = Counter(y for _, y in pairs[c])
        shared = (after[w] + 0.5) / (len(both) + 0.5 * (len(after) + 1))
        lower = (max(own[w] - d, 0) + d * len(own) * shared) / len(pairs[c])
        seen = {y: n for (x, y), n in pairs[c].items() if x == v}
        if v is None or not seen:
            return lower
        return (max(seen.get(w, 0) - d, 0) + d * len(seen) * lower) / sum(seen.values())

    out = []
    for text in asked:
        steps = list(itertools.pairwise([None, *tokens(text)]))
        out.append(sum(math.log(chance(1, *s) / chance(0, *s)) for s in steps) / max(1, len(steps)))
    return out


@pytest.mark.parametrize("common", [1, 1 << 20])
def test_toxicity_ratios_equal_brute_force(spark, monkeypatch, common):
    # Most bigrams occur once or twice, many contexts and words in one class only.
    monkeypatch.setattr(toxicity, "COMMON", common)
    draw = random.Random(4)
    text = lambda kind: " ".join(f"{kind if draw.random() < 0.4 else 'w'}{draw.randrange(12)}" for _ in range(9))
    rows = [(text("xy"[i % 2]), i % 2) for i in range(60)]
    asked = [text(kind) for kind in "xyz" * 10] + ["", "unseen", "unseen w1 x2 unseen", "W1 w1 w1 w1"]
    model = toxicity.build_model(toxicity.count_bigrams(spark.createDataFrame(rows, "text string, toxic int")))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    got = {r.doc_id: r.ratio for r in toxicity.with_ratio(docs, model).collect()}
    assert [got[i] for i in range(len(asked))] == pytest.approx(brute_ratios(rows, asked), abs=1e-9)


# --- 7, lines ------------------------------------------------------------------


def brute_lines(rows, least):
    runs, gone = {}, {}
    for doc, text in sorted(r for r in rows if r[1] is not None):
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    if run in runs:
                        gone.setdefault(doc, set()).update(range(i, j))
                    runs.setdefault(run, (doc, i))
    return {doc: sorted(places) for doc, places in gone.items()}


def test_lines_equal_brute_force(spark):
    draw = random.Random(4)
    rows = [
        (i, "\n".join(draw.choice(["a b", "c", "", "d e f", f"u{i} v"]) for _ in range(draw.randrange(1, 14))))
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.removed for r in linededup.dedup_lines(docs, 6).where("size(removed) > 0").collect()}
    assert got == brute_lines(rows, 6)


def test_no_plan_of_lines_holds_all_lengths(spark, monkeypatch):
    draw = random.Random(5)
    block = [draw.choice(["a", "b c", "d"]) + f" {i}" for i in range(40)]
    rows = [(i, "\n".join([f"u{i}", *block[i : i + 20]])) for i in range(12)]
    joins, own = [], linededup.stored

    def stored(df, label):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return own(df, label)

    monkeypatch.setattr(linededup, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = linededup.dedup_lines(docs, 10).where("size(removed) > 0").collect()
    assert {r.doc_id: r.removed for r in found} == brute_lines(rows, 10)
    # The joins of one length: both ends of a run, for the intervals and their members.
    assert 0 < max(joins) <= 5


def test_lines_cases(spark, odd, none):
    line = "word " * 60
    rows = [(1, f"{line}\nkeep", 1), (2, f"first\n{line}", 2), (3, None, 3), (4, "", 4), (2, f"first\n{line}", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, removed int")
    out = sorted((r.doc_id, r.text, r.n_lines) for r in linededup.dedup_lines(docs).collect() if r.text is not None)
    assert out == [(1, f"{line}\nkeep", 2), (2, "first", 2), (2, "first", 2), (4, "", 1)]
    assert linededup.dedup_lines(odd).count() == len(ODD)
    assert linededup.dedup_lines(none).count() == 0


# --- 8, chats ------------------------------------------------------------------


def test_chat_round_trip_and_order(spark):
    rows = [
        (1, 1, "user", "<|im_end|>\\c <|\\"), (1, 2, "assistant", None), (2, 1, "assistant", "x\ny"),
        (None, 1, None, "<"), (3, 2, "assistant", "b"), (3, 1, "user\n<|", "a"), (3, 2, "assistant", "b"),
    ]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    out = chats.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss_text", chat.loss_text(F.col("segments"))
    )
    got = {r.conv_id: r for r in out.collect()}
    turns = {i: [tuple(t) for t in r.turns] for i, r in got.items()}
    assert turns[1] == [("user", "<|im_end|>\\c <|\\"), ("assistant", "")]
    assert turns[3] == [("user\n<|", "a"), ("assistant", "b"), ("assistant", "b")]
    assert turns[None] == [("", "<")] and got[2].loss_text == "x\ny" and got[3].loss_text == "bb"
    assert [got[i].first_invalid for i in (1, 2, 3, None)] == [None, 1, 1, 1]


# --- 9, archives ---------------------------------------------------------------


def test_records_of_any_piece_size():
    records = [warc.record_bytes(i, "http://é/\r\n", b"x" * i * 50, None, "d") for i in range(5)]
    import gzip

    packed = gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))
    for size in (1, 7, 1000):
        pieces = (packed[i : i + size] for i in range(0, len(packed), size))
        assert list(warc.split_records(warc.inflated(pieces))) == records


def test_records_are_read_in_batches_of_bounded_bytes(tmp_path):
    made = [warc.record_bytes(i, "http://a", (b"%d" % i) * 500_000, None, "d") for i in range(30)]
    members = [warc.zlib.compress(x, wbits=31) for x in made]
    (tmp_path / "a").write_bytes(b"".join(members))
    lengths = [len(x) for x in members]
    index = pa.RecordBatch.from_arrays(
        [pa.array([f"file://{tmp_path}/a"] * 30), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)],
        names=["archive", "offset", "length"],
    )
    found = list(warc._records(iter([index])))
    assert [x for b in found for x in b.column("page_id").to_pylist()] == list(range(30))
    assert max(b.nbytes for b in found) <= scratch.BATCH_BYTES + 1_100_000


def test_archived_pages(spark):
    body = "é" * 60
    rows = [(3, "u", body, 1), (1, None, body, 2), (2, "u", None, 3), (5, "u", "short", 4), (6, "u", "short", 5), (None, "u", body, 6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, offset int")
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {
        3: ("revisit", 1, 120), 1: ("response", None, 120), 2: ("response", None, 0),
        5: ("response", None, 5), 6: ("response", None, 5), None: ("response", None, 120),
    }
    assert got[3].payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert warc.archived(pages.limit(0)).count() == 0


# --- 10, search ----------------------------------------------------------------


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS_ROWS", 16)
    monkeypatch.setattr(topk, "LIST_BYTES", 2000)
    monkeypatch.setattr(topk, "PIVOTS", 12)
    draw = np.random.default_rng(0)
    v = draw.normal(size=(400, 5)).round(3)
    v[100:250] = v[100]
    rows = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]
    rows += [(900, None, 0), (901, [None] * 5, 0), (1000, [float("nan")] * 5, 0), (None, [1.0] * 5, 0), rows[0]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_products(table).collect()}
    q = np.floor(1024 * v).astype(np.int64)
    want = {}
    for i in range(0, 400, 100):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:10]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want
    assert topk.top_products(table.limit(0)).count() == 0
    assert topk.top_products(table.where("vec_id IN (0, 5)").limit(2)).count() <= 1


def test_top_products_of_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, []), (2, [1e300, 0.0]), (3, [3.0]), (4, [0.0, 1.0, 5.0]), (5, [float("inf"), 0.0]),
        (6, [2.0e6, 2.0e6]), (7, [-1e-9, 1.0]), (100, [0.0, 0.0, 1.0]),
    ]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    unit = 1024 * 1024
    assert got == {
        (0, 1): (3, 3 * unit), (0, 2): (4, 2 * unit), (0, 3): (7, 2 * unit - 1024),
        (100, 1): (4, 5 * unit), (100, 2): (0, 0), (100, 3): (3, 0),
    }


def test_annuli_are_left_out_once_no_bound_reaches_the_floor():
    draw = np.random.default_rng(2)
    v = np.rint(draw.normal(size=(8192, 4)) * 4096).astype(np.int64)
    v[:64] = np.rint(draw.normal(size=(64, 4)) * 40).astype(np.int64) + 20_000
    norm2 = float((v * v).sum(axis=1).max())
    lifted = topk._lifted(v, norm2)
    gaps = topk._distances(lifted, lifted[:1])[:, 0]
    order = np.argsort(gaps, kind="stable")
    ids, v, gaps = order.astype(np.int64), v[order], gaps[order]
    at = np.flatnonzero(ids < 8)
    away = topk._distances(np.hstack([v[at].astype(float), np.zeros((8, 1))]), lifted[:1])[:, 0]
    floors = np.full(8, topk.NO_FLOOR, np.int64)
    row, place, score, visited = topk.expand(ids[at], v[at], away, floors, ids, v, gaps, 10, norm2)
    assert visited < 8192 // topk.ANNULUS_ROWS // 2
    for i, x in enumerate(at):
        products = v @ v[x]
        want = sorted((-int(products[j]), int(ids[j])) for j in range(len(ids)) if j != x)[:10]
        assert [(-int(s), int(ids[p])) for r, p, s in zip(row, place, score, strict=True) if r == i] == want
    again = topk.expand(ids[at], v[at], away, np.full(8, 2**62), ids, v, gaps, 10, norm2)
    assert len(again[0]) == 0 and again[3] == 0


# --- the pipeline --------------------------------------------------------------


def test_pipeline(spark, documents):
    columns, docs = documents.columns, documents
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] >= 0.98 * documents.count() and kept == sorted(kept, reverse=True)
    out = corpus_pipeline.tokenize(spark, docs, DATA).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_shingles_of_slices():
    column = pa.array(["x", "a b c", None, "A  b\tc d"]).slice(1)
    sets = list(shingle_sets(column, SPACED, 3))
    assert [len(s) for s in sets] == [1, 0, 2] and sets[0][0] in sets[2]


def test_ranks_are_read():
    with open(public_tokenizers.path(Q.RANK_FILE), "rb") as lines:
        token, rank = next(lines).split()
    assert RANKS[base64.b64decode(token)] == int(rank)


# --- Arrow batches ---------------------------------------------------------------


def arrow_batches(df):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return [r.n for r in df.select("text").mapInArrow(run, "n bigint").collect()]


@pytest.mark.parametrize("name", ["op1", "op7"])
def test_long_texts_do_not_travel_in_one_batch(spark, name):
    encode = lambda df: bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    run = {"op1": encode, "op7": linededup.dedup_lines}[name]
    long = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 50000) AS text")
    was = spark.conf.get(scratch.BATCH_SETTING)
    try:
        for given, most in (("64m", scratch.BATCH_BYTES), ("1m", 1 << 20), ("1g", scratch.BATCH_BYTES)):
            spark.conf.set(scratch.BATCH_SETTING, given)
            run(long)
            assert max(arrow_batches(long)) <= most + 600_000
    finally:
        spark.conf.set(scratch.BATCH_SETTING, was)


def test_workers_give_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words of a text", "en"), (2, "other words", "de")], "doc_id bigint, text string, lang string")
    given, calls = [], []
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: given.append(f) or own(self, f, schema))
    monkeypatch.setattr(scratch, "give_back", lambda: calls.append(1))
    minhash.sketches(docs, minhash.NearRule())
    linededup.line_rows(docs.selectExpr("doc_id", "text"), 50)
    langid.predict(docs, ["en"], langid.Network(1))
    bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)
    for run in given:
        before = len(calls)
        list(run(iter([])))
        assert len(calls) == before + 1
    assert len(given) == 5
