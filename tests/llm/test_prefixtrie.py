"""The prefix trie against brute force, over one round and many, and its defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowscore.llm import prefixtrie as T

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SEQUENCES = "conv_id bigint, turns array<struct<key:string,size:bigint>>"
COLUMNS = [
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(sequences):
    """Nodes of ``{conv_id: ((key, size), ...)}``."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * (path[-1][1] if path else 0)
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = own + sum(saved[c] for c in children[path])
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if sequences[c] == path)
        up = min(members[path[:-1]]) if path else None
        n = len(children[path])
        out.append((min(convs), len(path), up, len(convs), n, leaves[path], saved[path], sha(ends)))
    return sorted(out, key=repr)


def found(spark, sequences):
    rows = [(c, [(k, s) for k, s in turns]) for c, turns in sequences.items()]
    df = T.prefix_trie(spark.createDataFrame(rows, SEQUENCES))
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def drawn(seed, n, letters=3, longest=9):
    draw = random.Random(seed)
    names = [(sha(str(i)), i * i) for i in range(letters)]
    return {
        draw.randrange(10) * 1000 + i: tuple(draw.choice(names) for _ in range(draw.randrange(longest)))
        for i in range(n)
    }


@pytest.fixture
def small_shards(spark, monkeypatch):
    spark.conf.set(BATCH, 7)
    monkeypatch.setattr(T, "LAST_ROWS", 5)
    yield
    spark.conf.unset(BATCH)


def test_find_close_equals_a_stack():
    draw = random.Random(5)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        signs, depth = [], 0
        for _ in range(2 * n):
            up = depth == 0 or (draw.random() < 0.55 and signs.count(1) < n)
            signs.append(1 if up else -1)
            depth += signs[-1]
        signs = [1, *signs, *[-1] * (depth + 1)]
        stack, want = [], {}
        for i, sign in enumerate(signs):
            if sign > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(np.array(signs) == 1)
        assert T.Excess(np.array(signs)).find_close(opens).tolist() == [want[i] for i in opens.tolist()]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    sequences = drawn(seed, 300)
    assert found(spark, sequences) == brute(sequences)


@pytest.mark.parametrize("seed", [3, 4])
def test_trie_of_many_small_shards_equals_brute_force(spark, small_shards, seed):
    sequences = drawn(seed, 250, letters=2, longest=6)
    assert found(spark, sequences) == brute(sequences)


def test_copies_of_one_conversation_over_many_shards(spark, small_shards):
    one = tuple((sha(str(i)), 10) for i in range(4))
    sequences = {i: one for i in range(150)} | {200 + i: one[:2] for i in range(40)} | {300: one + one}
    assert found(spark, sequences) == brute(sequences)


def test_a_long_conversation(spark):
    long = tuple((sha(str(i)), 3) for i in range(3000))
    sequences = {1: long, 2: long[:1500], 3: ()}
    got = found(spark, sequences)
    assert len(got) == 3001
    assert got == brute({1: long, 2: long[:1500], 3: ()})


def test_no_conversations(spark):
    assert found(spark, {}) == []


ROWS = "conv_id bigint, turn bigint, role string, text string, key string, kind string, size int"


def rebuilt(spark, rows):
    df = spark.createDataFrame([(*r, "k", "spine", 1) for r in rows], ROWS)
    out = {r.conv_id: tuple((t.key, t.size) for t in r.turns) for r in T.rebuilt(df).collect()}
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = sha(f"{len(role.encode())}:{role}{text}")
            told[conv].append((turn is not None, turn or 0, key, len(text.encode())))
    want = {}
    for conv, turns in told.items():
        h = zlib.crc32(str(conv).encode()) % 9
        head = sorted(told.get(conv - conv % 5, []))[:h]
        want[conv] = tuple((k, s) for *_, k, s in head + sorted(turns)[h:])
    assert out == want
    return want


def test_rebuilding_with_nulls_ties_repeated_rows_and_absent_origins(spark):
    rows = [(c, t, "user", f"text {c % 3} {t} é") for c in range(0, 40) for t in range(c % 7)]
    rows += [(40, None, None, None), (40, 0, "user", "a"), (40, 0, "user", "b"), (40, 0, "user", "a")]
    rows += [(None, 0, "user", "x"), (41, 3, "", ""), (87, 0, "a", "b"), (42, 0, "ab", ""), (43, 0, "a", "b" * 100_000)]
    want = rebuilt(spark, rows)
    df = spark.createDataFrame([(*r, "k", "spine", 1) for r in rows], ROWS)
    got = sorted(map(tuple, T.prefix_trie(T.rebuilt(df)).collect()), key=repr)
    assert got == brute(want)


def test_nothing_to_rebuild(spark):
    assert rebuilt(spark, []) == {}
