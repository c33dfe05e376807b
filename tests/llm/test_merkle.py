"""The Merkle manifest against a plain recursion, and its defined cases."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from flowscore.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """All levels of the tree over the nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, at):
    out = ""
    for level in levels[:-1]:
        first = at - at % 3
        out += "".join(n for i, n in enumerate(level[first : first + 3], first) if i != at)
        at //= 3
    return out


def brute(rows):
    """(doc_id, source, leaf, subroot, root, all siblings) of rows (doc_id, source, text)."""
    leaves = [(s is not None, s or "", d is not None, d or 0, sha(part(d) + part(s) + part(t))) for d, s, t in rows]
    leaves.sort()
    trees = [(key, list(group)) for key, group in groupby(leaves, key=lambda x: x[:2])]
    levels = [climb([leaf[4] for leaf in group]) for _, group in trees]
    top = climb([tree[-1][0] for tree in levels])
    out = []
    for i, (((known, source), group), tree) in enumerate(zip(trees, levels, strict=True)):
        for j, leaf in enumerate(group):
            proof = siblings(tree, j) + siblings(top, i)
            doc = leaf[3] if leaf[2] else None
            out.append((doc, source if known else None, leaf[4], tree[-1][0], top[-1][0], sha(proof)))
    return out


def found(df, names=("doc_id", "source")):
    fields = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    out = merkle.manifest(df.withColumn("leaf", fields), "source", ["doc_id"], "leaf", carry=["doc_id"])
    out = out.withColumn("proof", merkle.proof_digest(F.col("siblings")))
    rows = out.withColumn("again", merkle.fold(F.col("leaf"), F.col("siblings"))).collect()
    assert all(r.again == r.root for r in rows)
    return [(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


SCHEMA = "doc_id bigint, source string, text string, grp string, place int, node string"


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1, 1], [3, 4], [9, 10, 28, 2], [243, 244, 1], [1000, 730, 5]])
def test_trees_equal_a_plain_recursion(spark, sizes):
    rows = [(i * 7 % 1009, f"s{g}", f"text {i}\n{g}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    assert order(found(df)) == order(brute(rows))


def test_nulls_repeated_rows_and_odd_sources(spark):
    rows = [
        (None, None, None),
        (None, None, "a"),
        (1, None, ""),
        (1, "", "a"),
        (1, "", "a"),
        (1, "ß", "x" * 200_000),
        (2, "Z", "é\n🙂"),
        (2, "z", None),
        (-3, "z", "b"),
    ]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    assert order(found(df)) == order(brute(rows))


def test_many_groups(spark):
    rows = [(i, f"source {i % 300}", "t") for i in range(700)]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    assert order(found(df)) == order(brute(rows))


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    df = spark.createDataFrame([(i, "s", "t", "x", 1, None) for i in range(20)], SCHEMA)
    fields = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    out = merkle.manifest(df.withColumn("leaf", fields), "source", ["doc_id"], "leaf", carry=["doc_id"])
    other = merkle.fold(F.sha2(F.lit("other"), 256), F.col("siblings"))
    assert out.where(other == F.col("root")).count() == 0
