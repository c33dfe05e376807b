"""A Merkle manifest of a table: leaf digests, one tree for each group, one over the groups.

The leaves of a group are numbered in order and cut into aligned blocks of
``FANOUT ** LEVELS``. A block keeps each of its levels as one string of
concatenated hex digests: fixed-width substrings of a level are hashed to the
level above, and the substrings that flank a node in its run are its sibling
segment. The roots of the blocks are the leaves of the next tier, until a group
has one node left; these subroots are the leaves of a last tree, built alike.
All of it is DataFrame code: no tier is held in one task or the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.functions.names import column
from flowscore.llm.scratch import discard, stored
from flowscore.operators.paging import number_rows

FANOUT = 3
# Levels of a block: 243 nodes, 15,552 characters at most.
LEVELS = 5
BLOCK = FANOUT**LEVELS
# Characters of a digest.
WIDTH = 64

_SEGMENTS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    written = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(written, F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: its fields, one after the other."""
    return digest(*map(field, values))


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its sibling segments, from the lowest level up, lead to."""
    return F.aggregate(siblings, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(siblings: Column) -> Column:
    """The digest of all siblings, level by level and from left to right."""
    parts = F.transform(siblings, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(parts, ""), 256)


def _parents(level: Column) -> Column:
    """The level above: a digest for each run of three nodes, the last run may be shorter."""
    run = FANOUT * WIDTH
    starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    return F.array_join(
        F.transform(starts, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), ""
    )


def _levels(lowest: Column, height: Column) -> Column:
    """The ``height + 1`` levels of a block, the lowest first."""
    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), height)
    return F.aggregate(
        steps,
        F.array(lowest),
        lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))),
    )


def _height(total: Column) -> Column:
    """Levels that ``total`` nodes need up to one node, a whole block's at most."""
    out = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(total <= FANOUT**level, level).otherwise(out)
    return out


def _segments(levels: Column, place: Column, height: Column) -> Column:
    """The sibling segment of the node at ``place`` of the lowest level, and of its ancestors."""

    def segment(level: Column, depth: Column) -> Column:
        power = F.element_at(F.array(*[F.lit(FANOUT**i) for i in range(LEVELS)]), depth + 1)
        node = F.floor(place / power).cast("int")
        before = node % FANOUT
        first = (node - before) * WIDTH + 1
        after = (FANOUT - 1 - before) * WIDTH
        return F.struct(
            F.substring(level, first, before * WIDTH).alias("left"),
            F.substring(level, (node + 1) * WIDTH + 1, after).alias("right"),
        )

    return F.transform(F.slice(levels, F.lit(1), height), segment)


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Nodes ``grp, place, total, node`` by block: the carried columns and the lowest level."""
    member = F.struct("place", "node", *carry)
    # Dealt anew by block, so that a group with most of the rows is spread.
    dealt = nodes.withColumn("block", F.expr(f"place DIV {BLOCK}")).repartition("grp", "block")
    grouped = dealt.groupBy("grp", "block").agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members")
    )
    lowest = F.array_join(F.transform("members", lambda m: m["node"]), "")
    return grouped.select("grp", "block", "total", "members", lowest.alias("lowest"))


def _top(blocks: DataFrame) -> DataFrame:
    """The root of each block, as a node of the next tier."""
    above = F.expr(f"(total + {BLOCK - 1}) DIV {BLOCK}")
    root = F.element_at(_levels(F.col("lowest"), _height(F.col("total"))), -1)
    return blocks.select("grp", F.col("block").alias("place"), above.alias("total"), root.alias("node"))


def _climb(nodes: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The root ``grp, node`` of each group, and the stored blocks of every tier."""
    tiers = []
    while True:
        tiers.append(stored(_blocks(nodes, carry if not tiers else ()), "merkle-blocks"))
        nodes = _top(tiers[-1])
        if nodes.where("total > 1").isEmpty():
            return nodes.select("grp", "node"), tiers


def _descend(tiers: list[DataFrame], above: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The members of the lowest tier, each with all its sibling segments.

    ``above`` has ``grp, upper`` and more columns of a group, which are passed on.
    A block's segments above itself are found once, with its tier's parents.
    """
    given = [name for name in above.columns if name not in ("grp", "upper")]
    upper, on = above, ["grp"]
    for tier, blocks in reversed(list(enumerate(tiers))):
        height = _height(F.col("total"))
        levelled = blocks.join(upper, on).withColumn("levels", _levels(F.col("lowest"), height))
        members = F.transform(
            "members",
            lambda m, i: F.struct(
                m.alias("m"),
                F.concat(_segments(F.col("levels"), i, _height(F.col("total"))), "upper").alias("s"),
            ),
        )
        out = levelled.select("grp", *given, F.inline(members))
        if tier == 0:
            names = [F.col(f"m.{name}").alias(name) for name in ("place", "node", *carry)]
            return out.select("grp", *given, *names, F.col("s").alias("siblings"))
        upper = out.select("grp", F.col("m.place").alias("block"), *given, F.col("s").alias("upper"))
        on = ["grp", "block"]
    raise ValueError("no tiers")


def manifest(
    rows: DataFrame, group: str, order_by: Sequence[str], leaf: str, carry: Sequence[str] = ()
) -> DataFrame:
    """``group``, ``carry``, ``leaf``, ``place``, ``siblings``, ``subroot``, ``root`` of every row.

    ``siblings`` has, from the leaf's level to the root of all, what stands left
    and right of the node in its run, as concatenated hex digests: with ``fold``
    it leads from the leaf to the root. Leaves of a group are ordered by
    ``order_by`` (nulls first), equal ones by their digest; groups by their
    UTF-8 bytes, null first. Null is a group like others. A group of one leaf
    has that leaf as its subroot; a table of one group has its subroot as its
    root. Repeated rows are leaves of their own. No rows give none. Only the
    named columns are read, so others may have any name. Runs jobs when called.
    """
    grp = F.coalesce(F.concat(F.lit("g"), column(group).cast("string")), F.lit(""))
    keys = [f"__k{i}" for i in range(len(order_by))]
    carried = [f"__c{i}" for i in range(len(carry))]
    leaves = stored(
        rows.select(
            grp.alias("grp"),
            *[column(name).alias(key) for name, key in zip(order_by, keys, strict=True)],
            column(leaf).alias("node"),
            *[column(name).alias(key) for name, key in zip(carry, carried, strict=True)],
        ),
        "merkle-leaves",
    )
    numbered = number_rows(leaves, ["grp", *keys, "node"], carry=["grp", "node", *carried])
    # Of each group, the number of its first leaf, which also orders the groups.
    sizes = numbered.groupBy("grp").agg(F.min("row_no").alias("first"), F.count("*").alias("total"))
    sized = stored(sizes, "merkle-groups")
    ordered = number_rows(sized, ["first"], index="group_no", carry=["grp"])
    nodes = numbered.join(sized, "grp").select(
        "grp", (F.col("row_no") - F.col("first")).alias("place"), "total", "node", *carried
    )
    subroots, tiers = _climb(nodes, carried)
    subroots = stored(
        subroots.join(ordered, "grp").select(
            F.lit("").alias("all"), "grp", "group_no", "node"
        ),
        "merkle-subroots",
    )
    count = subroots.count()
    top = subroots.select(
        F.col("all").alias("grp"),
        F.col("group_no").alias("place"),
        F.lit(count).cast("bigint").alias("total"),
        "node",
        F.col("grp").alias("of"),
    )
    roots, upper_tiers = _climb(top, ["of"])
    nothing = F.array().cast(_SEGMENTS)
    above = _descend(
        upper_tiers, roots.select("grp", F.col("node").alias("root"), nothing.alias("upper")), ["of"]
    )
    above = stored(
        above.select(
            F.col("of").alias("grp"),
            F.col("node").alias("subroot"),
            "root",
            F.col("siblings").alias("upper"),
        ),
        "merkle-paths",
    )
    discard(leaves, sized, subroots, *upper_tiers)
    out = _descend(tiers, above, carried)
    shown = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1))
    return out.select(
        shown.alias(group),
        *[F.col(key).alias(name) for key, name in zip(carried, carry, strict=True)],
        F.col("node").alias(leaf),
        "place",
        "siblings",
        "subroot",
        "root",
    )
