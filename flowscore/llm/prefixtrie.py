"""The prefix trie of conversations, as balanced parentheses, one shard after the other.

Conversations are sorted by their turns' digests, so that what shares a prefix
stands together. A shard is a run of sorted rows: adjacent rows' common prefixes
give its trie as a sequence of parentheses. Blocks of their excess, with a tree
of range minima above, find where a node closes and so its subtree; ranks of the
pairs ``()`` count leaves; cumulative arrays in the nodes' order give members
and savings. All of it is exact for nodes that lie in one shard. The others are
on the shard's first or last path, its spines: these are the rows of the next
round, two for each shard, until one shard has them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm.scratch import discard, stored

# Bytes of a turn's digest.
WIDTH = 32
# Positions of a block of the excess sequence.
BLOCK = 32
# Nodes that a shard may have, unless a few rows alone have more; rows it has at least.
SHARD_NODES, SHARD_ROWS = 1 << 18, 4
# Spine paths that are merged in one shard; more take another round.
LAST_ROWS = 4096
# Bits of a shard's number below the partition's.
SHARD_BITS = 33
_NONE = np.iinfo(np.int64).max
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

SUMS = ("members", "children", "leaves", "saved")
PATH_SCHEMA = (
    "shard bigint, path binary, sizes array<bigint>, keys array<binary>, least array<bigint>, "
    + ", ".join(f"{name} array<bigint>" for name in SUMS)
)
NODE_SCHEMA = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
SCHEMA = f"kind string, ids string, {PATH_SCHEMA}, {NODE_SCHEMA}"
_TYPES = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<binary>": pa.list_(pa.binary()),
}
FIELDS = [pa.field(n, _TYPES[t]) for n, t in (f.split(" ") for f in SCHEMA.split(", "))]


def parentheses(lengths: np.ndarray, common: np.ndarray) -> np.ndarray:
    """+1 for ``(`` and -1 for ``)``: the trie of sorted sequences.

    ``common`` is what a sequence shares with the one before, 0 for the first.
    """
    opens = lengths - common
    closes = np.append(lengths[:-1] - common[1:], lengths[-1])
    runs = np.stack([opens, closes], axis=1).ravel()
    signs = np.tile(np.array([1, -1], np.int64), len(lengths))
    return np.concatenate([[1], np.repeat(signs, runs), [-1]])


class Excess:
    """Range min-max blocks over the excess of a sequence of parentheses."""

    def __init__(self, signs: np.ndarray) -> None:
        self.excess = np.cumsum(signs)
        self.size = len(signs)
        blocks = -(-self.size // BLOCK)
        self.leaves = 1 << max(blocks - 1, 0).bit_length()
        padded = np.full(self.leaves * BLOCK, _NONE, np.int64)
        padded[: self.size] = self.excess
        # A heap of minima: node 1 is the whole, the blocks are the last level.
        self.low = np.full(2 * self.leaves, _NONE, np.int64)
        self.low[self.leaves :] = padded.reshape(-1, BLOCK).min(axis=1)
        width = self.leaves
        while width > 1:
            width //= 2
            self.low[width : 2 * width] = self.low[2 * width : 4 * width].reshape(-1, 2).min(axis=1)

    def _scan(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place from ``at`` on, within its block, whose excess is less than ``below``; or -1."""
        found = np.full(len(at), -1, np.int64)
        end = np.minimum((at // BLOCK + 1) * BLOCK, self.size)
        left, place = np.arange(len(at)), at.copy()
        while len(left):
            left = left[place[left] < end[left]]
            hit = self.excess[place[left]] < below[left]
            found[left[hit]] = place[left[hit]]
            left = left[~hit]
            place[left] += 1
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at ``opens`` close."""
        below = self.excess[opens]
        found = self._scan(opens, below)
        far = np.flatnonzero(found < 0)
        node = opens[far] // BLOCK + self.leaves
        below = below[far]
        # Up, until a right sibling holds a place that is low enough.
        up = np.arange(len(far))
        while len(up):
            right = (node[up] & 1) == 0
            met = right & (self.low[np.where(right, node[up] + 1, 1)] < below[up])
            node[up[met]] += 1
            up = up[~met]
            node[up] //= 2
        # Down, to the first block that does.
        down = np.flatnonzero(node < self.leaves)
        while len(down):
            left = node[down] * 2
            node[down] = np.where(self.low[left] < below[down], left, left + 1)
            down = down[node[down] < self.leaves]
        found[far] = self._scan((node - self.leaves) * BLOCK, below)
        return found


def range_minima(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of each run of values, by doubled windows."""
    out = np.empty(len(first), np.int64)
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[first[at] + size[at] - (1 << k)])
    return out


@dataclass
class Rows:
    """Sorted paths; per turn ``digests sizes``, per node of a path the other arrays."""

    lengths: np.ndarray
    digests: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    sums: dict[str, np.ndarray]
    paths: list[bytes]
    ids: np.ndarray | None = None
    keys: list[bytes] | None = None

    @staticmethod
    def read(batch: pa.RecordBatch) -> Rows:
        paths = batch.column("path").to_pylist()
        lengths = np.array([len(p) // WIDTH for p in paths], np.int64)
        digests = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, WIDTH // 8)
        numbers = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        sizes = numbers("sizes").astype(np.int64)
        if "conv_id" not in batch.schema.names:
            sums = {name: numbers(name) for name in SUMS}
            keys = batch.column("keys").flatten().to_pylist()
            return Rows(lengths, digests, sizes, numbers("least"), sums, paths, keys=keys)
        ids = batch.column("conv_id").to_numpy()
        total = int((lengths + 1).sum())
        ends = np.cumsum(lengths + 1) - 1
        sums = {name: np.zeros(total, np.int64) for name in SUMS}
        sums["members"][ends] = 1
        least = np.full(total, _NONE, np.int64)
        least[ends] = ids
        return Rows(lengths, digests, sizes, least, sums, paths, ids=ids)

    def common(self) -> np.ndarray:
        """How many turns each row shares with the one before."""
        starts = np.cumsum(self.lengths) - self.lengths
        both = np.minimum(self.lengths[1:], self.lengths[:-1])
        row = np.repeat(np.arange(len(both)), both)
        place = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
        differ = (self.digests[starts[1:][row] + place] != self.digests[starts[:-1][row] + place]).any(axis=1)
        np.minimum.at(both, row[differ], place[differ])
        return np.concatenate([[0], both])


def _path_keys(path: bytes) -> list[bytes]:
    """A name for each node of a path: the digest of its turns' digests."""
    running = hashlib.sha256()
    out = [running.digest()]
    for at in range(0, len(path), WIDTH):
        running.update(path[at : at + WIDTH])
        out.append(running.digest())
    return out


class Shard:
    """The trie of some rows, and what of it is known for good.

    ``last``: no other shard has any of its nodes, so all of it is.
    """

    def __init__(self, rows: Rows, last: bool) -> None:
        self.rows = rows
        lengths, common = rows.lengths, rows.common()
        signs = parentheses(lengths, common)
        self.opens = np.flatnonzero(signs == 1)
        n = len(self.opens)
        excess = Excess(signs)
        closes = excess.find_close(self.opens)
        self.depth = excess.excess[self.opens] - 1
        first, size = np.arange(n), (closes - self.opens + 1) // 2

        # The node of each place of each path: the last one made at its depth.
        self.begins = np.cumsum(lengths + 1) - (lengths + 1)
        row = np.repeat(np.arange(len(lengths)), lengths + 1)
        deep = np.arange(len(row)) - np.repeat(self.begins, lengths + 1)
        new = deep > np.repeat(common, lengths + 1)
        new[0] = True
        made = np.where(new, np.cumsum(new) - 1, 0) + deep * (n + 1)
        by_depth = np.argsort(deep, kind="stable")
        self.node = np.empty(len(row), np.int64)
        self.node[by_depth] = np.maximum.accumulate(made[by_depth])
        self.node -= deep * (n + 1)
        self.maker = np.flatnonzero(new)
        self.parent = np.concatenate([[-1], self.node[self.maker[1:] - 1]])
        # A path has a node more than turns; row and depth give its last turn.
        sizes = np.concatenate([[0], rows.sizes[self.maker[1:] - row[self.maker[1:]] - 1]])

        own = {name: np.zeros(n, np.int64) for name in SUMS}
        for name, values in rows.sums.items():
            np.add.at(own[name], self.node, values)
        least = np.full(n, _NONE, np.int64)
        np.minimum.at(least, self.node, rows.least)

        self.spine = np.zeros(n, bool)
        if not last:
            self.spine[self.node[: lengths[0] + 1]] = True
            self.spine[self.node[self.begins[-1] :]] = True
        inside = np.append(0, np.cumsum(own["members"]))
        self.n_convs = inside[first + size] - inside[first]
        self.least = range_minima(least, first, size)
        below = np.bincount(self.parent[1:], minlength=n)
        self.n_children = own["children"] + below
        # Pairs () that are leaves: no child here, none that an earlier round had.
        pairs = np.zeros(len(signs), np.int64)
        pairs[self.opens] = (below == 0) & (own["children"] == 0) & ~self.spine
        rank = np.append(0, np.cumsum(pairs))
        earlier = np.append(0, np.cumsum(own["leaves"]))
        self.n_leaves = rank[closes] - rank[self.opens] + earlier[first + size] - earlier[first]
        gain = own["saved"] + np.where(self.spine, 0, (self.n_convs - 1) * sizes)
        gains = np.append(0, np.cumsum(gain))
        self.saved = gains[first + size] - gains[first]

    def ends(self) -> dict[int, bytes]:
        """The ids of the conversations that end at a node, comma-joined, by node."""
        ids = self.rows.ids
        if ids is None:
            return {}
        at = self.node[self.begins + self.rows.lengths]
        cut = np.flatnonzero(np.diff(at)) + 1
        lows, highs = [0, *cut.tolist()], [*cut.tolist(), len(at)]
        return {
            int(at[a]): b",".join(b"%d" % i for i in ids[a:b].tolist())
            for a, b in zip(lows, highs, strict=True)
        }

    def _spine_paths(self) -> list[tuple[int, slice, np.ndarray]]:
        """(row, its places, which of its nodes it speaks for) of the first and last path."""
        low, high = self.begins[-1], len(self.node)
        first = slice(0, int(self.rows.lengths[0]) + 1)
        paths = [(0, first, np.ones(first.stop, bool))]
        apart = ~np.isin(self.node[low:high], self.node[first])
        return paths + ([(len(self.begins) - 1, slice(int(low), high), apart)] if apart.any() else [])

    def output(self, shard: int) -> Iterator[pa.RecordBatch]:
        ends = self.ends()
        keys: dict[int, bytes] = {}
        if self.rows.keys is not None:
            keys = {i: self.rows.keys[m] for i, m in enumerate(self.maker.tolist())}
        paths = self._spine_paths() if self.spine.any() else []
        for row, places, _ in paths:
            keys.update(zip(self.node[places].tolist(), _path_keys(self.rows.paths[row]), strict=True))
        if paths:
            yield self._spine_rows(shard, paths, keys)
            named = [(keys[v], text) for v, text in ends.items() if self.spine[v]]
            yield _batch(
                kind=pa.array(["ends"] * len(named)),
                ids=pa.array([text.decode() for _, text in named], pa.string()),
                shard=pa.array([shard] * len(named), pa.int64()),
                key=pa.array([key for key, _ in named], pa.binary()),
            )
        done = np.flatnonzero(~self.spine)
        if not len(done):
            return
        up = self.parent[done]
        open_above = (up >= 0) & self.spine[up]
        known = self.rows.ids is not None
        hashes = [hashlib.sha256(ends.get(v, b"")).hexdigest() for v in done.tolist()] if known else None
        yield _batch(
            kind=pa.array(["node"] * len(done)),
            shard=pa.array([shard] * len(done), pa.int64()),
            key=None if known else pa.array([keys[v] for v in done.tolist()], pa.binary()),
            parent_key=pa.array(
                [keys.get(v) if v >= 0 and (o or not known) else None for v, o in zip(up.tolist(), open_above.tolist(), strict=True)],
                pa.binary(),
            ),
            conv_id=pa.array(self.least[done]),
            depth=pa.array(self.depth[done]),
            parent_conv_id=pa.array(self.least[up], mask=(up < 0) | open_above),
            n_convs=pa.array(self.n_convs[done]),
            n_children=pa.array(self.n_children[done]),
            n_leaves=pa.array(self.n_leaves[done]),
            saved_tokens=pa.array(self.saved[done]),
            ends_sha256=None if hashes is None else pa.array(hashes),
        )

    def _spine_rows(self, shard: int, paths: list, keys: dict[int, bytes]) -> pa.RecordBatch:
        """The spines as rows of the next round: what hangs off each node beside the spines."""
        spine = np.flatnonzero(self.spine)
        up = self.parent[spine]
        inner = up >= 0
        totals = {"members": self.n_convs, "leaves": self.n_leaves, "saved": self.saved}
        own = {}
        for name, total in totals.items():
            own[name] = total.copy()
            np.subtract.at(own[name], up[inner], total[spine[inner]])
        own["children"] = self.n_children - np.bincount(up[inner], minlength=len(self.spine))
        columns: dict[str, list] = {name: [] for name in ("shard", "path", "sizes", "keys", "least", *SUMS)}
        turns = np.append(0, np.cumsum(self.rows.lengths))
        for nth, (row, places, speaks) in enumerate(paths):
            nodes = self.node[places]
            columns["shard"].append(shard + nth)
            columns["path"].append(self.rows.paths[row])
            columns["sizes"].append(self.rows.sizes[turns[row] : turns[row + 1]].tolist())
            columns["keys"].append([keys[v] for v in nodes.tolist()])
            columns["least"].append(np.where(speaks, self.least[nodes], _NONE).tolist())
            for name in SUMS:
                columns[name].append(np.where(speaks, own[name][nodes], 0).tolist())
        types = {field.name: field.type for field in FIELDS}
        arrays = {name: pa.array(values, types[name]) for name, values in columns.items()}
        return _batch(kind=pa.array(["spine"] * len(paths)), **arrays)


def _batch(**columns: pa.Array | None) -> pa.RecordBatch:
    n = len(columns["kind"])
    given = {name: values for name, values in columns.items() if values is not None}
    arrays = [given.get(f.name, None) for f in FIELDS]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, f.type) if a is None else a for f, a in zip(FIELDS, arrays, strict=True)],
        schema=pa.schema(FIELDS),
    )


def _cuts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows for a shard each."""
    nodes = np.cumsum(pc.binary_length(batch.column("path")).to_numpy(zero_copy_only=False) // WIDTH + 1)
    low = 0
    while low < batch.num_rows:
        before = nodes[low - 1] if low else 0
        high = int(np.searchsorted(nodes, before + SHARD_NODES, "right"))
        high = min(max(high, low + SHARD_ROWS), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def _shards(paths: DataFrame, last: bool = False) -> DataFrame:
    """One round: the tries of the shards of sorted paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if last:
            every = [batch for batch in batches if batch.num_rows]
            if every:
                rows = pa.Table.from_batches(every).combine_chunks().to_batches()[0]
                yield from Shard(Rows.read(rows), last=True).output(0)
            return
        number = TaskContext.get().partitionId() << SHARD_BITS
        for batch in batches:
            for rows in _cuts(batch):
                yield from Shard(Rows.read(rows), last=False).output(number)
                number += 2

    return paths.mapInArrow(run, SCHEMA)


def _joined_ends(segments: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes whose ids are spread over shards.

    A digest takes its bytes one after the other, so a key's segments pass
    through one task, as a stream: one text for each shard, none of it kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, keys, hashes = None, None, [], []
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("ids"), strict=True):
                if key.as_py() != now:
                    if now is not None:
                        keys.append(now)
                        hashes.append(running.hexdigest())
                    now, running = key.as_py(), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(text.as_buffer())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes)], names=["key", "ends"])
                keys, hashes = [], []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends"])

    ordered = segments.select("key", "shard", "ids").repartition("key").sortWithinPartitions("key", "shard")
    return ordered.mapInArrow(run, "key binary, ends string")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as digest and size.

    By turn, null first; turns of equal number by their digest. Null role or
    text is empty. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            "turn", F.sha2(told, 256).alias("key"), F.octet_length(text).cast("bigint").alias("size")
        ).alias("t"),
    )
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"], t["size"]))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row for every distinct prefix of the sequences ``conv_id, turns`` (of ``key, size``).

    ``key`` is a digest of 64 hex characters, ``size`` what a turn costs. Columns
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``. Null or no turns are the empty
    sequence, a member of the root only; no sequences give no rows. Equal
    sequences share all their nodes; conv_ids must not be null and be distinct.
    A sequence is read whole by one task, as 40 bytes a turn. Runs jobs when
    called, one or two rounds more for every ten thousandfold number of rows.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<key:string,size:bigint>>"))
    paths = sequences.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.unhex(F.array_join(F.transform(turns, lambda t: t["key"]), "")).alias("path"),
        F.transform(turns, lambda t: t["size"]).alias("sizes"),
    )
    base = stored(paths, "trie-paths")
    ordered = base.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [stored(_shards(ordered), "trie-shards")]
    columns = [field.split(" ")[0] for field in PATH_SCHEMA.split(", ")]
    while True:
        spines = rounds[-1].where("kind = 'spine'").select(*columns)
        last = spines.count() <= LAST_ROWS
        if last:
            again = spines.coalesce(1).sortWithinPartitions("shard")
        else:
            again = spines.repartitionByRange("shard").sortWithinPartitions("shard")
        rounds.append(stored(_shards(again, last), "trie-spines"))
        if last:
            break
    names = [field.split(" ")[0] for field in NODE_SCHEMA.split(", ")]
    merged = rounds[1].where("kind = 'node'").select(*names)
    for later in rounds[2:]:
        merged = merged.unionByName(later.where("kind = 'node'").select(*names))
    ends = _joined_ends(rounds[0].where("kind = 'ends'"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    spine_nodes = stored(
        merged.join(ends, "key", "left")
        .join(parents, "parent_key", "left")
        .withColumns(
            {
                "parent_conv_id": F.col("above"),
                "ends_sha256": F.coalesce("ends", F.lit(EMPTY_SHA256)),
            }
        ),
        "trie-merged",
    )
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = rounds[0].where("kind = 'node'")
    # Parents that a shard does not know: by shard, so that the root is no hot key.
    on_spine = rounds[0].where("kind = 'spine'").select(
        F.shiftright("shard", 1).alias("pair"), F.explode("keys").alias("parent_key")
    )
    final = spine_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    found = stored(on_spine.distinct().join(final, "parent_key"), "trie-parents")
    hanging = (
        inner.where("parent_key IS NOT NULL")
        .withColumn("pair", F.shiftright("shard", 1))
        .join(found, ["pair", "parent_key"])
        .withColumn("parent_conv_id", F.col("above"))
    )
    discard(base, *rounds[1:])
    return (
        spine_nodes.select(*out)
        .unionByName(inner.where("parent_key IS NULL").select(*out))
        .unionByName(hanging.select(*out))
    )


def rebuilt(conversations: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """``conv_id, turns``: each conversation behind the first turns of its group's first one.

    Of conversation ``c`` the first ``h`` turns, ``h = crc32(c) % modulus``, are those
    of ``c - c % group``: all if it has fewer, none if it is absent.
    """
    own = stored(turn_rows(conversations), "turns")
    head = own.where(f"conv_id % {int(group)} = 0").select(
        F.col("conv_id").alias("origin"), F.slice("turns", 1, modulus - 1).alias("head")
    )
    shared = (F.crc32(F.col("conv_id").cast("string")) % modulus).cast("int")
    origin = F.col("conv_id") - F.col("conv_id") % group
    keyed = own.select("conv_id", "turns", origin.alias("origin"), shared.alias("h"))
    nothing = F.array().cast("array<struct<key:string,size:bigint>>")
    joined = keyed.join(head, "origin", "left")
    return joined.select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0))),
        ).alias("turns"),
    )
