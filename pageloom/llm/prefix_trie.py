"""Prefix trie of conversations: range shards of sorted paths and a broadcast skeleton of their splitters."""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import materialize

#: Bytes of one turn in a path: 16 of the SHA-256 of (role, text), 4 of the number of code points of the text.
TURN_BYTES = 20
#: Ids that differ only in so many low bits are joined to one string before they meet in a shard.
ID_BITS = 8
#: Bytes of paths that a shard aims at.
SHARD_BYTES = 1 << 24
#: Skeleton nodes that may be broadcast and brought to the driver; with more, neighbouring shards are joined.
SKELETON_NODES = 1 << 18

_NO_ENDS = hashlib.sha256().hexdigest()
_SCHEMA = ("skeleton int, parent_skeleton int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
           "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, turn binary")


def turn_key(role: Column, text: Column) -> Column:
    """What stands for a turn in a path (hex): equal for equal (role, text); null counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(both, 256), 1, 32), F.lpad(F.lower(F.hex(F.char_length(text))), 8, "0"))


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) per conversation: its turns by ``turn`` (null first), as one binary of ``TURN_BYTES`` each.

    Rows of one turn number are taken in the order of their key. Texts are not shuffled, only keys are; the keys of
    one conversation are one cell. Rows without conv_id belong to no conversation.
    """
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"),
                 turn_key(F.col("role"), F.col("text")).alias("key")).alias("at"))
    ordered = F.array_sort(F.collect_list("at"))
    return turns.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"))


def rebuilt_paths(paths: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path): the first h turns of conversation c - c % every, then c's own turns after its first h.

    h is crc32 of the decimal id modulo ``most``. A conversation has ``every`` others at its head at most.
    """
    heads = paths.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, TURN_BYTES * (most - 1)).alias("head"))
    own = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int") * TURN_BYTES)
    head = F.expr("substring(coalesce(head, X''), 1, h)")
    return own.join(heads, "base", "left").select(
        "conv_id", F.concat(head, F.expr("substring(path, h + 1)")).alias("path"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that both paths begin with."""
    low, high = 0, min(len(a), len(b)) // TURN_BYTES
    if a[: high * TURN_BYTES] == b[: high * TURN_BYTES]:
        return high
    while low < high:  # the first ``low`` agree, the first ``high`` do not
        middle = (low + high + 1) // 2
        if a[low * TURN_BYTES: middle * TURN_BYTES] == b[low * TURN_BYTES: middle * TURN_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


def splitter_skeleton(bounds: DataFrame, step: int) -> dict[tuple[int, bytes], int]:
    """Trie of the prefixes that paths on both sides of a splitter share: (parent, turn) -> number, the root being 0.

    ``bounds`` has (shard, low, high) per shard; ``step`` neighbouring shards count as one. A node can have members in
    several shards only if it lies on such a prefix. Rows come one by one, so the driver holds the trie alone.
    """
    nodes, group, before = {}, None, b""
    for row in bounds.orderBy("shard").toLocalIterator():
        if group is not None and row["shard"] // step != group:
            at = 0
            low = bytes(row["low"])
            for k in range(_common(before, low)):
                at = nodes.setdefault((at, low[k * TURN_BYTES: (k + 1) * TURN_BYTES]), len(nodes) + 1)
            if len(nodes) > SKELETON_NODES:
                break
        group, before = row["shard"] // step, bytes(row["high"])
    return nodes


class _Shard:
    """Nodes of one shard in preorder, taken from its paths in order; the stack is the current path."""

    def __init__(self, skeleton: dict[tuple[int, bytes], int]):
        self.skeleton, self.turns, self.ends = skeleton, [b""], {}
        self.n, self.low, self.depth, self.parent, self.number = (array("q", [v]) for v in (0, 2**63 - 1, 0, -1, 0))
        self.path, self.stack, self.digest = None, [0], None

    def add(self, path: bytes, n: int, low: int, ids: str) -> None:
        if path != self.path:
            self.close()
            keep = _common(self.path or b"", path)
            del self.stack[keep + 1:]
            for k in range(keep, len(path) // TURN_BYTES):
                turn, top = path[k * TURN_BYTES: (k + 1) * TURN_BYTES], self.stack[-1]
                above = self.number[top]
                self.stack.append(len(self.n))
                self.turns.append(turn)
                self.n.append(0)
                self.low.append(2**63 - 1)
                self.depth.append(k + 1)
                self.parent.append(top)
                self.number.append(self.skeleton.get((above, turn), -1) if above >= 0 else -1)
            self.path, self.digest = path, hashlib.sha256(ids.encode())
        else:
            self.digest.update(b"," + ids.encode())
        top = self.stack[-1]
        self.n[top] += n
        self.low[top] = min(self.low[top], low)

    def close(self) -> None:
        if self.digest is not None:
            self.ends[self.stack[-1]] = self.digest.hexdigest()

    def rows(self, size: int = 20_000):
        """Finished nodes, and what this shard adds to those of the skeleton (own part, without skeleton children)."""
        self.close()
        count, n, low, parent, number = len(self.n), self.n, self.low, self.parent, self.number
        children, leaves, saved = (array("q", bytes(8 * count)) for _ in range(3))
        for i in range(count - 1, 0, -1):
            above = parent[i]
            n[above] += n[i]
            low[above] = min(low[above], low[i])
            if number[i] < 0:
                leaves[i] += not children[i]
                saved[i] += (n[i] - 1) * int.from_bytes(self.turns[i][16:], "big")
                children[above] += 1
                leaves[above] += leaves[i]
                saved[above] += saved[i]
        for start in range(0, count, size):
            part = range(start, min(count, start + size))
            above = [parent[i] for i in part]
            over = [number[p] if p >= 0 else -1 for p in above]
            yield {
                "skeleton": [number[i] for i in part], "parent_skeleton": over,
                "conv_id": low[part.start: part.stop], "depth": self.depth[part.start: part.stop],
                "parent_conv_id": [None if p < 0 or o >= 0 else low[p] for p, o in zip(above, over)],
                "n_convs": n[part.start: part.stop], "n_children": children[part.start: part.stop],
                "n_leaves": leaves[part.start: part.stop], "saved_tokens": saved[part.start: part.stop],
                "ends_sha256": [self.ends.get(i) for i in part], "turn": self.turns[part.start: part.stop],
            }


def _shard_nodes(shards: DataFrame, skeleton: dict[tuple[int, bytes], int]) -> DataFrame:
    """Nodes of every shard; its rows come by (shard, path, block), so only the nodes of one shard are held."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_SCHEMA))
    sent = shards.sparkSession.sparkContext.broadcast(skeleton)

    def run(batches):
        state, now = None, None
        for batch in batches:
            names = ("shard", "path", "n", "low", "ids")
            for shard, *row in zip(*[batch.column(c).to_pylist() for c in names]):
                if shard != now:
                    if state is not None:
                        for part in state.rows():
                            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in target], schema=target)
                    state, now = _Shard(sent.value), shard
                state.add(*row)
        if state is not None:
            for part in state.rows():
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in target], schema=target)

    return shards.mapInArrow(run, _SCHEMA)


def _reduced(partial: DataFrame, skeleton: dict[tuple[int, bytes], int]) -> pa.Table:
    """Skeleton nodes with the parts of all shards added up, then rolled up towards the root (``SKELETON_NODES`` at most)."""
    sums = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends")
    ).toArrow().to_pydict()
    number, rows = sums.pop("skeleton"), {}
    for i, k in enumerate(number):
        rows[k] = {name: values[i] for name, values in sums.items()}
    parents = {k: (above, turn) for (above, turn), k in skeleton.items()}
    depth = {0: 0}
    for k in range(1, len(skeleton) + 1):  # parents come first
        depth[k] = depth[parents[k][0]] + 1
    for k in range(len(skeleton), 0, -1):
        above, turn = parents[k]
        rows[k]["leaves"] += not rows[k]["children"]
        rows[k]["saved"] += (rows[k]["n"] - 1) * int.from_bytes(turn[16:], "big")
        rows[above]["children"] += 1
        rows[above]["leaves"] += rows[k]["leaves"]
        rows[above]["saved"] += rows[k]["saved"]
    if 0 in rows:
        rows[0]["leaves"] += not rows[0]["children"]
    order = sorted(rows)
    return pa.table({
        "skeleton": pa.array(order, pa.int32()),
        "conv_id": pa.array([rows[k]["conv_id"] for k in order], pa.int64()),
        "depth": pa.array([depth[k] for k in order], pa.int64()),
        "parent_conv_id": pa.array([rows[parents[k][0]]["conv_id"] if k else None for k in order], pa.int64()),
        "n_convs": pa.array([rows[k]["n"] for k in order], pa.int64()),
        "n_children": pa.array([rows[k]["children"] for k in order], pa.int64()),
        "n_leaves": pa.array([rows[k]["leaves"] for k in order], pa.int64()),
        "saved_tokens": pa.array([rows[k]["saved"] for k in order], pa.int64()),
        "ends_sha256": pa.array([rows[k]["ends"] for k in order], pa.string()),
        "turn": pa.array([parents[k][1] if k else b"" for k in order], pa.binary()),
    })


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path), from the root without a turn down.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: members beyond the first times the code points of the node's turn), ends_sha256
    (of the ids of paths that end here, ascending, joined by commas) and turn (the key of the last turn; empty at the root).

    Equal paths meet as strings of up to 2**``ID_BITS`` ids, so copies are merged before the paths are sorted. Paths are
    dealt to ranges; what the paths on both sides of a splitter share is the skeleton, which every task has. A shard goes
    through its sorted paths once and finishes every node outside the skeleton; its parts of the others are added up and
    rolled up along the skeleton. A shard's task holds its nodes (about ``SHARD_BYTES`` of paths), one path and no text. A path without turns is a
    member of the root. No path gives no node. The hash over the ids of one node is worked out in one stream,
    as SHA-256 has no other way.
    """
    spark = paths.sparkSession
    block = F.shiftright("conv_id", ID_BITS).alias("block")
    blocks = materialize(paths.groupBy("path", block).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"),
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")))
    if shards is None:
        size = blocks.agg(F.sum(F.octet_length("path") + F.octet_length("ids"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    ranged = materialize(blocks.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()))
    bounds = materialize(ranged.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")))
    step, skeleton = 1, splitter_skeleton(bounds, 1)
    while len(skeleton) > SKELETON_NODES:
        step *= 2
        skeleton = splitter_skeleton(bounds, step)
    parts = -(-shards // step)
    dealt = ranged.withColumn("shard", F.floor(F.col("shard") / step).cast("int")).repartitionById(
        parts, F.col("shard")).sortWithinPartitions("shard", "path", "block")
    nodes = materialize(_shard_nodes(dealt, skeleton))
    top = spark.createDataFrame(_reduced(nodes.filter("skeleton >= 0"), skeleton)).select(
        "skeleton", *[c.strip().split(" ")[0] for c in _SCHEMA.split(",")[2:]])
    above = F.broadcast(top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("top_conv_id")))
    below = nodes.filter("skeleton < 0").join(above, "parent_skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id"))
    both = below.select(*top.columns[1:]).union(top.drop("skeleton"))
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))).withColumn(
        "turn", F.lower(F.hex("turn")))


def with_turns(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """``trie`` with the role and text of every node's turn (null at the root), from the table it was made of."""
    turns = conversations.select(
        turn_key(F.col("role"), F.col("text")).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["turn"])
    return trie.join(turns, "turn", "left")


def conversation_trie(conversations: DataFrame, every: int = 100, most: int = 6, shards: int | None = None) -> DataFrame:
    """:func:`prefix_trie` of the rebuilt ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    Null role or text counts as empty; repeated rows are turns of their own; rows without conv_id are left out, as they belong to no conversation.
    """
    return prefix_trie(rebuilt_paths(materialize(turn_paths(conversations)), every, most), shards)
