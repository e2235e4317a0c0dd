"""Prefix trie of conversations, found block by block.

Turns are dealt into blocks of ``BLOCK`` consecutive turns, and a block into one digest. Two
conversations share their first n blocks exactly if the *chains* of these digests are equal. A chain
is told by the sums, over its blocks, of two 56-bit numbers hashed from place and block: sums can be
taken over spans of a long conversation at once, and no task needs a conversation from its start.

1. Conversations are counted per (chain before, block): as many rows as there are distinct
   openings, not conversations.
2. Where a chain goes on in one block only, the turns inside it branch nowhere: each is a node with
   the block's own members.
3. Where several blocks follow a chain, and only there, the blocks' turns are compared from the left:
   equal beginnings become one node, which adds up the members of its blocks.

Totals over subtrees take no walk. A node belongs to its smallest member, so each conversation owns
one stretch of its own path, down to its end. A subtree's total is the sum of its members' stretches,
counted along the same blocks, less what the node's owner has above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import fields, numbered, sums_before
from wakeline.sources.staging import stage

#: Turns in a block.
BLOCK = 4
#: Conversation ids that are joined to one piece of text before they are hashed.
PIECE = 4096
ROOT = b"root"


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, …), role, text: turns by turn (null first), then role, then text; written once.

    A null role or text is an empty one. Rows without conv_id belong to no conversation.
    """
    known = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.monotonically_increasing_id()]
    known = stage(known.withColumn("row", order.pop()), "turns")
    return stage(numbered(known, ["conv_id"], [*order, F.col("row")], "pos").drop("turn", "row"), "ordered")


def with_openings(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, pos, role, text of all conversations, openings replaced by those of others.

    Conversation c takes its first h turns from conversation c - c % every (all, if there are
    fewer; none, if it is not there), then goes on with its own after the first h, where h is the
    unsigned crc32 of c in decimal, modulo ``most``. ``turns`` come from ``turns_in_order``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    hubs = sizes.select(F.col("conv_id").alias("hub"), F.col("n").alias("hub_turns"))
    plan = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("hub"))
    plan = stage(plan.join(hubs, "hub", "left"), "openings")
    first = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "hub")
    taken = first.join(plan.select("conv_id", "h", "hub"), "hub").where("pos < h")
    shift = F.least("h", F.coalesce("hub_turns", F.lit(0))) - F.col("h")
    own = turns.join(plan.select("conv_id", "h", shift.alias("shift")), "conv_id").where("pos >= h")
    return taken.select("conv_id", "pos", "role", "text").unionByName(
        own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "role", "text")
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _chain_number(hashed: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(hashed, at, 7)), 16, 10).cast("decimal(38,0)")


def _chain(k: Column, a: Column, b: Column) -> Column:
    """Name of the chain of the first k blocks; the empty chain is the root."""
    sums = F.concat_ws(":", k.cast("string"), a.cast("string"), b.cast("string"))
    return F.when(k == 0, F.lit(ROOT)).otherwise(_digest(sums))


def blocks_of(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: conv_id, k, chain (of the blocks before), ids (a node per turn), sizes (bytes)."""
    told = turns.select(
        "conv_id",
        "pos",
        _digest(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("d"),
        F.octet_length("text").cast("long").alias("size"),
    )
    rows = told.groupBy("conv_id", F.expr(f"pos div {size}").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "d", "size"))).alias("t")
    )
    rows = rows.select("conv_id", "k", F.col("t.d").alias("d"), F.col("t.size").alias("sizes"))
    block = _digest(F.concat(F.concat(F.col("k").cast("string"), F.lit(":")).cast("binary"), _joined(F.col("d"))))
    rows = rows.withColumn("block", block).withColumns(
        {"a": _chain_number(F.col("block"), 1), "b": _chain_number(F.col("block"), 8)}
    )
    rows = sums_before(rows, "conv_id", "k", {"a0": "a", "b0": "b"})
    k, a0, b0 = F.col("k"), F.col("a0").cast("decimal(38,0)"), F.col("b0").cast("decimal(38,0)")
    after = _chain(k + 1, (a0 + F.col("a")).cast("decimal(38,0)"), (b0 + F.col("b")).cast("decimal(38,0)"))
    rows = rows.withColumns({"chain": _chain(k, a0, b0), "after": after})
    inside = lambda x, i: F.when(i == size - 1, F.col("after")).otherwise(
        _digest(F.concat("chain", _joined(F.slice("d", 1, i + 1))))
    )
    return stage(rows.select("conv_id", "k", "chain", F.transform("d", inside).alias("ids"), "sizes"), "blocks")


def _turns_of(blocks: DataFrame, size: int, *columns: str) -> DataFrame:
    """One row per turn of each block: id, parent, depth, n_bytes and ``columns``."""
    rows = blocks.select("k", "chain", "ids", *columns, F.posexplode(F.arrays_zip("ids", "sizes")).alias("i", "x"))
    return rows.select(
        F.col("x.ids").alias("id"),
        F.when(F.col("i") == 0, F.col("chain")).otherwise(F.get("ids", F.col("i") - 1)).alias("parent"),
        (F.col("k") * size + F.col("i") + 1).alias("depth"),
        F.col("x.sizes").alias("n_bytes"),
        *columns,
    )


def _nodes(blocks: DataFrame, size: int) -> DataFrame:
    """id, parent, depth, n_bytes, n_convs and least (smallest member) of every node but the root."""
    distinct = blocks.groupBy("k", "chain", "ids", "sizes").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("least")
    )
    distinct = stage(distinct, "openings")
    followers = distinct.groupBy("chain").agg(F.count("*").alias("n_next"))
    split = distinct.join(followers, "chain")
    alone = _turns_of(split.where("n_next = 1"), size, "n_convs", "least")
    branching = _turns_of(split.where("n_next > 1"), size, "n_convs", "least")
    refined = branching.groupBy("id", "parent", "depth", "n_bytes").agg(
        F.sum("n_convs").alias("n_convs"), F.min("least").alias("least")
    )
    return alone.unionByName(refined)


def _subtree_sums(blocks: DataFrame, size: int, stretches: DataFrame) -> DataFrame:
    """id, leaves and saved: sums over members' stretches, per node but the root."""
    held = blocks.join(stretches, "conv_id").groupBy("k", "chain", "ids", "sizes").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    return _turns_of(held, size, "leaves", "saved").groupBy("id").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )


def hash_lists(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """id and ends_sha256: hex SHA-256 of each id's conv_ids, ascending, in decimal, comma-joined.

    Ids are sorted over ranges and joined to pieces of ``piece`` ids, in many tasks for one list;
    then a task reads the pieces of a list in order, one at a time.
    """
    schema = fields(ends, "first long, text string", "id")
    arrow = to_arrow_schema(schema)
    sorted_ends = stage(ends, "ends").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held = None, None, []
        for batch in batches:
            out = []
            for i, conv in zip(batch["id"].to_pylist(), batch["conv_id"].to_pylist()):
                if i != node or len(held) == piece:
                    if held:
                        out.append((node, first, ",".join(held)))
                    node, first, held = i, conv, []
                held.append(str(conv))
            yield pieces_of(out)
        if held:
            yield pieces_of([(node, first, ",".join(held))])

    def pieces_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows) if rows else ((), (), ()), arrow.types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=arrow)

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, ids, hashes = None, None, [], []
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if i != node:
                    if state:
                        ids.append(node)
                        hashes.append(state.hexdigest())
                    node, state = i, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, arrow.types[0]), "ends_sha256": pa.array(hashes, pa.string())})
            ids, hashes = [], []
        if state:
            yield pa.RecordBatch.from_pydict({"id": [node], "ends_sha256": [state.hexdigest()]})

    pieces = sorted_ends.mapInArrow(join_pieces, schema)
    pieces = pieces.repartition("id").sortWithinPartitions("id", "first")
    return pieces.mapInArrow(hash_pieces, fields(ends, "ends_sha256 string", "id"))


def trie(turns: DataFrame, conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (0, 1, … without a gap), role, text, no nulls; ``conversations``: every
    conv_id once, also those without turns, which are members of the root only. A node is a distinct
    sequence of first turns; conv_id is its smallest member. No conversation, no node. Repeated
    conversations are members of the same nodes. Further columns do not matter.
    """
    blocks = blocks_of(turns, size)
    convs = stage(conversations.select("conv_id"), "convs")
    nodes = _nodes(blocks, size)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least")).where("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("id"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("n_bytes"),
        "n_convs",
        "least",
    )
    nodes = stage(nodes.unionByName(root).withColumn("value", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, "id", "left").fillna({"n_children": 0}), "nodes")
    # a conversation's stretch: what it owns, and whether its end is childless
    stretches = nodes.groupBy(F.col("least").alias("conv_id")).agg(
        F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("value").alias("saved")
    )
    stretches = stage(stretches, "stretches")
    total = stretches.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(F.lit(ROOT).alias("id"), "leaves", "saved")
    sums = _subtree_sums(blocks, size, stretches).unionByName(total)

    end = F.max(F.struct("k", F.element_at("ids", -1).alias("id")))["id"]
    ends = blocks.groupBy("conv_id").agg(end.alias("id"))
    ends = convs.join(ends, "conv_id", "left").select(F.coalesce("id", F.lit(ROOT)).alias("id"), "conv_id")
    lists = hash_lists(ends)

    above = sums_before(nodes, "least", "depth", {"above": "value"})
    parents = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        above.join(sums, "id")
        .join(lists, "id", "left")
        .join(parents, "parent", "left")
        .select(
            F.col("least").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )


def shared_openings(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) rebuilt by ``with_openings``."""
    turns = turns_in_order(conversations)
    return trie(stage(with_openings(turns), "rebuilt"), turns.select("conv_id").distinct())
