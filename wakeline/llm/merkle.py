"""Merkle manifest of a dataset, one tree per key, checked by a recursive query that climbs it.

``build`` writes the tree level by level. A node row knows its children (their digests in
order, at most ``FANOUT``) and its parent: the node (tree, level, pos) that it is child number
``slot`` of. The roots of the keys' trees are the leaves of one more tree, number -1.

``climb`` is one recursive query. The leaves of one parent share the whole path above it, so a
row of the climb carries them together: their recomputed hashes, folded with the siblings of
each node passed, and these siblings once for all of them. A lone hot key is just a deeper
tree: no task holds more of it than a range of leaves or the children of one node. High in the tree all rows of the climb meet few nodes: these are the hot
partitions of an equi join against one small row, which adaptive skew handling splits.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import numbered
from wakeline.operators.skew import key_struct
from wakeline.sources.staging import stage

FANOUT = 8
#: Bytes of a digest; nodes hold digests as bytes and hash them as hex text.
WIDTH = 32
#: Number of the tree over the keys' roots.
TOP = -1
_LINK = ("parent_tree", "parent_level", "parent_pos", "slot")
#: Spark's setting for the rows that a recursive query may make; -1 is no limit.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass(frozen=True)
class Manifest:
    """``runs``: leaves of one parent with that parent's link; ``nodes``: all inner nodes;
    ``keys``: tree, key, number of leaves and subroot; ``root``: hex digest, null for no rows."""

    runs: DataFrame
    nodes: DataFrame
    keys: DataFrame
    root: str | None


def hex_of(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def hash_bytes(digests: Column | str) -> Column:
    """Digest of one or more digests that stand one after the other."""
    return F.unhex(F.sha2(hex_of(digests), 256))


def leaf_hash(*columns: Column | str) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and its text, or a dash for null."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _joined(digests: str) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _link(tree: Column, level: int, pos: str) -> list[Column]:
    """Where the node is a child: parent's tree, level and pos, and the place among its children."""
    return [tree, F.lit(level), _parent(pos), (F.col(pos) % FANOUT).cast("int")]


def _parent(pos: str) -> Column:
    return F.expr(f"{pos} div {FANOUT}")


def _inner(below: DataFrame, level: int, sizes: DataFrame, top_tree: bool) -> DataFrame:
    """Nodes of ``level`` from the (tree, pos, digest) of the level below.

    ``sizes`` has tree and n, the nodes on this level; a level of one node is the tree's root,
    whose parent is in the top tree, or nothing.
    """
    made = below.groupBy("tree", _parent("pos").alias("pos")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("c")
    )
    made = made.select("tree", F.lit(level).alias("level"), "pos", _joined("c").alias("children"))
    made = made.withColumn("digest", hash_bytes("children")).join(sizes, "tree")
    return made.select("tree", "level", "pos", "digest", "children", *_linked(level, top_tree))


def _linked(level: int, top_tree: bool) -> list[Column]:
    """The link of a node: inside its tree, or from a tree's root (n = 1) into the top tree."""
    inside = _link(F.col("tree"), level + 1, "pos")
    above = _link(F.lit(TOP).cast("long"), 1, "tree")
    is_root, nothing = F.col("n") == 1, F.lit(top_tree) | (F.col("trees") == 1)
    return [
        F.when(is_root & nothing, None).when(is_root, a).otherwise(i).alias(name)
        for name, a, i in zip(_LINK, above, inside)
    ]


def _levels(leaves: DataFrame, sizes: DataFrame, top_tree: bool) -> list[DataFrame]:
    """Written inner levels over (tree, pos, digest); ``sizes``: tree, n leaves, trees."""
    levels, below, level = [], leaves, 0
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        # trees whose level below has one node are complete
        sizes = sizes.where("n > 1").withColumn("n", F.ceil(F.col("n") / FANOUT))
        below, level, most = below.join(sizes.select("tree"), "tree", "left_semi"), level + 1, -(-most // FANOUT)
        below = stage(_inner(below, level, sizes, top_tree), "level")
        levels.append(below)
    return levels


def build(docs: DataFrame, key: str, order: str, leaf: Column, *carry: Column) -> Manifest:
    """The trees of ``docs``: one per value of ``key``, its rows by ``order``, nulls first.

    Rows of equal order stand by leaf digest; ``carry`` columns stay with their leaf. Keys stand
    by their bytes, null first. A key of one row has the leaf as its root. No rows, no root.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(order).alias("order"), leaf.alias("leaf"), *carry)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    by = [F.col("order").asc_nulls_first(), F.col("leaf"), F.col("row")]
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    counted = stage(numbered(counted, [], [F.col("key").asc_nulls_first()], "tree"), "keys")
    trees = counted.count()
    sizes = counted.select("tree", "n", F.lit(trees).alias("trees"))
    trees_of = counted.select(key_struct(["key"]).alias("k"), "tree", "n", F.lit(trees).alias("trees"))
    placed = numbered(rows, ["key"], by, "pos").withColumn("j", key_struct(["key"]))
    placed = placed.join(trees_of, F.col("j") == F.col("k")).drop("j", "k", "row")
    placed = stage(placed, "placed")

    lower = _levels(placed.select("tree", "pos", F.col("leaf").alias("digest")), sizes, False)
    # children of one parent, with the parent's own link; a lone leaf stands for itself
    own = [c for c in placed.columns if c not in ("tree", "pos", "n", "trees", "key", "order")]
    runs = placed.groupBy("tree", _parent("pos").alias("run"), "n", "trees").agg(
        F.sort_array(F.collect_list(F.struct("pos", "order", *own))).alias("leaves")
    )
    lone = runs.where("n = 1").withColumn("pos", F.col("run"))
    lone = lone.select("tree", "run", "leaves", F.lit(None).cast("binary").alias("children"), *_linked(0, False))
    if lower:
        parents = lower[0].select("tree", F.col("pos").alias("run"), "children", *_LINK)
        runs = lone.unionByName(runs.where("n > 1").select("tree", "run", "leaves").join(parents, ["tree", "run"]))
    else:
        runs = lone
    runs = stage(runs, "runs")

    subroots = [placed.where("n = 1").select("tree", F.col("leaf").alias("digest"))]
    subroots += [x.where(f"parent_tree IS NULL OR parent_tree = {TOP}").select("tree", "digest") for x in lower]
    found = subroots[0]
    for more in subroots[1:]:
        found = found.unionAll(more)
    keys = stage(counted.join(found.withColumnRenamed("digest", "subroot"), "tree").select("tree", "key", "n", "subroot"), "subroots")
    over = keys.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    over = stage(over, "top")  # a written number, which joins stay equi joins on
    one = over.groupBy("tree").agg(F.count("*").alias("n")).withColumn("trees", F.lit(1))
    upper = _levels(over, one, True)
    nodes = None
    for level in [*lower, *upper]:
        nodes = level if nodes is None else nodes.unionAll(level)
    if nodes is None:
        schema = "tree long, level int, pos long, digest binary, children binary, parent_tree long, parent_level int, parent_pos long, slot int"
        nodes = docs.sparkSession.createDataFrame([], schema)
    last = (upper[-1].select("digest") if upper else keys.select(F.col("subroot").alias("digest"))).first()
    return Manifest(runs, nodes, keys, bytes(last[0]).hex() if last else None)


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)


def _around(children: str, slot: str) -> tuple[str, str]:
    """SQL for the children before and after one of them."""
    return f"substring({children}, 1, {WIDTH} * {slot})", f"substring({children}, {WIDTH} * {slot} + {WIDTH + 1})"


def _fold(children: str, slot: str, digest: str) -> str:
    left, right = _around(children, slot)
    return f"unhex(sha2(lower(hex(concat({left}, {digest}, {right}))), 256))"


_CLIMB = f"""
    WITH RECURSIVE climb (tree, run, parent_tree, parent_level, parent_pos, slot, folded, siblings) AS (
        SELECT tree, run, parent_tree, parent_level, parent_pos, slot, folded, X'' FROM {{runs}}
        UNION ALL
        SELECT c.tree, c.run, n.parent_tree, n.parent_level, n.parent_pos, n.slot,
            transform(c.folded, f -> {_fold("n.children", "c.slot", "f")}),
            concat(c.siblings, {", ".join(_around("n.children", "c.slot"))})
        FROM climb c JOIN {{nodes}} n
            ON n.tree = c.parent_tree AND n.level = c.parent_level AND n.pos = c.parent_pos
    )
    SELECT tree, run, folded, siblings FROM climb WHERE parent_tree IS NULL
"""


def climb(manifest: Manifest, claimed: str) -> DataFrame:
    """Every leaf with tree, order, leaf, proof_sha256, folded_root and verified.

    ``claimed`` is the carried column with the digest that the row has now; it is folded with
    the stored siblings up to a root. The proof is all siblings passed, as hex text.
    """
    now = f"x.{claimed}"
    folded = f"transform(leaves, (x, i) -> IF(children IS NULL, {now}, {_fold('children', 'i', now)}))"
    start = manifest.runs.select(
        "tree", "run", *_LINK, F.expr(folded).alias("folded")
    )
    spark = start.sparkSession
    with _any_number_of_rows(spark):
        top = stage(spark.sql(_CLIMB, runs=start, nodes=manifest.nodes), "climbed")
    rows = manifest.runs.select("tree", "run", "leaves", "children").join(top, ["tree", "run"])
    rows = rows.select("tree", "children", "folded", "siblings", F.posexplode("leaves").alias("i", "x"))
    own = F.expr(f"IF(children IS NULL, X'', concat({', '.join(_around('children', 'i'))}))")
    root = hex_of(F.get("folded", F.col("i")))
    return rows.select(
        "tree",
        F.col("x.order").alias("order"),
        F.col("x.leaf").alias("leaf"),
        F.sha2(hex_of(F.concat(own, F.col("siblings"))), 256).alias("proof_sha256"),
        root.alias("folded_root"),
        (root == F.lit(manifest.root)).alias("verified"),
    )


def prove_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    One tree per lang, its documents by doc_id; a leaf hashes doc_id, source, lang, n_chars and
    text. ``tampered`` is the text that a row has when it is checked. Nulls are told apart from
    empty texts; rows of one id stand by their digest, a null id first; repeated rows are leaves of
    their own. An empty table gives no rows. Further columns do not matter.
    """
    fields = ("doc_id", "source", "lang", "n_chars")
    claimed = leaf_hash(*fields, tampered).alias("claimed")
    manifest = build(docs, "lang", "doc_id", leaf_hash(*fields, "text"), claimed)
    done = climb(manifest, "claimed").join(manifest.keys.select("tree", "subroot"), "tree")
    return done.select(
        F.col("order").alias("doc_id"),
        hex_of("leaf").alias("leaf"),
        hex_of("subroot").alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
        F.coalesce("verified", F.lit(False)).alias("verified"),
    )
