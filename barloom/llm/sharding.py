"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends region, rack and shard. At each level every child draws -ln(u)/weight, u a hash of
(doc_id, child's path) in (0, 1), and the smallest draw wins (weighted rendezvous). Draws of one child
don't depend on the others, so a changed weight moves rows into or out of that child's subtree only.
Growth appends a region to the tree in use (``extended``): rows move only into the new shard. This keeps the ``key`` law.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Rows of a slot bucket: slots are numbered within buckets of about this size, never in a whole shard.
ROWS_PER_BUCKET = 50_000
#: Shards of the first tree with racks. Copies of a row that one row stands for when slots are made.
FIRST, COPIES = 16, 10_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. The path names its draws; a leaf has a shard number."""

    path: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())


def uniform_tree(shards: int) -> Node:
    """A tree for ``shards`` shards: from 16 on, two regions of two racks of four shards, and each further shard in a region of its
    own; below, every shard is a region. So the tree for one more shard is the ``extended`` one, but for the step from 15 to 16."""
    if shards < FIRST:
        regions = [Node(f"x{s}", 1.0, None, (Node(f"x{s}/k0", 1.0, None, (Node(f"x{s}/k0/s0", 1.0, s),)),)) for s in range(shards)]
        return Node("", float(shards), None, tuple(regions))
    regions = []
    for r in range(2):
        inner = tuple(Node(f"g{r}/k{k}", 4.0, None, tuple(Node(f"g{r}/k{k}/s{s}", 1.0, (r * 2 + k) * 4 + s) for s in range(4))) for k in range(2))
        regions.append(Node(f"g{r}", 8.0, None, inner))
    tree = Node("", float(FIRST), None, tuple(regions))
    for _ in range(shards - FIRST):
        tree = extended(tree)
    return tree


def _shards(node: Node) -> int:
    return 1 if node.shard is not None else sum(_shards(c) for c in node.children)


def extended(tree: Node) -> Node:
    """``tree`` with one more shard, the next number, as a region of its own: whatever the tree and however often it was
    extended, rows move into the new shard only."""
    s = _shards(tree)
    leaf = Node(f"x{s}/k0/s0", 1.0, s)
    return Node(tree.path, tree.weight + 1.0, None, (*tree.children, Node(f"x{s}", 1.0, None, (Node(f"x{s}/k0", 1.0, None, (leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.path)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(node.weight))


def shard_of(key: Column, node: Node) -> Column:
    """The shard that a key descends to; null keys hash like any other key."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    won = F.array_min(F.array(*(F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("i")) for i, c in enumerate(live))))["i"]
    chosen = F.element_at(F.array(*(F.lit(c.shard) for c in live)), won + 1) if all(c.shard is not None for c in live) else None
    if chosen is None:
        for i, c in enumerate(live):
            here = shard_of(key, c)
            chosen = F.when(won == i, here) if chosen is None else chosen.when(won == i, here)
    return chosen


def shard(docs: DataFrame, shards: int = 16, tree: Node | None = None, grown: Node | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and the crc32 of no bytes (0). Rows that repeat a doc_id go to one shard, each
    with its own slot; a null doc_id is a key like any other. Texts, ties and other columns don't matter to
    the shard. An empty table gives an empty table. Slots ascend by (hash bucket, doc_id, size, crc). Equal rows are
    counted before they are numbered, and a bucket is drawn from id, size and crc, so neither copies nor a repeated id
    fill one task.
    """
    tree = tree or uniform_tree(shards)
    grown = grown or extended(tree)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, grown).alias("grown_shard"), F.shiftrightunsigned(F.xxhash64(F.lit("slot"), key, "size", "text_crc32"), 1).alias("spread"))
    rows = stored(rows, "shards")
    n_rows, most = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    parts = max(1, -(-n_rows // (shards * ROWS_PER_BUCKET)))
    rows = rows.withColumn("part", F.col("spread") % parts)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "part"]).withColumn("first", F.col("first") + F.col("at"))
    # Slots of many copies are made a bounded number at a time, and by all tasks.
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))
    out = out.withColumn("chunk", each).withColumn("first", F.col("first") + F.col("chunk") * COPIES).withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES))
    out = out.repartition("shard", "first") if (most or 0) > COPIES else out
    out = out.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
