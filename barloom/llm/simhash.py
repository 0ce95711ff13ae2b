"""SimHash near-dedup: fingerprints of word shingles linked by a binary trie self-join.

Distinct fingerprints are cut into four blocks of 16 bits. Two fingerprints that differ in at most two
bits agree on at least two blocks, so each of the six orders that put two blocks first yields one trie
whose first 32 levels have no error budget left to spend: those levels are a shuffle key. Below a key the
trie is joined with itself: pairs of nodes go down together, a pair that takes different branches gains
one differing bit and is pruned above the budget, and all pairs of a level move in one vectorised step.
A key's links leave as a spanning star per group, so a dense group of n texts sends n rows, not n².
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored, table, text_hash, without
from .components import components, stars
from .jaccard import similar

SEED, BUDGET = 42, 2
#: Distinct fingerprints under one 32-bit key above which that key is dealt out by node pairs 8 levels deeper.
HOT_KEY = 50_000
_SPLIT_BITS = 8
#: The orders of the 16-bit blocks (0 is the highest) that put each two of them first.
ORDERS = ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2), (1, 2, 0, 3), (1, 3, 0, 2), (2, 3, 0, 1))


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the shingles' XXH64; bytes.lower and bytes.split touch A-Z and x20, x09-x0D only."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n, digest = len(tokens) - words + 1, xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = h[i : i + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, th (text_hash) and fp, the 64 bits as a signed long; a null text has no words: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")), F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def trie_links(values: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose values differ in at most BUDGET bits.

    left and right are the first and last+1 positions of trie nodes that go down together; within each node
    ``values`` ascend. Equal left and right mean a node with itself. Values within a node are distinct.
    """
    (a0, a1), (b0, b1) = left, right
    err = np.zeros(len(a0), np.int64)
    out_a, out_b = [], []
    for bit in range(bits - 1, -2, -1):
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[single], b0[single]
        near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= BUDGET)
        out_a.append(x[near])
        out_b.append(y[near])
        a0, a1, b0, b1, err = (v[~single] for v in (a0, a1, b0, b1, err))
        if bit < 0 or not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        spend = err < BUDGET
        kids = (
            (a0, am, b0, bm, err, np.ones(len(a0), bool)), (am, a1, bm, b1, err, np.ones(len(a0), bool)),
            (a0, am, bm, b1, err + 1, spend), (am, a1, b0, bm, err + 1, spend & ~own),
        )
        a0, a1, b0, b1, err, live = (np.concatenate(x) for x in zip(*kids, strict=True))
        live &= (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        a0, a1, b0, b1, err = (v[live] for v in (a0, a1, b0, b1, err))
    return np.concatenate(out_a), np.concatenate(out_b)


def _join_groups(key: np.ndarray, split: np.ndarray, rest: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, sorted by key and rest; split is -1, or names the two deeper nodes that meet in a hot group."""
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (split[1:] != split[:-1]))))
    stop = np.concatenate((start[1:], [len(key)]))
    many = stop - start > 1
    start, stop = start[many], stop[many]
    pair = split[start]
    cut = (pair >= 0) & (pair >> _SPLIT_BITS != pair & ((1 << _SPLIT_BITS) - 1))
    high = np.concatenate(([0], np.cumsum((rest >> np.uint64(32 - _SPLIT_BITS)).astype(np.int64) == (split >> _SPLIT_BITS))))
    middle = np.where(cut, start + (high[stop] - high[start]), stop)
    a, b = trie_links(rest, (start, middle), (np.where(cut, middle, start), stop))
    label = stars(len(key), a, b)
    moved = np.flatnonzero(label != np.arange(len(key)))
    return rep[moved], rep[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, split, rest); a group that goes on in the next batch is held back."""
    held = None
    for b in batches:
        own = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) if len(held[0]) else np.zeros(0, bool)
        ready, held = [x[~last] for x in held], [x[last] for x in held]
        if len(ready[0]):
            yield _as_edges(ready)
    if held is not None and len(held[0]):
        yield _as_edges(held)


def _as_edges(cols: list[np.ndarray]) -> pa.RecordBatch:
    u, v = _join_groups(cols[0], cols[1], cols[2].astype(np.uint64), cols[3])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges (u, v) between the ``rep`` of fingerprints of ``distinct(fp, rep)`` that differ in at most two bits;
    a spanning star of each group's links, so that reachability is that of all links."""
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    tries = F.array(
        *(
            F.struct(
                (F.lit(k << 32) + block[a] * F.lit(1 << 16) + block[b]).alias("key"),
                (block[c] * F.lit(1 << 16) + block[d]).alias("rest"),
            )
            for k, (a, b, c, d) in enumerate(ORDERS)
        )
    )
    rows = distinct.where("rep IS NOT NULL").select("rep", F.explode(tries).alias("t")).select("t.key", "t.rest", "rep")
    hot = stored(rows.groupBy("key").count().where(F.col("count") > hot_key).select("key"), "hot")
    n_hot = hot.count()
    dealt = rows.withColumn("split", F.lit(-1))
    if n_hot:
        top = F.shiftright("rest", 32 - _SPLIT_BITS).cast("int")
        masks = [m for m in range(1 << _SPLIT_BITS) if m.bit_count() <= BUDGET]
        partner = F.explode(F.array(*(top.bitwiseXOR(F.lit(m)) for m in masks)))
        deeper = rows.join(sized(hot, n_hot), "key", "left_semi").withColumn("partner", partner)
        deeper = deeper.select("key", "rest", "rep", (F.least(top, "partner") * F.lit(1 << _SPLIT_BITS) + F.greatest(top, "partner")).alias("split"))
        dealt = dealt.join(sized(hot, n_hot), "key", "left_anti").unionByName(deeper)
    placed = dealt.repartition("key", "split").sortWithinPartitions("key", "split", "rest")
    return placed.select("key", "split", "rest", "rep").mapInArrow(_links, "u long, v long")


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, th, fp and component_id (the smallest doc_id reachable) for each row of ``docs``.

    Null and empty texts share fingerprint 0. Rows with a null id are given the component of their
    fingerprint; a fingerprint that only such rows have links to nothing and its component_id is null.
    Repeated rows give repeated results; an empty table gives an empty table; other columns aren't read.
    """
    prints = stored(fingerprints(docs, words), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("rep")), "distinct")
    label = components(links(distinct))
    classes = distinct.join(label, distinct["rep"] == label["node"], "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return prints.join(classes, "fp")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id; all columns are kept.

    A group hangs together by fingerprints within the budget, as in ``near_groups``, or by shingles of five words with a
    Jaccard similarity of 0.8 or more. Its nodes are text hashes, so rows with a null id take part and lose to any other.
    """
    prints = stored(fingerprints(docs), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("th").alias("rep")), "distinct")
    equal = prints.join(distinct, "fp").where("th <> rep").select(F.col("th").alias("u"), F.col("rep").alias("v"))
    label = components(links(distinct).union(equal).union(similar(docs)))
    grouped = prints.join(label, prints["th"] == label["node"], "left").select("doc_id", "th", F.coalesce("label", "th").alias("label"))
    grouped = stored(grouped, "grouped")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    keep = grouped.groupBy("label").agg(F.min(order).alias("k")).select("label", F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th"))
    gone = grouped.join(keep, "label").where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))))
    return without(docs, gone)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
