"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests.

Rows are dealt to an immutable snapshot and an incoming batch (``in_snapshot``; by default half of the
ids by hash). The snapshot's distinct digests lie in buckets; each bucket gets one static filter. Each
incoming digest asks the filter of its bucket. Positives join the snapshot's exact digests; repeats
inside one side are found by grouping that side alone. Texts behind repeated digests are then compared
byte by byte (grouped by digest *and* text, partial aggregation first), so neither a filter's false
positive nor a digest collision can merge different texts.

Only digests and ids are shuffled for the screening; texts move only for digests that repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored, table, text_hash, without

#: Keys for which one filter is built; bounds the memory of a task whatever the size of the corpus.
KEYS_PER_FILTER = 50_000
FILTER_SCHEMA = "bucket long, seed long, segment int, span int, cells binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Murmur3's public 64-bit finaliser over key + seed."""
    x = keys + np.uint64(seed)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def _cells(keys: np.ndarray, seed: int, segment: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, in three neighbouring segments, and its 8-bit fingerprint."""
    h = _mixed(keys, seed)
    first = (((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)).astype(np.int64)
    mask = segment - 1
    second = (first + segment) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
    third = (first + 2 * segment) ^ (h.astype(np.int64) & mask)
    return np.stack([first, second, third]), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter (3 cells a key, 8-bit fingerprints) for distinct uint64 keys: seed, segment, span, cells.

    Cells with one key left are peeled round by round, all cells of a round at once; the values are then
    set in reverse order. If peeling gets stuck, the next seed is taken.
    """
    keys = np.unique(keys)
    n = max(2, len(keys))
    segment = 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(room / segment) - 2)
    span, size = segments * segment, (segments + 2) * segment
    for seed in range(1, 1000):
        at, mark = _cells(keys, seed, segment, span)
        count = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        ids = np.arange(len(keys))
        for row in at:
            np.bitwise_xor.at(held, row, ids)
        ready, peeled, left = np.flatnonzero(count == 1), [], len(keys)
        while len(ready):
            chosen, where = np.unique(held[ready], return_index=True)
            peeled.append((chosen, ready[where]))
            left -= len(chosen)
            for row in at[:, chosen]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, chosen)
            touched = np.unique(at[:, chosen])
            ready = touched[count[touched] == 1]
        if left == 0:
            cells = np.zeros(size, np.uint8)
            for chosen, own in reversed(peeled):
                cells[own] = 0
                cells[own] = mark[chosen] ^ cells[at[0, chosen]] ^ cells[at[1, chosen]] ^ cells[at[2, chosen]]
            return seed, segment, span, cells.tobytes()
    raise ValueError("no seed gave a filter")


def may_contain(keys: np.ndarray, seed: int, segment: int, span: int, cells: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 256."""
    at, mark = _cells(keys.astype(np.uint64), seed, segment, span)
    got = np.frombuffer(cells, np.uint8)[at]
    return (got[0] ^ got[1] ^ got[2]) == mark


def _to_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, span, cells = build_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": seed, "segment": segment, "span": span, "cells": [cells]})


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys = incoming["key"].to_numpy(np.int64).view(np.uint64)
    hit = np.zeros(len(keys), bool)
    for f in filters.itertuples():
        hit |= may_contain(keys, f.seed, f.segment, f.span, f.cells)
    return incoming.loc[hit, ["digest"]]


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """One static filter per bucket of ``digests(bucket, key)``, kept as a table in the shared folder."""
    return stored(digests.select("bucket", "key").groupBy("bucket").applyInPandas(_to_filter, FILTER_SCHEMA), "fuse")


def exact_groups(docs: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, digest, keep_id, group_size.

    Null texts count as empty and are equal to empty texts. The row with the largest doc_id stays; a null
    id loses against any other, and if all ids of a group are null, keep_id is null. Rows that repeat one
    doc_id and text are one document: all of them have their own id as keep_id or none has. An empty table
    gives an empty table. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    old = F.pmod(F.xxhash64("doc_id", F.lit("snapshot")), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    base = docs.select("doc_id", text_hash(text).alias("th"), F.unhex(F.sha2(text, 256)).alias("digest"), old.alias("old"))
    base = stored(base, "digests")
    buckets = max(1, math.ceil(base.count() / KEYS_PER_FILTER))
    key = F.xxhash64("digest")
    counted = base.groupBy("old", "digest").agg(F.count(F.lit(1)).alias("n")).withColumns({"key": key, "bucket": F.pmod(key, F.lit(buckets))})
    counted = stored(counted, "distinct")
    snapshot, incoming = counted.where("old"), counted.where("not old")
    filters = snapshot_filters(snapshot)
    asked = incoming.select("bucket", "key", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket"))
    positive = asked.applyInPandas(_screen, "digest binary")
    across = positive.join(snapshot.select("digest"), "digest", "left_semi")
    repeated = stored(across.union(counted.where("n > 1").select("digest")).distinct(), "repeated")
    texts = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).join(sized(repeated), "digest", "left_semi")
    groups = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep"))
    groups = stored(groups.select("digest", text_hash(F.col("text")).alias("th"), "size", "keep"), "groups")
    out = base.join(sized(groups), ["digest", "th"], "left")
    return out.select(
        "doc_id", "th", "digest",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, all columns kept: that with the largest doc_id; a row with a null id stays only if
    no row of its text has an id. Of rows that repeat one doc_id and text any one stays."""
    groups = stored(exact_groups(docs), "exact")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    left = without(docs, groups.where(~stays))
    again = groups.where(stays & (F.col("group_size") > 1)).groupBy("doc_id", "th").count().where("count > 1")
    again = stored(again.select("doc_id", "th"), "again")
    if not again.take(1):
        return left
    th = "__th"
    marked = left.withColumn(th, text_hash(F.col("text")))
    both = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col(f"a.{th}") == F.col("b.th")]
    repeats = marked.alias("a").join(sized(again).alias("b"), both, "left_semi").dropDuplicates(["doc_id", th])
    return without(left, again).unionByName(repeats.drop(th))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
