"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is a number of blocks of ``BLOCK`` words. Sources get blocks by highest quotients target/(2k+1);
each source's blocks are apportioned to its shards by highest quotients over their sizes. A shard's words
stand in a seeded order of its documents and are taken block after block, round and round, at most twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored, table, text_hash

BLOCK, SHARE, MOST_REPEATS, WEIGHTS = 32, 1.5, 2, (3, 1, 2)
#: Rows of a shard, about; a source has as many shards as that needs. Rows of a part of a shard, about: a task sorts one part.
ROWS_PER_SHARD, ROWS_PER_PART = 20_000, 2_000
#: Rows that repeat an id and a text are counted; so many of them stand together, more are drawn apart.
COPIES = 500


def sainte_lague(claims: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients claim/(2k+1); equal quotients go to the first. Claims of 0 get none."""
    claims = np.asarray(claims, float)
    won = np.zeros(len(claims), np.int64)
    if seats <= 0 or claims.sum() <= 0:
        return won
    low, high = claims.sum() / (seats + len(claims) + 1), 2 * claims.max() + 1
    for _ in range(100):  # the smallest divisor that gives no more than all seats; what is left goes by single quotients
        mid = (low + high) / 2
        if np.floor(claims / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    won = np.floor(claims / high + 0.5).astype(np.int64)
    heap = [(-c / (2 * int(w) + 1), i) for i, (c, w) in enumerate(zip(claims, won, strict=True)) if c > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        _, i = heap[0]
        won[i] += 1
        heapq.heapreplace(heap, (-claims[i] / (2 * int(won[i]) + 1), i))
    return won


def water_filled(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    target, open_ = np.zeros(len(sizes)), sizes > 0
    cap = most * sizes.astype(float)
    while open_.any():
        left = total - cap[~open_].sum()
        target[open_] = left * weights[open_] / weights[open_].sum()
        over = open_ & (target > cap)
        if not over.any():
            break
        target[over] = cap[over]
        open_ = open_ & ~over
    return target


def _plan(share: float, most: float, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["source"].tolist()
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
        pdf = pdf.iloc[order].reset_index(drop=True)
        sizes = pdf["source_size"].to_numpy(np.int64)
        weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(pdf))], float)
        target = water_filled(sizes, weights, share * sizes.sum(), most)
        blocks = sainte_lague(target, round(float(target.sum()) / block))
        return pdf.assign(target=target, blocks=blocks)[["source", "source_size", "rows", "target", "blocks"]]

    return plan


def _quotas(most: float, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        size = pdf["shard_size"].to_numpy(np.int64)
        blocks = sainte_lague(size, int(pdf["blocks"].iloc[0]))
        return pdf.assign(quota=np.minimum(blocks * block, (most * size).astype(np.int64)))[["source", "shard", "shard_size", "quota"]]

    return quotas


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, th and size: words ``[^\\x20\\x09-\\x0D]+`` of each whole text, 0 for null."""
    words = F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+", -1))
    size = F.when(F.col("text").isNull() | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) == ""), F.lit(0)).otherwise(words)
    return docs.select("doc_id", "source", text_hash(F.col("text")).alias("th"), size.cast("long").alias("size"))


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST_REPEATS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, th, source, size, source_size, target, taken for each row of ``docs``.

    Null texts have size 0 and take 0; null sources form one source, last in order. Repeated rows and null ids
    take part as rows of their own; until the end, equal rows are one row with their number, so they don't fill a shard, a
    part or a task. If all sizes are 0, all targets are 0. An empty table gives an empty
    table. Other columns aren't read. The plan is made of one row per source, the quotas of one row per shard.
    """
    words = word_counts(docs).groupBy("doc_id", "source", "th", "size").agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    words = stored(words.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("k") * COPIES)), "words")
    all_words = F.col("size") * F.col("n")
    sources = words.groupBy("source").agg(F.sum(all_words).alias("source_size"), F.sum("n").alias("rows"))
    plan = sources.withColumn("mix", F.lit(0)).groupBy("mix").applyInPandas(_plan(share, most, block), "source string, source_size long, rows long, target double, blocks long")
    plan = stored(plan, "plan").withColumnRenamed("source", "__source")
    dealt = words.join(sized(plan), words["source"].eqNullSafe(plan["__source"])).drop("__source")
    draw = F.xxhash64(F.lit(seed), "doc_id", "th", "k")
    dealt = dealt.withColumn("draw", draw).withColumn("shard", F.pmod("draw", F.ceil(F.col("rows") / ROWS_PER_SHARD)))
    shards = dealt.groupBy("source", "shard", "blocks").agg(F.sum(all_words).alias("shard_size"))
    quotas = shards.groupBy("source").applyInPandas(_quotas(most, block), "source string, shard long, shard_size long, quota long")
    quotas = stored(quotas, "quotas").withColumnsRenamed({"source": "__source", "shard": "__shard"})
    met = dealt.join(sized(quotas), dealt["source"].eqNullSafe(quotas["__source"]) & (dealt["shard"] == quotas["__shard"]))
    # A shard's order is that of the draws; parts are equal spans of the draws, and what stands before a part is a sum over parts.
    parts = -(-ROWS_PER_SHARD // ROWS_PER_PART)
    met = met.withColumn("part", F.shiftright((F.shiftrightunsigned("draw", 44) * F.lit(parts)).cast("long"), 20))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = met.groupBy("source", "shard", "part").agg(F.sum(all_words).alias("s"))
    spans = stored(spans.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.col("part").alias("__part"), F.coalesce(F.sum("s").over(up_to(Window.partitionBy("source", "shard").orderBy("part"))), F.lit(0)).alias("first")), "spans")
    inside = up_to(Window.partitionBy("source", "shard", "part").orderBy(F.shiftrightunsigned("draw", 1), "doc_id", "size", "k"))
    met = met.withColumn("inside", F.coalesce(F.sum(all_words).over(inside), F.lit(0)))
    met = met.join(sized(spans), met["source"].eqNullSafe(spans["__source"]) & (met["shard"] == spans["__shard"]) & (met["part"] == spans["__part"])).withColumn("before", F.col("first") + F.col("inside"))
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    rounds = F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - rounds * F.col("shard_size") - F.col("before")))
    return met.select("doc_id", "th", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken whole, and where a block
    ends inside a document (once a shard), its first words once more as a row of their own."""
    columns = docs.columns
    taken = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    taken = taken.groupBy("__id", "__th", "__size").agg(F.sum("__taken").alias("__taken"), F.count(F.lit(1)).alias("__n"))
    # Rows that repeat an id and a text share what they take: each has an equal part of it.
    once = docs.withColumn("__t", text_hash(F.col("text")))
    met = once.join(taken, once["doc_id"].eqNullSafe(taken["__id"]) & (once["__t"] == taken["__th"]))
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+", -1)
    each = F.expr("__taken div __n")
    rest = F.expr("(__taken div __n) % __size")
    pieces = F.concat(
        F.array_repeat(F.col("text"), (F.floor(each / F.col("__size"))).cast("int")),
        F.when(rest > 0, F.array(F.array_join(F.slice(words, 1, rest.cast("int")), " "))).otherwise(F.array().cast("array<string>")),
    )
    rows = met.withColumn("text", F.explode(pieces))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
