"""A third of all rows that repeat one row, and texts of very many candidates."""

import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, secret_scan, sharding

SCHEMA = "doc_id long, text string, source string"


def test_trees_grow_into_the_next_ones(spark):
    ids = spark.range(3000).select("id")
    steps = [n for n in range(1, 41) if n != 15]
    trees = {n: sharding.uniform_tree(n) for n in range(1, 42)}
    assert all(sharding.extended(trees[n]) == trees[n + 1] for n in steps)
    for n in (5, 16, 23):
        got = ids.select(sharding.shard_of(F.col("id"), trees[n]).alias("a"), sharding.shard_of(F.col("id"), trees[n + 1]).alias("b")).collect()
        assert all(r["a"] == r["b"] or r["b"] == n for r in got) and any(r["b"] == n for r in got)


def test_slots_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.shard(docs, 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in out) == 3000 and all(r["n"] == r["d"] == r["m"] + 1 for r in out)


@pytest.mark.parametrize("copies", [1, 40])
def test_mix_of_many_equal_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    monkeypatch.setattr(mixing, "ROWS_PER_SHARD", 400)
    hot = spark.range(1000).selectExpr("7L doc_id", "'hot words of one row' text", "'a' source")
    docs = hot.unionByName(spark.range(2000).selectExpr("id doc_id", "repeat('w ', int(1 + id % 9)) text", "if(id % 2 = 0, 'a', 'b') source"))
    out = mixing.mix(docs).collect()
    assert len(out) == 3000
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        taken, target = sum(r["taken"] for r in own), own[0]["target"]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and abs(taken - target) <= max(100, 0.02 * target)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    again = sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((r["doc_id"], r["size"], r["taken"]) for r in out)


def test_a_text_of_many_candidates(spark):
    n = 100_000
    text = " ".join(f"abcdefghij{i:08d}" for i in range(n))
    began = time.time()
    got = secret_scan.findings(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("start", "candidate").orderBy("start").collect()
    assert len(got) == n and all(text[r["start"] : r["start"] + 18] == r["candidate"] for r in got[:: n // 50])
    assert time.time() - began < 120
