"""Helpers shared by the operators: shared-folder tables, size-checked joins, row identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow side (a few dozen bytes each) up to which a join broadcasts it.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) a temporary folder is made and set; on a cluster it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barloom-")
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here, a lost executor repeats nothing before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs in here drops its shuffle files as each execution ends. Otherwise they stay until the driver happens to collect
    its garbage, which comes by its own objects, not by the data. Frames that run in here should run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark's cleaner removes it when it is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a narrow table for broadcast when its counted rows stay below ``BROADCAST_ROWS``; beyond, Spark shuffles both sides."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def text_hash(text: Column) -> Column:
    """64 bits that stand for a text where rows of one doc_id must be told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) isn't among ``drops(doc_id, th)``; th is ``text_hash``. Null ids match null ids."""
    gone = sized(drops.select(F.col("doc_id").alias("__gone_id"), F.col("th").alias("__gone_th")).distinct())
    on = docs["doc_id"].eqNullSafe(gone["__gone_id"]) & (text_hash(docs["text"]) == gone["__gone_th"])
    return docs.join(gone, on, "left_anti")


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
