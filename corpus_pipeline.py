"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. The mix repeats documents, so after it a doc_id may
occur twice, and a document where a block ends once more with its first words. Packing keeps the token ids.

The stages hand their rows to Python in Arrow batches of at most ROWS: they set that in the session, where it stays, since
the last steps of a stage run when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import stored, table
from barloom.llm.exact_dedup import drop_exact
from barloom.llm.mixing import mixed_documents
from barloom.llm.packing import pack
from barloom.llm.simhash import drop_near
from barloom.llm.toxicity import drop_toxic

#: Rows of an Arrow batch, for the memory of executors: whole texts lie in several copies of it there, outside the heap.
ROWS = 1_000


def _batched(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= ROWS:  # 0 and less mean any number
        spark.conf.set(name, str(ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batched(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batched(spark)
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batched(spark)
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batched(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batched(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]
#: SQL can't express a fitted classifier, seeded draws or a tokenizer: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
