"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table (h, c, n): a line key's XXH64 and CRC32, and the number of documents that hold it, sorted by hash. A
batch merge-anti-joins the runs: keys that a run already knows to be frequent (``min_docs`` documents or more) need no
more counting and drop out; the others are added as a run at level 0. When a level holds ``fan_in`` runs, they are merged
into one run of the next level, their counts added up. A key that stays below ``min_docs`` in every run is counted in
full by them, so the sums over all runs decide exactly. Texts are read twice: once to hash their lines, once to drop lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored, table, text_hash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes (16 bytes each) of dropped lines up to which their table is broadcast; beyond, texts are shuffled once.
BROADCAST_HASHES = 1_000_000
#: Dropped keys of a text up to which its lines look them up one by one; beyond, its lines are joined with them.
FEW_KEYS = 64
#: Batches into which the query deals the table.
BATCHES = 4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped at both ends of x20 and x09-x0D, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _LOWER)


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.crc32(key.cast("binary")).alias("c"))


def _identity(text: Column) -> list[Column]:
    return [text_hash(text).alias("th"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("tc")]


def hashed_lines(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """doc_id, th, tc (a text's XXH64 and CRC32) and keys, the hashes (h, c) of its distinct line keys of at least
    ``min_length`` code points; one row per row of ``docs``."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_length))
    return docs.select("doc_id", *_identity(F.col("text")), F.transform(keys, _hashed).alias("keys"))


class LineRuns:
    """The levelled runs of one corpus, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = 3, min_length: int = 1, min_docs: int = 10):
        self.spark, self.fan_in, self.min_length, self.min_docs = spark, fan_in, min_length, min_docs
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, counts: DataFrame) -> DataFrame:
        return stored(counts.sortWithinPartitions("h", "c"), "run")

    def add(self, docs: DataFrame) -> None:
        """Adds the lines of a batch of documents; see ``add_hashed``."""
        self.add_hashed(hashed_lines(docs, self.min_length))

    def add_hashed(self, batch: DataFrame) -> None:
        """Counts a batch of ``hashed_lines``, anti-joins it with the keys that the runs have settled, adds the rest as a
        run and compacts every level that is full."""
        counts = batch.select(F.explode("keys").alias("k")).groupBy("k.h", "k.c").agg(F.count(F.lit(1)).alias("n"))
        if self.runs():
            settled = _union(self.runs()).where(F.col("n") >= self.min_docs).select("h", "c")
            counts = counts.join(settled.hint("merge"), ["h", "c"], "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(_merged(self.levels[level])))
            self.levels[level] = []
            level += 1

    def frequent(self) -> DataFrame:
        """(h, c) of the line keys that at least ``min_docs`` documents of all batches hold."""
        if not self.runs():
            return self.spark.createDataFrame([], "h long, c long")
        return stored(_merged(self.runs()).where(F.col("n") >= self.min_docs).select("h", "c"), "frequent")

    def screen(self, docs: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
        """doc_id, text, n_lines, n_dropped, kept: the text without the lines of frequent keys.

        A null or empty text is one empty line, kept. Lines with an empty key are never dropped. If all
        lines go, kept is empty. Repeated rows each count as a document and each give a row; rows with a null
        id too. An empty table gives an empty table. Other columns aren't read. ``hashed`` is ``hashed_lines`` of ``docs``
        where a caller has stored it already. A text with more than ``FEW_KEYS`` dropped keys has its lines joined with
        them, so its cost stays in proportion to its length.
        """
        hashed = hashed_lines(docs, self.min_length) if hashed is None else hashed
        found = hashed.select("th", "tc", F.explode("keys").alias("k")).select("th", "tc", "k.h", "k.c").join(sized(self.frequent()), ["h", "c"], "left_semi").distinct()
        gone = stored(found.groupBy("th", "tc").agg(F.collect_list(F.struct("h", "c")).alias("gone")), "gone")
        base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_identity(F.col("text")))
        few, many = gone.where(F.size("gone") <= FEW_KEYS), gone.where(F.size("gone") > FEW_KEYS)
        hashes, n_many = gone.agg(F.coalesce(F.sum(F.when(F.size("gone") <= FEW_KEYS, F.size("gone"))), F.lit(0)), F.count_if(F.size("gone") > FEW_KEYS)).first()
        met = base.join(F.broadcast(few) if hashes <= BROADCAST_HASHES else few, ["th", "tc"], "left")
        lines = lines_of(F.col("text"))
        kept = F.filter(lines, lambda x: ~F.array_contains(F.col("gone"), _hashed(line_key(x))))
        met = met.withColumn("left", F.when(F.col("gone").isNotNull(), kept))
        size = F.when(F.col("left").isNull(), F.size(lines)).otherwise(F.size("left"))
        out = F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
        if n_many:
            long = self._long(base.join(sized(many.select("th", "tc"), n_many), ["th", "tc"], "left_semi"), many)
            met = met.join(sized(long, n_many) if n_many <= 1000 else long, ["th", "tc"], "left")
            size, out = F.coalesce("long_size", size), F.coalesce("long_kept", out)
        n_lines = F.size(lines).cast("long")
        return met.select("doc_id", "text", n_lines.alias("n_lines"), (n_lines - size).cast("long").alias("n_dropped"), out.alias("kept"))

    def _long(self, texts: DataFrame, gone: DataFrame) -> DataFrame:
        """th, tc, long_size, long_kept of each distinct text of ``texts``: its lines without the keys of ``gone``."""
        lines = texts.dropDuplicates(["th", "tc"]).select("th", "tc", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
        lines = lines.select("th", "tc", "at", "line", _hashed(line_key(F.col("line"))).alias("k")).select("th", "tc", "at", "line", "k.h", "k.c")
        away = gone.select("th", "tc", F.explode("gone").alias("k")).select("th", "tc", "k.h", "k.c", F.lit(True).alias("drop"))
        met = lines.join(away, ["th", "tc", "h", "c"], "left")
        rest = F.collect_list(F.when(F.col("drop").isNull(), F.struct("at", "line")))  # nulls aren't collected
        kept = met.groupBy("th", "tc").agg(F.transform(F.sort_array(rest), lambda x: x["line"]).alias("left"))
        return kept.select("th", "tc", F.size("left").alias("long_size"), F.array_join("left", "\n").alias("long_kept"))


def _union(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Runs merged by hash; counts of equal hashes add up."""
    return _union(runs).groupBy("h", "c").agg(F.sum("n").alias("n"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES) -> DataFrame:
    """Hashes all lines once, adds them to fresh runs batch by batch, then screens all of ``docs``; see ``LineRuns.screen``."""
    runs = LineRuns(docs.sparkSession, min_docs=min_docs)
    hashed = stored(hashed_lines(docs), "lines")
    for k in range(batches):
        runs.add_hashed(hashed.where(F.pmod("th", F.lit(batches)) == k))
    return runs.screen(docs, hashed)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), lines AS (
  SELECT r, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM rows
), keyed AS (
  SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY r, doc_id
"""
