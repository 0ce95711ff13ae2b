"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words whose document counts differ most between toxic and other labelled rows (G²). Each
word is judged by its own G² alone, so the words of a rare language stand beside those of the most common one.
Features of a whole text: lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates. Trees and calibration are fitted on a bounded sample of the rows that may be learnt from; there,
a row's features come from a lexicon learnt without its fold, so that chance words look as weak as they are elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, stored, table

#: Labelled rows that are learnt from, about (a threshold on a hash picks them); words of the lexicon, at most.
SAMPLE_ROWS, LEXICON_WORDS = 20_000, 200
#: G² that a lexicon word needs; folds of the sample.
LEAST_G2, FOLDS = 12.0, 4
THRESHOLD = 0.7
#: Documents whose features leave a task at once.
DOCUMENTS = 500
#: Fixed: second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Fixed: signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
#: Fixed: signs that part words, in one byte and in several.
_SPLIT = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)
_WIDE_SPLIT = "“”„«»…—–"
_SIGNS = re.compile(r"[\W_]+")
_LONG = re.compile(r"(.)\1+")
FEATURES = (
    "hit_density", "hits", "kinds", "weight_density", "strongest", "near_second_person", "second_person",
    "capitals", "exclamations", "questions", "signs", "digits", "disguised_density", "disguised", "words",
)


def _split(lower: str) -> list[str]:
    for c in _WIDE_SPLIT:
        if c in lower:
            lower = lower.replace(c, " ")
    return lower.encode("utf-8", "replace").translate(_SPLIT).decode().split()


def words_of(text: str) -> list[str]:
    return _split(text.lower())


class Disguises(dict):
    """1 for a lower-case token that is no word of the lexicon as it stands but one when look-alike signs are read as
    letters, signs are left out or repeated letters are counted once; else 0. Remembers up to ``MOST`` tokens of at most
    40 characters that took a closer look, longer ones are looked at anew; most are plain at their first and last letter."""

    MOST = 50_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.edges = lexicon, {w[0] + w[-1] for w in lexicon}

    def __missing__(self, w: str) -> int:
        if w.isalpha():
            if w[0] + w[-1] not in self.edges:
                return 0
            hidden = w not in self.lexicon and _LONG.search(w) and _LONG.sub(r"\1", w) in self.lexicon
        else:
            plain = w.strip(".,;:!?\"'()[]")
            if plain.isalpha():
                return 0
            hidden = plain not in self.lexicon and _SIGNS.sub("", plain.translate(LOOKALIKES)) in self.lexicon
        if len(w) <= 40:
            if len(self) >= self.MOST:
                self.clear()
            self[w] = 1 if hidden else 0
        return 1 if hidden else 0


def features(text: str, lexicon: dict[str, float], disguises: Disguises | None = None) -> list[float]:
    """The features of one whole text, in the order of FEATURES; an empty text has zeros."""
    lower = text.lower()
    words = _split(lower)
    n = max(1, len(words))
    at = [] if lexicon.keys().isdisjoint(words) else [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in at]
    second = list(map(SECOND_PERSON.__contains__, words))
    near = sum(any(second[max(0, i - 3) : i + 4]) for i in at)
    disguises = Disguises(lexicon) if disguises is None else disguises
    disguised = sum(map(disguises.__getitem__, lower.split()))
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(count.sum()))
    exclaims, asks, digits = int(count[33]), int(count[63]), int(count[48:58].sum())
    signs = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return [
        len(at) / n, float(np.log1p(len(at))), float(len({words[i] for i in at})), sum(weights) / n, max(weights, default=0.0), near / max(1, len(at)), sum(second) / n,
        int(count[65:91].sum()) / size, exclaims / size, asks / size, signs / size, digits / size, disguised / n, float(np.log1p(disguised)), float(np.log1p(len(words))),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], name: str = "__features") -> DataFrame:
    """``docs`` with all its columns and one more: the array of features."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        disguises = Disguises(lexicon)
        for b in batches:
            for low in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(low, DOCUMENTS)
                got = pa.array([features(t.as_py() or "", lexicon, disguises) for t in part.column(at)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, got], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Words and weights (log odds) from ``sample(text, toxic, fold)``: of all rows, then for each fold of the rows outside
    it. At most LEXICON_WORDS words of each reach the driver; rows of one class only give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic, fold in zip(*b.columns, strict=True):
                words = sorted(set(words_of(text.as_py() or "")))
                cols = [pa.array(words, pa.string()), pa.array([toxic.as_py()] * len(words), pa.int32()), pa.array([fold.as_py()] * len(words), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["word", "toxic", "fold"])

    sums = (F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    sizes = {r["fold"]: (r["k1"], r["k0"]) for r in sample.groupBy("fold").agg(*sums).collect()}
    seen = sample.select("text", "toxic", "fold").mapInArrow(run, "word string, toxic int, fold int")
    counts = stored(seen.groupBy("word", "fold").agg(*sums), "words")
    k1, k0 = F.col("k1"), F.col("k0")
    out = []
    for apart in (None, *range(FOLDS)):
        n1, n0 = (sum(n[i] for fold, n in sizes.items() if fold != apart) for i in (0, 1))
        if not n1 or not n0:
            out.append({})
            continue
        share = (k1 + k0) / F.lit(float(n1 + n0))
        term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
        g2 = 2 * (term(k1, share * n1) + term(k0, share * n0) + term(n1 - k1, (1 - share) * n1) + term(n0 - k0, (1 - share) * n0))
        odds = F.log((k1 + 0.5) / F.lit(n1 + 1.0)) - F.log((k0 + 0.5) / F.lit(n0 + 1.0))
        rows = counts if apart is None else counts.where(F.col("fold") != apart)
        rows = rows.groupBy("word").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
        scored = rows.where(k1 * n0 > k0 * n1).select("word", g2.alias("g2"), odds.alias("odds")).where(F.col("g2") >= LEAST_G2)
        out.append({r["word"]: r["odds"] for r in scored.orderBy(F.desc("g2"), "word").limit(LEXICON_WORDS).collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from about ``sample_rows`` labelled rows of ``docs`` that ``may_learn``; a label that is null teaches nothing,
    a document with several labels is toxic if one says so. With one class only, every score is that class's rate."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity sample"), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    picked = known.where(draw < min(1.0, sample_rows / max(1, n)))
    # The sample's size is bounded by sample_rows, so its side may always be broadcast.
    fold = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("fold", fold), "labelled")
    rows, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    rate = (toxic or 0) / max(1, rows)
    if not 0 < rate < 1:
        return Model({}, None, None, rate)
    lexicon, *apart = learn_lexicons(sample)
    parts = [with_features(sample.where(F.col("fold") == k), apart[k]) for k in range(FOLDS)]
    train = stored(reduce(DataFrame.unionByName, parts).select("fold", "toxic", "__features").coalesce(4), "features")
    train = train.select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("__features").alias("features"))
    last = F.col("fold") == 0
    fold, rest = train.where(last), train.where(~last)
    if fold.agg(F.countDistinct("label")).first()[0] < 2 or rest.agg(F.countDistinct("label")).first()[0] < 2:
        fold = rest = train
    trees = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, maxBins=32, seed=11, minInstancesPerNode=3).fit(rest)
    judged = trees.transform(fold).select(_margin().alias("margin"), "label")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(judged)
    return Model(lexicon, trees, calibration, rate)


def _margin() -> Column:
    return vector_to_array("rawPrediction")[1]


def score(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """``docs`` with all its columns and ``name``, the calibrated probability (0 to 1) that a row is labelled toxic.

    Null texts count as empty; empty texts get the score of zero features. Repeated rows get equal scores,
    nothing else of a row is read, and columns may have any names that don't begin with two underscores.
    """
    if model.trees is None or model.calibration is None:
        return docs.withColumn(name, F.lit(float(model.rate)))
    held = docs.withColumnsRenamed({c: f"__own_{i}" for i, c in enumerate(docs.columns) if c != "text"})
    rows = with_features(held, model.lexicon).withColumn("features", array_to_vector("__features"))
    rows = model.trees.transform(rows).withColumn("margin", _margin())
    rows = model.calibration.setPredictionCol("__p").transform(rows.drop("prediction", "probability", "rawPrediction"))
    own = [F.col("text") if c == "text" else F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.select(*own, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__p")).alias(name))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc(doc_id) % 3 == 1, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches THRESHOLD; all columns are kept."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).where(F.col("__score") < THRESHOLD).drop("__score")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted")
    )
