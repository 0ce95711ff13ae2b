"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes, frozen after counting: contexts of three,
two, one and no bytes, method C escapes (distinct successors over total plus distinct), down to a uniform
byte. A text's score under a language is its exact code length under that frozen tree. Since the trees
don't change, the code length of every (context, byte) is worked out once, so a text is a run of lookups.

Bytes are folded into classes first: A-Z like a-z, white space and controls one class, digits one, other
ASCII signs one; bytes from x80 stay themselves. Trees are fitted on a bounded sample of labelled rows;
every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, table

#: Labelled rows of a language that its tree is fitted on, about (a threshold on a hash picks them).
SAMPLE_ROWS = 600
#: A three-byte context needs so many occurrences in the sample to have a row of its own.
LEAST_CONTEXT = 4
#: Bytes scored at once in a task.
CHUNK = 1 << 20


def _classes() -> np.ndarray:
    c = np.zeros(256, np.int32)
    c[33:127] = 28
    for b in range(26):
        c[97 + b] = c[65 + b] = 1 + b
    c[48:58] = 27
    c[128:] = 29 + np.arange(128)
    return c


CLASS = _classes()
A = 29 + 128


def _contexts(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of the three classes before each byte (a text begins after white space), class of each byte, first byte of each text."""
    pad = b"\0\0\0"
    x = CLASS[np.frombuffer(b"".join(pad + t for t in batch) + pad, np.uint8)]
    code = (x[:-3] * A + x[1:-2]) * A + x[2:-1]
    sizes = np.fromiter((len(t) for t in batch), np.int64, len(batch))
    first = np.cumsum(sizes + 3) - sizes - 3
    keep = np.ones(len(code), bool)
    for k in (0, 1, 2):  # positions whose byte is the padding before the next text
        keep[(first + sizes + k)] = False
    return code[keep], x[3:][keep], np.cumsum(sizes) - sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            code, sym, _ = _contexts([text.as_buffer().to_pybytes()])
            gram, n = np.unique(code.astype(np.int64) * A + sym, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


class Ppm:
    """Frozen trees of all languages: rows[context code] is a row of bits[row, byte class, language]."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray], least: int = LEAST_CONTEXT):
        self.langs = langs
        codes = np.concatenate([g // A for g in grams]) if grams else np.zeros(0, np.int64)
        weight = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        three, at = np.unique(codes, return_inverse=True)
        total = np.bincount(at, weights=weight, minlength=len(three)) if len(three) else np.zeros(0)
        self.three = three[total >= least]
        self.two = np.unique(three % (A * A))
        parts = [[], [], []]
        for g, n in zip(grams, counts, strict=True):
            sym, ctx = g % A, g // A

            def smoothed(keys: np.ndarray, own: np.ndarray, lower: np.ndarray, sym=sym, n=n) -> np.ndarray:
                """P(byte | context) for the contexts ``keys``; ``own``: each gram's context; lower: what an escape leads to."""
                hit = np.searchsorted(keys, own)
                ok = (hit < len(keys)) & (keys[np.minimum(hit, len(keys) - 1)] == own) if len(keys) else np.zeros(len(own), bool)
                table = np.zeros((len(keys), A))
                np.add.at(table, (hit[ok], sym[ok]), n[ok])
                whole, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
                below = np.maximum(whole + kinds, 1)
                escape = np.where(whole > 0, kinds / below, 1.0)
                return np.where(table > 0, table / below, escape * lower)

            p0 = smoothed(np.array([0]), np.zeros(len(g), np.int64), np.full((1, A), 1 / A))
            p1 = smoothed(np.arange(A), ctx % A, np.repeat(p0, A, 0))
            p2 = smoothed(self.two, ctx % (A * A), p1[self.two % A])
            p3 = smoothed(self.three, ctx, p2[np.searchsorted(self.two, self.three % (A * A))])
            for part, p in zip(parts, (p1, p2, p3), strict=True):
                part.append(-np.log2(p))
        self.bits = np.concatenate([np.stack(x, -1) for x in parts]).astype(np.float32) if grams else np.zeros((0, A, 0), np.float32)

    def rows(self) -> np.ndarray:
        """The row of the longest known context for each code of three classes."""
        out = np.tile(np.arange(A, dtype=np.int32), A * A).reshape(A, A * A)
        out[:, self.two] = A + np.arange(len(self.two), dtype=np.int32)
        out = out.ravel()
        out[self.three] = A + len(self.two) + np.arange(len(self.three), dtype=np.int32)
        return out

    def code_lengths(self, rows: np.ndarray, batch: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, whole texts, in chunks of bounded size."""
        out = np.zeros((len(batch), len(self.langs)))
        code, sym, first = _contexts(batch)
        for i in range(0, len(code), CHUNK):
            cost = self.bits[rows[code[i : i + CHUNK]], sym[i : i + CHUNK]].astype(np.float64)
            here = np.searchsorted(first, np.arange(i, min(i + CHUNK, len(code)), dtype=np.int64), side="right") - 1
            own, start = np.unique(here, return_index=True)
            out[own] += np.add.reduceat(cost, start, axis=0)
        return out


def fit(docs: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS) -> Ppm:
    """Trees from about ``sample_rows`` rows of each language among the rows that ``may_learn``; rows without text or lang teach nothing."""
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Ppm([], [], [])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "doc_id", "lang"), 11).cast("double") / F.lit(float(1 << 53))
    share = F.create_map(*(F.lit(v) for lang in langs for v in (lang, min(1.0, sample_rows / sizes[lang]))))
    sample = usable.where(draw < share[F.col("lang")]).select("lang", F.col("text").cast("binary"))
    counted = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas().sort_values("gram")
    per = {lang: part for lang, part in got.groupby("lang")}
    langs = [lang for lang in langs if lang in per]
    return Ppm(langs, [per[x]["gram"].to_numpy(np.int64) for x in langs], [per[x]["n"].to_numpy(np.int64) for x in langs])


def predict(docs: DataFrame, model: Ppm) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``.

    score: the predicted language's share of 2^-bits over all languages. A null text, a text without a
    letter (Unicode L), or a model without languages gives ``und`` with score 0. Equal code lengths go to the
    language that sorts first. Repeated rows give repeated results; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rows = shared.value, None
        for b in batches:
            picked: list[str] = []
            scores: list[float] = []
            texts = [t.as_buffer().to_pybytes() if ok.as_py() else b"" for t, ok in zip(b.column(1), b.column(2), strict=True)]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < CHUNK):
                    size += len(texts[stop])
                    stop += 1
                part, start = texts[start:stop], stop
                if not m.langs:
                    picked += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                rows = m.rows() if rows is None else rows
                bits = m.code_lengths(rows, part)
                best = bits.argmin(1)
                odds = np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                picked += [m.langs[i] if t else "und" for i, t in zip(best, part, strict=True)]
                scores += [float(1 / o) if t else 0.0 for o, t in zip(odds, part, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(picked, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.col("text").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return docs.select("doc_id", F.col("text").cast("binary"), letters).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc(doc_id) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
