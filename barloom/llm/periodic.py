"""Periodic runs of words: maximal repetitions found on harmonic grids by constant-time extension queries.

A run of period q that holds q at least four times covers four neighbouring multiples of q, whose words are equal. So a
document is walked once per period along the multiples of q (n/1 + n/2 + n/3 ... places), and each place with three equal
steps is extended to both sides. The extension is the longest common prefix of two suffixes. Only the suffixes that start
at places of a difference cover modulo 31 are sorted (6 of 31): from any two places some offset below 31 leads to
two sampled ones, so after comparing a few words the answer is a range minimum over the sorted samples' common prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, table

#: Times that a run holds its period, and words that it has, at least.
TIMES, LEAST_WORDS = 4, 6
#: Words of the documents that one walk takes together; a longer document is walked alone.
CHUNK_WORDS = 200_000
#: Fixed: a perfect difference set modulo 31; each residue is a difference of two of its members.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
#: For two residues the least offset that brings both into the cover; the place of a residue in the cover.
_SYNC = np.array([[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)])
_PLACE = np.array([COVER.index(r) if r in COVER else -1 for r in range(MODULUS)])


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


class Extension:
    """Longest common prefixes of suffixes of ``x``, an array of numbers from 0 in which the last one occurs once."""

    def __init__(self, x: np.ndarray):
        blocks = len(x) // MODULUS + 2
        self.x = np.concatenate((x, x.max() + 1 + np.arange(blocks * MODULUS + MODULUS - len(x)))).astype(np.int64)
        at = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        rank = np.zeros(len(at), np.int64)
        for t in range(0, MODULUS, 8):
            part = np.lexsort([self.x[at + u] for u in reversed(range(t, min(t + 8, MODULUS)))])
            own = np.zeros(len(at), np.int64)
            differ = np.zeros(len(at) - 1, bool)
            for u in range(t, min(t + 8, MODULUS)):
                w = self.x[at + u][part]
                differ |= w[1:] != w[:-1]
            own[part[1:]] = np.cumsum(differ)
            rank = _dense(rank * (len(at) + 1) + own)
        step, levels = len(COVER), [rank]
        while rank.max() < len(at) - 1:  # ranks of twice as many words from the ranks of a suffix and of its successor
            after = np.zeros(len(at), np.int64)
            after[:-step] = rank[step:] + 1
            rank = _dense(rank * (len(at) + 1) + after)
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = len(COVER) << k
            inside = np.flatnonzero(np.maximum(a, b) + step < len(at))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            a[same] += step
            b[same] += step
            common[same] += MODULUS << k
        left = np.arange(len(a))
        for t in range(MODULUS):
            left = left[self.x[at[a[left]] + t] == self.x[at[b[left]] + t]]
            common[left] += 1
        self.least = [common]
        while 2 << len(self.least) - 1 <= len(common):
            half, last = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places, how many words from there on are equal."""
        sync, out = _SYNC[i % MODULUS, j % MODULUS], np.zeros(len(i), np.int64)
        left, whole = np.arange(len(i)), np.ones(len(i), bool)
        for t in range(MODULUS):
            left = left[sync[left] > t]
            same = self.x[i[left] + t] == self.x[j[left] + t]
            whole[left[~same]] = False
            left = left[same]
            out[left] += 1
        at = np.flatnonzero(whole)
        a, b = ((p[at] + sync[at]) // MODULUS * len(COVER) + _PLACE[(p[at] + sync[at]) % MODULUS] for p in (i, j))
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            mine, row = level == k, self.least[k]
            out[at[mine]] += np.minimum(row[low[mine]], row[high[mine] - (1 << k)])
        return out


def _grid(x: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(q, k): places k * q from which three steps of q words meet equal words. Documents come longest first."""
    most = int(lengths[0]) // TIMES if len(lengths) else 0
    # Documents long enough for a run of period q are a prefix.
    fit = np.searchsorted(-lengths, -np.maximum(LEAST_WORDS, TIMES * np.arange(1, most + 1)), side="right")
    for q in range(1, most + 1):
        if not fit[q - 1]:
            break
        y = x[: ends[fit[q - 1] - 1] : q]
        same = y[1:] == y[:-1]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(k):
            yield q, k


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents in a row, each closed by a number of its own; where each ends."""
    top = max(int(d.max()) for d in docs) + 1
    x = np.concatenate([p for i, d in enumerate(docs) for p in (d, np.array([top + i]))])
    return x, np.cumsum([len(d) + 1 for d in docs])


def runs_of(docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each document, an array of word numbers, its runs as rows (start, length, period) by start and period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(docs)
    order = sorted((i for i, d in enumerate(docs) if len(d) >= LEAST_WORDS), key=lambda i: -len(docs[i]))
    if not order:
        return out
    x, ends = _joined([docs[i] for i in order])
    hit = np.zeros(len(order), bool)
    for q, k in _grid(x, ends, np.diff(ends, prepend=0) - 1):
        hit[np.searchsorted(ends, k * q, side="right")] = True
    order = [i for i, h in zip(order, hit, strict=True) if h]
    if not order:
        return out
    x, ends = _joined([docs[i] for i in order])
    ahead, back = Extension(x), Extension(np.concatenate((x[:-1][::-1], x[-1:])))
    found = []
    for q, k in _grid(x, ends, np.diff(ends, prepend=0) - 1):
        while len(k):
            first = np.flatnonzero(np.diff(k, prepend=-2) != 1)
            i = k[first] * q
            forward = ahead(i, i + q)
            behind = np.zeros(len(i), np.int64)
            inner = i > 0  # in the mirrored row, the words before place i start at len(x) - 1 - i
            behind[inner] = back(len(x) - 1 - i[inner], len(x) - 1 - i[inner] - q)
            start, length = i - behind, forward + behind + q
            good = length >= max(LEAST_WORDS, TIMES * q)
            found.append(np.column_stack((start[good], length[good], np.full(good.sum(), q))))
            # What lies inside the run that was found would find it again.
            last = np.repeat((i + q + forward - 1) // q - 1, np.diff(np.append(first, len(k))))
            k = k[k > last]
    every = np.concatenate(found) if found else none
    if len(every):  # three equal steps need not lie in a run that is long enough
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        # A stretch that is found for several periods is a run of the smallest.
        every = every[np.concatenate(([True], (np.diff(every[:, 0]) != 0) | (np.diff(every[:, 1]) != 0)))]
        every = every[np.lexsort((every[:, 2], every[:, 0]))]
        owner = np.searchsorted(ends, every[:, 0], side="right")
        every[:, 0] -= (ends - np.diff(ends, prepend=0))[owner]
        for d in np.unique(owner).tolist():
            out[order[d]] = every[owner == d]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that stay: all but those of a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    for b in batches:
        first, size, held = 0, 0, []
        for i, text in enumerate(b.column(1)):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if held and size + len(words) > CHUNK_WORDS:
                yield b.column(0).slice(first, i - first), held
                first, size, held = i, 0, []
            held.append(words)
            size += len(words)
        if held:
            yield b.column(0).slice(first, len(held)), held


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and collapsed, for each row of ``docs(doc_id, text)``.

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. collapsed holds the words that no run repeats, one space between.
    A null or empty text has no words, no runs and an empty collapsed text. Whole texts are read, however long: one document
    takes memory of about 150 bytes a word when it holds a run. Repeated rows and null ids give a row each; an empty table
    gives an empty table; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            number: dict[bytes, int] = {}
            coded = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in texts]
            runs = runs_of(coded)
            short = []
            for words, own in zip(texts, runs, strict=True):
                short.append(b" ".join([words[i] for i in kept_words(len(words), own).tolist()] if len(own) else words))
            flat = np.concatenate(runs)
            cells = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            starts = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            cols = [ids, pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(starts, cells), pa.array(short, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "array<struct<start:long,length:long,period:long>>"
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_words long, runs {shape}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document of ten, by the crc32 of its id, repeats a stretch of its words to the end."""
    h = id_crc(F.col("doc_id"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, n - a)), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    out = out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return out
