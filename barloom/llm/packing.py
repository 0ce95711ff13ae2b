"""Packing token sequences by minimum bin slack.

Documents are cut at every 2048 tokens; full pieces are sequences of their own. The rests, a multiset of
lengths, are packed group by group: the longest rest opens a window, a bitset subset-sum over the remaining
lengths and their counts finds the sum closest to what is free, and walking the bitsets back gives how many
of each length go in. A found multiset fills as many windows as its counts allow.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

WINDOW, END = 2048, 1
#: Rests that one group packs; bounds a task, and costs at most the padding of a last window a group.
RESTS_PER_GROUP = 5_000
#: Documents whose pieces leave a task at once.
DOCUMENTS = 250
#: Fixed: the one token of the vocabulary that a text may spell out; it is one id wherever it stands.
SPELLED_OUT = {"<|endoftext|>": 50256}
_ENCODERS: dict[str, object] = {}


def encoder(ranks: str | None = None):
    """The byte-level BPE of ``byte_bpe_50k``: the rank file holds the same vocabulary and merges as the JSON file,
    and gives the same ids several times faster (a test compares them). ranks: path of that file."""
    import public_tokenizers
    import tiktoken

    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The public pattern, written with possessive repeats so that nothing is tried twice.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens=SPELLED_OUT)
    return _ENCODERS[path]


def ids_of(text: str, coder) -> np.ndarray:
    """The ids of a whole text, then the end id."""
    got = coder.encode(text, allowed_special="all") if any(t in text for t in SPELLED_OUT) else coder.encode_ordinary(text)
    got.append(END)
    return np.frombuffer(array("I", got), np.uint32).astype("<u4", copy=False)


def pieces(docs: DataFrame, ranks: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, salt (and ids) for each piece; a null text is empty: only the end id.
    salt is the place of the document in its batch: it deals out rows that are otherwise equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for b in batches:
            for low in range(0, b.num_rows, DOCUMENTS):
                row, start, length, crc, whole, ids = [], [], [], [], [], []
                for i, text in enumerate(b.column(1).slice(low, DOCUMENTS), low):
                    got = ids_of(text.as_py() or "", coder)
                    for at in range(0, len(got), window):
                        piece = got[at : at + window]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        whole.append(len(got))
                        if with_ids:
                            ids.append(piece.tobytes())
                cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole, row))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fill(counts: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """Packs a multiset of lengths (all at most ``window``): (multiset of a window, number of windows filled so)."""
    counts = {w: c for w, c in counts.items() if c > 0}
    order = sorted(counts, reverse=True)
    while order:
        longest = order[0]
        room = window - longest
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for w in order:
            if w > room:
                continue
            left, k = min(counts[w] - (w == longest), room // w), 1
            while left > 0 and not reach >> room & 1:
                k = min(k, left)
                steps.append((w, k, reach))
                reach |= (reach << (w * k)) & mask
                left, k = left - k, k * 2
            if reach >> room & 1:
                break
        best, used = reach.bit_length() - 1, {longest: 1}
        for w, k, before in reversed(steps):
            if not before >> best & 1:
                used[w] = used.get(w, 0) + k
                best -= w * k
        times = min(counts[w] // n for w, n in used.items())
        yield used, times
        for w, n in used.items():
            counts[w] -= n * times
        order = [w for w in order if counts[w]]


def _pack(window: int, groups: int, with_ids: bool):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["sequence_id", "offset"]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]))
        length = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        at_length = {w: list(np.flatnonzero(length == w)[::-1]) for w in np.unique(length).tolist()}
        at = 0
        for used, times in fill({w: len(r) for w, r in at_length.items()}, window):
            for _ in range(times):
                place = 0
                for w, n in used.items():
                    for _ in range(n):
                        i = at_length[w].pop()
                        sequence[i], offset[i] = at, place
                        place += w
                at += 1
        sequence = sequence * groups + rows.column("group")[0].as_py()
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).select(columns)

    return pack


def pack(docs: DataFrame, ranks: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset. Ids of sequences are unique, not gapless.

    Null and empty texts are one piece of the end id. Repeated rows are packed as often as they occur; a
    null doc_id is packed like any other. An empty table gives an empty table; other columns aren't read.
    """
    cut = stored(pieces(docs, ranks, window, with_ids), "pieces")
    groups = max(1, math.ceil(cut.count() / RESTS_PER_GROUP))
    placed = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups))).drop("salt")
    fields = [f for f in cut.schema.fields if f.name != "salt"]
    return placed.groupBy("group").applyInArrow(_pack(window, groups, with_ids), T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
