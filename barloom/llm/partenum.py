"""N-gram Jaccard join by PartEnum signatures: no pair of similar sets is left out, and few others meet.

Two sets with a Jaccard similarity of 0.8 or more, the smaller of a elements, differ in at most a/4 elements. The hashes of
the shingles are the domain; for each band of set sizes it is cut into groups, and each group into three parts. A set
signs, for its first groups, every choice of two parts of the three: what it holds there. A group in which two sets differ
in one element at most has a choice on which they are equal, and a/4 differences can spoil a/8 groups at most; a set
signs 0.15 a + 2. Sets near the upper end of a band sign in the next one too, so sets of all sizes that may be similar
share a band.

A signature that many sets share says little: it is an empty choice, a passage that many documents quote, or a large family
of near copies. A set leaves those signatures out, unless it has so many of them that they may be all that it shares
with a similar set (``slack``). So families stay together while documents that share a passage part. What then shares a
signature is compared, all pairs of a small bucket, and by tiles in a large one: first by sketches whose difference is a lower
bound, then whole. Signatures repeat each other: a family shares some hundreds of them. So buckets of the same few sets
travel once, and sets that large buckets leave to compare meet once in their family, whatever buckets they share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffles_dropped, sized, stored, table, text_hash
from .components import components, stars
from .jaccard import apart

#: Words of a shingle. The signatures are made for a similarity of 0.8.
WORDS = 5
PARTS, SMALLEST = 3, 4
#: Bands of set sizes begin at these: each half as wide again as the one before.
BANDS = [SMALLEST]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] * 3 // 2)
#: Sets of a bucket up to which all pairs are compared; beyond, the signature is common.
SMALL = 8
#: Draws of the set that a large bucket hangs to; buckets of the same sets and draw hang to the same one.
DRAWS = 8
#: Signatures that one task sorts; times that a task meets one before it deals its sets out by other keys.
BUCKET, HOT = 500_000, 64
#: Sets of one side of a tile of sketches.
TILE = 2048
_FLUSH = 400_000
_WORD = (1 << 64) - 1
_SUMMARY = 0xFFFFFFFF
#: Bytes up to which a word is hashed beside the others of its text.
LONG = 64
#: Bytes of texts that are cut into words at once.
AT_ONCE = 1 << 17
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """64 bits of a state and of what comes next; for one state no two x have the same result."""
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word of a text and its place, in order: all words at once, 8 bytes a step; those of more than LONG bytes by
    XXH64. bytes.lower touches A-Z only, and words end at x20, x09-x0D only."""
    low = text.lower()
    raw = np.frombuffer(low + b" " * 9, np.uint8)  # the last word ends, and 8 bytes may be read from any place in it
    inside = _INSIDE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate((np.zeros(1, np.int64), edges))
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
    # Sizes are mixed first: beside the bytes of a short word as they stand they could make up for each other.
    out = _mixed(_mixed(np.zeros(1, np.uint64), size.astype(np.uint64)), eight[start] & _BYTES[np.minimum(size, 8)])
    more = np.arange(len(size))
    for at in range(8, LONG, 8):
        more = more[size[more] > at]
        if not len(more):
            break
        out[more] = _mixed(out[more], eight[start[more] + at] & _BYTES[np.minimum(size[more] - at, 8)])
    for i in more[size[more] > LONG].tolist():
        out[i] = xxhash.xxh64_intdigest(low[start[i] : start[i] + size[i]])
    return out, start


def _chained(h: np.ndarray, words: int) -> np.ndarray:
    """64 bits for each so many words in a row."""
    n = len(h) - words + 1
    out = np.full(n, words, np.uint64)
    for k in range(words):
        out = _mixed(out, h[k : k + n])
    return out


def shingle_sets(texts: Iterable[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Distinct 64-bit hashes of each text's shingles, ascending; texts of about AT_ONCE bytes are cut into words together."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t) + 1
        if held >= AT_ONCE:
            yield from _sets_of(part, words)
            part, held = [], 0
    yield from _sets_of(part, words)


def _sets_of(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    h, start = word_hashes(b" ".join(texts))
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()
    every = _chained(h, words) if len(h) >= words else h[:0]
    for a, b in zip([0, *ends], ends):
        if b - a >= words:
            yield np.unique(every[a : b - words + 1])
        else:
            yield _chained(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], words))


def sketch_of(found: np.ndarray) -> np.ndarray:
    """Parities of the elements that fall on each of at least as many bits, a power of two from 512 on: sketches of equal
    length differ in no more bits than their sets in elements. The two halves of a sketch make one of half the length by xor."""
    bits = max(512, 1 << (len(found) - 1).bit_length()) if len(found) else 512
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_of(found: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return xxhash.xxh3_64_intdigest(found.tobytes())


def groups_of(size: int) -> int:
    """Groups that a set of that size signs: more than two differences each can spoil."""
    return size // 4 * 3 // 5 + 2


def signatures(found: np.ndarray) -> np.ndarray:
    """The signatures of an ascending set as 48-bit numbers; the lowest bit tells two neighbouring bands apart."""
    n, out = len(found), []
    if n < SMALLEST:  # similar sets of so few elements are equal
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    m = groups_of(n)
    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)))
    for g in (band, band + 1)[: 1 + (n * 5 // 4 >= BANDS[band + 1])]:
        parts = np.uint64(groups_of(BANDS[g + 1] - 1) * PARTS)
        cut = np.searchsorted(((found >> np.uint64(32)) * parts) >> np.uint64(32), np.arange(m * PARTS + 1, dtype=np.uint64))
        held = np.diff(mixed[cut]).reshape(m, PARTS)
        z = held.sum(axis=1, dtype=np.uint64)[:, None] - held + np.uint64(g * 0xD1B54A32D192ED03 & _WORD)
        z += np.arange(m * PARTS, dtype=np.uint64).reshape(m, PARTS) * np.uint64(0x8CB92BA72F3D8DD7)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        out.append((z.ravel() >> np.uint64(17) << np.uint64(1)) | np.uint64(g & 1))
    return np.concatenate(out)


def slack(n):
    """Common signatures in one band from which a set may have nothing else in common with a similar one.

    With q = floor(a / 4) differences at most and ``groups_of`` groups, a similar pair that shares common signatures
    only has at least 2 * groups - q of them, for whichever a from 0.8 n to n; this is a lower bound of that.
    """
    return F.floor(F.floor(F.floor(n * 4 / 5) / 4) / 5) + 3


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (text_hash), n (size of the set), node (which stands for the set) and its sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, sketch = [], [], []
            for found in shingle_sets((t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(2)), words):
                n.append(len(found))
                node.append(node_of(found))
                sketch.append(sketch_of(found))
            sketches = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketch)]), pa.int32()), pa.array(np.concatenate(sketch or [np.zeros(0, np.int64)])))
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), sketches]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "node", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")), F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, th long, n long, node long, sketch array<long>")


def _packed(sig: np.ndarray, ref: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.argsort(bucket, kind="stable")
    sig, ref, bucket = sig[order], ref[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)).tolist()
    for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(bucket[a]), sig[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), ref[a:b].tobytes()


def _dealt(sig: np.ndarray, ref: np.ndarray, buckets: int, often: int) -> pa.RecordBatch:
    """Signatures by bucket, 6 bytes each and 4 for the set. One that is met more than ``often`` times
    here leaves a mark in its bucket, and its sets go to buckets below 0, where all rows are taken as shared."""
    kinds, at, n = np.unique(sig, return_inverse=True, return_counts=True)
    hot = n[at] > often
    marks = kinds[n > often]
    place = lambda s: ((s >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)
    cold = np.concatenate((sig[~hot], marks))
    rows = list(_packed(cold, np.concatenate((ref[~hot], np.full(len(marks), _SUMMARY, np.uint32))), place(cold)))
    if hot.any():
        rows += _packed(sig[hot], ref[hot], -1 - (ref[hot] % buckets).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["bucket", "sig", "ref"])


def _shared(key: tuple, rows: pa.Table, small: int) -> pa.Table:
    """What two different sets sign: (sig, ref, whole) of a signature of more than ``small`` sets, or ``few``, the ascending refs
    of up to so many, once for all signatures of just these. Not whole are signatures whose sets lie in other buckets too."""
    raw = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, 6)
    sig = np.zeros((len(raw), 8), np.uint8)
    sig[:, :6] = raw
    sig, ref = sig.view(np.int64).ravel(), np.frombuffer(b"".join(rows.column("ref").to_pylist()), np.uint32)
    order = np.lexsort((ref, sig))
    sig, ref = sig[order], ref[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])))
    sig, ref = sig[new], ref[new]
    first = np.flatnonzero(np.diff(sig, prepend=sig[:1] - 1))
    size = np.diff(first, append=len(sig))
    part = ref[first + size - 1] == _SUMMARY if key[0].as_py() >= 0 else np.ones(len(first), bool)
    few = []
    for k in range(2, small + 1):
        sets = ref[first[(size == k) & ~part][:, None] + np.arange(k)]
        few += np.unique(sets.view(f"V{4 * k}").ravel()).tolist() if len(sets) else []
    wide = np.repeat(part | (size > max(small, 1)), size) & (ref != _SUMMARY)
    n, m = int(wide.sum()), len(few)
    return pa.table(
        [
            pa.concat_arrays([pa.array(sig[wide]), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array(ref[wide].astype(np.int64)), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array(~np.repeat(part, size)[wide]), pa.nulls(m, pa.bool_())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(few, pa.binary())]),
        ],
        ["sig", "ref", "whole", "few"],
    )


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): all pairs of the refs of each row of ``few``, a < b."""
    for batch in batches:
        by = {}
        for few in batch.column(0).to_pylist():
            by.setdefault(len(few) // 4, []).append(few)
        a, b = [], []
        for k, rows in by.items():
            i, j = np.triu_indices(k, 1)
            refs = np.frombuffer(b"".join(rows), np.uint32).reshape(-1, k).astype(np.int64)
            a.append(refs[:, i].ravel())
            b.append(refs[:, j].ravel())
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])


def shared_signatures(docs: DataFrame, total: int, words: int = WORDS) -> DataFrame:
    """(sig, ref, whole, few) as in ``_shared``: what two or more sets sign; ref is the lower 32 bits of a set's node. total:
    signatures of all rows, about. A set that a task has seen signs only once there."""
    buckets, small, hot = max(1, -(-total // BUCKET)), SMALL, HOT  # as they are here, not in the workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sigs, refs, held = set(), [], [], 0
        for b in batches:
            for found in shingle_sets((t.as_buffer().to_pybytes() for t in b.column(0)), words):
                node = node_of(found)
                if len(found) < SMALLEST or node in seen:
                    continue
                if len(seen) >= 1 << 20:  # forgetting repeats signatures, no more
                    seen.clear()
                seen.add(node)
                sigs.append(signatures(found))
                refs.append(np.full(len(sigs[-1]), min(node & _SUMMARY, _SUMMARY - 1), np.uint32))
                held += len(sigs[-1])
                if held > _FLUSH:
                    yield _dealt(np.concatenate(sigs), np.concatenate(refs), buckets, hot)
                    sigs, refs, held = [], [], 0
        if held:
            yield _dealt(np.concatenate(sigs), np.concatenate(refs), buckets, hot)

    rows = docs.where("text IS NOT NULL").select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, sig binary, ref binary")
    return rows.groupBy("bucket").applyInArrow(lambda key, rows: _shared(key, rows, small), "sig long, ref long, whole boolean, few binary")


def _sets(docs: DataFrame, rows: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(th, s): the sets of the asked nodes; th is the node."""
    picked = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("k"))
    picked = sized(picked.select(F.col("node").alias("k_node"), F.col("k.doc_id").alias("k_id"), F.col("k.th").alias("k_th")), asked.count())
    docs = docs.select("doc_id", "text")
    texts = docs.join(picked, docs["doc_id"].eqNullSafe(picked["k_id"]) & (text_hash(docs["text"]) == picked["k_th"]))
    texts = texts.select("k_node", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [s.view(np.int64) for s in shingle_sets((t.as_buffer().to_pybytes() for t in part.column(1)), words)]
                ends = pa.array(np.cumsum([0, *map(len, got)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(got)))], ["th", "s"])

    return texts.mapInArrow(run, "th long, s array<long>").dropDuplicates(["th"])


def _differ(a: str, b: str):
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    fold = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    return F.expr(f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)")


def _near_rows(n: np.ndarray, c: np.ndarray, sketches: list[np.ndarray], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a tile have a partner in another component whose sketch may be that of a similar set, and for each row the
    first that it reaches over such partners. ``left`` and the others meet, or all of them where left is everywhere true."""
    least = min(map(len, sketches))
    folded = []
    for s in sketches:
        while len(s) > least:
            s = s[: len(s) // 2] ^ s[len(s) // 2 :]
        folded.append(s)
    bits = np.array(folded).view(np.uint64)
    a, b = np.flatnonzero(left), np.arange(len(n)) if left.all() else np.flatnonzero(~left)
    label = every = np.arange(len(n))
    out = np.zeros(len(n), bool)
    for at in range(0, len(a), 256):
        i = a[at : at + 256]
        apart = np.zeros((len(i), len(b)), np.int32)
        for k in range(least):
            apart += np.bitwise_count(bits[i, k][:, None] ^ bits[b, k])
        near = (apart * 9 <= n[i][:, None] + n[b]) & (c[i][:, None] != c[b])
        u, v = np.nonzero(near)
        out[i[u]] = out[b[v]] = True
        label = stars(len(n), np.concatenate((i[u], every)), np.concatenate((b[v], label)))
    return out, label


def _near_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, p, q, side, node, c, n, sketch) sorted by sig, p and q; a tile that goes on in the next batch is held back."""
    held = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = np.column_stack([held.column(k).to_numpy() for k in range(3)])
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, np.int64)
        if len(first) > 1:
            yield _near_of(held.slice(0, first[-1]), first)
            held = held.slice(first[-1])
    if held is not None and held.num_rows:
        yield _near_of(held, np.array([0, held.num_rows]))


def _near_of(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    side, node, c, n = (rows.column(k).to_numpy() for k in ("side", "node", "c", "n"))
    sketches = rows.column("sketch").combine_chunks()
    flat, ends = sketches.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sketches.value_lengths().to_numpy())))
    kept, anchor = np.zeros(rows.num_rows, bool), node.copy()
    for i, j in zip(first.tolist(), [*first[1:].tolist(), rows.num_rows], strict=True):
        if j > i:
            left = np.ones(j - i, bool) if (side[i:j] == side[i]).all() else side[i:j] == 0
            kept[i:j], first = _near_rows(n[i:j], c[i:j], [flat[a:b] for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)], left)
            anchor[i:j] = node[i:j][first]
    return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (node, anchor, c, n)], ["node", "anchor", "c", "n"])


def _unsettled(large: DataFrame, sketches: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, anchor, c, n) of sets in large buckets that may be similar to a set of another component in the same bucket, by their sketches;
    c is the component, n the size of the set, and what may be similar in one tile has an anchor in common.

    A bucket of more than TILE sets is cut into parts, and each two parts meet in a tile."""
    label = components(edges)
    rows = large.join(label.toDF("node", "label"), "node", "left").select("sig", "node", F.coalesce("label", "node").alias("c"))
    mixed = rows.groupBy("sig").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("k")).where("a <> b")
    parts = mixed.select("sig", F.ceil(F.col("k") / TILE).cast("int").alias("parts"))
    rows = rows.join(parts, "sig").withColumn("x", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("y", each).select("sig", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), (F.col("x") > F.col("y")).cast("int").alias("side"), "node", "c")
    # A part alone is one tile; in a tile of two, the part of the lower number is side 0.
    rows = rows.join(sketches.select("node", "n", "sketch"), "node").select("sig", "p", "q", "side", "node", "c", "n", "sketch")
    rows = rows.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
    return rows.mapInArrow(_near_tiles, "node long, anchor long, c long, n long").distinct()


def _families(left: DataFrame) -> DataFrame:
    """(band, key, th, c, size): each set of ``left(node, anchor, c, n)`` once, by the sets that anchors join it to, however many
    buckets they share."""
    family = components(left.select(F.col("node").alias("u"), F.col("anchor").alias("v"))).toDF("node", "family")
    rows = left.select("node", "c", "n").distinct().join(family, "node", "left")
    return rows.select(F.lit(0).alias("band"), F.coalesce("family", "node").alias("key"), F.col("node").alias("th"), "c", F.col("n").alias("size"))


def links(docs: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Edges (u, v) between nodes whose sets have a similarity of 0.8 or more: not each such pair, but all that are needed
    to reach one end of it from the other. rows: ``prints`` of docs."""
    nodes = rows.where(F.col("n") >= SMALLEST).select("node", "n").distinct()
    total = nodes.agg(F.sum(F.col("n") * 7 / 10 + 9)).first()[0] or 0
    met = stored(shared_signatures(docs, int(total), words), "signatures")
    # 32 bits may stand for several sets; all of them are taken.
    refs = nodes.withColumn("ref", F.least(F.col("node").bitwiseAND(F.lit(_SUMMARY)), F.lit(_SUMMARY - 1)))
    few = met.where("few IS NOT NULL").select("few").distinct().mapInArrow(_pairs_of, "a long, b long").distinct()
    few = few.join(refs.toDF("u", "x", "a"), "a").join(refs.toDF("v", "y", "b"), "b")
    # A signature that isn't whole counts as common, however few sets it has in the end.
    wide = met.where("whole").select("sig", "ref").union(met.where("NOT whole").select("sig", "ref").distinct())
    often = wide.join(refs, "ref").withColumn("w", F.count(F.lit(1)).over(Window.partitionBy("ref", "node", F.col("sig").bitwiseAND(F.lit(1)))))
    held = stored(often.where(F.col("w") >= slack(F.col("n"))).select("sig", "node", "n"), "bound")
    drawn = F.xxhash64("node", F.pmod(F.shiftright("sig", 1), F.lit(DRAWS)))
    again = held.groupBy("sig").agg(F.min_by("node", drawn).alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1")
    held = stored(held.join(again, "sig"), "held")
    small = held.where(F.col("k") <= SMALL).select("sig", "node", "n")
    large = held.where(F.col("k") > SMALL)
    a, b = small.toDF("sig", "u", "x"), small.toDF("sig", "v", "y")
    near = few.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "x", "y").union(a.join(b, "sig").where("u < v").select("u", "v", "x", "y"))
    near = near.where("5 * least(x, y) >= 4 * greatest(x, y)").select("u", "v")
    star = large.where("node <> rep").select(F.least("node", "rep").alias("u"), F.greatest("node", "rep").alias("v"))
    near = stored(near.union(star).distinct(), "candidates")
    wanted = near.select(F.col("u").alias("node")).union(near.select("v")).union(large.select("node")).distinct()
    sketches = stored(rows.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "sketch"), "sketches")
    # What differs in the sketches differs in the sets: most pairs that aren't similar end here.
    side = lambda name: sketches.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    pairs = near.join(side("u"), "u").join(side("v"), "v")
    pairs = pairs.where((F.least("nu", "nv") * 5 >= F.greatest("nu", "nv") * 4) & (_differ("su", "sv") * 9 <= F.col("nu") + F.col("nv"))).select("u", "v")
    pairs = stored(pairs, "pairs")
    asked = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "asked")
    sets = stored(_sets(docs, rows, asked, words), "sets")
    both = pairs.join(sets.select(F.col("th").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("th").alias("v"), F.col("s").alias("b")), "v")
    common, every = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    edges = stored(both.where(common * 100 >= (every - common) * 80).select("u", "v"), "links")
    left = stored(_unsettled(large, sketches, edges), "unsettled")
    if not left.take(1):
        return edges
    sets = stored(_sets(docs, rows, left.select("node").distinct(), words), "sets")
    more = apart(stored(_families(left), "families"), sets)
    return edges if more is None else edges.union(stored(more, "across"))


def jaccard_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) for each row of ``docs``.

    A text of fewer words has the whole sequence as its one shingle; null, empty and blank texts have none and link with
    nothing, so each is its own component. Rows of equal sets are linked. doc_id may be of any type with an order. A row with
    a null id takes part in links and gets its component's smallest id, null if no row there has one. Repeated rows give
    repeated results; an empty table gives an empty table; other columns aren't read. Sets and shingles are told apart
    by 64 bits.
    """
    with shuffles_dropped(docs.sparkSession):
        rows = stored(prints(docs, words), "prints")
        edges = links(docs, rows, words)
        label = stored(components(edges), "labels")
        classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k"))
        classes = classes.join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        classes = stored(classes, "classes")
        linked = label.select("label").distinct()
        least = classes.join(linked, "label", "left_semi").groupBy("label").agg(F.min("first").alias("least"))
        # A set of one row without links is its own component: only the others are joined.
        moved = classes.join(least, "label", "left").where("k > 1 OR least IS NOT NULL").select("node", F.coalesce("least", "first").alias("component_id"))
        moved = stored(moved, "moved")
    out = rows.join(sized(moved), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT h.a, h.b FROM shared h JOIN n x ON x.doc_id = h.a JOIN n y ON y.doc_id = h.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
