"""Sharding, mixing and packing: contract checks and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import mixing, packing, sharding


def check_shards(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == want
    return {k: len(v) for k, v in slots.items()}


def test_sharding_query(spark, sf, documents):
    rows = sharding.op3_sharding(spark, sf).collect()
    counts = check_shards(rows, [(r["doc_id"], r["text"]) for r in documents])
    assert len(counts) == 16 and max(counts.values()) < 2 * 1000 / 16
    assert 0.02 < np.mean([r["grown_shard"] == 16 for r in rows]) < 0.11


def test_sharding_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 1)
    rows = sharding.shard(odd, 16).collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert len({r["shard"] for r in rows if r["doc_id"] == 10}) == 1
    assert sharding.shard(none).count() == 0


def test_changed_weight_moves_into_its_subtree_only(spark):
    def tree(w):
        leaves = lambda g, k: tuple(sharding.Node(f"g{g}/k{k}/s{s}", w if (g, k, s) == (0, 1, 0) else 1.0, g * 4 + k * 2 + s) for s in range(2))
        racks = lambda g: tuple(sharding.Node(f"g{g}/k{k}", sum(x.weight for x in leaves(g, k)), None, leaves(g, k)) for k in range(2))
        return sharding.Node("", 0, None, tuple(sharding.Node(f"g{g}", sum(x.weight for x in racks(g)), None, racks(g)) for g in range(2)))

    from pyspark.sql import functions as F

    got = spark.range(20_000).select(sharding.shard_of(F.col("id"), tree(1.0)).alias("a"), sharding.shard_of(F.col("id"), tree(3.0)).alias("b")).collect()
    moved = Counter((r["a"], r["b"]) for r in got if r["a"] != r["b"])
    assert moved and all(b < 4 for _, b in moved)
    share = Counter(r["b"] for r in got)
    assert abs(share[2] / len(got) - 3 / 10) < 0.02 and abs(share[7] / len(got) - 1 / 10) < 0.02


@pytest.mark.parametrize("n", [*range(1, 18), 23, 24, 31, 32, 39, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    from pyspark.sql import functions as F

    first = sharding.uniform_tree(n)
    trees = [first, sharding.extended(first), sharding.extended(sharding.extended(first))]
    rows = spark.range(4000).select(*(sharding.shard_of(F.col("id"), t).alias(f"s{i}") for i, t in enumerate(trees))).collect()
    assert {r["s0"] for r in rows} == set(range(n))
    for a, b, new in (("s0", "s1", n), ("s1", "s2", n + 1)):
        moved = [r[b] for r in rows if r[a] != r[b]]
        assert set(moved) == {new} and abs(len(moved) / 4000 - 1 / (new + 1)) < 0.05


def plain_shard(key, node):
    """The descent in plain code: Spark's xxhash64 of (key, path) is XXH64 of the key's 8 bytes, then of the path with that as the seed."""
    import struct

    import xxhash

    while node.shard is None:
        draws = []
        for i, c in enumerate(node.children):
            h = xxhash.xxh64_intdigest(c.path.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
            draws.append((-np.log(((h >> 11) + 0.5) / (1 << 53)) / c.weight, i))
        node = node.children[min(draws)[1]]
    return node.shard


def test_shards_are_those_of_the_plain_descent(spark, sf):
    tree = sharding.uniform_tree(16)
    grown = sharding.extended(tree)
    for r in sharding.op3_sharding(spark, sf).collect():
        assert r["shard"] == plain_shard(r["doc_id"], tree) and r["grown_shard"] == plain_shard(r["doc_id"], grown)


def test_sharding_counts_copies_before_it_numbers_them(spark):
    rows = spark.createDataFrame([(None, "t")] * 300 + [(i, "t") for i in range(50)], "doc_id long, text string")
    out = sharding.shard(rows, 4).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 350 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_sainte_lague(claims, seats):
    won = [0] * len(claims)
    for _ in range(seats):
        i = max(range(len(claims)), key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague(seed):
    rng = np.random.default_rng(seed)
    claims = rng.integers(0, 50, 12).astype(float) if seed % 2 else rng.pareto(1, 12)
    seats = int(rng.integers(1, 300))
    assert mixing.sainte_lague(claims, seats).tolist() == plain_sainte_lague(claims.tolist(), seats)


def test_water_filled():
    got = mixing.water_filled(np.array([10, 1000, 0, 10]), np.array([3.0, 1.0, 2.0, 3.0]), 1530.0, 2)
    assert got.tolist() == [20, 1490, 0, 20]


def words(text):
    return len((text or "").translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).replace("  ", " ").split(" ")) if False else len([w for w in (text or "").translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ") if w])


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += words(d["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = np.array([(3, 1, 2)[i % 3] for i in range(len(names))], float)
    target = dict(zip(names, mixing.water_filled(np.array([sizes[s] for s in names]), weights, 1.5 * sum(sizes.values()), 2), strict=True))
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"]) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in names)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((d["doc_id"] or -1, words(d["text"])) for d in docs)


def test_mixing_query(spark, sf, documents, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_SHARD", 20)
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 4)
    out = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = out.collect()
    check_mix(rows, documents)
    assert sorted(map(str, rows)) == sorted(map(str, out.collect()))


def test_mixing_takes_whole_documents_in_one_order(spark, sf, monkeypatch):
    """Within a shard, documents are taken whole from the first on; at most one of them is cut."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 37)
    rows = [r for r in mixing.mix(docs).collect() if r["size"]]
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    for group in by_source.values():
        low = min(r["taken"] // r["size"] for r in group)
        assert sum(r["taken"] % r["size"] != 0 for r in group) <= 1 and all(low * r["size"] <= r["taken"] <= (low + 1) * r["size"] for r in group)


def test_mixing_empty_texts_only(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(rows).collect()} == {(0, 0.0, 0)}
    assert mixing.mixed_documents(rows).count() == 0


def test_mixing_odd_rows(odd, none):
    check_mix(mixing.mix(odd).collect(), [r.asDict() for r in odd.collect()])
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    want = sum(r["taken"] for r in mixing.mix(odd).collect())
    assert abs(sum(words(r["text"]) for r in mixed.collect()) - want) <= 1


def check_pack(rows, docs, plain):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = Counter()
    for d in docs:
        want[(d["doc_id"], len(plain(d["text"] or "")) + 1)] += len(plain(d["text"] or "")) + 1
    got = Counter()
    for r in rows:
        got[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert got == want
    ids = {d["doc_id"]: [*plain(d["text"] or ""), 1] for d in docs}
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
    for seq in by_sequence.values():
        seq.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in seq] == np.cumsum([0, *(r["length"] for r in seq)]).tolist()[:-1] and sum(r["length"] for r in seq) <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(by_sequence))


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = {}

    def encode(text):
        if text not in seen:
            seen[text] = tok.encode(text, add_special_tokens=False).ids
        return seen[text]

    return encode


def test_packing_query(spark, sf, documents, plain):
    assert check_pack(packing.op6_packing(spark, sf).collect(), documents, plain) > 0.995


def test_packing_odd_rows(odd, none, plain):
    rows = packing.pack(odd.where("doc_id <> 10 or doc_id is null")).collect()
    check_pack(rows, [r.asDict() for r in odd.where("doc_id <> 10 or doc_id is null").collect()], plain)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(none).count() == 0
    twice = packing.pack(odd).where("doc_id = 10").collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_same_ids_as_the_json_tokenizer(plain):
    odd = ["", " ", "a  b\n\n c\t", "it's we'LL 12345 ½ ñandú 你好   x  ", "<|endoftext|>", "ab  <|endoftext|>  \n cd<|endoftext|><|endoftext|> <|endoftext", "\n \n", "x" * 3000, "!" * 500 + "?", "é́ \U0001f600\U0001f601"]
    assert [packing.ids_of(t, packing.encoder()).tolist() for t in odd] == [[*plain(t), 1] for t in odd]


def test_fill_is_exact_and_tight():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = Counter(rng.integers(1, 2049, 400).tolist())
        used, windows = Counter(), 0
        for pattern, times in packing.fill(dict(counts)):
            assert sum(w * n for w, n in pattern.items()) <= 2048
            windows += times
            for w, n in pattern.items():
                used[w] += n * times
        assert used == counts and windows <= -(-sum(w * n for w, n in counts.items()) // 2048) * 1.06 + 1
    assert next(packing.fill({1500: 1, 600: 1, 500: 1, 48: 1}))[0] == {1500: 1, 500: 1, 48: 1}
