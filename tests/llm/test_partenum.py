"""The n-gram Jaccard join against all pairs."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import partenum


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(texts):
    """doc_id: (n, component) of {doc_id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    having = {}
    for i in sorted(sets):
        for x in sets[i]:
            having.setdefault(x, []).append(i)
    for j in sets:
        common = {}
        for x in sets[j]:
            for i in having[x]:
                common[i] = common.get(i, 0) + 1
        for i, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_words_and_shingles_are_told_apart_at_once():
    rng = random.Random(5)
    letters = ["a", "B", "b", "\0", "\x1c", "\x85", "\xa0", "é", "É", "\u2003", "\U0001f600", "x" * 7, "y" * 8, "z" * 31]
    blanks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    word_of, seen, texts, alone = {}, {}, [], []
    for i in range(400):
        n = rng.choice([0, 1, 2, 4, 5, 6, 40])
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 9]))) for _ in range(n)]
        text = rng.choice(["", *blanks]) + "".join(w + rng.choice(blanks) for w in words)
        text = text if rng.random() < 0.5 else text.rstrip(" \t\n\x0b\x0c\r")
        plain = text.encode().lower().split()
        hashes = partenum.word_hashes(text.encode())[0].tolist()
        assert len(hashes) == len(plain)
        for w, h in zip(plain, hashes, strict=True):
            assert word_of.setdefault(w, h) == h
        assert len(partenum.shingle_set(text.encode())) == len(shingles(text))
        texts.append(text.encode())
        alone.append(partenum.shingle_set(texts[-1]).tobytes())
        seen.setdefault(frozenset(shingles(text)), set()).add(alone[-1])
    assert [s.tobytes() for s in partenum.shingle_sets(texts)] == alone
    assert len(set(word_of.values())) == len(word_of) > 1000 and max(map(len, word_of)) > partenum.LONG
    assert all(len(s) == 1 for s in seen.values()) and len({next(iter(s)) for s in seen.values()}) == len(seen)


def test_a_text_costs_no_call_a_word(monkeypatch):
    calls = []
    real = partenum.xxhash.xxh64_intdigest
    monkeypatch.setattr(partenum.xxhash, "xxh64_intdigest", lambda *a: calls.append(1) or real(*a))
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    assert len(partenum.shingle_set(text)) == 4996 and not calls


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_similar_sets_share_a_signature_or_have_none_to_spare():
    rng = np.random.default_rng(3)
    for size in [4, 5, 6, 7, 8, 9, 10, 12, 13, 16, 18, 19, 27, 28, 50, 100, 210, 211, 400, 1000]:
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            most = size // 4  # differing elements: some are left out, others come in
            out = int(rng.integers(0, most + 1))
            b = np.concatenate((a[out:], rng.integers(0, 1 << 63, max(0, int(rng.integers(0, most - out + 1))), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if 5 * common < 4 * (len(a) + len(b) - common) or len(b) < 4:
                continue
            assert np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size


def test_slack_is_a_lower_bound(spark):
    sizes = list(range(4, 2000)) + [10_000, 99_999]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", partenum.slack(F.col("n")).alias("s")).collect()
    for r in rows:
        assert r["s"] <= min(2 * partenum.groups_of(a) - a // 4 for a in range(-(-4 * r["n"] // 5), r["n"] + 1))


def changed(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"n{rng.random()}"
    return w


@pytest.mark.parametrize("small", [8, 1])
def test_families_passages_and_chains(spark, small, monkeypatch):
    monkeypatch.setattr(partenum, "SMALL", small)
    monkeypatch.setattr(partenum, "BUCKET", 3000)
    monkeypatch.setattr(partenum, "HOT", 5)
    rng = random.Random(small)
    word = lambda: f"w{rng.randrange(5000)}"
    texts, passage = [], [word() for _ in range(40)]
    for size in (6, 8, 9, 12, 20, 40, 60, 130, 300):
        base = [word() for _ in range(size)]
        texts += [base[:i] + base[i + 1 :] for i in (0, size // 2)]
        texts += [changed(rng, base, rng.randint(0, max(1, size // 60))) for _ in range(20)]
        for _ in range(8):  # a chain: each a few words from the one before
            base = changed(rng, base, 1)[rng.randint(0, 1) :]
            texts.append(base)
    texts += [[word() for _ in range(30)] + passage + [word() for _ in range(rng.randint(5, 60))] for _ in range(60)]
    texts += [passage + [word()] * rng.randint(0, 9) for _ in range(30)]
    texts += [["a", "b"], ["A", "b"], ["a"], [], [], ["x"] * 9, ["x"] * 30] + [texts[30]] * 200
    rng.shuffle(texts)
    docs = {i: " ".join(w) for i, w in enumerate(texts)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    want = plain(docs)
    assert got(partenum.jaccard_groups(df)) == want
    assert 20 < len({c for _, c in want.values()}) < len(want) - 100


def test_odd_rows(odd, none):
    out = partenum.jaccard_groups(odd)
    by = got(out)
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == by[5] == by[6] == (1, 4) and by[7] == by[8] == (3, 7)
    assert by[None] == (1, None) and by[10] == (1, 10) and out.count() == odd.count()
    assert partenum.jaccard_groups(none).count() == 0
    named = odd.selectExpr("concat('d', lpad(doc_id, 3, '0')) AS doc_id", "text", "n_chars AS node", "h AS label")
    assert got(partenum.jaccard_groups(named))["d008"] == (3, "d007")


def test_buckets_of_the_same_few_sets_leave_once():
    few, wide, marked = [7, 3, 9], list(range(20, 29)), [3, 7]
    rows = [(s, r) for s in range(50) for r in few] + [(60, r) for r in wide + wide[:2]] + [(61, r) for r in [*marked, partenum._SUMMARY]] + [(62, 5)]
    sig, ref = np.array([r[0] for r in rows], np.uint64) << np.uint64(1), np.array([r[1] for r in rows], np.uint32)
    table = pa.table([pa.array([sig.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()]), pa.array([ref.tobytes()])], ["sig", "ref"])
    out = partenum._shared((pa.scalar(0),), table, 8).to_pylist()
    assert [np.frombuffer(r["few"], np.uint32).tolist() for r in out if r["few"]] == [[3, 7, 9]]
    assert sorted((r["sig"] // 2, r["ref"], r["whole"]) for r in out if not r["few"]) == [(60, r, True) for r in wide] + [(61, r, False) for r in marked]
    pairs = pa.Table.from_batches(partenum._pairs_of(iter([pa.RecordBatch.from_arrays([pa.array([r["few"] for r in out if r["few"]])], ["few"])])))
    assert [tuple(r.values()) for r in pairs.to_pylist()] == [(3, 7), (3, 9), (7, 9)]
    below = partenum._shared((pa.scalar(-1),), table, 8).to_pylist()  # all are shared with rows elsewhere
    assert not any(r["few"] or r["whole"] for r in below) and len(below) == 150 + 9 + 2 + 1


def tile(rows):
    """What ``_near_tiles`` makes of rows (sig, p, q, side, node, c, n, sketch) in batches of 7."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    table = pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["sig", "p", "q", "side", "node", "c", "n", "sketch"])
    return [tuple(r.values()) for b in partenum._near_tiles(iter(table.to_batches(7))) for r in b.to_pylist()]


def test_sets_that_share_many_buckets_meet_once(spark):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(6):  # families of five that share 95 of 100 elements
        base = rng.integers(0, 1 << 63, 105, dtype=np.uint64)
        sets += [np.unique(np.delete(base, np.arange(k, k + 5))) for k in range(0, 25, 5)]
    row = lambda sig, i, side=0: (sig, 0, int(side > 0 or sig > 90), side, 10 * i, i, len(sets[i]), partenum.sketch_of(sets[i]).tolist())
    rows = [row(sig, i) for sig in range(80) for i in range(30) if (i * 7 + sig) % 10]
    rows += [row(95, i, int(i % 5 == 4)) for i in range(30)]  # two sides: the last of each family meets the others
    out = set(tile(rows))
    near = {(a, b) for a in range(30) for b in range(a) if a // 5 == b // 5}
    joined = {frozenset((r[0] // 10, r[1] // 10)) for r in out}
    assert {r[0] // 10 for r in out} == set(range(30)) and all(a // 5 == b // 5 for a, *b in map(sorted, joined) for b in b)
    got = partenum._families(spark.createDataFrame(sorted(out), "node long, anchor long, c long, n long")).collect()  # of 2 190 rows in buckets
    assert sorted((r["th"], r["c"], r["size"]) for r in got) == [(10 * i, i, len(s)) for i, s in enumerate(sets)]
    key = {r["th"] // 10: r["key"] for r in got}
    assert all(key[a] == key[b] for a, b in near) and len(set(key.values())) == 6


def test_shuffle_files_go_as_soon_as_they_are_read(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    docs = {i: " ".join(changed(rng, base if i % 2 else base[::-1], i % 5)) for i in range(60)}
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.split("_")[1] for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    kept = spark.conf.get(key)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    out = partenum.jaccard_groups(df)
    # A stage that a plan turned out not to need may end after it and leave its own.
    assert len(files() - before) <= 3 and spark.conf.get(key) == kept
    assert got(out) == plain(docs)
