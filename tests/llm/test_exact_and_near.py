"""Exact dedup, SimHash near-dedup, components and line dedup against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from barloom.llm import exact_dedup, jaccard, line_dedup, simhash
from barloom.llm.common import text_hash
from barloom.llm.components import components, stars


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        ((r["doc_id"], keep[r["text"] or ""], len(groups[r["text"] or ""]), r["doc_id"] == keep[r["text"] or ""], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows), key=str
    )


def test_exact_query(spark, sf, documents):
    got = sorted((tuple(r) for r in exact_dedup.op9_exact_dedup(spark, sf).collect()), key=str)
    assert got == brute_exact(documents)


def test_exact_odd_rows(odd, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(odd).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 5, 2), (5, 5, 2), (6, 6, 1), (7, 8, 2), (8, 8, 2), (None, None, 1), (9, 9, 1), (10, 10, 2), (11, 11, 1)}
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.drop_exact(odd)
    ids = sorted(str(r["doc_id"]) for r in left.collect())
    assert left.columns == odd.columns and ids == sorted(map(str, (2, 3, 5, 6, 8, None, 9, 10, 11)))
    twice = odd.where("doc_id IS NULL OR doc_id = 4")
    assert sorted(str(r["doc_id"]) for r in exact_dedup.drop_exact(twice.union(twice)).collect()) == ["4", "None"]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.may_contain(keys, *built).all()
    assert exact_dedup.may_contain(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64), *built).mean() < 0.01
    if n >= 5000:
        assert len(built[3]) < 1.35 * n


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """fps: {doc_id: fingerprint}; the smallest id that each reaches over links of at most two bits."""
    ids = sorted(fps)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in ids}


def test_simhash_query(spark, sf, documents):
    want = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents}
    groups = brute_groups(want)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp:016x}", groups[i]) for i, fp in want.items()}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("hot_key", [50_000, 3])
def test_trie_links_keep_reachability(spark, hot_key):
    rng = random.Random(5)
    fps = {}
    for _ in range(12):  # dense groups: the same upper half, chains of one and two changed bits
        x = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                x ^= 1 << b
            fps[len(fps)] = x
    fps |= {len(fps) + i: rng.getrandbits(64) for i in range(100)}
    ids = {v: k for k, v in reversed(fps.items())}
    rows = [(int(np.uint64(v).astype(np.int64)), i) for v, i in ids.items()]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), hot_key)
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    want = brute_groups({i: v for v, i in ids.items()})
    assert {i: label.get(i, i) for i in want} == want


def test_near_odd_rows(odd, none):
    got = simhash.near_groups(odd)
    by = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 7), (None, None), (10, 10)} <= by and got.count() == odd.count()
    assert simhash.near_groups(none).count() == 0
    left = simhash.drop_near(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 4, 7, None, 9, 10, 11}


def test_near_stage_finds_similar_shingles(spark, sf, documents):
    def plain(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(96)]
    near = [x if i not in (30, 60) else "changed" for i, x in enumerate(base)]
    far = [x if i % 10 else "other" for i, x in enumerate(base)]
    made = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (None, " ".join(near[:-1]))], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near(made).collect()} == {1, 3}
    sets, by = {d["doc_id"]: plain(d["text"]) for d in documents}, defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    met = {p for ids in by.values() if len(ids) < 40 for p in combinations(sorted(ids), 2)}
    want = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in simhash.drop_near(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert want and not [p for p in want if kept >= set(p)]


@pytest.mark.parametrize("sides", [None, 7])
def test_dense_groups_lose_no_link(spark, monkeypatch, sides):
    """A text with 40 copies that differ too much from one another, chains of edits, and texts that share half of their words."""
    if sides:
        monkeypatch.setattr(jaccard, "TILE_TEXTS", sides)
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    edited = lambda base, n: [f"x{rng.randrange(9000)}" if i in at else x for at in [rng.sample(range(len(base)), n)] for i, x in enumerate(base)]
    base, passage, chain = words(120), words(60), [words(120)]
    for _ in range(25):
        chain.append(edited(chain[-1], 2))
    made = [base, *(edited(base, 2) for _ in range(40)), *chain, *(passage + words(40) for _ in range(40))]
    sets = [frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in made]
    label = {i: i for i in range(len(made))}
    for _ in range(len(made)):
        before = dict(label)
        for i, j in combinations(label, 2):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(made)], "doc_id long, text string")
    ids = {r["th"]: r["doc_id"] for r in docs.select("doc_id", text_hash(docs["text"]).alias("th")).collect()}
    edges = [(ids[r["u"]], ids[r["v"]]) for r in jaccard.similar(docs).collect()]
    assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or label[a] == label[b] for a, b in edges)
    got = stars(len(made), *(np.array(x) for x in zip(*edges, strict=True)))
    assert got.tolist() == [label[i] for i in range(len(made))] and len(set(got.tolist())) < len(made) - 50


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + rng.randrange(1, 300)) for _ in range(400)]
    e = chain + [(b, a) for a, b in star] + [(5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {b: 1000 for _, b in star}


def brute_lines(rows, least=10):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    split = [[(x, key(x)) for x in (r["text"] or "").split("\n")] for r in rows]
    df = defaultdict(int)
    for lines in split:
        for k in {k for _, k in lines if k}:
            df[k] += 1
    for r, lines in zip(rows, split, strict=True):
        kept = [x for x, k in lines if not k or df[k] < least]
        yield r["doc_id"], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_query(spark, sf, documents):
    got = sorted(tuple(r) for r in line_dedup.op4_line_dedup(spark, sf).collect())
    assert got == sorted(brute_lines(documents)) and any(r[2] for r in got)


def test_line_odd_rows(odd, none):
    rows = [r.asDict() for r in odd.collect()]
    out = line_dedup.dedup_lines(odd, min_docs=2, batches=4)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == sorted(brute_lines(rows, 2), key=str)
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("limits", [("FEW_KEYS", 0), ("FEW_KEYS", 2), ("BROADCAST_HASHES", -1)])
def test_lines_by_each_way(spark, sf, odd, documents, monkeypatch, limits):
    monkeypatch.setattr(line_dedup, *limits)
    got = sorted(tuple(r) for r in line_dedup.op4_line_dedup(spark, sf).collect())
    assert got == sorted(brute_lines(documents))
    rows = [r.asDict() for r in odd.collect()]
    out = line_dedup.dedup_lines(odd, min_docs=2, batches=3).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out), key=str) == sorted(brute_lines(rows, 2), key=str)


def test_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2, min_docs=4)
    for k in range(4):
        runs.add(spark.createDataFrame([(k, f"x\nonly {k}")], "doc_id long, text string"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {r["n"] for r in runs.levels[2][0].collect()} == {1, 4}
    assert runs.frequent().count() == 1


def test_settled_keys_leave_later_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2)
    batch = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs.add(batch("x\ny", "x", "z"))
    runs.add(batch("x", "y", "y"))
    assert sorted(r["n"] for r in runs.levels[0][0].collect()) == [1, 1, 2]
    assert [r["n"] for r in runs.levels[0][1].collect()] == [2]  # x is settled and no longer counted
    assert runs.frequent().count() == 2
    counts = runs.levels[0][0].join(runs.levels[0][1].hint("merge"), ["h", "c"], "left_anti")
    assert "SortMergeJoin" in counts._jdf.queryExecution().executedPlan().toString()
