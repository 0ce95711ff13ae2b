"""Periodic runs against a plain search over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import periodic


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e > s and e - s + q >= max(6, 4 * q):
                out.setdefault((s, e - s + q), q)
            s = max(e, s) + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_row(doc_id, text):
    w = plain_words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return doc_id, len(runs), s, length, q, q and 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_cover():
    c = periodic.COVER
    assert {(a - b) % periodic.MODULUS for a in c for b in c} == set(range(periodic.MODULUS))


@pytest.mark.parametrize("kinds", [1, 2, 3, 50])
def test_extension(kinds):
    rng = np.random.default_rng(kinds)
    x = np.append(rng.integers(0, kinds, 700), kinds)
    x[200:400] = x[:200]
    got = periodic.Extension(x)
    i, j = rng.integers(0, 701, (2, 3000))
    i, j = i[i != j], j[i != j]
    assert got(i, j).tolist() == [next(t for t in range(701) if a + t > 700 or b + t > 700 or x[a + t] != x[b + t]) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize("seed", range(6))
def test_random_documents(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(120):
        w = []
        while len(w) < rng.randint(0, 300):
            part = [rng.randint(0, rng.choice((0, 1, 2, 9))) for _ in range(rng.randint(1, 12))]
            w += (part * rng.choice((1, 1, 3, 4, 5, 9)))[: rng.randint(1, 200)]
        docs.append(np.array(w, np.int64))
    got = periodic.runs_of(docs)
    assert [list(map(tuple, r.tolist())) for r in got] == [plain_runs(d.tolist()) for d in docs]


def test_one_word_a_hundred_thousand_times():
    n = 100_000
    assert periodic.runs_of([np.zeros(n, np.int64)])[0].tolist() == [[0, n, 1]]
    assert periodic.runs_of([np.arange(n) % 25_000])[0].tolist() == [[0, n, 25_000]]
    fib = [0, 1]
    while len(fib) < 3000:
        fib = fib + fib[: len(fib) // 2]
    assert list(map(tuple, periodic.runs_of([np.array(fib)])[0].tolist())) == plain_runs(fib)


def test_query(spark, sf, documents):
    got = sorted(tuple(r) for r in periodic.op12_periodic_runs(spark, sf).collect())
    assert got == sorted(plain_row(r["doc_id"], r["text"]) for r in documents)
    assert sum(r[1] > 0 for r in got) > len(got) / 20


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in periodic.periodic_runs(odd).collect()}
    assert periodic.periodic_runs(odd).count() == odd.count() and periodic.periodic_runs(none).count() == 0
    assert [tuple(r) for r in got[7]["runs"]] == [(0, 60_000, 3)] and got[7]["collapsed"] == "wort und satz"
    assert got[1]["runs"] == [] and got[1]["collapsed"] == "" and got[1]["n_words"] == 0 and got[3]["collapsed"] == ""
    assert got[6]["collapsed"] == "Same text here" and got[None]["collapsed"] == "no id at all"
    rows = {r["doc_id"]: r["text"] for r in periodic.planted(odd).collect()}
    for r in odd.collect():
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10:
            assert rows[r["doc_id"]] == r["text"]


def test_equal_steps_without_a_run():
    a = [*range(8), 0, *range(10, 17), 0, *range(20, 27), 0, *range(30, 37)]  # word 0 at 0, 8, 16 and 24, no run
    b = [*range(40, 52)]
    assert plain_runs(a) == plain_runs(b) == []
    assert [r.tolist() for r in periodic.runs_of([np.array(a), np.array(b)])] == [[], []]
