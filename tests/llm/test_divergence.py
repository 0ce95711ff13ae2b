"""The source divergence audit against plain sums of whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    text = lambda x: "" if x is None else x
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text(t).translate(LOWER))
        groups.add((text(lang), text(source)))
        counts[text(lang), text(source)].update(found)
        held[text(lang)].update(set(found))
    out = []
    for lang, source in groups:
        kept = [w for w, d in held[lang].items() if d >= least]
        of = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[k] for k in kept) + len(kept)) for w in kept}
        gap = lambda p, q: (p - q) ** 2 // q
        own, whole = of(counts[lang, source]), of(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            q = of(counts[lang, other])
            pairs.append((sum(gap(own[w], q[w]) for w in kept), other))
        terms = [(gap(own[w], whole[w]), w) for w in kept if counts[lang, source][w] and own[w] > whole[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                out.append((lang, source, part, item, v, i + 1))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least,top", [(1, 3), (3, 200)])
def test_random_corpora(spark, least, top, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 7)  # many blocks
    rng = random.Random(least)
    words = ["".join(rng.choices("abÀé😀ZQ", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice("xyz"), rng.choice(["a", "é", "b", None, ""])) for _ in range(80)]
    rows += [("only one source", "lonely", "s")] * 4 + [("no term kept", "bare", "a"), ("other words", "bare", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.divergence(df, least, top)) == plain(rows, least, top)


def test_one_source_with_a_third_of_all_rows_and_many_sources(spark):
    rng = random.Random(5)
    rows = [("hot words of one source " * 3, "en", "hot")] * 300 + [(f"w{rng.choice('abc')}x words", "en", f"s{i % 150}") for i in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.divergence(df)) == plain(rows)


def test_odd_rows(odd, none):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    got = rows_of(divergence.divergence(odd, 1))
    assert got == plain(rows, 1) and any(r[0] == "" for r in got)
    out = divergence.divergence(none)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_shares_beyond_32_bits():
    n, whole = np.array([0, 5 * 10**12, 10**15 - 1]), np.array([10**15] * 3)
    assert divergence.share(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // 10**15 for x in n]
