"""Language ID, nearest neighbours, secret scan, toxicity, pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import language_id, nearest, secret_scan, toxicity


def test_language_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in language_id.op1_language_id(spark, sf).collect()}
    assert len(rows) == len(documents) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    judged = [rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in documents if rows[d["doc_id"]]["held_out"] and d["lang"] and len(d["text"]) > 20]
    assert np.mean(judged) > 0.97


def test_language_odd_rows(spark, odd, none):
    model = language_id.fit(odd, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[7] == "de" and got[10] in model.langs
    assert language_id.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(none, F.lit(True))).collect()} == {"und"}


def test_code_lengths_are_those_of_the_tree():
    texts = {"a": b"abra cadabra abra", "b": b"banana bandana ananas"}
    grams, counts = [], []
    for t in texts.values():
        code, sym, _ = language_id._contexts([t])
        g, n = np.unique(code.astype(np.int64) * language_id.A + sym, return_counts=True)
        grams.append(g)
        counts.append(n)
    model = language_id.Ppm(list(texts), grams, counts, least=1)

    def plain(train, text):
        c = [0, 0, 0, *language_id.CLASS[list(train)].tolist()]
        seen = Counter((tuple(c[i - k : i]), c[i]) for i in range(3, len(c)) for k in range(4))
        x, bits = [0, 0, 0, *language_id.CLASS[list(text)].tolist()], 0.0
        for i in range(3, len(x)):
            p = 1.0
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    p /= language_id.A
                    break
                near = {s: n for (ctx, s), n in seen.items() if ctx == tuple(x[i - k : i])}
                total = sum(near.values()) + len(near)
                if x[i] in near:
                    p *= near[x[i]] / total
                    break
                p *= len(near) / total if near else 1
            bits -= np.log2(p)
        return bits

    for text in (b"abracadabra", b"bandanas are blue", b""):
        got = model.code_lengths(model.rows(), [text, b"zz", text])
        assert np.allclose(got[0], [plain(t, text) for t in texts.values()], rtol=1e-5) and np.allclose(got[0], got[2])


def brute_nearest(rows, k=10):
    ok = {i: np.array(e, float) for i, e in rows if e is not None and None not in e and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float))}
    for q in ok:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(np.cumsum((ok[q] - v) ** 2)[-1])), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            yield from ((q, n, i, s) for n, (s, i) in enumerate(found, 1))


def test_nearest_query(spark, sf, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES_PER_BLOCK", 2)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in nearest.op7_nearest(spark, sf).collect()) == sorted(brute_nearest(rows))


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (100, [5.0, 5.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(df, df.where("vec_id % 100 = 0"), 2).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (100, 1, 1), (100, 2, 2)]
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_secret_scan(spark, sf, documents):
    rows = secret_scan.op8_secret_scan(spark, sf).collect()
    want = Counter()
    for d in documents:
        for m in re.finditer(r"(?i)token = \"([0-9a-f]{40})\"", d["text"] or ""):
            want[(d["doc_id"], m.start(1), hashlib.sha256(m[1].encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["start"], r["candidate_sha256"]) for r in rows if r["is_secret"])
    assert want and not want - got
    assert sum((got - want).values()) <= 0.05 * sum(want.values()) + 2


def test_forest_on_kinds_that_it_never_saw(spark, sf):
    words = secret_scan.dictionary(spark.read.parquet(f"{sf}/documents.parquet"))
    made = secret_scan.made_labels(spark, words, each=100)
    assert made.count() == 100 * len(secret_scan.KINDS) and sorted(made.limit(50).collect()) == sorted(secret_scan.made_labels(spark, words, each=100).limit(50).collect())
    model = secret_scan.fit(made.where("NOT held_out"), words)
    rows = secret_scan.judge(made.where("held_out").withColumnRenamed("is_secret", "truth"), model, words).collect()
    hits = sum(r["truth"] == 1 and r["is_secret"] for r in rows)
    assert hits / sum(r["truth"] for r in rows) >= 0.9 and hits / sum(r["is_secret"] for r in rows) >= 0.9


def test_secret_findings_are_all_occurrences(spark, odd, none):
    docs = spark.createDataFrame([(1, "key abcdefgh12345678 abcdefgh12345678x abcdefgh12345678"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["candidate"]) for r in secret_scan.findings(docs).collect())
    assert got == [(1, 4, "abcdefgh12345678"), (1, 21, "abcdefgh12345678x"), (1, 39, "abcdefgh12345678")]
    texts = ["token=abcdefgh12345678", "my password = \"hunter2x\" and Secret: ab$c!d%e, pwd=abc", "api_key:'x1y2' tokens : a-b-c-d", "a=\"abcdefgh12345678===\" é=ABCDEFGH12345678abcdefgh", "é" * 60 + " ABCDEFGH12345678==x" * 5 + "\nß", "abcdefgh12345678" * 9, "=" * 40]
    got = secret_scan.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(secret_scan.CANDIDATE, t):
            name = re.match(secret_scan.PREFIX + r"(?=[^\s\"'`]{4})", m[0])
            at = m.start() + (name.end() if name else 0)
            want.append((i, at, t[at : m.end()], t[max(0, at - secret_scan.CONTEXT) : at], t[m.end() : m.end() + secret_scan.CONTEXT]))
    assert sorted(tuple(r) for r in got) == want and {"hunter2x", "ab$c!d%e,", "x1y2", "a-b-c-d"} <= {w[2] for w in want}
    assert secret_scan.scan(none).count() == 0
    assert secret_scan.scan(odd).count() == secret_scan.findings(odd).count()
    assert all(r["is_secret"] for r in secret_scan.scan(docs, docs.limit(0).selectExpr("text candidate", "text before", "text after", "1.0 is_secret")).collect())


def test_toxicity_query(spark, sf, documents):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    found = [rows[i]["predicted"] for i, t in labels.items() if t == 1 and i in rows]
    wrong = [rows[i]["predicted"] for i, t in labels.items() if t == 0 and i in rows]
    assert np.mean(found) > 0.7 and np.mean(wrong) < 0.02


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    out = toxicity.score(odd, model)
    assert out.columns == [*odd.columns, "__score"] and out.count() == odd.count()
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(odd, labels.limit(0), F.lit(True))
    assert {r["__score"] for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert len(toxicity.features("", {})) == len(toxicity.FEATURES)


def test_toxicity_reaches_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    docs = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    out = toxicity.score(docs, toxicity.fit(docs.drop("toxic"), labels, ~toxicity.held_out(F.col("doc_id")))).where(toxicity.held_out(F.col("doc_id")))
    rows = out.select("lang", "toxic", (F.col("__score") >= toxicity.THRESHOLD).alias("said")).collect()
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([r["said"] for r in rows if r["lang"] == lang and r["toxic"]]) >= 0.9, lang
        assert np.mean([r["said"] for r in rows if r["lang"] == lang and not r["toxic"]]) < 0.01, lang


def test_disguised_words_count():
    at = toxicity.FEATURES.index("disguised")
    lexicon = {"idiot": 2.0, "clown": 2.0}
    assert toxicity.features("you 1d10t and i.d.i.o.t and cloooown here", lexicon)[at] == pytest.approx(np.log1p(3))
    assert toxicity.features("you " + "i.d.i.o.t" + "." * 60 + " here", lexicon)[at] == pytest.approx(np.log1p(1))
    assert toxicity.features("you idiot", lexicon)[toxicity.FEATURES.index("near_second_person")] == 1


def test_pipeline(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        kept = [r.asDict() for r in after.collect()]
        if name == "exact_dedup":
            texts = Counter(r["text"] for r in kept)
            assert max(texts.values()) == 1 and texts.keys() == {r["text"] for r in before.collect()}
        before = spark.createDataFrame(kept, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}


def test_pipeline_odd_rows(spark, sf, odd, none):
    """Every stage takes nulls, repeated rows, very long texts, an empty table and clashing columns, and hands on the columns of its input."""
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == odd.columns, name
            docs = spark.createDataFrame([tuple(r) for r in after.collect()], odd.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
