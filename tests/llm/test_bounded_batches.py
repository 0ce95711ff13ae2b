"""Rows leave and enter Python tasks in small batches, with the same results."""

import pyarrow as pa

import corpus_pipeline
from barloom.llm import packing, toxicity

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def held(monkeypatch, df, call):
    """The function that ``call`` hands to mapInArrow."""
    caught = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: caught.append(f) or self)
        call(df)
    return caught[0]


def test_pieces_and_features_leave_in_small_batches(spark, monkeypatch):
    rows = [(i, "some words and more " * (i % 7)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    for call, most in ((packing.pieces, packing.DOCUMENTS), (lambda d: toxicity.with_features(d, {"words": 1.0}), toxicity.DOCUMENTS)):
        run = held(monkeypatch, df, call)
        out = list(run(iter([whole])))
        assert max(b.num_rows for b in out) <= most and sum(b.num_rows for b in out) == len(rows)
        with monkeypatch.context() as m:
            m.setattr(packing, "DOCUMENTS", 5000)
            m.setattr(toxicity, "DOCUMENTS", 5000)
            (once,) = run(iter([whole]))
        assert pa.Table.from_batches([once]) == pa.Table.from_batches(out).combine_chunks()


def test_stages_bound_their_batches(spark, odd):
    before = spark.conf.get(NAME)
    try:
        for now, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            spark.conf.set(NAME, now)
            corpus_pipeline.exact(spark, odd, "")
            assert spark.conf.get(NAME) == want
    finally:
        spark.conf.set(NAME, before)
