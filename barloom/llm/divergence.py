"""Source divergence audit: chi-square-like distances between the sources of a language by Gustavson row accumulation.

Every (lang, source) group gives each kept term of its language a smoothed share in parts of 1e9. The term-major index
holds, per term, the sources that use it and how often. A block of that index works row by row: a group scatters its
terms through the index into an accumulator with one place per peer, so no pair of postings becomes a row. Terms that
one or both sides lack are worked out from the shares of a count of zero: the whole baseline once, and a correction
for each distinct count of either side.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored, table

#: Documents of a language that a kept term occurs in; places of the term report.
LEAST_DOCS, TOP = 3, 200
#: Postings that one block of the index holds, before the square of the sources asks for more.
BLOCK_POSTINGS, MOST_POSTINGS = 20_000, 4_000_000
#: Distinct (group, term) entries that a task counts before it hands them on.
HELD = 300_000
SCALE = 1_000_000_000
#: Bytes of a term (letters and everything beyond ASCII), A-Z lower-cased; every other byte parts terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included."""
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents that hold it); null text, lang and source are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d = defaultdict(Counter), defaultdict(Counter)

        def flushed() -> pa.RecordBatch:
            rows = [(lang, source, term, c, d[lang, source][term]) for (lang, source), own in n.items() for term, c in own.items()]
            lang, source, term, c, held = zip(*rows, strict=True)
            n.clear(), d.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            cols = [pa.array(x, k) for x, k in zip((lang, source, term, c, held), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*cols[:2], cols[2].cast(pa.string()), *cols[3:]], ["lang", "source", "term", "n", "d"])

        seen = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = terms_of(text.as_buffer().to_pybytes())
                own, key = set(words), (lang, source)
                before = len(n[key])
                n[key].update(words)
                d[key].update(own)
                seen += len(n[key]) - before
                if seen > HELD:
                    yield flushed()
                    seen = 0
        if seen:
            yield flushed()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = docs.select(blank("lang"), blank("source"), blank("text").cast("binary")).mapInArrow(run, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share_sql(n: str, whole: str) -> str:
    """1 + floor(1e9 (n + 1) / whole) in 64 bits, three digits at a time."""
    rest, out = f"({n} + 1)", []
    for power in (1_000_000, 1000, 1):
        out.append(f"(({rest} * 1000) div {whole}) * {power}L")
        rest = f"(({rest} * 1000) % {whole})"
    return "1 + " + " + ".join(out)


def share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    rest, out = n + 1, np.zeros_like(whole + n)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def accumulate(ends: np.ndarray, peer: np.ndarray, n: np.ndarray, total: np.ndarray, v: int) -> Iterator[np.ndarray]:
    """For each group in turn its accumulator over all peers, for one block of the term-major index.

    Postings of term k are ``peer`` and ``n`` from ends[k] to ends[k + 1]; ``total`` are the groups' counts of kept terms.
    """
    whole = total + v
    zero = share(np.zeros_like(total), whole)
    p = share(n, whole[peer])
    term = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    by_group = np.argsort(peer, kind="stable")
    starts = np.searchsorted(peer[by_group], np.arange(len(total) + 1))
    # Distinct (peer, share): all that a group must know of the terms which it lacks itself.
    order = np.lexsort((p, peer))
    first = np.flatnonzero(np.concatenate(([True], (np.diff(peer[order]) != 0) | (np.diff(p[order]) != 0)))) if len(p) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(p)))
    seen_by, seen = peer[order][first], p[order][first]
    for g in range(len(total)):
        base = gap(zero[g], zero)
        acc = np.zeros(len(total), np.int64)
        np.add.at(acc, seen_by, times * (gap(zero[g], seen) - base[seen_by]))
        mine = by_group[starts[g] : starts[g + 1]]
        own, often = np.unique(p[mine], return_counts=True)
        for at in range(0, len(own), 512):
            part = own[at : at + 512, None]
            acc += (often[at : at + 512, None] * (gap(part, zero[None, :]) - base)).sum(axis=0)
        size = (ends[1:] - ends[:-1])[term[mine]]
        reach = np.repeat(ends[term[mine]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pg, h, q = np.repeat(p[mine], size), peer[reach], p[reach]
        np.add.at(acc, h, gap(pg, q) - gap(pg, zero[h]) - gap(zero[g], q) + base[h])
        yield acc


def _block(key: tuple, index: pa.Table, groups: pa.Table) -> pa.Table:
    lang, block = (k.as_py() for k in key)
    groups = groups.sort_by("g")
    g, total, v = groups.column("g").to_numpy(), groups.column("total").to_numpy(), int(groups.column("v")[0].as_py())
    postings = index.column("postings").combine_chunks()
    if isinstance(postings, pa.ChunkedArray):
        postings = pa.concat_arrays(postings.chunks) if postings.num_chunks else pa.array([], index.schema.field("postings").type)
    ends = np.concatenate(([0], np.cumsum(postings.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = postings.flatten()
    peer, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    zero = share(np.zeros_like(total), total + v) if v else None
    out = []
    for i, acc in enumerate(accumulate(ends, peer, n, total, v) if v else (np.zeros(len(total), np.int64) for _ in g)):
        if block == 0 and v:
            acc = acc + v * gap(zero[i], zero)
        out.append(acc)
    k = len(g)
    return pa.table([pa.array([lang] * (k * k), pa.string()), pa.array(np.repeat(g, k)), pa.array(np.tile(g, k)), pa.array(np.concatenate(out))], ["lang", "g", "h", "v"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank for every (lang, source) of ``docs``.

    ``pair``: each other source of the language with the summed gap to it; ``term``: the ``top`` terms that the group uses
    more than its language. Null text, lang and source are ''; a group without kept terms still has its pairs, of value 0
    where the language keeps no term; the only source of a language has none. Repeated rows count as often as they occur.
    An empty table gives an empty table; doc_id and other columns aren't read. Sums need 64 bits while a group has
    under 9e15 terms. One task holds the source names and totals of one language, and one accumulator of as many places.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    names = docs.select(blank("lang"), blank("source")).distinct()
    names = stored(names.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "groups")
    n_names = names.count()
    few = lambda df: sized(df, n_names)
    counts = term_counts(docs).join(few(names), ["lang", "source"])
    index = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "n")).alias("postings"), F.sum("n").alias("all"), F.sum("d").alias("held"))
    index = stored(index.where(F.col("held") >= least_docs).select("lang", "term", "all", "postings"), "index")
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("all_n"), F.sum(F.size("postings")).alias("held"))
    totals = index.select("lang", F.inline("postings")).groupBy("lang", "g").agg(F.sum("n").alias("total"))
    widths = names.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    langs = widths.join(langs, "lang", "left").na.fill(0, ["v", "all_n", "held"])
    room = F.least(F.greatest(F.lit(BLOCK_POSTINGS), F.col("s") * F.col("s")), F.lit(MOST_POSTINGS))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("held") / room)).cast("long")).drop("s", "held")
    groups = names.join(totals, ["lang", "g"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = stored(groups, "totals")
    langs = few(groups.select("lang", "v", "all_n", "blocks").distinct())

    left = index.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "postings")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "g", "total", "v")
    met = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block"))
    met = met.applyInArrow(_block, "lang string, g long, h long, v long").where("g <> h").groupBy("lang", "g", "h").agg(F.sum("v").alias("value"))
    other = names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = met.join(few(names), ["lang", "g"]).join(few(other), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    used = index.select("lang", "term", "all", F.inline("postings")).join(few(groups), ["lang", "g"])
    used = used.withColumn("p", F.expr(share_sql("n", "(total + v)"))).withColumn("q", F.expr(share_sql("all", "(all_n + v)"))).where("p > q")
    term = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    # The bound on the rank reaches below the shuffle: each task keeps its own first places only.
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked(pairs).union(ranked(term).where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
    FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 200
"""
