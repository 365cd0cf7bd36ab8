"""How far the sources of a language differ in their terms, by inclusion and exclusion over supports.

For sources g and h with shares p of a term, f(p_g, p_h) summed over all V kept terms is split by who has the term. A share
depends on the count alone, so that what g pays against an absent h needs only g's histogram of counts, and what both pay where
neither has a term is one constant times V:

    sum = V * f00 + sum over g's counts of (f(p_g, 0) - f00) + the same for h + sum over common terms of (f(p_g, p_h) - f(p_g, 0) - f(0, p_h) + f00)

with 0 for the share of an absent term and f00 = f(0, 0). Only the last sum needs the postings of both, in a join by term.

Plan: words become counts a few MB of text at a time, exactly, by Arrow's dictionaries; all from there on is long arithmetic in
Spark. Postings are summed on their key before they move, so a source or a word of a third of all rows is a few rows a task. No
side is broadcast unless Spark itself finds it small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, table
from .memory import lean

LEAST_DOCS, TOP = 10, 10
#: Bytes of text counted at a time.
PIECE = 4 << 20
#: Bytes of terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
TERM = np.ones(256, dtype=bool)
TERM[:0x41] = TERM[0x5B:0x61] = TERM[0x7B:0x80] = False
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS_SQL = "lang string, source string, term string, n long, docs long"
GROUP = ["lang", "source"]


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each lang, source and term of a batch: occurrences, and documents that have it."""
    words = K.Spans(batch.column("text"), TERM, lower=True)
    terms = words.strings().dictionary_encode()
    size = max(1, len(terms.dictionary))
    key, n = np.unique(words.rows() * size + terms.indices.to_numpy(), return_counts=True)
    groups = pa.StructArray.from_arrays([batch.column(c) for c in GROUP], GROUP)
    of, first = {}, []
    rows = np.array([of.setdefault((g["lang"], g["source"]), len(of)) for g in groups.to_pylist()], dtype=np.int64)
    first = list(of)
    key = rows[key // size] * size + key % size if len(key) else key
    order = np.argsort(key, kind="stable")
    at = K.edges(key[order])
    own = key[order][at]
    langs, sources = (pa.array([g[k] for g in first], pa.string()).take(pa.array(own // size)) for k in (0, 1))
    sums = np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([langs, sources, terms.dictionary.take(pa.array(own % size)).cast(pa.string()), pa.array(sums, pa.int64()), pa.array(np.diff(np.append(at, len(order))), pa.int64())], schema=COUNTS)


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.pieces(batch, "text", PIECE):
            yield _counted(piece)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for totals to 9 * 10^15: long division, three digits at a time."""
    rest, all_ = n + 2, total + 2 * terms
    out = F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, all_)
        rest = rest * 1000 % all_
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1."""
    return _div((p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source; others unread).

    Part `pair` has for each source of a language every other one, with the gap summed over all terms that at least least_docs
    documents of the language have. Part `term` has the terms whose share in the source is above that in the language, the top
    ones of them. Ranks follow value, largest first, then item in the order of UTF-8 bytes.

    A null text, language or source is read as an empty one. Rows that repeat whole are documents of their own. A group without
    terms still is a group; without kept terms in its language all its values are 0. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *GROUP)])
    groups = docs.select(*GROUP).distinct()
    counts = docs.mapInArrow(_count, COUNTS_SQL).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"all_n": F.sum("n").over(every), "all_docs": F.sum("docs").over(every)}).where(F.col("all_docs") >= least_docs)
    kept = scratch.write(kept.select(*GROUP, "term", "n", "all_n"))

    terms = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("all_total"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    sizes = groups.join(terms, "lang", "left").join(totals, GROUP, "left").select(*GROUP, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terms", "total", "all_total")])
    none = F.lit(0).cast("long")
    # Without kept terms there is no share, and nothing to sum.
    sizes = scratch.write(sizes.withColumn("zero", F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms")))))
    posts = kept.join(sizes, GROUP).select(*GROUP, "term", "n", "zero", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("terms")).alias("q"))

    side = lambda d, s, *more: d.select("lang", *more, *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in ("lang", *more)])
    met = side(sizes.select(*GROUP, "terms", "zero"), "a").join(side(sizes.select(*GROUP, "zero"), "b"), "lang").where("source_a <> source_b")
    met = scratch.write(met.select("lang", "source_a", "source_b", "zero_a", "zero_b", F.col("terms_a").alias("terms"), gap(F.col("zero_a"), F.col("zero_b")).alias("f00")))
    pair = [F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b")]
    neither = met.where("source_a < source_b").select("lang", *pair, (F.col("terms") * F.coalesce("f00", none)).alias("v"))
    # A source's different counts are at most the root of twice its words.
    histogram = posts.groupBy(*GROUP, "n", "p").agg(F.count("*").alias("m")).select("lang", F.col("source").alias("source_a"), "p", "m")
    one = met.join(histogram, ["lang", "source_a"]).select("lang", *pair, (F.col("m") * (gap(F.col("p"), F.col("zero_b")) - F.col("f00"))).alias("v"))
    a, b = (side(posts.select(*GROUP, "term", "p", "zero"), s, "term") for s in "ab")
    p, q, x, y = (F.col(c) for c in ("p_a", "p_b", "zero_a", "zero_b"))
    both = a.join(b, ["lang", "term"]).where("source_a < source_b").select("lang", "source_a", "source_b", (gap(p, q) - gap(p, y) - gap(x, q) + gap(x, y)).alias("v"))
    sums = [d.groupBy("lang", "source_a", "source_b").agg(F.sum("v").alias("v")) for d in (neither, one, both)]
    value = sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy("lang", "source_a", "source_b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = value.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    ranked = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    above = posts.where("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
z AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (z.total + 2 * v.terms) AS p, 1 + (1000000000 * (k.n + 2)) // (v.total + 2 * v.terms) AS q
      FROM z JOIN k ON z.lang = k.lang JOIN v ON v.lang = k.lang LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
