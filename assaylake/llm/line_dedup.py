"""Deletion of repeated runs of lines, by a distributed suffix array over line numbers (DataFrame operations only).

Each line that occurs more than once has a number, in hash order; a line that occurs once ends every repeat, so it takes no part.
What stands between such lines, a stretch, is the unit: equal stretches collapse to the first of them, as whatever is in a later one
is a copy, so neither a line that a third of all documents hold nor a group of whole copies is a hot key further on.

Prefix doubling ranks the suffixes of the distinct stretches: a suffix's new rank is its rank by 2^k lines and, among equals, that of the
suffix 2^k lines further on; a rank is that of its first line plus the number of smaller suffixes that begin with it. Only suffixes that
still tie are ranked again, until equal rank means equal to the end of the stretch. Neighbours of the finished array are compared for
their longest common prefix: where it is under `min_lines`, an interval ends. Each interval's members but the first in
document order are later copies, and their lines go; runs of them are the maximal repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: A licence line between lines of a document's own, or a document of one line, is a run too.
MIN_LINES = 1
#: Ranges that numbers are dealt into, so that running sums need no single task over all rows.
RANGES = 4096
DOC, STRETCH = ["d", "th"], ["k1", "k2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r"))) > 0


def _before(df: DataFrame, n: str) -> DataFrame:
    """range, before: the sum of n over all earlier ranges, of at most RANGES + 1 rows."""
    sums = df.groupBy("range").agg(F.sum(n).alias(n))
    return F.broadcast(sums.select("range", (F.sum(n).over(Window.orderBy("range")) - F.col(n)).alias("before")))


def _counted(lines: DataFrame) -> DataFrame:
    """h1, h2, r: the lines that occur more than once, with the number of line places before theirs in hash order."""
    many = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("range", F.shiftright("h1", 52))
    inside = Window.partitionBy("range").orderBy("h1", "h2")
    return many.join(_before(many, "n"), "range").select("h1", "h2", (F.col("before") + F.sum("n").over(inside) - F.col("n")).alias("r"))


def _stretches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """d, th, start, ids, k1, k2: runs of repeated lines between others, from the start-th line on that is not blank; equal keys, equal ids."""
    found = docs.where("length(text) > 0").select(*DOC, F.posexplode(F.filter(_lines(F.col("text")), _filled)).alias("pos", "line"))
    lines = scratch.write(found.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(29), "line").alias("h2")))
    # Rows that repeat whole are one document; their lines have been counted twice, which makes no place a later one.
    placed = lines.join(_counted(lines), ["h1", "h2"]).select(*DOC, "pos", "r").repartition(*DOC).dropDuplicates([*DOC, "pos"])
    runs = placed.withColumn("g", F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"])
    whole = runs.groupBy(*DOC, "g").agg(F.min("pos").alias("start"), ids.alias("ids"))
    out = scratch.write(whole.select(*DOC, "start", "ids", F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit(31), "ids").alias("k2")))
    scratch.drop(lines)
    return out


def suffix_array(stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2, i, rest, r: the rank of the suffix from the i-th line of each of the distinct stretches on, rest lines long.

    Ranks order suffixes as their line numbers do; equal ranks are equal suffixes.
    """
    place, size = F.posexplode("ids").alias("i", "r"), F.size("ids")
    # How many share a rank (n), and the longest of them (most), is not known yet, so that all are ranked at first.
    s = stretches.select(*STRETCH, size.alias("size"), place).select(*STRETCH, "i", (F.col("size") - F.col("i")).alias("rest"), "r", F.lit(2).cast("long").alias("n"), F.lit(2**31 - 1).alias("most"))
    s = scratch.write(s)
    top = s.agg(F.max("r")).first()[0] or 0
    width, step, along = top // RANGES + 1, 1, Window.partitionBy(*STRETCH).orderBy("i")
    while not s.where(tied := f"n > 1 AND most > {step}").isEmpty():
        ahead = F.when(F.col("rest") > step, F.lead("r", step).over(along)).otherwise(F.lit(-1))
        pairs = scratch.write(s.withColumn("next", ahead).where(tied).select(*STRETCH, "i", "rest", "r", "next"))
        counts = pairs.groupBy("r", "next").agg(F.count("*").alias("n"), F.max("rest").alias("most")).withColumn("range", F.floor(F.col("next") / width))
        # A rank that very many suffixes share has its sums by ranges of the next rank, then within each.
        sums = counts.groupBy("r", "range").agg(F.sum("n").alias("all"))
        before = sums.select("r", "range", (F.sum("all").over(Window.partitionBy("r").orderBy("range")) - F.col("all")).alias("before"))
        inside = F.sum("n").over(Window.partitionBy("r", "range").orderBy("next")) - F.col("n")
        ranks = counts.withColumn("inside", inside).join(before, ["r", "range"]).select("r", "next", (F.col("r") + F.col("before") + F.col("inside")).alias("to"), "n", "most")
        moved = pairs.join(ranks, ["r", "next"]).select(*STRETCH, "i", "rest", F.col("to").alias("r"), "n", "most")
        new = scratch.write(s.where(f"NOT ({tied})").unionByName(moved))
        scratch.drop(s, pairs)
        s, step = new, 2 * step
    return s


def _common(a: Column, b: Column) -> Column:
    """How many elements of a and b agree from the first on."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(a.isNull(), 0).when(other > 0, other - 1).otherwise(F.size(b))


def _intervals(array: DataFrame, stretches: DataFrame, min_lines: int, scratch: Scratch) -> DataFrame:
    """first: of each interval of the array whose neighbours have at least min_lines lines in common, the first place (d, th, at, k1, k2, i)."""
    whole = array.join(stretches, STRETCH).select("r", F.struct(*DOC, (F.col("start") + F.col("i")).alias("at"), *STRETCH, "i").alias("place"), F.slice("ids", F.col("i") + 1, min_lines).alias("head"))
    # Neighbours that tie have all their lines in common: one row stands for them.
    rows = whole.groupBy("r").agg(F.min("place").alias("place"), F.first("head").alias("head"))
    width = (array.agg(F.max("r")).first()[0] or 0) // RANGES + 1
    rows = scratch.write(rows.withColumn("range", F.floor(F.col("r") / width)))
    ranges, inside = Window.orderBy("range"), Window.partitionBy("range").orderBy("r")
    ends = rows.groupBy("range").agg(F.max_by("head", "r").alias("end")).select("range", F.lag("end").over(ranges).alias("end"))
    lcp = _common(F.coalesce(F.lag("head").over(inside), F.col("end")), F.col("head"))
    cuts = rows.join(F.broadcast(ends), "range").select("range", "r", "place", F.when(lcp < min_lines, F.col("r")).alias("cut"))
    last = cuts.groupBy("range").agg(F.max("cut").alias("last")).select("range", F.max("last").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    named = cuts.withColumn("own", F.max("cut").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(last), "range")
    return named.groupBy(F.coalesce("own", "last").alias("interval")).agg(F.min("place").alias("first"))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """d, th, gone: for each document (id, hash of text) with later copies, the numbers of the lines to delete among those that are not blank.

    Documents are ordered by id, then by hash of text; rows equal in both are one document.
    """
    scratch = Scratch(docs.sparkSession)
    every = _stretches(docs, scratch)
    distinct = scratch.write(every.groupBy(*STRETCH).agg(F.min(F.struct(*DOC, "start")).alias("p"), F.first("ids").alias("ids")).select(*STRETCH, "p.*", "ids"))
    array = suffix_array(distinct, scratch)
    firsts = _intervals(array, distinct, min_lines, scratch).groupBy("first.k1", "first.k2").agg(F.collect_list("first.i").alias("kept"))
    span = lambda a, n: F.when(n > 0, F.sequence(a, a + n - 1)).otherwise(F.array().cast("array<int>"))
    later = F.array_except(span(F.lit(0), F.size("ids") - min_lines + 1), F.coalesce("kept", F.array().cast("array<int>")))
    gone = later if min_lines == 1 else F.array_distinct(F.flatten(F.transform(later, lambda p: F.sequence(p, p + (min_lines - 1)))))
    first = distinct.join(firsts, STRETCH, "left").select(*DOC, "start", gone.alias("gone"))
    copy = F.when(F.size("ids") >= min_lines, F.sequence(F.lit(0), F.size("ids") - 1)).otherwise(F.array().cast("array<int>"))
    found = every.join(first, [*DOC, "start"], "left").select(*DOC, F.transform(F.coalesce("gone", copy), lambda j: j + F.col("start")).alias("gone"))
    # Written, so that the join that follows knows its size: where that is small, the texts need no shuffle.
    out = scratch.write(found.where(F.size("gone") > 0).groupBy(*DOC).agg(F.flatten(F.collect_list("gone")).alias("gone")))
    scratch.drop(every, distinct, array)
    return out


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f's own lambdas use it."""
    return F.get(F.transform(F.array(value), f), 0)


def _kept(lines: Column, gone: Column) -> Column:
    """The lines, joined again, without those of the gone-th that are not blank."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    drop = _bound(F.filter(every, lambda i: _filled(F.get(lines, i))), lambda own: F.transform(gone, lambda p: F.get(own, p)))
    return F.array_join(F.transform(F.array_except(every, drop), lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs (doc_id, text and any other columns) with text_kept, n_lines and n_removed added or replaced.

    A line is what stands between line feeds; a blank one is skipped and never removed. Of runs of at least min_lines
    lines that occur more than once, in one document or several, the first in order of doc_id and line stays. Null and empty
    texts have no lines and stay; a null id comes first; equal rows are one document and are kept alike.
    """
    new = ["text_kept", "n_lines", "n_removed"]
    keyed = docs.drop(*new).withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("__th", F.xxhash64("text"))
    gone = repeated_lines(keyed.select(F.col("__d").alias("d"), F.col("__th").alias("th"), F.col("text").cast("string").alias("text")), min_lines)
    found = keyed.join(gone.select(F.col("d").alias("__d"), F.col("th").alias("__th"), F.col("gone").alias("__gone")), ["__d", "__th"], "left")
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_bound(_lines(F.col("text")), lambda lines: _kept(lines, F.col("__gone"))))
    n_lines = F.when(F.length("text") > 0, F.length("text") - F.length(F.translate("text", "\n", "")) + 1).otherwise(0).cast("long")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return found.select(*columns, kept.alias("text_kept"), n_lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text_kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS idx
  FROM documents WHERE text <> ''
), o AS (
  SELECT doc_id, idx, line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos
  FROM l WHERE translate(line, ' ' || chr(9) || chr(13), '') <> ''
), g AS (
  SELECT doc_id, idx, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS gone FROM o
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.idx) FILTER (NOT coalesce(gone, false)), '') AS kept
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.idx = l.idx GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, d.text)) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
