"""Printed tables made of orders, read from their XML text to long entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import completeness, grids, joins
from ..sources import readers
from .registry import Tables, query

_LINES = """l AS (SELECT l_orderkey AS o, l_partkey, l_quantity, l_discount, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem),
s AS (SELECT *, 100000 + l_partkey AS c, translate(substr(md5(l_partkey::VARCHAR), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') AS q FROM l)"""


def _lines(t: Tables):
    """Lines of each order in order, with a compound's number and sequence."""
    w = Window.partitionBy("o").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    q = F.translate(F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    return t.lineitem.withColumnRenamed("l_orderkey", "o").select("o", (100000 + F.col("l_partkey")).alias("c"), q.alias("q"), *[F.col(f"l_{n}").cast("int" if n == "quantity" else "double").alias(n) for n in ("quantity", "discount", "tax")], F.row_number().over(w).alias("k"))


def _row(*cells) -> F.Column:
    entry = lambda c: F.when(c == "", "<entry/>").otherwise(F.concat(F.lit("<entry>"), c, F.lit("</entry>")))
    return F.concat(F.lit("<row>"), *[entry(F.lit(c) if isinstance(c, str) else c) for c in cells], F.lit("</row>"))


def _documents(t: Tables):
    """A document a table: of even orders with a compound a row, of others with a compound a column."""
    lines = _lines(t)
    text, odd = lambda c: F.col(c).cast("string"), F.col("k") % 2 == 1
    name = F.when(odd, F.concat(text("c"), F.when(F.col("k") % 3 == 0, "†").otherwise(""))).otherwise("")
    whole = F.when(~odd, "").when(F.col("k") % 4 == 1, F.substring("q", 1, 12)).otherwise(F.col("q"))
    row = F.concat(_row(name, F.when(F.col("k") % 3 == 1, text("quantity")).otherwise(""), whole, text("discount")), F.when(F.col("k") % 4 == 1, _row("", "", F.substring("q", 13, 8), "")).otherwise(""))
    a = lines.where("o % 2 = 0").groupBy("o").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", row.alias("r"))))["r"], "").alias("body"))
    a = a.select("o", F.concat(_row("Compound", "Dose", "Sequence", "Residual"), _row("ID", "(nM)", "", "(%)"), F.col("body")).alias("body"))
    per = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("v"))))["v"], lambda v: F.concat(F.lit("<entry>"), v, F.lit("</entry>"))), "")
    b = lines.where("o % 2 = 1").groupBy("o").agg(per(F.concat(F.lit("ISIS "), text("c"))).alias("n"), per(text("quantity")).alias("x"), per(F.when(F.col("k") % 3 == 0, "").otherwise(text("tax"))).alias("y"))
    line = lambda first, c: F.concat(F.lit(f"<row><entry>{first}</entry>"), F.col(c), F.lit("</row>"))
    b = b.select("o", F.concat(line("Day", "n"), line("2 h", "x"), line("4/7", "y")).alias("body"))
    return a.unionByName(b).select(F.concat(F.lit('<tables num="0'), text("o"), F.lit('"><table><tgroup>'), F.col("body"), F.lit("</tgroup></table></tables>")).alias("text"))


@query(f"""WITH {_LINES}, a AS (SELECT *, max(CASE WHEN k % 2 = 1 THEN k END) OVER (PARTITION BY o ORDER BY k) AS i FROM s WHERE o % 2 = 0),
d AS (SELECT a.o, a.k, p.c, p.q, a.l_discount, max(CASE WHEN a.k % 3 = 1 THEN a.k END) OVER (PARTITION BY a.o, a.i ORDER BY a.k) AS dk FROM a JOIN s p ON p.o = a.o AND p.k = a.i),
e AS (SELECT o, 'A' AS kind, c, 'sequence' AS field, q AS value FROM d UNION ALL SELECT o, 'A', c, 'residual_pct', l_discount::VARCHAR FROM d UNION ALL SELECT d.o, 'A', d.c, 'dose_nm', s.l_quantity::INTEGER::VARCHAR FROM d JOIN s ON s.o = d.o AND s.k = d.dk
  UNION ALL SELECT o, 'B', c, '2_h', l_quantity::INTEGER::VARCHAR FROM s WHERE o % 2 = 1 UNION ALL SELECT o, 'B', c, '4_per_7', l_tax::VARCHAR FROM s WHERE o % 2 = 1 AND k % 3 <> 0)
SELECT o::VARCHAR AS table_id, kind, c::VARCHAR AS compound, field, value, count(*) AS n FROM e GROUP BY ALL""")
def grid_entries(t: Tables):
    """From the text of printed tables to entries: rows that spill over, doses carried down, sequences split over rows, compounds as columns."""
    found = _documents(t).select(F.explode(readers.tables(F.col("text"))).alias("t")).select(F.col("t.num").alias("table_id"), F.posexplode("t.rows").alias("position", "cells"))
    return grids.entries(found).groupBy("table_id", "kind", "compound", "field", "value").agg(F.count("*").alias("n"))


def _claimed(t: Tables):
    """Printed tables, an order's parts with two doses, and what is claimed of them: of four tables in five with a defect.

    1: a part's claims are gone; 2: a value is mistyped; 3: all compounds are renamed; 4: a dose that is not printed.
    """
    lines = joins.dealt(t.lineitem.select(F.col("l_orderkey").alias("o"), "l_partkey", "l_quantity", "l_discount"), "o", rows=100_000)
    own = lines.groupBy("o", "l_partkey").agg((10 + F.max("l_quantity")).cast("int").alias("a"), (61 + F.round(100 * F.max("l_discount"))).cast("int").alias("b"))
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy("l_partkey"))).withColumn("c", 100000 + F.col("l_partkey"))
    text = lambda c: F.col(c).cast("string")
    # A row now and then is printed without its second cell.
    cells = F.when(F.col("k") % 4 == 0, F.array(text("c"), text("a"), text("b"))).otherwise(F.array(text("c"), F.concat(F.lit("0"), text("k")), text("a"), text("b")))
    line = lambda k, c: F.struct(k.alias("position"), c.alias("cells"))
    head, row = line(F.lit(0), F.array(*map(F.lit, ("ISIS NO", "SEQ ID", "100 nM", "0.5 µM")))), line(F.col("k"), cells)
    rows = own.select(F.col("o").alias("table_id"), F.explode(F.when(F.col("k") == 1, F.array(head, row)).otherwise(F.array(row))).alias("x")).select("table_id", "x.*")
    defect, first = F.col("o") % 5, F.col("k") == 1
    claim = lambda dose, value: F.struct(F.lit(float(dose)).alias("dose"), value.cast("string").alias("value"))
    # The last four digits make another name; with a zero in front, none that a compound has.
    name = F.when(defect == 3, F.concat(F.lit("099"), F.substring(text("c"), -4, 4))).otherwise(text("c"))
    each = F.array_compact(F.array(claim(100, 100 - F.col("a") + F.when((defect == 2) & first, 3).otherwise(0)), claim(500, 100 - F.col("b")), F.when((defect == 4) & first, claim(7777, F.col("a")))))
    claims = own.where(~((defect == 1) & first)).select(F.col("o").alias("table_id"), name.alias("compound"), F.explode(each).alias("x")).select("table_id", "compound", "x.dose", "x.value")
    return rows, claims


@query("""WITH g AS (SELECT l_orderkey AS o, l_partkey, 10 + max(l_quantity)::INTEGER AS a, 61 + round(100 * max(l_discount))::INTEGER AS b FROM lineitem GROUP BY 1, 2), k AS (SELECT *, o % 5 AS d, row_number() OVER (PARTITION BY o ORDER BY l_partkey) AS k FROM g),
p AS (SELECT o, a AS v FROM k UNION SELECT o, b FROM k UNION SELECT o, 100000 + l_partkey FROM k UNION SELECT o, k FROM k WHERE k % 4 <> 0),
f AS (SELECT o, 103 - a AS v, a - 3 AS w FROM k WHERE d = 2 AND k = 1), u AS (SELECT f.o, NOT bool_or(coalesce(p.v = f.v OR p.v = f.w, false)) AS lost FROM f JOIN p ON p.o = f.o GROUP BY 1),
n AS (SELECT o, any_value(d) AS d, count(*) AS n, count(DISTINCT 99 * 10000 + l_partkey % 10000) AS renamed, bool_or(k % 4 = 0) AS short FROM k GROUP BY 1),
t AS (SELECT o, d, n, CASE WHEN d = 3 THEN 0 WHEN d = 1 THEN n - 1 ELSE n END AS r, renamed, short FROM n WHERE d <> 1 OR n > 1)
SELECT o AS table_id, r AS n_rows, CASE d WHEN 1 THEN n - 1 WHEN 3 THEN renamed ELSE n END AS n_compounds, CASE WHEN d = 3 THEN renamed ELSE 0 END AS n_missing, 2 * r AS n_cells, CASE WHEN d = 2 THEN 2 * r - 1 ELSE 2 * r END AS n_accounted, CASE WHEN d = 2 THEN round(100.0::DOUBLE * (2 * r - 1) / (2 * r), 2) WHEN d <> 3 THEN 100.0 END AS coverage_pct,
CASE WHEN d = 1 THEN 1 ELSE 0 END AS n_dropped, coalesce(lost, false)::INT AS n_unsourced, (d = 4)::INT AS n_unprinted, (d = 2)::INT AS n_partial, d <> 3 AND short AS ragged FROM t LEFT JOIN u USING (o)""")
def grid_defects(t: Tables):
    """What a check of tables finds where claims were dropped, mistyped, renamed or given a dose that is not printed."""
    return completeness.report(*_claimed(t)).drop("suspect_column")
