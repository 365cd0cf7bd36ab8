"""Small values: texts, numbers, look-ups, draws and exact tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import dedup, funnel, joins, match, metrics, resample
from .names import _dealt, _oracle
from .registry import Tables, query

KINDS = ["C57BL/6 Mice", "Sprague-Dawley_rats", "cynomolgus monkey", "Human", "hamster", None, "ratio", "rhesus macaque"]
HEADS = ["% Inhibition (nM)", "Dose µg/kg", "α-syn  mRNA", "ALT", "_x_", None, "TNFβ / γ", "50% of IC50"]
FILES = ["US1_table_00012.xml", "US1_table_7.json", "US1_context.txt", "US9_t3", "a_table_0100_b", None, "table_0", "x"]


@query(_oracle(("species", ["mouse", "rat", "monkey", "human", "hamster", None, "ratio", "monkey"]), ("head", ["pct_inhibition_nm", "dose_ug_per_kg", "alpha_syn_mrna", "alt", "x", None, "tnfbeta_per_gamma", "50_pct_of_ic50"]), ("number", ["12", "7", None, None, "100", None, "0", None]), ("run", ["00012", None, None, None, "0100", None, None, None])).replace("FROM part", ", 'US' || p_partkey || '_table_' || lpad((p_partkey % 700)::VARCHAR, 5, '0') || '.xml' AS file FROM part"))
def text_values(t: Tables):
    own = _dealt(t, KINDS, "kind").join(_dealt(t, HEADS, "h"), "p_partkey").join(_dealt(t, FILES, "f"), "p_partkey")
    file = X.table_id(F.concat(F.lit("US"), F.col("p_partkey").cast("string")), (F.col("p_partkey") % 700).cast("int"))
    return own.select("p_partkey", X.species(F.col("kind")).alias("species"), X.header(F.col("h")).alias("head"), X.table_number(F.col("f")).alias("number"), X.first_number(F.col("f")).alias("run"), file.alias("file"))


@query("""SELECT l_orderkey, l_linenumber, len(list_filter([l_quantity, l_extendedprice / 1000, l_tax * 100], lambda x: x BETWEEN 2 AND 40)) AS n_within, round(least(greatest(l_quantity, 5.0::DOUBLE), 45.0::DOUBLE), 6) AS clipped, abs(l_tax - l_discount) <= 1e-8 + 1e-5 * abs(l_discount) AS close,
round(l_extendedprice * pow(10.0::DOUBLE, 2 - floor(log10(l_extendedprice)))) / pow(10.0::DOUBLE, 2 - floor(log10(l_extendedprice))) AS short FROM lineitem""")
def number_values(t: Tables):
    own = N.array_within(F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_tax") * 100), 2, 40)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.size(F.filter(own, lambda x: x.isNotNull())).cast("long").alias("n_within"), F.round(N.clip(F.col("l_quantity"), 5.0, 45.0), 6).alias("clipped"), N.close(F.col("l_tax"), F.col("l_discount")).alias("close"), N.significant(F.col("l_extendedprice")).alias("short"))


@query("SELECT l_orderkey, arg_min(l_quantity, l_linenumber * 1000000 + l_partkey + l_quantity / 100) AS first FROM lineitem GROUP BY 1")
def first_values(t: Tables):
    own = t.lineitem.withColumn("o", F.col("l_linenumber") * 1000000 + F.col("l_partkey") + F.col("l_quantity") / 100)
    return own.groupBy("l_orderkey").agg(dedup.first_non_null("l_quantity", "o").alias("first"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'works' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def renamed_or_self(t: Tables):
    names = t.spark.createDataFrame([("BUILDING", "house"), ("MACHINERY", "works")], "k string, v string")
    return joins.lookup_or_self(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", names, "k", "v")


@query("""WITH s AS (SELECT p_partkey, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part), p AS (SELECT p_partkey, substr(s, (p_partkey % 28)::INTEGER + 1, 5) AS probe, s FROM s)
SELECT p_partkey, probe, position(probe IN s) AS place FROM p WHERE length(s) - length(replace(s, probe, '')) = 5""")
def probe_places(t: Tables):
    """Probes that stand just once in their sequence, overlaps not counted."""
    s = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    own = t.part.select("p_partkey", s.alias("s"))
    probes = own.select("p_partkey", F.substring("s", (F.col("p_partkey") % 28 + 1).cast("int"), F.lit(5)).alias("probe"))
    return joins.contained_once(probes, own, "p_partkey", "probe", "s").select("p_partkey", "probe", "place")


@query("SELECT o_orderkey, o_custkey, n FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 2) USING (o_orderkey)")
def one_to_one_merge(t: Tables):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).where("n > 2")
    return joins.validated_left(t.orders.select("o_orderkey", "o_custkey"), counts, ["o_orderkey"], "one_to_one")


RATES, SIZES = [0.3144, 0.5139, 0.4451], [400, 300, 300]


@query(f"""WITH f AS (SELECT l_orderkey % 5 AS fold, round(avg((l_quantity > 25)::INT::DOUBLE), 4) AS a, round(avg((l_discount < 0.05)::INT::DOUBLE), 4) AS b FROM lineitem GROUP BY 1), d AS (SELECT range AS draw FROM range(20000)),
u AS (SELECT draw, ('0x' || substr(md5('4274|' || draw || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, ('0x' || substr(md5('4274|' || draw || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS v FROM d)
SELECT draw, round(x.a * y.b * {RATES[0]}::DOUBLE, 9) AS rate, round(x.a / (SELECT avg(a) FROM f) * (y.b / (SELECT avg(b) FROM f)), 6) AS factor FROM u JOIN f x ON x.fold = floor(u * 5) JOIN f y ON y.fold = floor(v * 5)""")
def joint_draws(t: Tables):
    """Each draw takes a fold of either rate by its own number; rates and enrichment factors are multiplied draw by draw."""
    f = t.lineitem.groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.round(F.avg((F.col("l_quantity") > 25).cast("double")), 4).alias("a"), F.round(F.avg((F.col("l_discount") < 0.05).cast("double")), 4).alias("b"))
    own = resample.fold_draws(t.spark, f, ["a", "b"], 5, 20000, 4274)
    whole = F.broadcast(f.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb")))  # one row
    return own.crossJoin(whole).select("draw", F.round(F.col("a") * F.col("b") * RATES[0], 9).alias("rate"), F.round(F.col("a") / F.col("ma") * (F.col("b") / F.col("mb")), 6).alias("factor"))


@query("""WITH c AS (SELECT l_returnflag AS k, count(*) FILTER (l_quantity < 2 AND l_tax > 0.07) AS a, count(*) FILTER (l_quantity < 2 AND l_tax <= 0.07) AS b, count(*) FILTER (l_quantity >= 2 AND l_quantity < 4 AND l_tax > 0.07) AS c, count(*) FILTER (l_quantity >= 2 AND l_quantity < 4 AND l_tax <= 0.07) AS d FROM lineitem GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM c), w AS (SELECT *, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) AS w FROM x),
m AS (SELECT *, max(w) OVER (PARTITION BY k) AS top, max(CASE WHEN x = a THEN w END) OVER (PARTITION BY k) AS own FROM w) SELECT k, a, b, c, d, round(least(1.0, sum(CASE WHEN w <= own + 1e-7 THEN exp(w - top) ELSE 0 END) / sum(exp(w - top))), 6) AS p, round(least(1.0, 3 * sum(CASE WHEN w <= own + 1e-7 THEN exp(w - top) ELSE 0 END) / sum(exp(w - top))), 6) AS corrected FROM m GROUP BY k, a, b, c, d""")
def exact_tests(t: Tables):
    """Fisher's exact test of 2 x 2 tables, one row each, with Bonferroni's correction."""
    few, taxed = F.col("l_quantity") < 2, F.col("l_tax") > 0.07
    some = (F.col("l_quantity") >= 2) & (F.col("l_quantity") < 4)
    cells = t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(F.count_if(few & taxed).alias("a"), F.count_if(few & ~taxed).alias("b"), F.count_if(some & taxed).alias("c"), F.count_if(some & ~taxed).alias("d"))

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([metrics.fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)])

    own = cells.withColumn("q", exact("a", "b", "c", "d"))
    return own.select("k", "a", "b", "c", "d", F.round("q", 6).alias("p"), F.round(metrics.bonferroni(F.col("q"), 3), 6).alias("corrected"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {m}::DOUBLE, '{op}', {c}::DOUBLE)" for i, (n, m, op, c) in enumerate(funnel.STAGES)) + ") AS s(idx, name, threshold, op, cost)")
def stage_dimension(t: Tables):
    return funnel.stages(t.spark)


@query("""WITH a AS (SELECT l_partkey % 400 AS k, l_orderkey * 10 + l_linenumber AS i, l_returnflag AS c FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_partkey % 400 AS k, l_orderkey * 10 + l_linenumber AS j, l_returnflag AS c FROM lineitem WHERE l_linestatus = 'O'),
x AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY i) AS r FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY j) AS r FROM b), s AS (SELECT x.k, i, j FROM x JOIN y USING (k, c, r)),
p AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM a WHERE i NOT IN (SELECT i FROM s)), q AS (SELECT k, j, row_number() OVER (PARTITION BY k ORDER BY j) AS r FROM b WHERE j NOT IN (SELECT j FROM s))
SELECT k, i, j, true AS context_equal FROM s UNION ALL SELECT k, i, j, CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN false END FROM p FULL JOIN q USING (k, r)""")
def context_then_stable(t: Tables):
    """Records of equal context are paired in order, then what is left of a bucket in order."""
    side = lambda s, n: t.lineitem.where(F.col("l_linestatus") == s).select((F.col("l_partkey") % 400).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(n), F.col("l_returnflag").alias("c"))
    return match.match_context_then_stable(side("F", "i"), side("O", "j"), ["k"], "c", "i", "j")
