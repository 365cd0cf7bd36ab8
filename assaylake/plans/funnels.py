"""The attrition funnel from measured pass rates, and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from functools import reduce

from pyspark.sql import functions as F

from ..operators import funnel as P
from .registry import Tables, query

COSTS = [500.0, 2000.0, 15000.0, 20000.0, 25000.0, 30000.0, 100000.0]


def rates(t: Tables) -> DataFrame:
    """scenario (return flag), rates: seven pass rates of rows, rounded to four places."""
    r = lambda c: F.round(F.avg(c.cast("double")), 4)
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    each = [r(q > 40), r(q > 30), r(d < 0.05), r(x <= 0.04), r(d <= 0.08), r(q > 10), F.lit(1.0)]
    return t.lineitem.groupBy(F.col("l_returnflag").alias("scenario")).agg(F.array(*each).alias("rates"))


RATES = """r AS (SELECT l_returnflag AS scenario, [round(avg((l_quantity > 40)::INT::DOUBLE),4), round(avg((l_quantity > 30)::INT::DOUBLE),4), round(avg((l_discount < 0.05)::INT::DOUBLE),4), round(avg((l_tax <= 0.04)::INT::DOUBLE),4), round(avg((l_discount <= 0.08)::INT::DOUBLE),4), round(avg((l_quantity > 10)::INT::DOUBLE),4), 1.0::DOUBLE] AS rates FROM lineitem GROUP BY 1)"""
CEIL = "list_reduce(list_prepend([{t}::DOUBLE], list_transform(list_reverse({r}), lambda p: [p])), lambda a, p: list_prepend(ceil(a[1] / p[1]), a))"
PLAIN = CEIL.replace("ceil(a[1] / p[1])", "a[1] / p[1]")
COST = "list_sum(list_transform(range(1, 8), lambda i: {n}[i] * " + str(COSTS) + "[i]::DOUBLE))"


def _counts(r: str, t: float = 1.0, ceil: bool = True) -> str:
    return (CEIL if ceil else PLAIN).format(r=r, t=t)


@query(f"""WITH {RATES}, n AS (SELECT *, {_counts("rates")} AS n FROM r) SELECT scenario, i::INTEGER AS stage, round(rates[i + 1], 4) AS rate, n[i + 1] AS candidates, round(n[i + 1] * {COSTS}[i + 1]::DOUBLE, 2) AS cost, round({COST.format(n="n")}, 2) AS total_cost,
round(list_product(rates[1:i + 1]), 9) AS survival FROM n, range(7) s(i)""")
def funnel_backcalc(t: Tables):
    own = rates(t).withColumn("n", P.counts(F.col("rates"))).withColumn("s", P.survival(F.col("rates"))).withColumn("total", P.cost(F.col("n"), P.costs_column()))
    cells = own.select("scenario", "total", "n", "s", F.posexplode("rates").alias("stage", "rate"))
    cost = F.get(F.col("n"), F.col("stage")) * F.get(P.costs_column(), F.col("stage"))
    return cells.select("scenario", "stage", F.round("rate", 4).alias("rate"), F.get("n", F.col("stage")).alias("candidates"), F.round(cost, 2).alias("cost"), F.round("total", 2).alias("total_cost"), F.round(F.get("s", F.col("stage")), 9).alias("survival"))


@query(f"""WITH {RATES}, e AS (SELECT scenario, [least(rates[1] * 2.441::DOUBLE, 1), least(rates[2] * 1.797::DOUBLE, 1), rates[3], rates[4], rates[5], rates[6], rates[7]] AS rates FROM r), n AS (SELECT scenario, {_counts("rates")} AS n FROM e)
SELECT scenario, n[1] AS initial, round({COST.format(n="n")}, 2) AS total_cost FROM n""")
def funnel_enriched(t: Tables):
    factors = F.array(F.lit(2.441), F.lit(1.797), *[F.lit(None).cast("double")] * 5)
    n = rates(t).withColumn("n", P.counts(P.by_factor(F.col("rates"), factors)))
    return n.select("scenario", F.get("n", F.lit(0)).alias("initial"), F.round(P.cost(F.col("n"), P.costs_column()), 2).alias("total_cost"))


PRECISIONS = [0.4, 0.5, 0.45, None, 0.2, None, None]
SQL_PRECISIONS = "(CAST([0.4, 0.5, 0.45, NULL, 0.2, NULL, NULL] AS DOUBLE[]))"
FLOORED = f"list_transform(range(1, 8), lambda i: CASE WHEN {SQL_PRECISIONS}[i] IS NULL THEN rates[i] ELSE least(greatest({SQL_PRECISIONS}[i], rates[i]), 1.0::DOUBLE) END)"
FREE = FLOORED.replace("rates[i]), 1.0", "1e-12::DOUBLE), 1.0")


def _precisions():
    return F.array(*[F.lit(p).cast("double") for p in PRECISIONS])


@query(f"""WITH {RATES}, e AS (SELECT scenario, {_counts("rates")} AS b, {_counts(FLOORED)} AS n FROM r) SELECT scenario, round((1 - {COST.format(n="n")} / {COST.format(n="b")}) * 100, 4) AS saved_pct FROM e""")
def funnel_savings(t: Tables):
    return rates(t).select("scenario", F.round(P.savings(F.col("rates"), _precisions(), P.costs_column()), 4).alias("saved_pct"))


@query(f"""WITH {RATES}, e AS (SELECT scenario, {_counts("rates", 1, False)} AS b, {_counts(FREE, 1, False)} AS n FROM r) SELECT scenario, round(n[1], 6) AS initial, round({COST.format(n="n")}, 4) AS total_cost, round(4 * list_sum(n[3:7]), 6) AS animals, round((1 - {COST.format(n="n")} / {COST.format(n="b")}) * 100, 4) AS saved_pct FROM e""")
def funnel_expected(t: Tables):
    own = rates(t).withColumn("n", P.counts(P.by_precision(F.col("rates"), _precisions(), floor=False), ceil=False))
    saved = P.savings(F.col("rates"), _precisions(), P.costs_column(), ceil=False, floor=False)
    return own.select("scenario", F.round(F.get("n", F.lit(0)), 6).alias("initial"), F.round(P.cost(F.col("n"), P.costs_column()), 4).alias("total_cost"), F.round(P.animals(F.col("n")), 6).alias("animals"), F.round(saved, 4).alias("saved_pct"))


@query(f"""WITH {RATES}, t AS (SELECT scenario, unnest([1.0, 10.0, 100.0, 1000.0])::DOUBLE AS target, rates FROM r) SELECT scenario, target, round({COST.format(n="c")}, 2) AS ceiling_cost, round({COST.format(n="e")}, 2) AS expected_cost FROM (SELECT *, {PLAIN.replace("[{t}::DOUBLE]", "[target]").format(r="rates")} AS e, {CEIL.replace("[{t}::DOUBLE]", "[target]").format(r="rates")} AS c FROM t)""")
def ceiling_gap(t: Tables):
    own = None
    for target in (1.0, 10.0, 100.0, 1000.0):
        one = rates(t).select("scenario", F.lit(target).alias("target"), F.round(P.cost(P.counts(F.col("rates"), target), P.costs_column()), 2).alias("ceiling_cost"), F.round(P.cost(P.counts(F.col("rates"), target, ceil=False), P.costs_column()), 2).alias("expected_cost"))
        own = one if own is None else own.unionByName(one)
    return own


@query(f"""WITH th AS (SELECT unnest([20, 25, 30, 35, 40])::DOUBLE AS threshold), p AS (SELECT threshold, round(avg((l_quantity > threshold)::INT::DOUBLE), 4) AS rate, round(avg((l_quantity > threshold)::INT::DOUBLE) FILTER (l_discount > 0.07), 4) AS precision_ FROM lineitem, th GROUP BY 1), e AS (SELECT *, [rate, 0.3, 0.5, 0.4, 0.4, 0.35, 1.0]::DOUBLE[] AS r, [least(greatest(precision_, rate), 1.0), 0.3, 0.5, 0.4, 0.4, 0.35, 1.0]::DOUBLE[] AS q FROM p),
n AS (SELECT *, {_counts("r")} AS b, {_counts("q")} AS m FROM e) SELECT threshold, rate, precision_, round((1 - {COST.format(n="m")} / {COST.format(n="b")}) * 100, 4) AS saved_pct FROM n""")
def threshold_tornado(t: Tables):
    marks = [20.0, 25.0, 30.0, 35.0, 40.0]
    sums = [x for m in marks for x in (F.round(F.avg((F.col("l_quantity") > m).cast("double")), 4).alias(f"r{m:.0f}"), F.round(F.avg(F.when(F.col("l_discount") > 0.07, (F.col("l_quantity") > m).cast("double"))), 4).alias(f"p{m:.0f}"))]
    one = t.lineitem.agg(*sums)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("threshold"), F.col(f"r{m:.0f}").alias("rate"), F.col(f"p{m:.0f}").alias("precision_")) for m in marks])))
    rest = [F.lit(x) for x in (0.3, 0.5, 0.4, 0.4, 0.35, 1.0)]
    saved = P.savings(F.array("rate", *rest), F.array("precision_", *[F.lit(None).cast("double")] * 6), P.costs_column())
    return rows.select("threshold", "rate", "precision_", F.round(saved, 4).alias("saved_pct"))


FIVE = {"a": "l_quantity > 25", "b": "l_discount < 0.05", "c": "l_tax <= 0.04", "d": "l_quantity < 40", "e": "l_discount > 0.02"}


@query("WITH f AS (SELECT l_orderkey % 5 AS fold, " + ", ".join(f"round(avg(({c})::INT::DOUBLE), 4) AS {n}" for n, c in FIVE.items()) + " FROM lineitem GROUP BY 1) SELECT " + ", ".join(f"{n}.fold AS fold_{n}" for n in FIVE) + ", round(" + " * ".join(f"{n}.{n}" for n in FIVE) + ", 6) AS rate FROM " + ", ".join(f"f {n}" for n in FIVE))
def scenario_cross(t: Tables):
    """Each way to take one of five folds for each of five rates."""
    f = t.lineitem.groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(*[F.round(F.avg(F.expr(c).cast("double")), 4).alias(n) for n, c in FIVE.items()])
    # Five rows a side, whatever the table's size: a fold is a remainder by five. 3125 combinations.
    sides = [F.broadcast(f.select(F.col("fold").alias(f"fold_{n}"), n)) for n in FIVE]
    rate = reduce(lambda x, y: x * y, [F.col(n) for n in FIVE])
    return reduce(lambda x, y: x.crossJoin(y), sides).select(*[f"fold_{n}" for n in FIVE], F.round(rate, 6).alias("rate"))
