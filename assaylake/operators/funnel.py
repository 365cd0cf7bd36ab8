"""The attrition funnel: how many candidates must enter each stage, and what they cost.

Scenarios are rows with an array of pass rates; the recursion from the last stage back is one array expression a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import threshold

#: The stages, their rules and the cost of a candidate in each.
STAGES = (
    ("efficacy", 80.0, ">", 500.0),
    ("potency", 500.0, "<", 2000.0),
    ("mouse liver", 1.5, "<", 15000.0),
    ("mouse neuro", 1.0, "<=", 20000.0),
    ("rat liver", 1.5, "<", 25000.0),
    ("rat neuro", 1.0, "<=", 30000.0),
    ("monkey liver", 1.5, "<", 100000.0),
)
#: Upper limits of normal of the liver enzyme, by species.
LIMITS = {"mouse": 70.0, "rat": 39.0, "monkey": 103.0}
COSTS = [s[3] for s in STAGES]


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(STAGES)], "idx int, name string, threshold double, op string, cost double")


def _rates(rates: Column) -> Column:
    return rates.cast("array<double>")


def counts(rates: Column, target: float | Column = 1.0, ceil: bool = True) -> Column:
    """Candidates at each stage and after the last: N[i] = N[i + 1] / p[i], rounded up; infinite where a rate is 0."""
    up = (lambda x: F.ceil(x).cast("double")) if ceil else (lambda x: x)
    infinite = F.lit(float("inf"))

    def step(acc, p):
        need = F.get(acc, F.lit(0))
        return F.concat(F.array(F.when((p > 0) & (need < infinite), up(need / F.when(p > 0, p).otherwise(F.lit(1.0)))).otherwise(infinite)), acc)

    return F.aggregate(F.reverse(_rates(rates)), F.array(target.cast("double") if isinstance(target, Column) else F.lit(float(target))), step)


def survival(rates: Column) -> Column:
    """Share that is left after each stage."""
    return F.slice(F.aggregate(_rates(rates), F.array(F.lit(1.0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) * p))), F.lit(2), F.size(rates))


def cost(n: Column, costs: Column, skip_infinite: bool = False) -> Column:
    """Sum of counts times costs; stages with an infinite count make it infinite, or are left out."""
    each = F.zip_with(F.slice(n, F.lit(1), F.size(costs)), costs, lambda a, b: F.when(a < float("inf"), a * b).otherwise(F.lit(0.0) if skip_infinite else F.lit(float("inf"))))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def by_factor(rates: Column, factors: Column) -> Column:
    """p * factor, at most 1; a null factor leaves the rate."""
    return F.zip_with(_rates(rates), factors.cast("array<double>"), lambda p, f: F.when(f.isNull(), p).otherwise(F.least(p * f, F.lit(1.0))))


def by_precision(rates: Column, precisions: Column, floor: bool) -> Column:
    """Rates replaced by precisions, at most 1; with floor never less than the rate itself."""

    def one(p, q):
        own = F.greatest(q, p) if floor else F.greatest(q, F.lit(1e-12))
        return F.when(q.isNull() | F.isnan(q), p).otherwise(F.least(own, F.lit(1.0)))

    return F.zip_with(_rates(rates), precisions.cast("array<double>"), one)


def savings(rates: Column, precisions: Column, costs: Column, target: float | Column = 1.0, ceil: bool = True, floor: bool = True) -> Column:
    """Percent that precisions save against the plain rates."""
    base = cost(counts(rates, target, ceil), costs, True)
    return (1 - cost(counts(by_precision(rates, precisions, floor), target, ceil), costs, True) / base) * 100


def savings_spread(rates: Column, precisions: Column, spreads: Column, costs: Column) -> Column:
    """Half the distance between the savings at precisions plus and minus their spread."""
    high = F.zip_with(precisions, spreads, lambda p, s: p + F.coalesce(s, F.lit(0.0)))
    low = F.zip_with(precisions, spreads, lambda p, s: F.greatest(p - F.coalesce(s, F.lit(0.0)), F.lit(0.0)))
    return F.abs(savings(rates, high, costs) - savings(rates, F.when(F.lit(True), low), costs)) / 2


def animals(n: Column) -> Column:
    """Four for each candidate in the stages from the third to the one before the last count."""
    return 4 * F.aggregate(F.slice(n, F.lit(3), F.size(n) - 3), F.lit(0.0), lambda a, x: a + x)


def costs_column(costs: list[float] = COSTS) -> Column:
    return F.array(*[F.lit(float(c)) for c in costs])


def cohort_rates(df: DataFrame, cohorts: list[tuple[str, Column, Column, str, float]]) -> DataFrame:
    """stage, name, n, passed, rate of each cohort (name, members, value, comparison, mark), all from one pass over df."""
    sums = [x for i, (_, member, value, op, mark) in enumerate(cohorts) for x in (F.count_if(member & value.isNotNull()).alias(f"n{i}"), F.count_if(member & threshold(value, op, mark)).alias(f"p{i}"))]
    rows = [F.struct(F.lit(i).alias("stage"), F.lit(c[0]).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("passed")) for i, c in enumerate(cohorts)]
    return df.agg(*sums).select(F.inline(F.array(*rows))).withColumn("rate", F.round(F.try_divide("passed", "n"), 4))


def contributions(scenarios: DataFrame, precisions: list[float | None], costs: list[float], arms: dict[str, list[int]], whole: str = "all") -> DataFrame:
    """scenario, arm, saved_pct with precisions in an arm's stages only, and lost: what the whole saves more; expected counts, at least the rate itself."""
    own = lambda stages: F.array(*[F.lit(p if i in stages else None).cast("double") for i, p in enumerate(precisions)])
    saved = lambda a: F.round(savings(F.col("rates"), own(arms[a]), costs_column(costs), ceil=False), 4)
    rows = scenarios.select("scenario", saved(whole).alias("w"), F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), saved(a).alias("saved_pct")) for a in arms])))
    return rows.select("scenario", "arm", "saved_pct", F.round(F.col("w") - F.col("saved_pct"), 4).alias("lost"))


def uplifts(df: DataFrame, link: str, gate: Column, passes: Column, picked: Column, least: int = 30, least_picked: int = 10) -> DataFrame:
    """link, n_all, n_gated, base_rate, base_uplift, model_uplift, ratio: pass rates of what passed the gate over those of all, where enough did."""
    p = passes.cast("double")
    own = df.groupBy(link).agg(
        F.count("*").alias("n_all"), F.count_if(gate).alias("n_gated"), F.count_if(gate & picked).alias("n_picked"), F.avg(p).alias("base_rate"),
        F.avg(F.when(gate, p)).alias("bg"), F.avg(F.when(picked, p)).alias("m"), F.avg(F.when(picked & gate, p)).alias("mg"),
    )
    base, model = F.when(F.col("n_gated") >= least, F.try_divide("bg", "base_rate")), F.when(F.col("n_picked") >= least_picked, F.try_divide("mg", "m"))
    return own.select(link, "n_all", "n_gated", "base_rate", base.alias("base_uplift"), model.alias("model_uplift"), F.try_divide(model, base).alias("ratio"))


def uplifted(rate: Column, factor: Column) -> Column:
    """A rate times its factor, at most 1; as it is without one."""
    return F.least(rate * F.coalesce(factor, F.lit(1.0)), F.lit(1.0))
