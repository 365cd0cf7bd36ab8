"""Selection of the best-scored share of rows, and what it enriches.

Order within a table is global; so that no task sorts all rows, the cut is found by counts over distinct scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .graph import checkpointed


def size_floor(n: Column, share: float) -> Column:
    """max(1, floor(share * n)) in double arithmetic."""
    return F.greatest(F.lit(1), F.floor(F.lit(float(share)) * n)).cast("long")


def size_round(n: Column, share: float) -> Column:
    """max(1, round half to even of share * n)."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(share)) * n, 0)).cast("long")


def ranked(df: DataFrame, score: str, row: str, low: bool, strata: list[str] = ()) -> DataFrame:
    """df with k (from 1, best first) and n, in each stratum. Ties: for low scores the least row first, for high ones the greatest.

    Rows are dealt by ranges of the score, whatever their stratum; a row's rank is its rank among its stratum's rows in its range
    and their number in the ranges before, so a stratum that holds most rows is spread over as many tasks as there are ranges.
    """
    order = _order(score, row, low)
    dealt = _dealt(df, order)
    return _numbered(dealt, dealt, order, list(strata)).select(*df.columns, "k", "n")


def _order(score: str, row: str, low: bool) -> list[Column]:
    return [F.asc(score), F.asc(row)] if low else [F.desc(score), F.desc(row)]


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    return checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def _numbered(rows: DataFrame, dealt: DataFrame, order: list[Column], strata: list[str], k: str = "k", n: str = "n") -> DataFrame:
    """rows of dealt with their rank k and the number n in each stratum."""
    sizes = dealt.groupBy("__p", *strata).agg(F.count("*").alias("__n"))  # a row per range and stratum
    whole = Window.partitionBy(*strata)
    before = sizes.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], (F.sum("__n").over(whole.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias(n))
    inside = F.row_number().over(Window.partitionBy("__p", *strata).orderBy(*order))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(strata)], F.col("__p") == F.col("__q"))
    joined = rows.withColumn("__k", inside).join(before, same)
    return joined.select(*rows.columns, (F.col("__k") + F.col("__before")).cast("long").alias(k), n)


def enrichment(df: DataFrame, score: str, outcome: str, passes: Column, row: str, low: bool, share: float = 0.2, size=size_floor) -> DataFrame:
    """n, n_selected, base_rate, selected_rate, factor of the best share of rows with finite scores and outcomes."""
    r = ranked(df.where(finite(F.col(score), F.col(outcome))).withColumn("__pass", passes.cast("double")), score, row, low)
    return _rates(r.withColumn("__sel", F.col("k") <= size(F.col("n"), share)))


def _rates(rows: DataFrame, extra: list[str] = ()) -> DataFrame:
    own = rows.groupBy(*extra).agg(F.count("*").alias("n"), F.count_if("__sel").alias("n_selected"), F.avg("__pass").alias("b"), F.avg(F.when(F.col("__sel"), F.col("__pass"))).alias("s"))
    return own.select(*extra, "n", "n_selected", F.round("b", 4).alias("base_rate"), F.round("s", 4).alias("selected_rate"), F.round(F.try_divide("s", "b"), 3).alias("factor"))


def stratified(df: DataFrame, score: str, outcome: str, passes: Column, row: str, stratum: str, low: bool, share: float = 0.2, least: int = 10) -> DataFrame:
    """As enrichment, with the share taken in each stratum of `least` rows or more; the base rate is that of all finite rows."""
    rows = df.where(finite(F.col(score), F.col(outcome))).withColumn("__pass", passes.cast("double"))
    r = ranked(rows, score, row, low, [stratum])
    return _rates(r.withColumn("__sel", F.col(stratum).isNotNull() & (F.col("n") >= least) & (F.col("k") <= size_floor(F.col("n"), share))))


def fold_rates(df: DataFrame, fold: str, score: str, passes: str, row: str, low: bool, share: float = 0.2) -> DataFrame:
    """fold, n, b, s: the pass rate of each fold and that of its best share."""
    r = ranked(df.where(finite(F.col(score), F.col(passes))), score, row, low, [fold])
    return r.groupBy(fold).agg(F.count("*").alias("n"), F.avg(passes).alias("b"), F.avg(F.when(F.col("k") <= size_floor(F.col("n"), share), F.col(passes))).alias("s"))


def pooled_and_folds(df: DataFrame, fold: str, score: str, outcome: str, passes: Column, row: str, low: bool, share: float = 0.2) -> DataFrame:
    """A row: base_rate, selected_rate and factor of enrichment, and precision_sd, the spread over folds of the best share's pass rate, from one ranking."""
    order = _order(score, row, low)
    rows = df.where(finite(F.col(score), F.col(outcome))).select(F.col(fold).alias("__fold"), score, row, passes.cast("double").alias("__pass"))
    dealt = _dealt(rows, order)
    both = _numbered(_numbered(dealt, dealt, order, [], "k", "n"), dealt, order, ["__fold"], "fk", "fn")
    taken = lambda k, n: F.when(F.col(k) <= size_floor(F.col(n), share), F.col("__pass"))
    # Passes are 0 or 1, so sums over folds are exact.
    sums = both.groupBy("__fold").agg(F.count("__pass").alias("n"), F.sum("__pass").alias("b"), F.count(taken("k", "n")).alias("m"), F.sum(taken("k", "n")).alias("s"), F.avg(taken("fk", "fn")).alias("own"))
    rate = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return sums.agg(F.round(rate("b", "n"), 4).alias("base_rate"), F.round(rate("s", "m"), 4).alias("selected_rate"), F.round(F.try_divide(rate("s", "m"), rate("b", "n")), 3).alias("factor"), F.round(F.stddev_samp("own"), 4).alias("precision_sd"))


def sweep(df: DataFrame, score: str, outcome: str, passes: Column, row: str, low: bool, shares: list[float]) -> DataFrame:
    """share, n_selected, selected_rate, factor for each share, from one ranking: sums by rank bands, not a copy of the rows a share."""
    r = ranked(df.where(finite(F.col(score), F.col(outcome))).withColumn("__pass", passes.cast("double")), score, row, low)
    sums = [x for i, s in enumerate(shares) for x in (F.count_if(F.col("k") <= size_floor(F.col("n"), s)).alias(f"n{i}"), F.avg(F.when(F.col("k") <= size_floor(F.col("n"), s), F.col("__pass"))).alias(f"s{i}"))]
    one = r.agg(F.avg("__pass").alias("b"), *sums)
    rows = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"n{i}").alias("n_selected"), F.round(f"s{i}", 4).alias("selected_rate"), F.round(F.try_divide(f"s{i}", "b"), 3).alias("factor")) for i, s in enumerate(shares)])
    return one.select(F.inline(rows))


def precision_grid(df: DataFrame, score: str, outcome: str, row: str, low: bool, shares: list[float], thresholds: list[float], stratum: str | None = None, least: int = 10, size=size_floor) -> DataFrame:
    """share, threshold, n, n_selected, n_hit, base_rate, precision, factor: how many of the best share of rows have an outcome above a threshold.

    With a stratum the share is taken in each stratum of `least` rows or more; rows without one, and those of smaller strata, stay
    in the base rate. Every share and threshold comes from one ranking and one count: shares lie in one another, and so do
    thresholds, so a row is told by the first share that takes it and by how many thresholds it passes.
    """
    shares, thresholds = sorted(shares), sorted(thresholds)
    rows = df.where(finite(F.col(score), F.col(outcome)))
    r = ranked(rows, score, row, low, [stratum] if stratum else [])
    first = F.coalesce(*[F.when(F.col("k") <= size(F.col("n"), x), i) for i, x in enumerate(shares)], F.lit(len(shares)))
    if stratum:
        first = F.when(F.col(stratum).isNotNull() & (F.col("n") >= least), first).otherwise(len(shares))
    passed = sum((F.when(F.col(outcome) > x, 1).otherwise(0) for x in thresholds), F.lit(0))
    counts = r.groupBy(first.alias("first"), passed.alias("passed")).agg(F.count("*").alias("m"))  # a row a share and threshold
    own = counts.select("m", "first", "passed", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))).alias("j"))
    taken, hit = F.col("first") <= F.col("i"), F.col("passed") > F.col("j")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0))
    out = own.groupBy("i", "j").agg(F.sum("m").alias("n"), some(taken).alias("n_selected"), some(taken & hit).alias("n_hit"), some(hit).alias("n_pass"))
    at = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col(i) + 1)
    base, precision = F.col("n_pass") / F.col("n"), F.try_divide("n_hit", "n_selected")
    return out.select(at(shares, "i").alias("share"), at(thresholds, "j").alias("threshold"), "n", "n_selected", "n_hit", F.round(base, 6).alias("base_rate"), F.round(precision, 6).alias("precision"), F.round(F.try_divide(precision, base), 6).alias("factor"))


def best_rows(df: DataFrame, keys: list[str], score: str, row: str) -> DataFrame:
    """Of each key the row with the greatest score, the least row number among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(row))
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def cumulative_cut(df: DataFrame, item: str, n: str, most: float) -> DataFrame:
    """Items by falling n while the middle of each one's share of 360 degrees is at most `most`; for tables of groups."""
    w = Window.orderBy(F.desc(n), F.asc(item))
    total = F.sum(n).over(Window.partitionBy())
    middle = (F.sum(n).over(w) - F.col(n) / 2) / total * 360
    return df.withColumn("angle", F.round(middle, 6)).where(F.col("angle") <= most)
