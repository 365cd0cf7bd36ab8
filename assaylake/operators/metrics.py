"""Statistics over groups: rank correlations, quantiles, classification and regression figures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .joins import small

#: Ranges that a column's values are dealt into, so that running sums need no task with all rows of a key.
RANGES = 64


def _range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most value, by halves."""
    if not cuts:
        return F.lit(0)
    half = len(cuts) // 2
    return F.when(value >= cuts[half], half + 1 + _range_of(value, cuts[half + 1 :])).otherwise(_range_of(value, cuts[:half]))


def range_cuts(df: DataFrame, values: list[str]) -> list[list[float]]:
    """Approximate quantiles that deal each column's values into RANGES ranges of about the same size; one scan, some numbers back."""
    at = [i / RANGES for i in range(1, RANGES)]
    found = df.agg(*[F.percentile_approx(F.col(v).cast("double"), at, 1000) for v in values]).first()
    return [sorted({x for x in own or [] if math.isfinite(x)}) for own in found]


def cumulated(df: DataFrame, keys: list[str], value: str, counts: list[str], cuts: list[float]) -> DataFrame:
    """df, one row a key and value, with before_<c>, the sum of c over the key's smaller values, and all_<c>, over all of them.

    Values, which are numbers, are dealt into ranges at cuts, so that a key with most of the rows is spread over tasks; what
    goes before a range comes from sums by key and range, RANGES rows a key at most.
    """
    dealt = df.withColumn("__range", _range_of(F.col(value).cast("double"), cuts))
    sums = dealt.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__s_{c}") for c in counts])
    up, whole = Window.partitionBy(*keys).orderBy("__range"), Window.partitionBy(*keys)
    ranges = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__q"), *[(F.sum(f"__s_{c}").over(up) - F.col(f"__s_{c}")).alias(f"__b_{c}") for c in counts], *[F.sum(f"__s_{c}").over(whole).alias(f"all_{c}") for c in counts])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__range") == F.col("__q"))
    inside = Window.partitionBy(*keys, "__range").orderBy(value)
    own = [(F.sum(c).over(inside) - F.col(c)).alias(f"__i_{c}") for c in counts]
    joined = dealt.select("*", *own).join(ranges, same)
    return joined.select(*df.columns, *[(F.col(f"__i_{c}") + F.col(f"__b_{c}")).alias(f"before_{c}") for c in counts], *[f"all_{c}" for c in counts])


def average_ranks(df: DataFrame, keys: list[str], ranked: dict[str, str]) -> DataFrame:
    """df with the mean ranks of some columns among their key, under the names that `ranked` gives. Ranks come from counts per distinct value, joined back."""
    out = df
    for (value, name), cuts in zip(ranked.items(), range_cuts(df, list(ranked)), strict=True):
        counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
        ranks = cumulated(counts, keys, value, ["__n"], cuts).select(*keys, value, (F.col("before___n") + (F.col("__n") + 1) / 2).alias(name))
        out = out.join(ranks, [*keys, value])
    return out


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and the exact linear quantiles of a column, by name; nulls don't count. From counts per distinct value."""
    return _percentiles(_value_counts(df, keys, value), keys, at, range_cuts(df, [value])[0])


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("n"))


def _percentiles(counts: DataFrame, keys: list[str], at: dict[str, float], cuts: list[float]) -> DataFrame:
    """The same from counts (keys, __v, n)."""
    rows = cumulated(counts, keys, "__v", ["n"], cuts)

    def place(i: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n")), F.col("__v")))

    spot = {q: F.lit(q) * (F.col("all_n") - 1) for q in at.values()}
    found = rows.groupBy(*keys).agg(F.max("all_n").alias("all_n"), *[x for n, q in at.items() for x in (place(F.floor(spot[q])).alias(f"__l_{n}"), place(F.ceil(spot[q])).alias(f"__h_{n}"))])
    share = {q: spot[q] - F.floor(spot[q]) for q in at.values()}
    return found.select(*keys, *[((1 - share[q]) * F.col(f"__l_{n}") + share[q] * F.col(f"__h_{n}")).alias(n) for n, q in at.items()])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho and its 95 % interval by Fisher's z; pairs with a null are left out."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    both = average_ranks(own, keys, {x: "rx", y: "ry"})
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("r"))
    half = F.when(F.col("n") > 3, 1.96 / F.sqrt(F.col("n") - 3))
    inner = F.when(F.abs("r") < 1, F.atanh("r"))
    return out.select(*keys, "n", F.round("r", 6).alias("rho"), F.round(F.tanh(inner - half), 6).alias("low"), F.round(F.tanh(inner + half), 6).alias("high"))


def student_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom, through the incomplete beta function."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else math.nan
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return _beta(df / (df + t2), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


#: Steps of the continued fraction; on the side of the middle where it is used it has long stood still by then.
STEPS = 300


def _half_gamma(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): its series at a + 12, and the factors from there back to a."""
    z = a + 12
    log = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    return reduce(Column.__mul__, [(a + j) / (a + j + 0.5) for j in range(12)], F.exp(log))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, less 1."""

    def step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        num = F.when(i == 0, 1.0).when(i % 2 == 0, even).otherwise(odd)
        c, d = 1 + num / s["c"], 1 / (1 + num * s["d"])
        return F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.struct(*[F.lit(v).alias(k) for k, v in (("f", 1.0), ("c", 1.0), ("d", 0.0))]), step, lambda s: s["f"] - 1)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t, as an expression; null for fewer than three pairs, 0 where r is 1 or -1."""
    x, a, half = 1 - r * r, (n - 2) / 2, F.lit(0.5)
    front = F.pow(x, a) * F.sqrt(1 - x) * _half_gamma(a) / math.sqrt(math.pi)
    p = F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x > (a + 1) / (a + 2.5), 1 - front / half * _fraction(1 - x, half, a)).otherwise(front / a * _fraction(x, a, half))
    return F.when((n >= 3) & r.isNotNull(), p)


def significances(pairs: DataFrame, tests: int | None = None) -> DataFrame:
    """pairs (a, b, n, rho) with p and corrected, p by Bonferroni's number of tests: those given, else as many as the table has, each of two triangles' once."""
    m = F.lit(tests) if tests is not None else F.count_distinct(F.array_sort(F.array("a", "b")))
    one = pairs.agg(m.alias("__m"))  # one row
    told = pairs.withColumn("p", correlation_p(F.col("rho"), F.col("n")))
    return told.crossJoin(F.broadcast(one)).withColumn("corrected", F.least(F.col("p") * F.col("__m"), F.lit(1.0))).drop("__m")


def correlations(df: DataFrame, item: str, metrics: list[str], least: int = 10) -> DataFrame:
    """a, b, n, rho for each pair of metrics with enough items that have both, in both triangles.

    Metrics are unpivoted once; items meet themselves, so that a pair costs one row an item.
    """
    long = df.select(item, F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics]))).where("v IS NOT NULL")
    pairs = long.select(item, F.col("m").alias("a"), F.col("v").alias("x")).join(long.select(item, F.col("m").alias("b"), F.col("v").alias("y")), item).where("a <> b")
    return spearman(pairs, ["a", "b"], "x", "y").where(F.col("n") >= least).select("a", "b", "n", "rho")


def bonferroni(p: Column, m: int) -> Column:
    return F.least(p * m, F.lit(1.0))


def median_limit(df: DataFrame, keys: list[str], value: str, times: float = 3.0) -> DataFrame:
    """keys, median, mad and median + times * mad. Rows are counted by value once; deviations come from these counts."""
    counts = checkpointed(_value_counts(df, keys, value))
    med = _percentiles(counts, keys, {"median": 0.5}, range_cuts(counts, ["__v"])[0])
    joined = counts.join(small(med), keys) if keys else counts.crossJoin(F.broadcast(med))  # one row
    away = joined.groupBy(*keys, "median", F.abs(F.col("__v") - F.col("median")).alias("__v")).agg(F.sum("n").alias("n"))
    far = _percentiles(away, [*keys, "median"], {"mad": 0.5}, range_cuts(away, ["__v"])[0])
    return far.select(*keys, F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round(F.col("median") + times * F.col("mad"), 6).alias("upper"))


def impute_median(df: DataFrame, value: str) -> DataFrame:
    """Nulls of a column replaced by its median, one row that is broadcast."""
    return df.crossJoin(F.broadcast(percentiles(df, [], value, {"__m": 0.5}))).withColumn(value, F.coalesce(value, "__m")).drop("__m")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Linear quantiles as columns q025, q500 and so on."""
    names = {f"q{round(q * 1000):03d}": q for q in at}
    return percentiles(df, keys, value, names).select(*keys, *[F.round(n, 6).alias(n) for n in names])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 1), n over equal widths between the least and the greatest value, which is in the last bin; equal ends are widened by a half."""
    same = F.when(F.min(value) == F.max(value), 0.5).otherwise(0.0)
    ends = F.broadcast(df.agg((F.min(value) - same).alias("lo"), (F.max(value) + same).alias("hi")))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))
    return df.crossJoin(ends).where(F.col(value).isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, auc by rank sums, and the threshold and value of the greatest Youden index (score >= threshold is positive).

    Both come from counts per distinct score.
    """
    own = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    t = cumulated(own, keys, score, ["p", "q"], range_cuts(df, [score])[0]).withColumn("below", F.col("before_q")).withColumn("tp", F.col("all_p") - F.col("before_p")).withColumn("fp", F.col("all_q") - F.col("before_q"))
    t = t.withColumn("j", F.round(F.try_divide("tp", "all_p") - F.try_divide("fp", "all_q"), 9))
    return t.groupBy(*keys).agg(
        F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.max("all_p") * F.max("all_q")), 6).alias("auc"),
        F.max(F.struct("j", score))[score].alias("threshold"),
        F.round(F.max("j"), 6).alias("youden"),
    )


def regression(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """n, mae, rmse, pearson, r2 (squared correlation) and determination (1 - residual / total)."""
    d = F.col(y) - F.col(p)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.corr(y, p).alias("c"), F.var_pop(y).alias("v"))
    return out.select(*keys, "n", F.round("mae", 6).alias("mae"), F.round(F.sqrt("mse"), 6).alias("rmse"), F.round("c", 6).alias("pearson"), F.round(F.col("c") * F.col("c"), 6).alias("r2"), F.round(1 - F.try_divide("mse", "v"), 6).alias("determination"))


def confusion(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """Counts, sensitivity, specificity and accuracy; labels that are null are left out."""
    y, p = F.col(label), F.col(predicted)
    out = df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    rate = lambda a, b, name: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6).alias(name)
    return out.select("*", rate("tp", "fn", "sensitivity"), rate("tn", "fp", "specificity"), F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6).alias("accuracy"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables of the same margins that are no likelier."""
    r, s, k = a + b, c + d, a + c
    weight = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(s + 1) - math.lgamma(k - x + 1) - math.lgamma(s - k + x + 1)
    logs = [weight(x) for x in range(max(0, k - s), min(r, k) + 1)]
    top, own = max(logs), weight(a)
    total = sum(math.exp(x - top) for x in logs)
    return min(1.0, sum(math.exp(x - top) for x in logs if x <= own + 1e-7) / total)


def means_in_order(df: DataFrame, key: str, value: str, order: str, mark: float) -> DataFrame:
    """key, mean of doubles, such that comparing it with mark gives the same whatever the deal of rows.

    The last bits of a sum of doubles go by the order of addition. Where they could put a mean on either side of mark, values are
    added one by one in `order`, which is different for each row of a key; other means are sums of parts.
    """
    x = F.col(value)
    own = df.groupBy(key).agg(F.avg(x).alias("__mean"), (F.count(x) * F.avg(F.abs(x))).alias("__bound"))
    # A sum of n doubles is off by n units of the last place of the sum of their sizes at most, a mean by as many of the mean size.
    close = F.coalesce(F.abs(F.col("__mean") - mark) <= 4 * 2.0**-53 * (F.col("__bound") + F.abs(F.col("__mean")) + abs(mark)), F.lit(False))
    own = own.select(F.col(key).alias("__key"), "__mean", close.alias("__close"))
    of = df.join(own.where("__close").select("__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    run = F.sum(x).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    added = of.select(key, value, order, run.alias("__run")).groupBy(key).agg((F.max_by("__run", order) / F.count(x)).alias(value))
    return own.where("NOT __close").select(F.col("__key").alias(key), F.col("__mean").alias(value)).unionByName(added)


def rate(k: Column, n: Column) -> Column:
    """struct<k, n, pct>; 0 where there is nothing."""
    return F.struct(k.alias("k"), n.alias("n"), F.when(n > 0, F.round(100 * k / n, 2)).otherwise(F.lit(0.0)).alias("pct"))


def strata_rates(df: DataFrame, strata: list[str], hit: Column) -> DataFrame:
    """stratum, level, k, n, pct over each column of strata, in one pass by grouping sets of one column each."""
    own = df.select(*strata, hit.alias("__hit"))
    sets = own.groupingSets([[c] for c in strata], *strata).agg(F.count_if("__hit").alias("k"), F.count("*").alias("n"), F.grouping_id().alias("__g"))
    width = len(strata)
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(strata):
        mine = F.col("__g") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        name, level = F.when(mine, c).otherwise(name), F.when(mine, F.col(c).cast("string")).otherwise(level)
    return sets.select(name.alias("stratum"), level.alias("level"), "k", "n", F.round(100 * F.col("k") / F.col("n"), 2).alias("pct"))


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the least among equals; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(value))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and both standard deviations (of a sample and of all) of values that are numbers."""
    own = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"), F.round(F.stddev_pop(value), 6).alias("sd_pop"))


def shares(df: DataFrame, value: str) -> DataFrame:
    """value, n and its share of all rows; the counts, one row a value, are what is summed again."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(value, "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))


def best_marked(df: DataFrame, value: str, name: str, skip: Column | None = None) -> DataFrame:
    """df, a report, with whether a row has the greatest value of a column; skipped rows, such as a baseline, neither count nor are marked."""
    counted = F.lit(True) if skip is None else ~skip
    most = F.broadcast(df.agg(F.max(F.when(counted, F.col(value))).alias("__most")))
    return df.crossJoin(most).withColumn(name, F.coalesce(counted & (F.col(value) == F.col("__most")), F.lit(False))).drop("__most")
