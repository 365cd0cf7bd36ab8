"""Precision by share and threshold, and bootstrap intervals of enrichment on shared draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample, topk
from .registry import Tables, query

SHARES, THRESHOLDS = [0.01, 0.05, 0.1, 0.2, 0.5], [10.0, 25.0, 40.0, 45.0]
DRAWS, CURVE = 5000, [0.05, 0.1, 0.2, 0.3, 0.5]
OPERATING = 0.1

_ARMS = "x AS (SELECT l_quantity AS o, stratum AS s, row_number() OVER ({over} ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber DESC) AS k, count(*) OVER ({over}) AS n FROM r)"
_GRID = """SELECT share, threshold, count(*) AS n, count(*) FILTER (taken) AS n_selected, count(*) FILTER (taken AND o > threshold) AS n_hit, round(avg((o > threshold)::INT), 6) AS base_rate, round(avg((o > threshold)::INT) FILTER (taken), 6) AS precision, round(avg((o > threshold)::INT) FILTER (taken) / avg((o > threshold)::INT), 6) AS factor
FROM (SELECT *, {taken} AS taken FROM x, (SELECT unnest({shares}::DOUBLE[]) AS share), (SELECT unnest({thresholds}::DOUBLE[]) AS threshold)) GROUP BY 1, 2"""
_STRATUM = "CASE WHEN l_suppkey % 7 <> 0 THEN l_returnflag || l_suppkey % 13 END"


def _rows(t: Tables):
    stratum = F.when(F.col("l_suppkey") % 7 != 0, F.concat("l_returnflag", (F.col("l_suppkey") % 13).cast("string")))
    return t.lineitem.select("l_extendedprice", "l_quantity", stratum.alias("stratum"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))


def _sql(over: str, taken: str) -> str:
    return f"WITH r AS (SELECT *, {_STRATUM} AS stratum FROM lineitem), {_ARMS.format(over=over)} " + _GRID.format(taken=taken, shares=SHARES, thresholds=THRESHOLDS)


@query(_sql("", "k <= greatest(1, floor(share * n))"))
def precision_grid(t: Tables):
    return topk.precision_grid(_rows(t), "l_extendedprice", "l_quantity", "row", False, SHARES, THRESHOLDS)


@query(_sql("PARTITION BY stratum", "s IS NOT NULL AND n >= 10 AND k <= greatest(1, floor(share * n))"))
def precision_grid_strata(t: Tables):
    """The same with each share taken within strata; rows without one stay in the base rate."""
    return topk.precision_grid(_rows(t), "l_extendedprice", "l_quantity", "row", False, SHARES, THRESHOLDS, "stratum")


def _pair(text: str) -> str:
    return ", ".join(f"('0x' || substr(md5({text}), {at}, 8))::BIGINT % {resample.PRIME} AS {n}" for at, n in ((1, "x"), (9, "y")))


def _draws(name: str, table: str, row: str, score: str, passes: str, seed: int, shares: list[float]) -> str:
    steps = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in resample.POISSON)
    return f"""{name}d AS (SELECT range AS draw, {_pair(f"'{seed}|draw|' || range")} FROM range({DRAWS})), {name}r AS (SELECT {row} AS r, {score} AS s, ({passes})::INT AS good, {_pair(f"'{seed}|' || {row}")} FROM {table}),
{name}u AS (SELECT draw, r, s, good, ((a.x * b.x + a.y * b.y) % {resample.PRIME}) / {resample.PRIME}.0::DOUBLE AS u FROM {name}r a, {name}d b), {name}w AS (SELECT draw, r, s, good, {steps} AS w FROM {name}u),
{name}c AS (SELECT draw, good, w, sum(w) OVER (PARTITION BY draw ORDER BY s DESC, r DESC) - w AS ahead, sum(w) OVER (PARTITION BY draw) AS total, sum(w * good) OVER (PARTITION BY draw) AS passed FROM {name}w WHERE w > 0),
{name} AS (SELECT share, draw, sum(least(w, greatest(0, greatest(1, round_even(share * total, 0)) - ahead)) * good) / greatest(1, round_even(share * any_value(total), 0)) / nullif(any_value(passed) / any_value(total), 0) AS factor FROM {name}c, (SELECT unnest({shares}::DOUBLE[]) AS share) GROUP BY share, draw, total)"""


def _interval(by: str, table: str) -> str:
    return f"SELECT {by}count(factor) AS n, " + ", ".join(f"round(quantile_cont(factor, {q}) + 1e-9, 4) AS {n}" for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))) + f" FROM {table}"


def _gates(t: Tables, shares: list[float]):
    one = t.customer.withColumn("good", (F.col("c_acctbal") + F.col("c_custkey") % 2000 > 6000).cast("double"))
    two = t.part.withColumn("good", (F.col("p_size") + F.floor(F.col("p_retailprice")) % 10 > 30).cast("double"))
    return [resample.enrichment_draws(d, s, "good", r, False, shares, DRAWS, seed) for d, s, r, seed in ((one, "c_acctbal", "c_custkey", 4274), (two, "p_size", "p_partkey", 4275))]


_ONE = ("customer", "c_custkey", "c_acctbal", "c_acctbal + c_custkey % 2000 > 6000", 4274)
_TWO = ("part", "p_partkey", "p_size", "p_size + floor(p_retailprice) % 10 > 30", 4275)


@query(f"WITH {_draws('a', *_ONE, CURVE)} {_interval('share, ', 'a')} GROUP BY 1")
def enrichment_curve(t: Tables):
    """Enrichment by share with its interval; every share is taken of the same 5000 samples."""
    return resample.intervals(_gates(t, CURVE)[0], ["share"], "factor")


@query(f"WITH {_draws('a', *_ONE, [OPERATING])}, {_draws('b', *_TWO, [OPERATING])}, j AS (SELECT a.factor * b.factor AS factor FROM a JOIN b USING (draw)) {_interval('', 'j')}")
def compounded_enrichment(t: Tables):
    """Two gates' enrichment multiplied draw by draw, and its interval."""
    return resample.intervals(resample.compounded(_gates(t, [OPERATING])), [], "factor")
