"""Numeric and array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(c), c)


def finite(*columns: Column) -> Column:
    """All are numbers, neither NaN nor infinite."""
    return reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in columns))


def array_mean(c: Column) -> Column:
    """Mean of an array's elements that are there; null where there are none."""
    own = F.filter(c, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))


def readouts(*columns: Column) -> Column:
    """How many of some array columns hold at least one number."""
    has = [F.coalesce(F.exists(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)).cast("int") for c in columns]
    return reduce(lambda a, b: a + b, has)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def per_dose(value: Column, unit: Column, doses: Column, days: Column) -> Column:
    """A weekly dose as a dose of its own, where the number of doses and the days are there; otherwise as it is."""
    weekly = F.lower(unit).rlike("/\\s*w(ee)?k")
    return F.when(weekly & (doses > 0) & days.isNotNull(), value * days / 7 / doses).otherwise(value)


def within(c: Column, low: float, high: float) -> Column:
    """c, or null outside [low, high]."""
    return F.when(c.between(low, high), c)


def array_within(c: Column, low: float, high: float) -> Column:
    return F.filter(c, lambda x: x.between(low, high))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


def significant(c: Column, digits: int = 3) -> Column:
    """Rounded to significant figures."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def power_of_ten(value: Column, other: Column) -> Column:
    """The k of -3..3 but 0 for which value is other times 10^k; null where there is none."""
    hits = F.filter(F.array(*[F.lit(k) for k in (1, -1, 2, -2, 3, -3)]), lambda k: F.abs(value - other * F.pow(F.lit(10.0), k)) < 1e-6 * F.greatest(F.abs(value), F.lit(1.0)))
    return F.get(hits, F.lit(0))


def dose_scale(found: Column, expected: Column) -> Column:
    """Whether a dose is as expected, a thousand times off either way, or otherwise different."""
    same = lambda a, b: close(a, b, 1e-9, 0.0)
    return F.when(same(found, expected), "same").when(same(found, expected * 1000), "times_1000").when(same(found * 1000, expected), "by_1000").otherwise("other")


def orientation(found: Column, printed: Column) -> Column:
    """Of a percentage of control that should be turned into a percentage of inhibition."""
    turned, same = F.abs(found - (100 - printed)) < 1e-6, F.abs(found - printed) < 1e-6
    return F.when(turned & same, "uninformative").when(turned, "correct").when(same, "unflipped").otherwise("other")


def threshold(c: Column, op: str, value: float) -> Column:
    """Pass or not by a stage's rule."""
    rules = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}
    if op not in rules:
        raise ValueError(f"unknown rule {op}")
    return rules[op]
