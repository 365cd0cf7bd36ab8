"""Audit of extracted tables: grids, completeness and explained omissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[str, Column]], other: str = "unexplained") -> Column:
    """The first rule that holds, in order."""
    return reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit(other))


def explode_channels(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, channel, item, value: one row per number of each array column."""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])
    return df.select(*keys, F.inline(rows)).select(*keys, "channel", F.posexplode("v").alias("item", "value")).where("value IS NOT NULL")


def cells(grid: DataFrame, row: str, values: str) -> DataFrame:
    """row, column, cell of an array column; ragged rows are aligned to the right of the most frequent width."""
    width = grid.groupBy(F.size(values).alias("w")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "w"))["w"].alias("__w"))
    at = grid.crossJoin(F.broadcast(width)).select(row, (F.col("__w") - F.size(values)).alias("__s"), F.posexplode(values).alias("column", "cell"))
    return at.select(row, (F.col("column") + F.col("__s")).alias("column"), "cell")


def forward_fill(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Blank cells take the last cell that isn't."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.nullif(F.trim(column), F.lit("")), ignorenulls=True).over(w))


def consumed(printed: DataFrame, claimed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n_printed, n_claimed, n_found: claimed values met by printed ones as multisets, a printed one used once at most."""
    a = printed.groupBy(*keys, value).agg(F.count("*").alias("a"))
    b = claimed.groupBy(*keys, value).agg(F.count("*").alias("b"))
    both = a.join(b, [*keys, value], "full").na.fill(0, ["a", "b"])
    return both.groupBy(*keys).agg(F.sum("a").alias("n_printed"), F.sum("b").alias("n_claimed"), F.sum(F.least("a", "b")).alias("n_found"))


def ladder(stages: list[tuple[str, DataFrame]], item: str) -> DataFrame:
    """position, stage, n, dropped, strays: items in each stage, lost since the one before, and not in the one before."""
    rows = reduce(DataFrame.unionByName, [d.select(F.col(item).alias("i")).distinct().select(F.lit(k).alias("position"), F.lit(s).alias("stage"), "i") for k, (s, d) in enumerate(stages)])
    # One row per item with the stages that hold it, then sums over stages.
    held = rows.groupBy("i").agg(F.collect_set("position").alias("p"))
    names = [s for s, _ in stages]
    flat = held.select(F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(s).alias("stage"), F.array_contains("p", k).alias("here"), (F.array_contains("p", k - 1) if k else F.array_contains("p", k)).alias("was")) for k, s in enumerate(names)])).alias("x")).select("x.*")
    return flat.groupBy("position", "stage").agg(F.count_if("here").alias("n"), F.count_if(F.expr("was AND NOT here")).alias("dropped"), F.count_if(F.expr("here AND NOT was")).alias("strays"))


def membership(sets: list[tuple[str, DataFrame]], item: str) -> DataFrame:
    """n_sets, n: how many items are in how many of some sets."""
    rows = reduce(DataFrame.unionByName, [d.select(F.col(item).alias("i"), F.lit(s).alias("s")).distinct() for s, d in sets])
    return rows.where("i IS NOT NULL").groupBy("i").agg(F.countDistinct("s").alias("n_sets")).groupBy("n_sets").agg(F.count("*").alias("n"))


def label_classes(df: DataFrame, key: str, label: str) -> DataFrame:
    """key, label: the one label of a class, or all of them as mixed."""
    found = F.array_sort(F.collect_set(label))
    return df.groupBy(key).agg(F.when(F.size(found) > 1, F.concat(F.lit("mixed: "), F.array_join(found, " | "))).otherwise(F.get(found, F.lit(0))).alias(label))


#: What a caption says of conversions.
PERCENT_CONTROL = r"%\s*(control|utc|ltc)|percent\s+control|\bof\s+control\b|untreated control"
DOSE_UNIT = r"\d\s*(µm|μm|um\b|mm\b)|micromolar|millimolar"


def table_strata(df: DataFrame, table: str, dose: str, context: list[str], caption: str) -> DataFrame:
    """table, n, format (a series has three doses or more), n_contexts, multi_column, and what the caption says of conversions."""
    own = df.groupBy(table).agg(F.count("*").alias("n"), F.countDistinct(F.round(dose, 6)).alias("d"), F.countDistinct(F.struct(*context)).alias("n_contexts"), F.lower(F.min(caption)).alias("c"))
    return own.select(table, "n", F.when(F.col("d") >= 3, "dose-series").otherwise("single-dose").alias("format"), "n_contexts", (F.col("n_contexts") > 1).alias("multi_column"), F.col("c").rlike(PERCENT_CONTROL).alias("pct_control"), F.col("c").rlike(DOSE_UNIT).alias("dose_unit"))
