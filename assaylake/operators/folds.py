"""Grouped cross-validation folds and the audits of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_GROUPS = 100_000


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, fold (from 1): groups by falling size each go to the fold that is lightest so far.

    The fold of a group depends on all larger ones, so the sizes, one row a group and at most MOST_GROUPS of them, are folded in one
    array expression.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    if sizes.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(group).alias("g")))).alias("a"))
    start = F.struct(F.array(*[F.lit(0).cast("long") for _ in range(folds)]).alias("load"), F.array().cast("array<int>").alias("to"))

    def place(state, x):
        to = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda v, i: F.when(i == to - 1, v - x["n"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    folded = listed.select("a", F.aggregate("a", start, place)["to"].alias("to"))
    return folded.select(F.inline(F.zip_with("a", "to", lambda x, f: F.struct(x["g"].alias(group), f.alias("fold")))))


def leakage(df: DataFrame, item: str, fold: str) -> DataFrame:
    """fold, n_items, n_leaked: items of each test fold that its training rows hold too."""
    spread = df.select(item, fold).distinct()
    many = spread.groupBy(item).agg(F.count("*").alias("m"))
    return spread.join(many, item).groupBy(fold).agg(F.count("*").alias("n_items"), F.count_if(F.col("m") > 1).alias("n_leaked"))


def frozen_changes(frozen: DataFrame, now: DataFrame, item: str) -> DataFrame:
    """change, n: items missing, extra or moved against a frozen fold map (item, fold)."""
    both = frozen.select(item, F.col("fold").alias("f")).join(now.select(item, F.col("fold").alias("g")), item, "full")
    kind = F.when(F.col("g").isNull(), "missing").when(F.col("f").isNull(), "extra").when(F.col("f") != F.col("g"), "moved").otherwise("same")
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def holdout(df: DataFrame, group: str, held: list) -> DataFrame:
    """df with split: all rows of the held groups are test."""
    return df.withColumn("split", F.when(F.col(group).isin(held), "test").otherwise("train"))
