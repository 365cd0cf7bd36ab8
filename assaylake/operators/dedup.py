"""De-duplication by keys, and the lineage of each row through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order; nulls are a key like others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def latest_wins(df: DataFrame, keys: list[str], version: str, order: str) -> DataFrame:
    return first_rows(df, keys, F.desc(version), F.asc(order))


def earliest_group(df: DataFrame, item: str, group: str, name: str = "cv_group") -> DataFrame:
    """All rows, with the least group that each item occurs in; sums up before it joins."""
    least = df.groupBy(item).agg(F.min(group).alias(name))
    return df.join(least, item)


def group_id(endpoint: str, *keys: Column) -> Column:
    """A short stable name of a key: nulls are told from texts, -0.0 is 0.0."""
    parts = F.to_json(F.struct(*[F.coalesce(F.when(k.cast("string") == "-0.0", "0.0").otherwise(k.cast("string")), F.lit("\u0000missing")).alias(f"k{i}") for i, k in enumerate(keys)]))
    return F.concat(F.lit(f"{endpoint}:"), F.substring(F.sha2(parts, 256), 1, 24))


def dispositions(df: DataFrame, keys: list[str], reasons: Column, *order) -> DataFrame:
    """Each row with reasons, eligible, disposition and the place of its winner among equals.

    A row with reasons is discarded by a filter; of the others, the first of each key is kept and the rest are duplicates.
    """
    rows = df.withColumn("reasons", reasons).withColumn("eligible", F.col("reasons") == "")
    rank = F.row_number().over(Window.partitionBy("eligible", *keys).orderBy(*order))
    name = F.when(~F.col("eligible"), "discarded_filter").when(F.col("__k") == 1, "kept_processed").otherwise("discarded_duplicate")
    return rows.withColumn("__k", rank).withColumn("disposition", name).drop("__k")


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows that one multiset has more often than the other."""
    lost = a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("only_left").alias("side"), "n")
    return lost.unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("only_right").alias("side"), "n"))


def first_non_null(column: str, order: str) -> Column:
    return F.min_by(column, order)


def collapse(df: DataFrame, keys: list[str], order: str, arrays: list[str], firsts: list[str]) -> DataFrame:
    """One row per key: each array column the values there are, in order; each other column its first value there is."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]).alias(c) for c in arrays]
    return df.groupBy(*keys).agg(*lists, *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts])


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order, by bars; a null rule does not hold."""
    return F.concat_ws("|", *[F.when(c, n) for n, c in rules.items()])
