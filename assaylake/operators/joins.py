"""Joins with the checks and fall-backs that cleaning and auditing need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from .graph import checkpointed


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast where it has at most `most` rows; beyond that, Spark chooses."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """df dealt out by keys, some `rows` rows a task: for work whose cost lies in its rows, where a file of few bytes is one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def first_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value: the first value that is there, in an order, for each key that is there."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; evaluating it raises an error where a key occurs more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"keys {keys} are not unique")).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def validated_left(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A left join that is one_to_one or many_to_one, or an error."""
    if how not in ("one_to_one", "many_to_one"):
        raise ValueError(how)
    return (unique(left, keys) if how == "one_to_one" else left).join(unique(right, keys), keys, "left")


def lookup_or_self(df: DataFrame, column: str, names: DataFrame, key: str, value: str) -> DataFrame:
    """column replaced by what names has for it; others stay."""
    found = small(names.select(F.col(key).alias("__k"), F.col(value).alias("__v")))
    return df.join(found, F.col(column) == F.col("__k"), "left").withColumn(column, F.coalesce("__v", column)).drop("__k", "__v")


def unique_prefix(names: DataFrame, name: str, catalogue: DataFrame, key: str, least: int = 3) -> DataFrame:
    """name, key: names of `least` signs or more that exactly one catalogue key begins with.

    Both sides are cut to their first `least` signs, so that this is an equi-join with a check, not all pairs.
    """
    left = names.select(name).distinct().where(F.length(name) >= least).withColumn("__p", F.substring(name, 1, least))
    right = catalogue.select(key).distinct().withColumn("__p", F.substring(key, 1, least))
    pairs = left.join(right, "__p").where(F.col(key).startswith(F.col(name)))
    return pairs.groupBy(name).agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n = 1").drop("n")


def lookup_cascade(names: DataFrame, name: str, key: str, manual: DataFrame, catalogue: DataFrame, primary) -> DataFrame:
    """name, match, source for each distinct name: null; primary; manual (which may match nothing); exact; the one prefix; unmapped.

    key is the column with the name's normal form, catalogue has key, manual has (name, mapped key or the empty text).
    """
    own = names.select(name, key).distinct()
    by_hand = manual.select(F.col(name), F.col("mapped"), F.lit(True).alias("__hand"))
    exact = catalogue.select(F.col("key").alias("__exact")).distinct()
    prefix = unique_prefix(own.select(F.col(key)), key, catalogue.select(F.col("key").alias("__prefix")), "__prefix")
    out = own.join(by_hand, name, "left").join(exact, F.coalesce(F.nullif("mapped", F.lit("")), F.col(key)) == F.col("__exact"), "left").join(prefix, key, "left")
    hand, hit = F.coalesce("__hand", F.lit(False)), F.col("__exact").isNotNull()
    source = F.when(F.col(name).isNull(), "unmapped").when(primary, "primary").when(hand, "manual").when(hit, "exact").when(F.col("__prefix").isNotNull(), "prefix").otherwise("unmapped")
    match = F.when(source == "manual", F.when(F.col("mapped") != "", F.col("__exact"))).when(source == "exact", F.col("__exact")).when(source == "prefix", F.col("__prefix"))
    return out.select(name, match.alias("match"), source.alias("source"))


def follow_links(links: DataFrame, item: str, target: str, rounds: int = 64) -> DataFrame:
    """item, final: where each chain of links ends; a missing target ends it, a cycle raises an error.

    Chains are halved in each round, by joining the links with themselves; a chain of n links takes log2(n) rounds.
    """
    now = links.select(F.col(item), F.col(target).alias("final"))
    for _ in range(rounds):
        next_ = now.select(F.col(item).alias("final"), F.col("final").alias("__next"))
        joined = checkpointed(now.join(next_, "final", "left").select(item, F.coalesce("__next", "final").alias("final"), F.col("__next").isNotNull().alias("__moved")))
        now = joined.drop("__moved")
        if joined.where("__moved").isEmpty():
            return now
        if not joined.where(F.col(item) == F.col("final")).isEmpty():
            break
    raise ValueError("links form a cycle")


def contained_once(probes: DataFrame, texts: DataFrame, key: str, probe: str, text: str) -> DataFrame:
    """Rows of probes whose probe occurs exactly once in the text of the same key, with its place (from 1)."""
    return probes.join(texts, key).where(occurrences(F.col(text), F.col(probe)) == 1).withColumn("place", F.position(F.col(probe), F.col(text))).drop(text)


def prefer_context(left: DataFrame, right: DataFrame, keys: list[str], agrees, context, left_id: str, order: str) -> DataFrame:
    """Each left row with the first right row that agrees, rows of the same context before others."""
    joined = left.alias("l").join(right.alias("r"), keys).where(agrees)
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(context.cast("int").desc(), order))
    return joined.withColumn("__k", rank).where("__k = 1").drop("__k")
