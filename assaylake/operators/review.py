"""Review of extracted values against what was printed: agreement, gaps, ledgers, lineage and provenance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_reasons(df: DataFrame, keys: list[str], reasons: str, most: int = 3) -> DataFrame:
    """keys, reason, n, place: the most frequent of the reasons (by bars) of each key; 'none' where there is none."""
    each = df.select(*keys, F.explode(F.split(F.when(F.col(reasons) == "", "none").otherwise(F.coalesce(reasons, F.lit("none"))), r"\|")).alias("reason"))
    counts = each.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "reason"))).where(F.col("place") <= most)


def composed(exact: DataFrame, near: DataFrame, item: str, target: str) -> DataFrame:
    """item, target: where an item's exact canonical one goes by near links, else where it goes by exact ones."""
    return exact.join(near.select(F.col(item).alias(target), F.col(target).alias("__far")), target, "left").select(item, F.coalesce("__far", target).alias(target))


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with whether its row is the first of its key in order."""
    return df.withColumn("is_first", F.col(order) == F.min(order).over(Window.partitionBy(*keys)))


def isolated(items: DataFrame, item: str, content: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """item of those that share their content with no other and that no link holds."""
    alone = items.groupBy(content).agg(F.count("*").alias("n"), F.min(item).alias(item)).where("n = 1").select(item)
    held = links.select(F.col(a).alias(item)).union(links.select(F.col(b).alias(item)))
    return alone.join(held, item, "left_anti")


def set_differences(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """key, only_left, only_right: members that one side's set of a key has and the other's has not; keys that agree go."""
    one, two = (d.select(key, member).distinct().withColumn(n, F.lit(True)) for d, n in ((left, "__l"), (right, "__r")))
    both = one.join(two, [key, member], "full").groupBy(key).agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"))
    return both.where("only_left > 0 OR only_right > 0")


def reconciled(found: DataFrame, ledger: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key, then per kind of error how many were found and how many the ledger explains, and whether all agree."""
    a = found.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_found") for k in kinds])
    b = ledger.groupBy(key).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_told") for k in kinds])
    both = a.join(b, key, "full").na.fill(0)
    return both.withColumn("agrees", reduce(Column.__and__, [F.col(f"{k}_found") == F.col(f"{k}_told") for k in kinds]))


def evidence(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """key, n, digest: SHA-256 over the sorted rows of a key, so that order tells nothing and repeats count."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in parts]), 256)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("digest"))


def field_agreement(df: DataFrame, fields: list[tuple[str, Column, Column]]) -> DataFrame:
    """field, n_both, n_same, only_left, only_right of pairs of columns (name, left, right), in one pass."""
    sums = [x for n, a, b in fields for x in (F.count_if(a.isNotNull() & b.isNotNull()).alias(f"{n}_n"), F.count_if(a == b).alias(f"{n}_s"), F.count_if(a.isNotNull() & b.isNull()).alias(f"{n}_a"), F.count_if(a.isNull() & b.isNotNull()).alias(f"{n}_b"))]
    rows = [F.struct(F.lit(n).alias("field"), *[F.col(f"{n}_{k}").alias(m) for k, m in (("n", "n_both"), ("s", "n_same"), ("a", "only_left"), ("b", "only_right"))]) for n, *_ in fields]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def arm_gaps(gold: DataFrame, found: DataFrame, key: str, arm: str, column: str) -> DataFrame:
    """key, missing, invented, transposed: arms that only one side has, and whether the sides have the same arms in other columns."""
    sets = lambda d, n: d.groupBy(key).agg(F.collect_set(arm).alias(f"{n}_arms"), F.collect_set(F.struct(column, arm)).alias(f"{n}_cells"))
    both = sets(gold, "g").join(sets(found, "f"), key, "full")
    none = F.array().cast("array<string>")
    g, f = F.coalesce(F.col("g_arms").cast("array<string>"), none), F.coalesce(F.col("f_arms").cast("array<string>"), none)
    missing, invented = F.size(F.array_except(g, f)), F.size(F.array_except(f, g))
    moved = (missing == 0) & (invented == 0) & (F.size(F.array_except("g_cells", "f_cells")) > 0)
    return both.select(key, missing.alias("missing"), invented.alias("invented"), F.coalesce(moved, F.lit(False)).alias("transposed"))


def recall_split(df: DataFrame, keys: list[str], kept: Column, extracted: Column) -> DataFrame:
    """keys, n, filter_recall, extraction_recall, recall: what filters keep of the gold rows, what of that was extracted, and both."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(kept).alias("k"), F.count_if(kept & extracted).alias("x"))
    return out.select(*keys, "n", F.round(F.try_divide("k", "n"), 6).alias("filter_recall"), F.round(F.try_divide("x", "k"), 6).alias("extraction_recall"), F.round(F.try_divide("x", "n"), 6).alias("recall"))


def lifted(release: DataFrame, lineage: DataFrame, contributors: DataFrame, group: str, source: str, channel: str, value: str) -> DataFrame:
    """source, channel, value: release values that a source reaches through lineage; where a group has contributors of a channel, only those count."""
    # Values carry their contributors to the join with the sources, so that no pair of a value and a source is shuffled.
    own = contributors.groupBy(group, channel).agg(F.collect_set(source).alias("__own"))
    told = release.join(own, [group, channel], "left").join(lineage.select(group, source).distinct(), group)
    return told.where(F.col("__own").isNull() | F.array_contains("__own", F.col(source))).select(source, channel, value)


def relationship(df: DataFrame, key: str, state: str) -> DataFrame:
    """key, relationship of each class: absent where all are, mixed where some are, else partial where any is, else equivalent."""
    absent, partial = F.col(state) == "absent", F.col(state) == "partial"
    found = F.when(F.bool_and(absent), "absent").when(F.bool_or(absent), "mixed").when(F.bool_or(partial), "partial").otherwise("equivalent")
    return df.groupBy(key).agg(found.alias("relationship"))


def row_identifier(cells: Column, known: Column, controls: str) -> Column:
    """A printed row's compound: the first run of 4 to 7 digits that is known, else the first control's name, else null."""
    runs = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{4,7})(?!\d)"), F.lit(1))))
    ids = F.filter(runs, lambda r: F.array_contains(known, r))
    names = F.filter(F.transform(cells, lambda c: F.regexp_extract(F.lower(c), rf"\b({controls})\b", 1)), lambda n: n != "")
    return F.coalesce(F.get(ids, F.lit(0)), F.get(names, F.lit(0)))


def provenance(df: DataFrame, item: str, content: str, similar: Column, ok: Column) -> DataFrame:
    """df with category: failed, self (the first of its content, or the only one), exact (a later copy) or false_similarity (linked, but not by content)."""
    w = Window.partitionBy(content)
    first = F.min(item).over(w) == F.col(item)
    return df.withColumn("category", F.when(~ok, "failed").when(~first, "exact").when(similar & (F.count("*").over(w) == 1), "false_similarity").otherwise("self"))


def replayed(frozen: DataFrame, now: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """keys, n, n_missing, n_extra, n_off: whether labels re-attached by fold and row number are those that were frozen."""
    both = frozen.select(*keys, "row", F.col(value).alias("__a"), F.lit(True).alias("__x")).join(now.select(*keys, "row", F.col(value).alias("__b"), F.lit(True).alias("__y")), [*keys, "row"], "full")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("__y").isNull()).alias("n_missing"), F.count_if(F.col("__x").isNull()).alias("n_extra"), F.count_if(F.abs(F.col("__a") - F.col("__b")) > tolerance).alias("n_off"))


def mapped(df: DataFrame, keys: list[str], source: str, spec: list[dict[str, str]]) -> DataFrame:
    """keys, entry and the named fields: one row for each entry of a mapping spec, whose fields name keys of the source map."""
    names = list(dict.fromkeys(n for e in spec for n in e))
    rows = F.array(*[F.struct(F.lit(i).alias("entry"), *[(F.element_at(F.col(source), e[n]) if n in e else F.lit(None).cast("string")).alias(n) for n in names]) for i, e in enumerate(spec)])
    out = df.select(*keys, F.inline(rows))
    return out.where(reduce(Column.__or__, [F.col(n).isNotNull() for n in names]))


#: Vetted conversions of a text, by name; nothing else is run on extracted tables.
CONVERSIONS: dict[str, Callable[[Column], Column]] = {
    "number": lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("double"),
    "percent": lambda c: F.regexp_extract(c, r"^\s*([-+]?[\d.]+)\s*%?\s*$", 1).try_cast("double"),
    "inhibition": lambda c: 100 - F.regexp_extract(c, r"^\s*([-+]?[\d.]+)\s*%?\s*$", 1).try_cast("double"),
}


def converted(c: Column, name: str) -> Column:
    """struct<ok, value, error> of a vetted conversion; an error a value, not a job."""
    if name not in CONVERSIONS:
        raise ValueError(f"no conversion {name}")
    v = CONVERSIONS[name](c)
    return F.struct(v.isNotNull().alias("ok"), v.alias("value"), F.when(v.isNull(), F.concat(F.lit(f"not a {name}: "), F.coalesce(c, F.lit("null")))).alias("error"))


def stage_tree(entries: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """key, item, n, values: entries by key and compound; those without an id, or with one of three digits or fewer, go; repeats are kept in order."""
    ok = F.col(item).isNotNull() & (F.length(F.regexp_extract(F.col(item).cast("string"), r"\d+", 0)) > 3)
    return entries.where(ok).groupBy(key, item).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("values"))
