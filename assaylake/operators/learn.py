"""Models over folds: ridge, forests, boosted trees and nearest neighbours."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .joins import dealt
from .resample import POISSON

MODELS = {
    "ridge": lambda: LinearRegression(featuresCol="__features", labelCol="y", regParam=1.0, elasticNetParam=0.0),
    "forest": lambda: RandomForestRegressor(featuresCol="__features", labelCol="y", numTrees=500, maxDepth=20, seed=7),
    "boosted": lambda: GBTRegressor(featuresCol="__features", labelCol="y", maxIter=20, maxDepth=4, seed=7),
}


#: Rows whose vectors are multiplied in one task, and queries at once.
BLOCK, QUERIES = 20_000, 256


def cross_validated(df: DataFrame, features: list[str], target: str, fold: str, row: str, model: str) -> DataFrame:
    """row, fold, y_true, y_pred: each fold predicted by a model fitted on the others' rows with all features and a target; null where a row lacks a feature."""
    own = df.withColumn("y", F.col(target).cast("double"))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])
    data = VectorAssembler(inputCols=features, outputCol="__features").transform(own.where(whole)).select(row, fold, "__features", "y")
    lacking = own.where(~F.coalesce(whole, F.lit(False))).select(row, fold, F.col("y").alias("y_true"), F.lit(None).cast("double").alias("y_pred"))
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect() if r[0] is not None]
    if model == "forest":
        found = _forest(own.where(whole & F.col(fold).isNotNull()), features, fold, row, folds, MODELS[model]())
        return found.unionByName(lacking)
    data = checkpointed(dealt(data, row))  # boosting reads it some hundred times
    with ThreadPool(max(1, len(folds))) as pool:
        fit = inheritable_thread_target(data.sparkSession)(lambda f: MODELS[model]().fit(data.where((F.col(fold) != f) & F.col("y").isNotNull())))
        models = pool.map(fit, folds)
    parts = [m.transform(data.where(F.col(fold) == f)) for m, f in zip(models, folds, strict=True)]
    return reduce(DataFrame.unionByName, parts).select(row, fold, F.col("y").alias("y_true"), F.col("prediction").alias("y_pred")).unionByName(lacking)


#: Trees that are grown in one task.
TREES = 8


def _edges(df: DataFrame, features: list[str], most: int) -> list[list[float]]:
    """Where each feature is cut: between all its values, or at quantiles where they are more than `most`."""
    out = []
    for c in features:
        values = sorted(r[0] for r in df.select(F.col(c).cast("double")).distinct().limit(most + 1).collect())
        if len(values) > most:
            out.append(sorted(set(df.agg(F.percentile_approx(F.col(c).cast("double"), [k / most for k in range(1, most)], 10_000)).first()[0])))
        else:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
    return out


def _forest(df: DataFrame, features: list[str], fold: str, row: str, folds: list, model: RandomForestRegressor) -> DataFrame:
    """row, fold, y_true, y_pred by forests with the settings of `model`, one a fold.

    Rows with equal bins of all features are one cell, all that a tree can tell apart (bins are cut by the features of all folds; no
    outcome is used). A row has a weight of its own in each tree, Poisson(1) by a hash, the same in every fold's forest. Weights and
    weighted outcomes are added by cell where the rows are; a tree gets sums by cell, never rows, and gives sums of predictions by cell.
    """
    trees, depth, bins, seed = model.getNumTrees(), model.getMaxDepth(), model.getMaxBins(), model.getSeed()
    subset, width = -(-len(features) // 3), len(features)
    edges = _edges(df, features, bins)
    place = lambda c, cuts: F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda e: e < c)) if cuts else F.lit(0)
    cell = F.array(*[place(F.col(c).cast("double"), cuts) for c, cuts in zip(features, edges, strict=True)])
    index = F.array_position(F.array(*map(F.lit, folds)), F.col(fold)).cast("int") - 1
    rows = df.select(F.col(row).alias("__row"), F.col(fold).alias("__fold"), "y", index.alias("f"), cell.alias("cell"))

    def add(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(b) if isinstance(b, pa.RecordBatch) else b
            key = np.column_stack([t["f"].to_numpy(), t["cell"].combine_chunks().flatten().to_numpy().reshape(-1, width)]).astype(np.uint8)
            y = t["y"].to_numpy(zero_copy_only=False).astype(float)
            there, h = ~np.isnan(y), t["h"].to_numpy().astype(np.uint64)
            cells, of = np.unique(key, axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(of.ravel()[order]) != 0))
            y, there, h = np.where(there, y, 0.0)[order, None], there[order, None], h[order, None]
            for part in range(-(-trees // TREES)):
                w = _poisson(h, np.arange(part * TREES, min(trees, (part + 1) * TREES))) * there
                sums = np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * y, starts, axis=0)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": [cells.tobytes()], "w": [sums[0].astype(np.uint32).tobytes()], "wy": [sums[1].tobytes()]})

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        first = key[0].as_py() * TREES
        n = min(TREES, trees - first)
        blob = lambda c, kind, k: np.concatenate([np.frombuffer(x.as_buffer(), kind).reshape(-1, k) for x in t.column(c)])
        cells, of = np.unique(blob("cells", np.uint8, width + 1), axis=0, return_inverse=True)
        w, wy, found = blob("w", np.uint32, n), blob("wy", float, n), np.zeros(len(cells))
        for k in range(n):
            own, total = np.bincount(of.ravel(), w[:, k], len(cells)), np.bincount(of.ravel(), wy[:, k], len(cells))
            for f in range(len(folds)):
                held, fit = cells[:, 0] == f, (cells[:, 0] != f) & (own > 0)
                found[held] += _tree(cells[fit, 1:], own[fit], total[fit], cells[held, 1:], depth, bins, subset, np.random.default_rng([seed, first + k, f]))
        values = pa.array(cells[:, 1:].astype(np.int32).ravel())
        return pa.table({"f": pa.array(cells[:, 0].astype(np.int32)), "cell": pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * width), values), "total": found})

    sums = dealt(rows.select("f", "cell", "y", F.xxhash64(F.lit(seed), "__row").alias("h")), "cell").mapInArrow(add, "part int, cells binary, w binary, wy binary")
    found = sums.groupBy("part").applyInArrow(grow, "f int, cell array<int>, total double").groupBy("f", "cell").agg((F.sum("total") / trees).alias("y_pred"))
    return rows.join(found, ["f", "cell"]).select(F.col("__row").alias(row), F.col("__fold").alias(fold), F.col("y").alias("y_true"), F.nanvl("y_pred", F.lit(None).cast("double")).alias("y_pred"))


def _poisson(h: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Weights of rows (hashes, a column) in draws: Poisson(1) of mixed bits."""
    with np.errstate(over="ignore"):
        x = h + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return sum((u >= np.uint64(int(s * (1 << 53)))).astype(np.int64) for s in POISSON)


def _tree(x: np.ndarray, w: np.ndarray, wy: np.ndarray, other: np.ndarray, depth: int, bins: int, subset: int, rng: np.random.Generator) -> np.ndarray:
    """Predictions for the cells `other` by a tree of cells x with weights and weighted outcomes, level by level; each node tries `subset` features."""
    if not len(x):
        return np.full(len(other), np.nan)
    middle = wy.sum() / w.sum()
    wy = wy - middle * w
    out, live = np.zeros(len(other)), np.arange(len(other))
    at, to, k = np.zeros(len(x), int), np.zeros(len(other), int), 1
    least = 1e-12 * (wy * wy / w).sum()
    for level in range(depth + 1):
        n, y = np.bincount(at, w, k), np.bincount(at, wy, k)
        out[live] = (y / n)[to]
        if level == depth:
            break
        tried = np.argsort(rng.random((k, x.shape[1])), axis=1)[:, :subset]
        best, feature, cut = np.full(k, least), np.full(k, -1), np.zeros(k, int)
        before_n, before_y = np.cumsum(n) - n, np.cumsum(y) - y
        for f in tried.T:
            key = at * bins + x[np.arange(len(x)), f[at]]
            order = np.argsort(key)
            key = key[order]
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            node, b = key[last] // bins, key[last] % bins
            left_n, left_y = np.cumsum(w[order])[last] - before_n[node], np.cumsum(wy[order])[last] - before_y[node]
            right_n, right_y = n[node] - left_n, y[node] - left_y
            gain = np.where(right_n > 0.5, left_y**2 / left_n + right_y**2 / np.maximum(right_n, 1) - (y**2 / n)[node], 0.0)
            most = np.maximum.reduceat(gain, np.flatnonzero(np.append(True, node[1:] != node[:-1])))
            hit = np.flatnonzero(gain == most[node])
            hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])]
            better = most > best
            best, feature, cut = np.where(better, most, best), np.where(better, f, feature), np.where(better, b[hit], cut)
        split = feature >= 0
        if not split.any():
            break
        name = 2 * (np.cumsum(split) - 1)
        keep, follow = split[at], split[to]
        x, w, wy, at, other, live, to = x[keep], w[keep], wy[keep], at[keep], other[follow], live[follow], to[follow]
        at, to = (name[i] + (c[np.arange(len(c)), feature[i]] > cut[i]) for i, c in ((at, x), (to, other)))
        k = 2 * int(split.sum())
    return out + middle


def saved(model, path: str):
    """A fitted model written and read again, as its own class reads it."""
    model.write().overwrite().save(path)
    return type(model).load(path)


def neighbours(queries: DataFrame, base: DataFrame, item: str, vector: str, k: int, most_queries: int = 10_000) -> DataFrame:
    """query, neighbour, similarity, place: the k nearest by cosine of each query row, itself not counted.

    Queries go to where the rows are, in blocks of some most_queries rows by a hash of their ids, and partial top-k lists are merged.
    """
    blocks = -(-queries.count() // most_queries)
    if blocks > 1:
        of = F.pmod(F.xxhash64(item), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_neighbours(queries.where(of == i), base, item, vector, k) for i in range(blocks)])
    return _neighbours(queries, base, item, vector, k)


def _neighbours(queries: DataFrame, base: DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """Rows are dealt to blocks by a hash, queries go to each; a block multiplies its vectors at once and keeps what can be among its k nearest."""
    blocks = max(1, -(-base.count() // BLOCK))
    of = F.pmod(F.xxhash64(item), F.lit(blocks))
    wide = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    left = queries.select(F.col(item).alias("i"), wide(vector).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__p"))
    right = base.select(F.col(item).alias("i"), wide(vector).alias("v"), of.alias("__p"))
    kind = base.schema[item].dataType.simpleString()

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and b.num_rows:
            width = max(_width(q), _width(b))
            (own, u, m), (other, v, n) = _unit(q, width), _unit(b, width)
            places = {x: j for j, x in enumerate(other.to_pylist())}
            for at in range(0, len(u), QUERIES):
                s = u[at : at + QUERIES] @ v.T
                # A pair without a similarity comes last, one that is no number first, as in an ordering by Spark.
                rank = np.where(m[at : at + QUERIES, None] & n, np.where(np.isnan(s), np.inf, s), -2.0)
                same = [(r, places[x]) for r, x in enumerate(own.slice(at, len(s)).to_pylist()) if x in places]
                rank[[r for r, _ in same], [c for _, c in same]] = -np.inf
                # Roundings of the k-th best and of what is just below it may be equal, so all of them go on.
                most = min(k, rank.shape[1])
                low = np.partition(rank, -most, axis=1)[:, -most, None]
                r, c = np.nonzero((rank >= low - 2e-6) & (rank > -np.inf))
                parts.append(pa.table({"query": own.take(pa.array(r + at)), "neighbour": other.take(pa.array(c)), "similarity": pa.array(s[r, c], mask=rank[r, c] == -2.0)}))
        schema = pa.schema([("query", q.schema.field("i").type), ("neighbour", b.schema.field("i").type), ("similarity", pa.float64())])
        return pa.concat_tables(parts).cast(schema) if parts else schema.empty_table()

    found = left.groupBy("__p").cogroup(right.groupBy("__p")).applyInArrow(run, f"query {kind}, neighbour {kind}, similarity double")
    scored = found.select("query", "neighbour", F.round("similarity", 6).alias("similarity"))
    whole = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return scored.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= k)


def _width(rows: pa.Table) -> int:
    return pc.max(pc.list_value_length(rows.column("v"))).as_py() or 1


def _unit(rows: pa.Table, width: int) -> tuple:
    """Ids, vectors of length 1 and whether there is one: not for null or zero vectors, those with a null and those of another width."""
    vectors, ids = rows.column("v").combine_chunks(), rows.column("i").combine_chunks()
    if vectors.null_count == 0 and vectors.flatten().null_count == 0 and len(vectors.flatten()) == width * len(vectors) and pc.min(pc.list_value_length(vectors)).as_py() == width:
        there, x = np.ones(len(vectors), bool), vectors.flatten().to_numpy().reshape(len(vectors), width)
    else:
        own = vectors.to_pylist()
        there = np.array([v is not None and len(v) == width and None not in v for v in own])
        x = np.array([v if ok else [0.0] * width for v, ok in zip(own, there, strict=True)], float)
    norm = np.sqrt((x * x).sum(axis=1))
    there &= norm != 0
    return ids, x / np.where(norm != 0, norm, 1.0)[:, None], there
