"""What the findings of round 3 named, each by what would have failed before."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import helm as H
from assaylake.operators import curves, gestalt, graph, learn, metrics, resample, review, topk
from assaylake.plans import chemistry, evaluation, grids, names, study


class Given:
    def __init__(self, spark, **tables):
        self.spark = spark
        self.__dict__.update(tables)


@pytest.mark.parametrize("sequence,score", [("TCTCTATTCTCCGCTCGTTT", 33.8), ("GTAGTCGTTTTCTTTTAAAT", 48.7)])
def test_score_half_way_between_two_roundings(spark, sequence, score):
    p = F.struct(F.lit(sequence).alias("sequence"))
    assert spark.range(1).select(H.sequence_score(p).alias("s")).first().s == score


def test_parts_of_one_file_are_dealt_to_tasks(spark):
    parts = spark.range(1000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1)
    assert chemistry.noted(Given(spark, part=parts)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_agreement_has_no_join(spark):
    parts = spark.range(12).select(F.col("id").alias("p_partkey"), (F.col("id") % 5).cast("int").alias("p_size"))
    out = names.notation_agreement(Given(spark, part=parts))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 4 and all(r.best_sequence and not r.strict_sequence for r in out.collect())


def test_items_of_tables_are_those_of_the_sql(spark):
    rows = spark.createDataFrame([(1, 1000, 5.0), (2, 0, 6.0), (3, 1, 7.0)], "l_partkey long, l_suppkey long, l_quantity double")
    assert sorted(study.single_dose_tables(Given(spark, lineitem=rows)).collect()) == [(False, 1, 2), (True, 1, 1)]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3, 0.7]
    found = set()
    for order in (values, values[::-1], [0.3, 0.1, 0.7, 0.2]):
        rows = spark.createDataFrame([(1, float(x), x, x) for x in order], "l_partkey long, l_quantity double, l_discount double, l_tax double").coalesce(1)
        found.add(evaluation._means(Given(spark, lineitem=rows)).first().discount)
    assert found == {0.325}
    tie = spark.createDataFrame([(1, 1.0, x, x) for x in [0.01] * 31 + [0.02]], "l_partkey long, l_quantity double, l_discount double, l_tax double").coalesce(1)
    assert evaluation._means(Given(spark, lineitem=tie)).first().discount == 0.010313


def test_hashes_of_a_block_are_md5():
    for texts in ([b"4274|7", b"4274|8"], [b"x" * 60], ["4274|é".encode()]):
        for draws in (np.arange(10), np.arange(10, 100), np.arange(1000, 1500)):
            found = resample.md5_uniform(texts, draws)
            assert found.tolist() == [[int(hashlib.md5(t + b"|%d" % d).hexdigest()[:13], 16) / float(1 << 52) for d in draws] for t in texts]


def test_bootstrap_does_not_multiply_rows_by_draws(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, None), (None, 12, 5.0)], "k string, r long, v double")
    means = resample.bootstrap_means(rows, "k", "r", "v", 120, 7)
    assert "Generate" not in means._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.draw): r.mean for r in means.collect()}
    draw = lambda r, d: sum(int(hashlib.md5(f"7|{r}|{d}".encode()).hexdigest()[:13], 16) / float(1 << 52) >= s for s in resample.POISSON)
    for d in range(120):
        one, two, lone = draw(1, d), draw(2, d), draw(12, d)
        assert got["a", d] == (pytest.approx((one + 3 * two) / (one + two)) if one + two else None)
        assert got["b", d] is None and got[None, d] == (5.0 if lone else None)


def test_points_of_a_dose_are_one_member_of_a_curve(spark):
    rows = [("k", d, 5 + 90 / (1 + 20 / d) + n % 3) for d in (1.0, 10.0, 30.0, 100.0, 300.0) for n in range(9)]
    df = spark.createDataFrame(rows, "k string, d double, r double").coalesce(1)
    found = curves.fit_groups(df, ["k"], "d", "r")
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    own, plain = found.first(), curves.fit_many([(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))])[0]
    assert own.n == plain["n"] == 45
    for c in ("ic50", "bottom", "top", "hill", "r2"):
        assert own[c] == pytest.approx(plain[c], rel=1e-5)


def test_deviations_need_no_rows_of_the_table_again(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", None), ("b", 4.0)], "k string, v double")
    out = metrics.median_limit(rows, ["k"], "v")
    assert "LogicalRDD" in out._jdf.queryExecution().optimizedPlan().toString() and "LocalRelation" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.median, r.mad) for r in out.collect()} == {"a": (2.0, 1.0), "b": (4.0, 0.0)}


def test_weights_at_the_steps():
    edges = np.array([u + k for u in resample._STEPS for k in (-1, 0)] + [0, resample.PRIME - 1])
    found = resample.weights(np.array([1]), np.array([0]), np.stack([edges, edges], axis=1))[0]
    assert found.tolist() == np.searchsorted(resample.POISSON, edges / resample.PRIME, side="right").tolist()


def test_neighbours_are_found_by_block_without_a_row_a_pair(spark):
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0])]
    df = spark.createDataFrame(vectors, "i long, v array<double>")
    out = learn.neighbours(df.where("i = 0"), df, "i", "v", 4)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    found = [(r.neighbour, r.similarity) for r in out.orderBy("place").collect()]
    assert found == [(1, 0.998752), (2, 0.0), (3, None), (4, None)]


def test_lifted_values_shuffle_no_pair_of_value_and_source(spark):
    release = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "g long, ch int, value double")
    lineage = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 12), (1, None)], "g long, src long")
    contributors = spark.createDataFrame([(1, 1, 11), (1, 1, 11), (2, 1, None)], "g long, ch int, src long")
    out = review.lifted(release, lineage, contributors, "g", "src", "ch", "value")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(11, 1, 5.0), (10, 2, 6.0), (11, 2, 6.0), (None, 2, 6.0)], key=str)


def test_pooled_and_folds_are_one_ranking(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7).alias("f"), (F.col("id") * 7919 % 13).cast("double").alias("s"), F.when(F.col("id") % 50 != 3, F.col("id") * 31 % 17).cast("double").alias("y"))
    found = topk.pooled_and_folds(rows, "f", "s", "y", F.col("y") > 9, "id", low=False).first()
    pooled = topk.enrichment(rows, "s", "y", F.col("y") > 9, "id", low=False).first()
    folds = topk.fold_rates(rows.withColumn("p", (F.col("y") > 9).cast("double")), "f", "s", "p", "id", low=False).agg(F.round(F.stddev_samp("s"), 4).alias("sd")).first()
    assert [found[c] for c in ("base_rate", "selected_rate", "factor")] == [pooled[c] for c in ("base_rate", "selected_rate", "factor")] and found.precision_sd == folds.sd


def dealt_by(df) -> set:
    """The columns that rows are dealt by in the whole plan, and ExistingRDD where it reads a checkpoint."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {tuple(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)} | set(re.findall("ExistingRDD", plan))


LINES = [(o, 10 * o + k, k, float(10 + k), 0.01 * k, 0.02 * k) for o in (10, 11, 12, 13, 14) for k in (1, 2, 3, 4)]


@pytest.fixture
def lines(spark, tmp_path):
    given = spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    given.selectExpr("*", "1L AS l_suppkey", "1D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    return Given(spark, lineitem=spark.read.parquet(f"{tmp_path}/lineitem.parquet"))


def test_defects_deal_lines_by_table_only(lines):
    out = grids.grid_defects(lines)
    assert dealt_by(out) == {("o",)}
    got = {r.table_id: r for r in out.collect()}
    assert {k: (r.n_rows, r.n_missing, r.n_dropped, r.n_unsourced, r.n_unprinted, r.n_partial) for k, r in got.items()} == {10: (4, 0, 0, 0, 0, 0), 11: (3, 0, 1, 0, 0, 0), 12: (4, 0, 0, 1, 0, 1), 13: (0, 4, 0, 0, 0, 0), 14: (4, 0, 0, 0, 1, 0)}


def test_entries_deal_rows_by_order_and_by_table_only(lines):
    out = grids.grid_entries(lines)
    assert dealt_by(out) == {("o",), ("table_id",)}
    assert sorted(r.value for r in out.where("table_id = '11' AND field = '2_h'").collect()) == ["11", "12", "13", "14"]


def test_a_tree_of_cells_is_the_tree_of_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    g = np.random.default_rng(5)
    x, y = g.integers(0, 12, (400, 3)), g.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, label double")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    want = [r.prediction for r in DecisionTreeRegressor(maxDepth=6).fit(data).transform(data).collect()]
    cells, of = np.unique(x, axis=0, return_inverse=True)
    w, wy = np.bincount(of.ravel()).astype(float), np.bincount(of.ravel(), y)
    assert learn._tree(cells, w, wy, x, 6, 32, 3, np.random.default_rng(0)) == pytest.approx(want, abs=1e-9)
    weights = learn._poisson(np.arange(4000, dtype=np.uint64)[:, None] * np.uint64(7919), np.arange(50))
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02


def test_forests_of_500_trees_pass_cells_not_trees_through_the_driver(spark):
    rows = [(i, i % 3 + 1, float(i % 7), float(i % 2), None if i == 20 else float(i % 7) * 10) for i in range(84)] + [(84, 1, None, 0.0, 5.0), (85, None, 1.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "r long, fold int, a double, b double, y double")
    out = learn.cross_validated(df, ["a", "b"], "y", "fold", "r", "forest")
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.r: r for r in out.collect()}
    assert set(got) == set(range(85)) and got[84].y_pred is None and got[20].y_true is None
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["a", "b"], outputCol="__features").transform(df.dropna(subset=["a", "fold"])).coalesce(1)
    plain = learn.MODELS["forest"]().fit(data.where("fold <> 1 AND y IS NOT NULL")).transform(data.where("fold = 1")).collect()
    assert len(plain) == 28 and all(abs(got[r.r].y_pred - r.prediction) < 3 for r in plain), [(got[r.r].y_pred, r.prediction) for r in plain]


def test_folds_are_fitted_at_once_on_dealt_rows(spark, monkeypatch):
    import threading

    meet, parts, plain = threading.Barrier(3), [], learn.MODELS["ridge"]

    class Waits:
        def fit(self, data):
            parts.append(data.rdd.getNumPartitions())
            meet.wait(60)
            return plain().fit(data)

    monkeypatch.setitem(learn.MODELS, "boosted", Waits)
    df = spark.createDataFrame([(i, i % 3, float(i % 7), float(i)) for i in range(60)], "r long, fold long, a double, y double").coalesce(1)
    out = learn.cross_validated(df, ["a"], "y", "fold", "r", "boosted")
    assert len(parts) == 3 and min(parts) >= spark.sparkContext.defaultParallelism and out.where("y_pred IS NOT NULL").count() == 60


def near_texts(seed):
    """Ids, texts with edits, turns and repeats of a few bases, short ones and ones with rare characters only among them."""
    g = np.random.default_rng(seed)
    signs, texts = np.array(list("etaoin shrdlu.,TAE\nÄ中")), set()
    p = 1 / np.arange(1, len(signs) + 1)
    for size in (2, 9, 40, 150, 199, 201, 400, 900):
        base = g.choice(signs, size, p=p / p.sum())
        for share in (0, 0, 0.01, 0.03, 0.06, 0.1, 0.2):
            own = [c for c in base if g.random() >= share / 2]
            texts.add("".join(g.choice(signs) if g.random() < share / 2 else c for c in own))
        texts |= {"".join(np.r_[base[size // 2 :], base[: size // 2]]), "".join(base[:2]) * (size // 2)}
    return list(zip(map(int, g.permutation(len(texts))), sorted(texts - {""}), strict=False))


def ratios(rows):
    import difflib
    import itertools

    every = {(i, j): difflib.SequenceMatcher(None, x, y).ratio() for (i, x), (j, y) in itertools.combinations(sorted(rows), 2)}
    return {k: v for k, v in every.items() if v >= 0.9}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_pairs_are_those_of_all_ratios(spark, monkeypatch, seed):
    rows = near_texts(seed)
    want = ratios(rows)
    got = gestalt.pairs([r[0] for r in rows], [r[1] for r in rows], np.zeros(len(rows), bool), 0.9)
    assert len(want) > 20 and {(r.a, r.b): r.ratio for r in got.itertuples()} == want
    monkeypatch.setattr(gestalt, "MOST_PAIRS", 50)  # the library's own blocks
    got = gestalt.pairs([r[0] for r in rows], [r[1] for r in rows], np.zeros(len(rows), bool), 0.9)
    assert {(r.a, r.b): r.ratio for r in got.itertuples()} == want
    monkeypatch.setattr(graph, "LEAST", 200)  # several runs a block and several cells a run
    monkeypatch.setattr(graph, "MOST", 500)
    monkeypatch.setattr(graph, "GUESTS", 1)
    df = spark.createDataFrame([("b", *r) for r in rows], "k string, i long, t string")
    found = graph.gestalt_pairs(df, "k", "i", "t").collect()
    assert len(found) == len(want) and {(r.a, r.b): r.ratio for r in found} == want


def test_few_pairs_of_unlike_texts_are_matched(monkeypatch):
    g, tried = np.random.default_rng(7), []
    words = ["".join(g.choice(list("etaoinshrdlu"), g.integers(1, 4))) for _ in range(40)]
    rows = [(i, ". ".join(" ".join(g.choice(words, 12)).capitalize() for _ in range(40))) for i in range(60)]
    rows.append((60, rows[0][1].replace(words[0], words[1], 3)))
    real = gestalt.bounded_ratio
    monkeypatch.setattr(gestalt, "bounded_ratio", lambda *a: tried.append(1) or real(*a))
    got = gestalt.pairs([r[0] for r in rows], [r[1] for r in rows], np.zeros(len(rows), bool), 0.9)
    assert [(r.a, r.b) for r in got.itertuples()] == [(0, 60)] and len(tried) < 5
