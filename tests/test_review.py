"""Operators of review, files and sweeps on small cases, and defects put in on purpose."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaylake.functions import cell_lines, text
from assaylake.operators import audit, funnel, graph, learn, metrics, review
from assaylake.sources import readers


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


@pytest.mark.parametrize("split", ["900b", "128m"])
def test_lines_are_numbered_in_their_files(spark, tmp_path, split):
    for name, n in (("a", 300), ("b", 500), ("c", 900)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{name}{i},{i}\n" for i in range(2, n + 2)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = readers.csv_with_lines(spark, str(tmp_path), "x string, y int", "neuro")
        assert out.where("raw_row_id <> concat('neuro:', substr(x, 1, 1), '.csv:', y)").isEmpty()
        order = [r.x for r in out.orderBy("_ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert order == [f"{n}{i}" for n, k in (("a", 300), ("b", 500), ("c", 900)) for i in range(2, k + 2)]


def test_references_are_decoded_once(spark):
    cells = ["a &lt; b", "&#8722;5", "&amp;lt;", "&#x1F600;", "x&nbsp;&#8195; y", "&bogus; &mu;g", "<b>&alpha;</b>", "&#0; &#xD800;", None]
    got = [r.x for r in spark.createDataFrame([(c,) for c in cells], "c string").select(readers.entities(F.col("c")).alias("x")).collect()]
    assert got == ["a < b", "−5", "&lt;", "😀", "x y", "&bogus; μg", "α", "&#0; &#xD800;", None]


def test_printed_minus(spark):
    cells = [("−5", -5.0, [-5.0]), ("–100.5", -100.5, [-100.5]), ("1,000", 1000.0, [1000.0]), ("7, 5; −7", 7.0, [7.0, 5.0, -7.0]), ("n/a", None, None), ("about −3 nM", -3.0, None), ("", None, None)]
    df = spark.createDataFrame([(c,) for c, _, _ in cells], "c string").select("c", text.scalar(F.col("c")).alias("s"), text.printed(F.col("c")).alias("p"))
    assert [(r.c, r.s, r.p) for r in df.collect()] == cells


def test_constant_columns_have_a_histogram(spark):
    assert rows(metrics.histogram(spark.range(5).select(F.lit(3.0).alias("v")), "v", 10)) == [(6, 5)]


def test_fixed_values_of_names():
    assert len(cell_lines.PRIMARY) == 64 and len(cell_lines.IN_VITRO) == 83 and len(cell_lines.DOSE_RESPONSE) == 161


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), ("c", None), ("d", float("inf")), ("d", 0.0)], "k string, v double")
    got = {r[0]: r[1:] for r in rows(metrics.percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.25}))}
    assert got["a"] == (1.0, 1.0) and got["b"] == (2.0, 2.0) and "c" not in got
    assert metrics.percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_components_equal_union_find(spark):
    import random

    g = random.Random(3)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = list(range(400))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    items = spark.createDataFrame([(i,) for i in range(400)], "item long")
    got = dict(rows(graph.components(items, spark.createDataFrame(edges, "u long, v long"), "item", "u", "v")))
    assert got == {i: top(i) for i in range(400)}


PRINTED = [("t", 1, c, v) for c, v in (("a", 10.0), ("b", 20.0), ("c", 30.0))]


@pytest.mark.parametrize(("defect", "found"), [("none", (3, 3, 3)), ("dropped", (3, 2, 2)), ("invented", (3, 4, 3)), ("changed", (3, 3, 2)), ("doubled", (3, 4, 3))])
def test_defects_are_found(spark, defect, found):
    claimed = {"none": PRINTED, "dropped": PRINTED[:2], "invented": [*PRINTED, ("t", 1, "d", 40.0)], "changed": [*PRINTED[:2], ("t", 1, "c", 31.0)], "doubled": [*PRINTED, PRINTED[0]]}[defect]
    schema = "k string, row int, col string, v double"
    out = audit.consumed(spark.createDataFrame(PRINTED, schema), spark.createDataFrame(claimed, schema), ["k"], "v")
    assert rows(out) == [("t", *found)]


def test_rows_without_a_feature_keep_a_null_prediction(spark):
    df = spark.createDataFrame([(i, float(i) if i != 4 else None, i % 2, 2.0 * i if i != 5 else None) for i in range(12)], "row int, x double, fold int, y double")
    out = {r.row: r.y_pred for r in learn.cross_validated(df, ["x"], "y", "fold", "row", "ridge").collect()}
    assert len(out) == 12 and out[4] is None and all(v is not None for k, v in out.items() if k != 4)


def test_models_come_back(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x"], outputCol="__features").transform(spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y")))
    model = learn.MODELS["ridge"]().fit(data)
    again = learn.saved(model, f"file://{tmp_path}/m")
    assert again.transform(data).select("prediction").collect() == model.transform(data).select("prediction").collect()


def test_conversions_are_vetted(spark):
    df = spark.createDataFrame([("12 %",), ("x",), (None,)], "c string")
    assert rows(df.select(review.converted(F.col("c"), "inhibition").alias("r")).select("r.*")) == sorted([(True, 88.0, None), (False, None, "not a inhibition: x"), (False, None, "not a inhibition: null")], key=str)
    with pytest.raises(ValueError):
        review.converted(F.col("c"), "__import__")


def test_evidence_counts_repeats_and_ignores_order(spark):
    one = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2)], "k string, v int")
    again, other = spark.createDataFrame([("k", 2), ("k", 1), ("k", 2)], "k string, v int"), spark.createDataFrame([("k", 1), ("k", 2)], "k string, v int")
    digest = lambda df: review.evidence(df, "k", ["v"]).first().digest
    assert digest(one) == digest(again) != digest(other)


def test_uplifts_need_enough_rows(spark):
    df = spark.range(40).select(F.lit("a").alias("link"), "id")
    out = funnel.uplifts(df, "link", F.col("id") < 20, F.col("id") % 2 == 0, F.col("id") < 12).first()
    assert out.base_uplift is None and out.model_uplift == 1.0 and out.ratio is None
    assert spark.range(1).select(funnel.uplifted(F.lit(0.8), F.lit(2.0)), funnel.uplifted(F.lit(0.8), F.lit(None))).first()[:] == (1.0, 0.8)
