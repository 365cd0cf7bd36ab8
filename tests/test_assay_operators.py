from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import audit, curves, dedup, folds, funnel, graph, joins, learn, match, metrics, resample, topk
from assaylake.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_latest_version_wins(spark):
    df = spark.createDataFrame([("US2020", "c", 50.0, 0), ("US2024", "c", 50.0, 1), ("US2024", "c", 51.0, 2)], "patent string, id string, y double, _ord int")
    assert rows(dedup.latest_wins(df, ["id", "y"], "patent", "_ord")) == [("US2024", "c", 50.0, 1), ("US2024", "c", 51.0, 2)]


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, o int")
    assert rows(dedup.first_rows(df, ["k"], "o")) == [("a", 3), (None, 1)]


def test_dispositions(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 0), (2, "a", 5.0, 1), (3, "b", -1.0, 2)], "id int, k string, y double, _ord int")
    out = dedup.dispositions(df, ["k"], F.concat_ws("|", F.when(F.col("y") < 0, "range")), "_ord").select("id", "reasons", "disposition")
    assert rows(out) == [(1, "", "kept_processed"), (2, "", "discarded_duplicate"), (3, "range", "discarded_filter")]


def test_collapse_keeps_order_and_empty_lists(spark):
    df = spark.createDataFrame([("a", 2, 5.0, None), ("a", 1, None, None), ("a", 3, 7.0, "x"), ("b", 1, None, "y")], "k string, o int, v double, w string")
    assert rows(dedup.collapse(df, ["k"], "o", ["v"], ["w"])) == [("a", [5.0, 7.0], "x"), ("b", [], "y")]


def test_group_ids_tell_missing_from_text(spark):
    df = spark.createDataFrame([(None,), ("None",), ("-0.0",), ("0.0",)], "k string")
    ids = [r[0] for r in df.select(dedup.group_id("e", F.col("k"))).collect()]
    assert len(set(ids)) == 3 and ids[2] == ids[3] and all(len(i) == 26 for i in ids)


def test_validated_join_fails(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        joins.validated_left(a, b, ["k"], "many_to_one").collect()


def test_cascade(spark):
    names = spark.createDataFrame([(None, None), ("HepG2", "HEPG2"), ("Hep G", "HEPG"), ("PHH", "PHH"), ("Odd", "ODD"), ("None such", "NONESUCH")], "name string, key string")
    manual = spark.createDataFrame([("Odd", "A549"), ("None such", "")], "name string, mapped string")
    catalogue = spark.createDataFrame([("HEPG2",), ("A549",)], "key string")
    out = joins.lookup_cascade(names, "name", "key", manual, catalogue, F.col("name").rlike("(?i)phh"))
    assert rows(out) == sorted([(None, None, "unmapped"), ("HepG2", "HEPG2", "exact"), ("Hep G", "HEPG2", "prefix"), ("PHH", None, "primary"), ("Odd", "A549", "manual"), ("None such", None, "manual")], key=str)


def test_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "gone"), ("x", "c")], "i string, t string")
    assert rows(joins.follow_links(links, "i", "t")) == [("a", "gone"), ("b", "gone"), ("c", "gone"), ("x", "gone")]
    with pytest.raises(ValueError, match="cycle"):
        joins.follow_links(spark.createDataFrame([("a", "b"), ("b", "a")], "i string, t string"), "i", "t")


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    items = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "item long")
    out = dict(rows(graph.components(items, e, "item", "a", "b")))
    assert {out[i] for i in range(41)} == {0} and out[101] == 100 and out[200] == 200


def test_gestalt_pairs(spark):
    df = spark.createDataFrame([("k", 1, "line one\nline two"), ("k", 2, "line one\nline twO"), ("k", 3, "something else entirely"), ("j", 4, "line one\nline two")], "k string, i long, t string")
    assert [(r.a, r.b) for r in graph.gestalt_pairs(df, "k", "i", "t").collect()] == [(1, 2)]


def test_top_share_ties(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(10)], "i long, s double, y double")
    low = topk.enrichment(df, "s", "y", F.col("y") < 2, "i", low=True).first()
    high = topk.enrichment(df, "s", "y", F.col("y") >= 8, "i", low=False).first()
    assert (low.n_selected, low.selected_rate, low.factor) == (2, 1.0, 5.0) and (high.selected_rate, high.factor) == (1.0, 5.0)
    none = topk.enrichment(df, "s", "y", F.col("y") > 99, "i", low=True).first()
    assert none.base_rate == 0.0 and none.factor is None


def test_non_finite_rows_go(spark):
    df = spark.createDataFrame([(0, float("nan"), 1.0), (1, float("inf"), 1.0), (2, None, 1.0), (3, 1.0, 1.0)], "i long, s double, y double")
    assert topk.enrichment(df, "s", "y", F.col("y") > 0, "i", low=True).first().n == 1


def test_spearman_and_p(spark):
    g = np.random.default_rng(1)
    x, y = g.integers(0, 5, 60).tolist(), g.integers(0, 5, 60).tolist()
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "k string, x double, y double")

    def ranks(v):
        return [sum(w < a for w in v) + (sum(w == a for w in v) + 1) / 2 for a in v]

    got = metrics.spearman(df, ["k"], "x", "y").first()
    assert got.rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-6) and got.low < got.rho < got.high
    assert metrics.student_p(0.5, 20) == pytest.approx(0.0247, abs=1e-4)
    assert metrics.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03497, abs=1e-4)


def test_auc_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert metrics.auc(df, [], "s", "y").first().auc == 0.75


GOLDEN = [0.1181, 0.3144, 0.5139, 0.4451, 0.3996, 0.3522, 1.0]


def test_published_funnel(spark):
    r = F.array(*map(F.lit, GOLDEN))
    row = spark.range(1).select(funnel.counts(r).alias("n"), funnel.cost(funnel.counts(r), funnel.costs_column()).alias("cost")).first()
    assert row.n == [974, 115, 36, 18, 8, 3, 1, 1] and row.cost == 2_007_000


def test_funnel_conservation(spark):
    r = F.array(*map(F.lit, GOLDEN))
    n = spark.range(1).select(funnel.counts(r, ceil=False)).first()[0]
    assert all(a * p == pytest.approx(b) for a, p, b in zip(n, GOLDEN, n[1:]))


def test_zero_rate_is_infinite(spark):
    n = spark.range(1).select(funnel.counts(F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5)))).first()[0]
    assert n == [float("inf"), float("inf"), 2.0, 1.0]


def test_precision_floor(spark):
    r, q = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.2), F.lit(None).cast("double"))
    row = spark.range(1).select(funnel.by_precision(r, q, True).alias("a"), funnel.by_precision(r, q, False).alias("b")).first()
    assert row.a == [0.5, 0.5] and row.b == [0.2, 0.5]


def test_curve_fit():
    x = np.array([1, 3, 10, 30, 100, 300, 1000.0])
    y = curves.curve(x, np.array([5, 95, 40, 1.3]), False)
    f = curves.fit(x, y)
    assert f["ic50"] == pytest.approx(40, rel=0.02) and f["r2"] > 0.999
    assert curves.fit(x[:3], y[:3]) is None and curves.fit(x, np.full(7, 50.0)) is None
    assert curves.fit(x, np.linspace(20, 30, 7), curves.FOUR_PARAMETER) is None
    assert curves.fit(x, y, curves.FOUR_PARAMETER)["ic50"] == pytest.approx(40, rel=0.05)


def test_assignment_is_optimal():
    g = random.Random(3)
    for n, m in ((3, 3), (2, 5), (5, 3)):
        cost = np.array([[g.randint(0, 9) for _ in range(m)] for _ in range(n)], float)
        best = min(sum(cost[i, j] for i, j in zip(p, q)) for p in itertools.permutations(range(n), min(n, m)) for q in itertools.combinations(range(m), min(n, m)))
        assert sum(cost[i, j] for i, j in match.assign(cost)) == best


def test_value_match_prefers_values_then_contexts(spark):
    a = spark.createDataFrame([("k", 1, "x", "c"), ("k", 2, "y", "c"), ("k", 3, "z", "q")], "k string, g long, v string, c string")
    b = spark.createDataFrame([("k", 11, "y", "c"), ("k", 12, "x", "d")], "k string, f long, v string, c string")
    out = match.match_by_value(a, b, ["k"], "g", "f", "v", "c")
    assert rows(out) == sorted([("k", 1, 12, True, False), ("k", 2, 11, True, True), ("k", 3, None, None, None)], key=str)
    r = match.precision_recall(out, ["k"], "g", "f", F.col("value_equal")).first()
    assert (r.tp, r.fn, r.fp, r.precision, r.recall) == (2, 1, 0, 100.0, 66.67)


def test_folds_balance_and_leakage(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i % 4) for i in range(100)], "g string, item int")
    f = folds.group_folds(df, "g", 3)
    assert f.count() == 7 and {r.fold for r in f.collect()} == {1, 2, 3}
    assert all(r.n_leaked == 4 for r in folds.leakage(df.join(f, "g"), "item", "fold").collect())


def test_draws_do_not_depend_on_partitions(spark):
    a = resample.rate_draws(spark, [0.5, 0.2], [100, 50], 40, 7, slices=2)
    b = resample.rate_draws(spark, [0.5, 0.2], [100, 50], 40, 7, slices=5)
    assert rows(a) == rows(b)


def test_permutation_keeps_values(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("v"))
    out = resample.permuted(df, "k", "id", "v", 5)
    assert sorted(r.v for r in out.collect()) == sorted(r.shuffled for r in out.collect())
    assert all(r.shuffled // 10 % 3 == r.k for r in out.collect())


XML = '<doc><tables num="00003"><table><tgroup><tbody><row><entry>123456†</entry><entry/><entry>ACGTACGT</entry><entry>a&amp;b</entry><entry> 12 </entry><entry>x</entry><entry>y</entry><entry>124</entry></row><row><entry>go on</entry></row></tbody></tgroup></table></tables></doc>'


def test_grid_keeps_empty_cells(spark):
    df = spark.createDataFrame([(XML,)], "t string").select(F.explode(readers.tables(F.col("t"))).alias("x")).select("x.*")
    t = df.first()
    assert t.num == "3" and t.rows[0] == ["123456†", "", "ACGTACGT", "a&b", "12", "x", "y", "124"] and t.rows[1] == ["go on"]
    r = df.select(readers.reviewed_rows(F.col("rows")).alias("r")).first().r
    assert len(r) == 1 and (r[0].id, r[0].sequence, r[0].value) == ("123456", "ACGTACGT", -24.0)


def test_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2.5\n2,NaN\n")
    (tmp_path / "b.csv").write_text("x,y\n3,\n")
    out = readers.csv_with_lines(spark, str(tmp_path), "x int, y double", "e").orderBy("_ord").collect()
    assert [(r.x, r.y, r.raw_row_id) for r in out] == [(1, 2.5, "e:a.csv:2"), (2, None, "e:a.csv:3"), (3, None, "e:b.csv:2")]


def test_release_needs_all_splits(spark, tmp_path):
    d = spark.range(3)
    d.write.parquet(str(tmp_path / "t/train.parquet"))
    with pytest.raises(FileNotFoundError, match="validation, test"):
        readers.release(spark, str(tmp_path), "t")
    for s in ("validation", "test"):
        d.write.parquet(str(tmp_path / f"t/{s}.parquet"))
    assert readers.release(spark, str(tmp_path), "t").groupBy("release_split").count().count() == 3


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">c1 first\nacgt\nAC\n>c2\nggg\n")
    assert rows(readers.fasta(spark, str(tmp_path / "x.fa"))) == [("c1", "ACGTAC"), ("c2", "GGG")]


def test_checked_pairs(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.checked(df, ["x", "z"])
    with pytest.raises(Exception, match="x without y"):
        readers.checked(df, ["x"], [("x", "y")]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, None], float("nan"))], "i int, a array<double>, x double")
    sinks.csv(df, str(tmp_path / "c"), gzip=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().a == "[1.0,null]"
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"i":1,"a":[1.0,null],"x":null}'
    assert sinks.fields(df.schema)[1] == {"name": "a", "dataType": "sc:Float", "repeated": True}
    assert sinks.render("n=<<N>>", {"N": "3"}) == "n=3"
    with pytest.raises(ValueError, match="unfilled"):
        sinks.render("<<M>>", {})
    assert sinks.stale(["a", "b", ".gitattributes"], ["a"]) == ["b"]
    with pytest.raises(ValueError, match="null ids 1"):
        sinks.gate(spark.createDataFrame([(None, True, "h")], "i string, f boolean, h string"), "i", "f", "h")


def test_ragged_rows_align_right(spark):
    g = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "y", "z"]), (3, ["q"])], "r int, v array<string>")
    assert (3, 2, "q") in rows(audit.cells(g, "r", "v"))


def test_forward_fill(spark):
    df = spark.createDataFrame([("t", 1, "a"), ("t", 2, " "), ("t", 3, "b")], "t string, o int, c string")
    assert [r.c for r in audit.forward_fill(df, ["t"], "o", "c").orderBy("o").collect()] == ["a", "a", "b"]


def test_streamed_windows_equal_batch(spark, tmp_path):
    from assaylake.streaming import events

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read_stream(spark, str(tmp_path / "in"), table.schema), late=None)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows")) == rows(events.windowed(table))


def test_hot_buckets_have_most_equal_values(spark):
    n = 900
    a = spark.createDataFrame([("k", i, 1 + i % 3, "c") for i in range(3 * n)], "k string, g long, v long, c string")
    b = spark.createDataFrame([("k", i, 2 + i % 3, "d") for i in range(3 * n)], "k string, f long, v long, c string")
    out = match.match_by_value(a, b, ["k"], "g", "f", "v", "c").collect()
    assert sum(bool(r.value_equal) for r in out) == 2 * n and len(out) == 3 * n
    assert len({r.g for r in out}) == len({r.f for r in out}) == 3 * n


@pytest.mark.parametrize("gates", [curves.CANONICAL, curves.FOUR_PARAMETER])
def test_hot_groups_are_fitted_by_all_points(spark, monkeypatch, gates):
    g = random.Random(5)
    doses = [1.0, 3.0, 10.0, 30.0, 100.0, 300.0]
    points = [("k", d, float(curves.curve(np.array([d]), np.array([5, 95, 20, 1.3]), False)[0]) + g.gauss(0, 6)) for m, d in enumerate(doses) for _ in range(3 + 11 * (m % 3))]
    df = spark.createDataFrame(points, "k string, d double, r double")
    whole = curves.fit_groups(df, ["k"], "d", "r", gates).first()
    monkeypatch.setattr(curves, "MOST_POINTS", 10)
    parts = curves.fit_groups(df, ["k"], "d", "r", gates).first()
    assert parts.n == whole.n == len(points)
    for c in ("ic50", "bottom", "top", "hill", "r2"):
        assert parts[c] == pytest.approx(whole[c], rel=1e-3)


def test_neighbours_in_blocks_are_the_same(spark):
    g = random.Random(6)
    df = spark.createDataFrame([(i, [g.random() for _ in range(4)]) for i in range(60)], "i long, v array<double>")
    assert rows(learn.neighbours(df, df, "i", "v", 3, most_queries=17)) == rows(learn.neighbours(df, df, "i", "v", 3))
