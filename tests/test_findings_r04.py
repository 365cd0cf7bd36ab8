"""What the findings of round 4 named, each by what would have failed before."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest

from assaylake.operators import completeness, graph
from assaylake.plans import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def split(spark):
    """Files are read in many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def of_sql(name: str, folder) -> list:
    duck = duckdb.connect()
    duck.execute("SET threads=1")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return duck.execute(catalog.ORACLE[name])


def test_means_at_a_mark_do_not_depend_on_tasks(spark, split, tmp_path):
    duckdb.execute(f"COPY (SELECT * FROM '{FOLDER}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 4096)")
    assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 4
    got = catalog.QUERIES["joint_marginals"](spark, str(tmp_path)).first()
    assert tuple(got) == of_sql("joint_marginals", tmp_path).fetchone()


def test_renamed_compounds_are_not_those_of_the_table(spark, tmp_path):
    parts = [(13, p) for p in (890123, 5, 912345, 932345, 1_000_007)] + [(18, 990001), (18, 890001)]
    rows = [(o, p, k, 1, 10.0 + k, 1.0, 0.05, 0.02) for k, (o, p) in enumerate(parts)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/l")
    duckdb.execute(f"COPY (SELECT * FROM '{tmp_path}/l/*.parquet') TO '{tmp_path}/lineitem.parquet'")
    found = of_sql("grid_defects", tmp_path)
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, catalog.QUERIES["grid_defects"](spark, str(tmp_path)).select(*columns).collect())) == sorted(found.fetchall())


def test_cells_are_looked_up_without_windows(spark):
    rows = spark.createDataFrame([("t", 0, ["ISIS NO", "100 nM"]), ("t", 1, ["123456", "40"]), ("t", 2, ["234567", "1.50"]), ("t", 3, ["345678", "7"])], "table_id string, position int, cells array<string>")
    claims = spark.createDataFrame([("t", "123456", 100.0, "60"), ("t", "234567", 100.0, "1.5"), ("u", "9999", None, None)], "table_id string, compound string, dose double, value string")
    out = completeness.report(rows, claims)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.table_id: tuple(r)[1:] for r in out.collect()}
    assert found == {"t": (2, 2, 0, 2, 2, 100.0, 1, 0, 0, 0, None, False), "u": (0, 1, 1, 0, 0, None, 0, 0, 0, 0, None, False)}


def test_tables_are_whole_whatever_the_batches(monkeypatch):
    columns = "table_id n_compounds n_values n_unprinted line claim position k width digits name key bare dose".split()
    rows = []
    for t in range(5):
        cells = [("123456", None, "123456.0", "123456"), ("", str(40 + t), f"{40 + t}.0", None)]
        rows += [(t, 1, 1, 0, 0, True, None, f, 2, "123456", None, key, None, 100.0) for f, key in enumerate(("60.0", "40.0"))]
        rows += [(t, 1, 1, 0, p + 1, False, p, k, 2, *cell, None) for p in range(t % 3 + 1) for k, cell in enumerate(cells)]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.float64()]
    own = pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], columns)
    want = completeness.figures(own).to_pylist()
    assert [r["n_rows"] for r in want] == [1, 2, 3, 1, 2] and [r["n_sourced"] for r in want] == [1, 0, 0, 0, 0]
    for at_once in (1, 6, 1000):
        monkeypatch.setattr(completeness, "EVENTS_AT_ONCE", at_once)
        for size in (1, 2, 3, 7, 100):
            assert [r for b in completeness._counted(iter(own.to_batches(size))) for r in b.to_pylist()] == want


def test_cells_of_texts_are_not_put_together_by_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 100)
    df = spark.createDataFrame([(str(i % 9), i, chr(97 + i) * 300) for i in range(18)], "k string, i int, t string")
    out = graph.gestalt_pairs(df, "k", "i", "t")
    assert out.collect() == [] and out.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
