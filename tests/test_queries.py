"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from assaylake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"boosted_cv", "rf_cv", "hill_four_parameter"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(row) -> tuple:
    return tuple(f"{v + 0.0:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    found = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(plain([r[i] for i in order]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - SLOW))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0


def test_row_order_and_partitions_do_not_matter(spark):
    from pyspark.sql import functions as F

    from assaylake.operators import topk

    rows = spark.range(500).select("id", (F.col("id") * 7919 % 13).cast("double").alias("s"), (F.col("id") % 5).cast("double").alias("y"))
    one = topk.enrichment(rows, "s", "y", F.col("y") < 2, "id", low=True).collect()
    other = topk.enrichment(rows.repartition(7, F.rand(3)), "s", "y", F.col("y") < 2, "id", low=True).collect()
    assert one == other


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_draws_are_as_many_as_the_references(spark):
    from pyspark.sql import functions as F

    from assaylake.operators import learn, resample

    customers = spark.read.parquet(f"{FOLDER}/customer.parquet")
    means = resample.bootstrap_means(customers, "c_nationkey", "c_custkey", "c_acctbal", 5000, 4274)
    want = {r[0]: r[1] for r in means.groupBy("c_nationkey").agg(F.round(F.expr("percentile(mean, 0.025D)"), 4)).collect()}
    assert {r.c_nationkey: r.low for r in catalog.QUERIES["bootstrap_ci"](spark, FOLDER).collect()} == want
    assert catalog.QUERIES["mc_cost"](spark, FOLDER).count() == 100_000
    assert catalog.QUERIES["permutation_floor"](spark, FOLDER).select("seed").distinct().count() == 20
    forest = learn.MODELS["forest"]()
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (500, 20)


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    import difflib
    import itertools

    signs = lambda a, b: "\n".join(chr(0x4E00 + i) for i in range(a, b))
    base = signs(0, 300)
    texts = [(1, base, "s"), (2, base, "r"), (3, signs(0, 290) + signs(900, 903), "s"), (4, signs(0, 290) + signs(900, 903), "r"), (5, signs(0, 210) + signs(500, 590), "s"), (6, signs(600, 630) + signs(30, 300), "s"), (7, base, "r")]
    rows = [(i, x, s, "en") for i, x, s in texts]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.ratio for r in catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()}
    own = {}
    for i, x, s, _ in rows:
        own.setdefault((s, x), i)
    want = {}
    for ((s, x), i), ((r, y), j) in itertools.combinations(sorted(own.items(), key=lambda e: e[1]), 2):
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        if s == r and ratio >= 0.9:
            want[i, j] = round(ratio, 6)
    assert got == want and (2, 4) in want and (1, 3) in want and (1, 5) not in want
