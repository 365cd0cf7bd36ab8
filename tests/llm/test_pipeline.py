from __future__ import annotations

import brute
import corpus_pipeline
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, from documents on."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(kept):
    assert all(d.columns == kept[0].columns for d in kept[:-1]) and "sequence_id" in kept[-1].columns


def test_clean_documents_stay(kept):
    first, told = {i for i, t in pairs(kept[0]) if len(t) > 200}, {i for i, _ in pairs(kept[1])}
    assert len(first - told) <= 0.01 * len(first)


def test_one_of_each_group_stays(kept):
    before, after = pairs(kept[2]), {i for i, _ in pairs(kept[3])}
    assert after == {i for i, _, c in brute.components(before) if i == c}


def test_no_passage_stays(spark, kept):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(r[5] for r in brute.leaks(pairs(kept[4]), bench))


def test_all_that_stays_is_packed(kept):
    assert {r.doc_id for r in kept[5].select("doc_id").collect()} == {i for i, _ in pairs(kept[4])}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_rows_without_an_id_stay_where_none_of_their_group_has_one(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = spark.createDataFrame([(None, a), (None, f"{a} more"), (None, b), (1, c), (None, c), (2, d), (3, d), (4, d), (5, a + b), (5, c + d)], "doc_id long, text string")
    got = pairs(corpus_pipeline.near_duplicates(spark, docs, FOLDER))
    assert sorted(got, key=str) == sorted([(None, b), (1, c), (2, d), (5, a + b), (5, c + d), next(x for x in got if x[0] is None and x[1].startswith(a))], key=str)


def test_single_repeated_lines_go(spark):
    docs = spark.createDataFrame([(1, "a\nlicence\nb"), (2, "c\nlicence\nd"), (3, "one line"), (4, "one line"), (5, "e\n\nf")], "doc_id long, text string")
    assert sorted(pairs(corpus_pipeline.lines(spark, docs, FOLDER))) == [(1, "a\nlicence\nb"), (2, "c\nd"), (3, "one line"), (5, "e\n\nf")]
