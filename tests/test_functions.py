from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaylake.functions import helm as H
from assaylake.functions import numbers as N
from assaylake.functions import text as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {kind(v)}" for k, v in values.items()) or "x int").select(column.alias("v")).first().v


def kind(v):
    return {str: "string", float: "double", int: "int", list: "array<double>"}.get(type(v), "string")


def test_parse(spark):
    p = one(spark, H.parse(F.col("h")), h="RNA1{{[moe](G)[sp].d([5meC])[sp].(T).[lna](A).bad}}$$$$")
    assert (p.sequence, p.length, p.sugars, p.backbones) == ("GCUA", 4, ["MOE", "DNA", "RNA", "LNA"], ["PS", "PS", "PO"])
    assert p.mods == [None, "5meC", None, None]
    for h in (None, "", "nothing", "RNA1{{}}$$$$", "RNA1{{xx.yy}}$$$$"):
        assert one(spark, H.parse(F.col("h")), h=h) is None


def test_build_and_parse_round_trip(spark):
    built = H.build(F.lit("ACGTACGTACGTACGTACGT"), F.lit("eeeeeddddddddddeeeee"), F.lit("s" * 19 + "o"))
    p = H.parse(built)
    row = spark.range(1).select(p["sequence"].alias("s"), H.wings(p).alias("w"), H.ps_count(p).alias("n"), H.chemistry_class(p).alias("c"), H.shorthand(p).alias("r"), H.validate(built).alias("ok")).first()
    assert (row.s, tuple(row.w), row.n, row.c, row.r) == ("ACGTACGTACGTACGTACGT", (5, 10, 5), 19, "5-10-5 MOE gapmer", "5(MOE)-10(DNA)-5(MOE)")
    assert row.ok.is_valid and row.ok.errors == []


def test_quality_reasons(spark):
    short = "RNA1{{d(A).d(A)}}$$$$"
    assert one(spark, H.doubts(F.col("h"), H.parse(F.col("h"))), h=short) == "short|one_base|all_dna"
    assert one(spark, H.doubts(F.col("h"), H.parse(F.col("h"))), h="???") == "uncertain"
    assert one(spark, H.doubts(F.col("h"), H.parse(F.col("h"))), h="unreadable") == ""


@pytest.mark.parametrize("text, expected", [("7, 5, 7", [7, 5, 7]), ("3", [3]), ("9, 8", None), ("", None), ("x, 4", [4]), (None, None)])
def test_score_list(spark, text, expected):
    assert one(spark, S.score_list(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("1,000", 1000.0), (" 12 nM", 12.0), ("N/A", None), ("-", None), ("about -3.5", -3.5), (None, None)])
def test_scalar(spark, text, expected):
    assert one(spark, S.scalar(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("7, 5, 7", [7, 5, 7]), ("[7. 5. 7.]", [7, 5, 7]), ("1,000", None), ("7", None), ("[7]", [7]), ("a, b", None)])
def test_vector(spark, text, expected):
    assert one(spark, S.vector(F.col("t")), t=text) == expected


@pytest.mark.parametrize("a, b, same", [("7, 5, 7", "[7.0, 5.0, 7.0]", True), ("1,000", "1000", True), ("NA", "", True), ("x", "X ", True), ("7, 5", "7", False), ("[7]", "7", True), ("1", "2", False)])
def test_same_value(spark, a, b, same):
    assert one(spark, S.same_value(F.col("a"), F.col("b")), a=a, b=b) is same


def test_weekly_dose(spark):
    d = S.dose_parts(F.col("d"))
    assert one(spark, N.per_dose(d["value"], d["unit"], F.lit(2.0), F.lit(7.0)), d="14 mg/kg/wk") == 7.0
    assert one(spark, N.per_dose(d["value"], d["unit"], F.lit(None).cast("double"), F.lit(7.0)), d="14 mg/kg/wk") == 14.0


@pytest.mark.parametrize("found, printed, expected", [(50.0, 50.0, "uninformative"), (33.0, 67.0, "correct"), (67.0, 67.0, "unflipped"), (50.0, 59.0, "other")])
def test_orientation(spark, found, printed, expected):
    assert one(spark, N.orientation(F.col("a"), F.col("b")), a=found, b=printed) == expected


def test_numbers(spark):
    assert one(spark, N.array_mean(F.col("a")), a=[1.0, float("nan"), 3.0]) == 2.0
    assert one(spark, N.significant(F.col("x")), x=12345.0) == 12300.0
    assert one(spark, N.clip(F.col("x"), 0, 100), x=-3.0) == 0.0
    assert one(spark, N.clean(F.col("x")), x=float("nan")) is None
    assert one(spark, S.dose_nm(F.col("t")), t="2.5 uM") == 2500.0
    assert one(spark, S.species(F.col("t")), t="Sprague-Dawley rats") == "rat"
    assert one(spark, S.table_number(F.col("t")), t="US1_table_00042.xml") == "42"
    with pytest.raises(ValueError, match="unknown rule"):
        N.threshold(F.col("x"), "=", 1.0)
