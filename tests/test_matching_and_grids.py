"""Exact matching, rules as data, ranks in strata, shared draws, printed grids and strict notation against plain versions."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import notation
from assaylake.operators import completeness, grids, match, metrics, records, resample, topk


def best_pairs(left, right):
    """The best (equal values, fitting contexts) of all ways to pair two short lists of (value, context)."""
    if len(left) > len(right):
        ways = (zip(p, right) for p in itertools.permutations(left, len(right)))
    else:
        ways = (zip(left, p) for p in itertools.permutations(right, len(left)))
    fits = lambda a, b: all(x is None or x == y for x, y in zip(a[1], b[1]))
    return max((sum(a[0] is not None and a[0] == b[0] for a, b in w), sum(fits(a, b) for a, b in w)) for w in map(list, ways))


def test_classes_are_paired_as_well_as_can_be():
    g = random.Random(1)
    for _ in range(150):
        side = lambda: [(g.choice([None, "x", "y"]), tuple(g.choice([None, "a", "b"]) for _ in range(2))) for _ in range(g.randint(1, 5))]
        left, right = side(), side()
        x, y = ([(*k, n) for k, n in Counter(s).items()] for s in (left, right))
        pairs = match.pair_classes(x, y)
        fits = lambda i, j: all(p is None or p == q for p, q in zip(x[i][1], y[j][1]))
        got = sum(n for i, j, n in pairs if x[i][0] is not None and x[i][0] == y[j][0]), sum(n for i, j, n in pairs if fits(i, j))
        assert sum(n for *_, n in pairs) == min(len(left), len(right)) and got == best_pairs(left, right)


def test_a_bucket_of_ten_thousand_is_exact(spark):
    n = 10_000
    # Every value has a partner. The silent half of the left could take any context; the other half needs its own.
    a = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("g"), (F.col("id") % 500).cast("string").alias("v"), F.array(F.when(F.col("id") % 2 == 0, (F.col("id") % 20).cast("string"))).alias("c"))
    b = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("f"), (F.col("id") % 500).cast("string").alias("v"), F.array((F.col("id") % 20).cast("string")).alias("c"))
    out = match.match_compatible(a, b, ["k"], "g", "f", "v", "c")
    r = out.agg(F.count("*").alias("n"), F.count_distinct("g").alias("g"), F.count_distinct("f").alias("f"), F.count_if("value_equal").alias("v"), F.count_if("context_equal").alias("c")).first()
    assert tuple(r) == (n, n, n, n, n)


def test_left_over_records_and_empty_sides(spark):
    kind = "k string, {} long, v string, c array<string>"
    a = spark.createDataFrame([("k", 1, "x", ["a"]), ("k", 2, None, [None]), ("only", 3, "x", ["a"])], kind.format("g"))
    b = spark.createDataFrame([("k", 11, "x", ["b"]), ("k", 12, "x", ["a"]), ("k", 13, None, [None])], kind.format("f"))
    out = sorted(map(tuple, match.match_compatible(a, b, ["k"], "g", "f", "v", "c").collect()), key=str)
    assert ("k", 1, 12, True, True) in out and ("only", 3, None, None, None) in out and len(out) == 4
    assert sum(r[1] == 2 and r[3] is False and r[4] for r in out) == 1
    assert match.match_compatible(a, b.limit(0), ["k"], "g", "f", "v", "c").count() == 3
    assert match.match_compatible(a.limit(0), b.limit(0), ["k"], "g", "f", "v", "c").count() == 0


RULES = [records.Rule("e", "dose", "required", "number"), records.Rule("e", "cell", "compared"), records.Rule("e", "note", "compared")]


def measured(spark, rows):
    return spark.createDataFrame(rows, "measurement_id string, table_ref string, endpoint string, channel string, compound string, identity map<string,string>, outcome string")


def test_ledger_tells_every_record(spark):
    gold = measured(spark, [
        ("g1", "t", "e", "c", "12", {"dose": "5", "cell": "A  b"}, "7"), ("g2", "t", "e", " C", "12.0", {"dose": "5.0", "cell": "n/a"}, "8"), ("g3", "t", "e", "c", "13", {"dose": "5"}, "1"),
        ("g4", "u", "e", "c", "12", {"dose": "5"}, "1"), ("g5", "t", "x", "c", "12", {}, "1"), ("g6", "t", "e", "c", "12", {"dose": "NA"}, "1"), ("g7", "t", "e", "", "None", {}, "1"),
    ])
    found = measured(spark, [("f1", "t", "e", "c", "12", {"dose": "5", "cell": "q"}, "8.0000001"), ("f2", "t", "e", "c", "12", {"dose": "5", "cell": "a b"}, "9"), ("f3", "t", "e", "c", "99", {"dose": "5"}, "1")])
    scope = spark.createDataFrame([("t", "fam", "class")], "table_ref string, family string, table_class string")
    told = records.ledger(gold, found, RULES, scope)
    by = {r.measurement_id: (r.status, r.counterpart_id, r.reason, r.value_correct, r.context_correct) for r in told.collect()}
    assert by["g2"] == ("matched_value_correct", "f1", None, True, True) and by["g1"] == ("matched_value_incorrect", "f2", None, False, True)
    assert by["g3"][0] == "missing" and by["f3"][0] == "extra"
    assert [by[f"g{k}"][2] for k in (4, 5, 6, 7)] == ["table_not_in_equivalence_scope", "no_identity_rule_for_endpoint", "missing_required_identity:dose", "missing_channel"]
    r = records.match_summary(told, []).first()
    assert (r.n_matched, r.n_value_correct, r.n_fully_correct, r.n_missing, r.n_extra, r.n_unresolved_gold, r.n_unresolved_found) == (2, 1, 1, 1, 1, 4, 0)
    coarse = {r.measurement_id: r.status for r in records.ledger(gold, found, records.demoted(RULES, {"dose"}), scope).collect()}
    # Either of two may be left over: what is silent in all that is compared fits as well as what agrees.
    assert sorted([coarse["g1"], coarse["g6"]]) == ["matched_value_incorrect", "missing"] and coarse["g2"] == "matched_value_correct"
    with pytest.raises(Exception, match="not unique"):
        records.ledger(gold.union(gold), found, RULES, scope).collect()


@pytest.mark.parametrize("bad", [[records.Rule("e", "f", "wrong")], [records.Rule("e", "f", "required", "none")], [records.Rule("e", "f"), records.Rule("e", "f", "compared")]])
def test_bad_rules_are_errors(bad):
    with pytest.raises(ValueError):
        records.check(bad)


def test_ranks_in_a_hot_stratum_are_dealt_over_tasks(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 97 == 1, None).otherwise("a").alias("s"), (F.col("id") * 7919 % 101).cast("double").alias("x"))
    got = {r.id: (r.k, r.n) for r in topk.ranked(rows, "x", "id", False, ["s"]).collect()}
    want, seen = {}, {}
    own = rows.collect()
    n = Counter(r.s for r in own)
    for r in sorted(own, key=lambda r: (-r.x, -r.id)):
        seen[r.s] = seen.get(r.s, 0) + 1
        want[r.id] = (seen[r.s], n[r.s])
    assert got == want


def test_draws_of_enrichment_equal_a_plain_bootstrap(spark):
    g, draws = random.Random(2), 60
    data = [(i, g.choice([1.0, 2.0, 3.5, None]) if i % 9 else float(i % 7), g.randint(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, s double, good int").repartition(7)
    got = {(r.share, r.draw): r.factor for r in resample.enrichment_draws(df, "s", "good", "id", False, [0.1, 0.5], draws, 11).collect()}
    rows = sorted((r for r in data if r[1] is not None), key=lambda r: (-r[1], -r[0]))
    import hashlib

    xy = [[int(hashlib.md5(f"11|{i}".encode()).hexdigest()[k : k + 8], 16) % resample.PRIME for k in (0, 8)] for i, *_ in rows]
    w = resample.weights(np.array([p[0] for p in xy]), np.array([p[1] for p in xy]), resample.draw_numbers(draws, 11))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    for share in (0.1, 0.5):
        for d in range(draws):
            sample = [r[2] for r, k in zip(rows, w[:, d]) for _ in range(k)]
            k = max(1, round(share * len(sample)))
            assert got[share, d] == pytest.approx(sum(sample[:k]) / k / (sum(sample) / len(sample)))
    both = resample.compounded([spark.createDataFrame([(0, 2.0), (1, None)], "draw long, factor double"), spark.createDataFrame([(0, 3.0), (1, 1.0)], "draw long, factor double")])
    assert sorted(map(tuple, both.collect()), key=str) == [(0, 6.0), (1, None)]


def test_grid_entries(spark):
    a = [["Compound", "Dose", "Seq.", "Inhibition"], ["No.", "(nM)", "", "(%)"], ["ISIS 123456", "10", "ACGTA", "45"], ["", "", "CCG", ""], ["", "20", "", "50"], ["", "", "", "55"], ["654321†", "", "TTT", "7", "extra"], ["note", "", "", ""]]
    b = [["Time", "ISIS 111111", "ISIS 222222"], ["2 h", "91", "0"], ["4 h", "", "44"]]
    rows = spark.createDataFrame([(t, k, c) for t, x in (("a", a), ("b", b), ("none", [["x", "y"], []])) for k, c in enumerate(x)], "table_id string, position int, cells array<string>")
    got = {(r.table_id, r.kind, r.position, r.compound, r.field): r.value for r in grids.entries(rows).collect()}
    seq = {k: v for k, v in got.items() if k[4] == "seq"}
    assert seq == {("a", "A", p, "123456", "seq"): "ACGTACCG" for p in (2, 4, 5)} | {("a", "A", p, "654321", "seq"): "TTT" for p in (6, 7)}
    assert [got["a", "A", p, "123456", "dose_nm"] for p in (2, 4, 5)] == ["10", "20", "20"] and ("a", "A", 6, "654321", "dose_nm") not in got
    assert got["a", "A", 5, "123456", "inhibition_pct"] == "55" and got["a", "A", 6, "654321", "column_4"] == "extra"
    assert {k[3:]: v for k, v in got.items() if k[0] == "b"} == {("111111", "2_h"): "91", ("222222", "2_h"): "0", ("222222", "4_h"): "44"}
    assert grids.entries(rows.limit(0)).count() == 0


GRID = [["ISIS NO", "SEQ ID", "40 nM", "1,000 nM"], *[[str(900000 + k), str(k + 200), str(11 + 3 * k), str(52 + 3 * k)] for k in range(8)]]
CLAIMS = [(str(900000 + k), d, str(100 - v)) for k in range(8) for d, v in ((40.0, 11 + 3 * k), (1000.0, 52 + 3 * k))]


@pytest.mark.parametrize(
    ("change", "caught"),
    [
        (lambda c: c, {}), (lambda c: [x for x in c if x[0] != "900003"], {"n_dropped": 1}), (lambda c: [(c[0][0], c[0][1], "92.5"), *c[1:]], {"coverage_pct": 93.75, "n_unsourced": 1, "n_partial": 1}),
        (lambda c: [("99" + i[2:], d, v) if i == "900001" else (i, d, v) for i, d, v in c], {"n_missing": 1, "n_dropped": 1}), (lambda c: [*c, (c[0][0], 7777.0, c[0][2])], {"n_unprinted": 1}),
        (lambda c: [(i, 1000.0 if d == 40 else 40.0, v) for i, d, v in c], {"coverage_pct": 0.0, "n_partial": 2}), (lambda c: [(str(int(i) - 900000 + 200), d, v) for i, d, v in c], {"suspect_column": 0}),  # the ids of another column
    ],
)
def test_injected_defects_are_found(spark, change, caught):
    rows = spark.createDataFrame([("t", k, c) for k, c in enumerate(GRID)], "table_id string, position int, cells array<string>")
    claims = spark.createDataFrame([("t", *c) for c in change(CLAIMS)], "table_id string, compound string, dose double, value string")
    r = completeness.report(rows, claims).first().asDict()
    clean = {"n_rows": 8, "n_missing": 0, "coverage_pct": 100.0, "n_dropped": 0, "n_unsourced": 0, "n_unprinted": 0, "n_partial": 0, "suspect_column": None}
    want = clean | ({"n_rows": 7} if "n_dropped" in caught else {}) | caught
    assert {k: r[k] for k in clean} == want


def test_a_metadata_column_does_not_take_what_measurements_print(spark):
    rows = spark.createDataFrame([("t", k, c) for k, c in enumerate([["900001", "45", "45"], ["900002", "46", "52"], ["900003", "47", "53"], ["900004", "54"]])], "table_id string, position int, cells array<string>")
    claims = spark.createDataFrame([("t", f"90000{k}", None, v) for k, v in ((1, "45"), (2, "52"), (3, "53"), (4, "54"))], "table_id string, compound string, dose double, value string")
    r = completeness.report(rows, claims, mirror=False).first()
    assert (r.n_cells, r.n_accounted, r.n_unsourced, r.ragged) == (4, 4, 0, True)


def plain_nesting(text):
    pairs, open_ = {")": "(", "]": "[", "}": "{"}, []
    for i, x in enumerate(text, 1):
        if x in pairs.values():
            open_.append((x, i))
        elif x in pairs:
            if not open_:
                return i, "unopened"
            if open_[-1][0] != pairs[x]:
                return i, "crossed"
            open_.pop()
    return (open_[0][1], "unclosed") if open_ else None


def plain_strict(text):
    m = re.search(r"RNA1\{\{(.*)\}\}", text, re.DOTALL)
    if not m or not m[1]:
        return None
    units = [re.match(r"^(\[[a-zA-Z0-9]+\]|d)\(([^)]+)\)(\[sp\])?$", u.strip()) for u in m[1].split(".")]
    if not all(u and u[1] in notation.LETTERS for u in units):
        return None
    return "".join("C" if u[2] == "[5meC]" else u[2] for u in units), "".join(notation.LETTERS[u[1]] for u in units), "".join("s" if u[3] else "o" for u in units[:-1])


def test_notation_equals_a_plain_parser(spark):
    g = random.Random(4)
    pieces = ["RNA1{", "RNA1{{", "}}$$$$", "}$$$$", "[moe]", "[cet]", "d", "(A)", "(C)", "([5meC])", "[sp]", ".", "(", ")", "[", "]", "{", "}", "x", " ", "CHEM1{q}|"]
    texts = ["".join(g.choice(pieces) for _ in range(g.randint(0, 14))) for _ in range(400)]
    for _ in range(200):
        units = [g.choice(["[moe]", "d", "[cet]", "[lna]"]) + g.choice(["(A)", "(G)", "([5meC])"]) + g.choice(["", "[sp]"]) for _ in range(g.randint(1, 6))]
        text = "RNA1{{" + ".".join(units) + "}}$$$$"
        k = g.randrange(len(text))
        texts += [text, text[:k] + text[k + 1 :]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", notation.nesting(F.col("t")).alias("n"), notation.read_strict(F.col("t")).alias("r"))
    for r in df.collect():
        assert (None if r.n is None else tuple(r.n)) == plain_nesting(r.t), r.t
        assert (None if r.r is None else (r.r.sequence, r.r.sugars, r.r.links)) == plain_strict(r.t), r.t
    again = df.where("r.sequence RLIKE '^[ACG]+$' AND t LIKE 'RNA1{{%}}$$$$'").select("t", notation.build_strict(F.col("r.sequence"), F.col("r.sugars"), F.col("r.links"), F.lit(False)).alias("b"))
    for r in again.collect():
        assert r.b == re.sub(r"\[sp\](?=\}\})", "", r.t.replace("[5meC]", "C")), r.t


@pytest.mark.parametrize(("text", "errors", "warnings"), [(None, ["none"], []), ("boom", ["message:boom"], []), ("RNA2{d(A)}$$$$", ["no_polymer"], []), ("RNA1{d(A)[sp].d(C)}$$$$", [], []), ("RNA1{(A)..d(Q)}$$$$", [], ["sugar:1", "unusual_base:3"]), ("RNA1{d(A)[sp]}$$$$", ["last_link:1"], []), ("RNA1{}$$$$", ["no_units"], [])])
def test_notation_check(spark, text, errors, warnings):
    v = spark.createDataFrame([(text,)], "t string").select(notation.check(F.col("t")).alias("v")).first().v
    assert (v.errors, v.warnings, v.is_valid) == (errors, warnings, not errors)


def test_p_values_equal_the_plain_function(spark):
    g = random.Random(3)
    rows = [(r, n) for n in (3, 4, 5, 10, 100, 5000, 10**6) for r in (0.0, 1e-4, -0.02, 0.3, -0.7, 0.999, 1.0, g.uniform(-1, 1))] + [(0.5, 2), (None, 9)]
    out = spark.createDataFrame(rows, "r double, n long").select("r", "n", metrics.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for r in out:
        if r.r is None or r.n < 3:
            assert r.p is None
        else:
            assert r.p == pytest.approx(metrics.student_p(r.r, r.n), rel=1e-7, abs=1e-290)
    pairs = spark.createDataFrame([("x", "y", 20, 0.5), ("y", "x", 20, 0.5), ("x", "z", 20, 0.1), ("z", "x", 20, 0.1)], "a string, b string, n long, rho double")
    for r in metrics.significances(pairs).collect():
        assert r.corrected == pytest.approx(min(1, 2 * r.p))
    assert metrics.significances(pairs, 15).where("corrected = least(15 * p, 1)").count() == 4
