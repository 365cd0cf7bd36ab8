"""Chemistry notation of oligonucleotides as native expressions.

A polymer is written as `RNA1{{[moe](G)[sp].d([5meC])[sp].(A)}}$$$$`: units by full stops, each a sugar, a base in round
brackets, and `[sp]` where the link to the next unit is a phosphorothioate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sugars by their sign.
SUGARS = {"moe": "MOE", "lna": "LNA", "cet": "cEt", "fr": "fR", "m": "OMe", "d": "DNA"}
#: A score of sequences, its constant and the weight of each base and of the run without G at the 3' end.
SCORE = {"": 136.0430, "A": -3.1263, "C": -5.1100, "T": -4.7217, "G": -10.1264, "run": 1.3577}
RUN_CAP = 20
#: What the features of a notation tell apart, and how many units they reach.
BASES, KINDS, BONDS, REACH = ("A", "C", "G", "T", "U", "5meC"), ("MOE", "DNA", "LNA", "cEt", "fR", "OMe", "RNA"), ("PS", "PO"), 30
BAD = r"\[(lna|LNA|fR|FR|am|AM|\?)\]|\[m\]\("


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unit(unit: Column) -> Column:
    """struct<sugar, base, mod, ps> of one unit; a null base where it can't be read."""
    return let(F.trim(F.replace(unit, F.lit("[sp]"), F.lit(""))), lambda body: _sugar_and_content(unit, body))


def _sugar_and_content(unit: Column, body: Column) -> Column:
    named, deoxy, ribo = body.rlike(r"^\[\w+\]\([^)]+\)"), body.startswith("d("), body.startswith("(") & body.endswith(")")
    sign = F.lower(F.regexp_extract(body, r"^\[(\w+)\]", 1))
    names = F.create_map(*[F.lit(x) for pair in SUGARS.items() for x in pair])
    sugar = F.when(named, F.coalesce(F.element_at(names, sign), F.upper(sign))).when(deoxy, "DNA").when(ribo, "RNA")
    content = (
        F.when(named, F.regexp_extract(body, r"^\[\w+\]\(([^)]+)\)", 1))
        .when(deoxy, F.regexp_replace(F.substring(body, F.lit(3), F.length(body)), r"\)$", ""))
        .when(ribo, F.substring(body, F.lit(2), F.length(body) - 2))
    )
    return let(F.struct(sugar.alias("sugar"), content.alias("content")), lambda x: _read(unit, x["sugar"], x["content"]))


def _read(unit: Column, sugar: Column, content: Column) -> Column:
    changed = content.startswith("[") & content.endswith("]")
    mod = F.when(changed, F.substring(content, F.lit(2), F.length(content) - 2))
    raw = F.when(changed, F.when(mod == "5meC", "C").otherwise(F.nullif(F.substring(mod, 1, 1), F.lit("")))).otherwise(F.upper(content))
    base = let(raw, lambda r: F.when((r == "T") & (sugar == "RNA"), "U").when((r == "U") & (sugar == "DNA"), "T").otherwise(r))
    return F.struct(sugar.alias("sugar"), base.alias("base"), mod.alias("mod"), unit.contains("[sp]").alias("ps"))


def units(helm: Column) -> Column:
    """The readable units of a notation, in order; empty where there is none."""
    inside = F.regexp_extract(helm, r"(?s)\{\{(.+?)\}\}", 1)
    parts = F.filter(F.transform(F.split(inside, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.filter(F.transform(parts, _unit), lambda u: u["base"].isNotNull()), F.array().cast("array<struct<sugar:string,base:string,mod:string,ps:boolean>>"))


def parse(helm: Column) -> Column:
    """struct<sequence, length, sugars, bases, mods, backbones>; null where nothing can be read."""
    return let(units(helm), _whole)


def _whole(u: Column) -> Column:
    links = F.transform(F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0))), lambda x: F.when(x["ps"], "PS").otherwise("PO"))
    bases = F.transform(u, lambda x: x["base"])
    whole = F.struct(F.array_join(bases, "").alias("sequence"), F.size(u).alias("length"), F.transform(u, lambda x: x["sugar"]).alias("sugars"), bases.alias("bases"), F.transform(u, lambda x: x["mod"]).alias("mods"), links.alias("backbones"))
    return F.when(F.size(u) > 0, whole)


def _count(values: Column, wanted: str) -> Column:
    return F.size(F.filter(values, lambda x: x == wanted))


def letters(parsed: Column) -> Column:
    """Sugars as one letter each: M, D, K (cEt), L, and O for others."""
    one = F.create_map(*[F.lit(x) for x in ("MOE", "M", "DNA", "D", "cEt", "K", "LNA", "L")])
    return F.array_join(F.transform(parsed["sugars"], lambda s: F.coalesce(F.element_at(one, s), F.lit("O"))), "")


def wings(parsed: Column) -> Column:
    """struct<five, gap, three>: MOE units at each end and DNA units between."""
    s = letters(parsed)
    five, three = F.length(F.regexp_extract(s, "^M*", 0)), F.length(F.regexp_extract(s, "M*$", 0))
    middle = F.substring(s, five + 1, F.length(s) - five - three)
    gap = F.when(five + three >= F.length(s), 0).otherwise(F.length(F.regexp_replace(middle, "[^D]", "")))
    return F.struct(five.alias("five"), gap.alias("gap"), three.alias("three"))


def ps_count(parsed: Column) -> Column:
    return _count(parsed["backbones"], "PS")


def chemistry_counts(parsed: Column) -> Column:
    """[MOE, cEt, DNA, PS, PO], all 0 where nothing was read."""
    own = [_count(parsed["sugars"], x) for x in ("MOE", "cEt", "DNA")] + [_count(parsed["backbones"], x) for x in ("PS", "PO")]
    return F.array(*[F.when(parsed.isNull(), 0).otherwise(x) for x in own])


def chemistry_class(parsed: Column) -> Column:
    s = letters(parsed)
    return (
        F.when(parsed.isNull(), "unparsed").when(s.rlike("^M{5}D{10}M{5}$"), "5-10-5 MOE gapmer").when(s.contains("K") & s.contains("M"), "mixed MOE/cET")
        .when(s.contains("K"), "cET gapmer").when(s.contains("L"), "LNA-containing").when(s.rlike("^M+D+M+$"), "MOE gapmer (other wing)").otherwise("other")
    )


def doubts(helm: Column, parsed: Column) -> Column:
    """Why a notation is no good, by bars; empty where it is kept. What can't be read is kept."""
    reasons = {
        "uncertain": helm.contains("?"),
        "short": parsed["length"] <= 10,
        "no_dna": ~F.array_contains(parsed["sugars"], "DNA"),
        "one_base": F.size(F.array_distinct(parsed["bases"])) == 1,
        "all_dna": F.forall(parsed["sugars"], lambda s: s == "DNA"),
    }
    return F.concat_ws("|", *[F.when(c, k) for k, c in reasons.items()])


def valid_chemistry(helm: Column) -> Column:
    return F.coalesce((helm != "None") & ~helm.rlike(BAD), F.lit(False))


def sequence_score(parsed: Column) -> Column:
    """A linear score of base counts and of the run without G at the 3' end; null where nothing was read."""
    seq = parsed["sequence"]
    run = F.length(F.regexp_extract(seq, "[^G]*$", 0))
    run = F.when(run == F.length(seq), RUN_CAP).otherwise(F.least(run, F.lit(RUN_CAP)))
    n = {b: F.length(seq) - F.length(F.translate(seq, b, "")) for b in "ACTG"}
    score = F.lit(SCORE[""])
    for b in "ACTG":  # from left to right, as ties of the rounding depend on it
        score = score + SCORE[b] * n[b]
    return F.round((score + SCORE["run"] * run) * 10) / 10 + 0.0


def shorthand(parsed: Column) -> Column:
    """Runs of sugars: 5(MOE)-10(DNA)-5(MOE)."""
    runs = F.aggregate(
        parsed["sugars"],
        F.array().cast("array<struct<s:string,n:int>>"),
        lambda a, s: F.when(
            F.get(a, F.size(a) - 1)["s"] == s, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(s.alias("s"), (F.get(a, F.size(a) - 1)["n"] + 1).alias("n"))))
        ).otherwise(F.concat(a, F.array(F.struct(s.alias("s"), F.lit(1).alias("n"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.format_string("%d(%s)", r["n"], r["s"])), "-")


def build(sequence: Column, sugars: Column, backbones: Column) -> Column:
    """Notation of a sequence; sugars by letter (e MOE, k cEt, l LNA, d DNA), links by letter (s, o)."""
    return let(F.struct(sequence.alias("q"), sugars.alias("s"), backbones.alias("b")), lambda x: _built(x["q"], x["s"], x["b"]))


def _built(sequence: Column, sugars: Column, backbones: Column) -> Column:
    sign = F.create_map(*[F.lit(x) for x in ("e", "[moe]", "k", "[cet]", "l", "[lna]", "d", "d", "m", "[m]")])
    at = F.sequence(F.lit(1), F.length(sequence))
    unit = lambda i: F.concat(F.element_at(sign, F.substring(sugars, i, F.lit(1))), F.lit("("), F.substring(sequence, i, F.lit(1)), F.lit(")"), F.when(F.substring(backbones, i, F.lit(1)) == "s", "[sp]").otherwise(""))
    return F.concat(F.lit("RNA1{{"), F.array_join(F.transform(at, unit), "."), F.lit("}}$$$$"))


def validate(helm: Column) -> Column:
    """struct<is_valid, errors>: ending, kind of polymer, brackets and units."""
    inside = F.regexp_extract(helm, r"(?s)\{\{(.+?)\}\}", 1)
    parts = F.split(inside, r"\.")
    n = lambda sign: F.length(helm) - F.length(F.translate(helm, sign, ""))
    wrong = [
        ("ending", ~helm.endswith("$$$$")),
        ("polymer", ~helm.rlike("^(RNA1|CHEM)")),
        ("round_brackets", n("(") != n(")")),
        ("square_brackets", n("[") != n("]")),
        ("curly_brackets", n("{") != n("}")),
        ("units", F.exists(parts, lambda x: ~x.rlike(r"^(\[\w+\]|d|r)?\((\[\w+\]|[ACGTU])\)(\[sp\]|p)?$"))),
    ]
    errors = F.filter(F.array(*[F.when(c, k) for k, c in wrong]), lambda x: x.isNotNull())
    return F.when(helm.isNotNull(), F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors")))


def only_sugars(parsed: Column, allowed: list[str]) -> Column:
    """Whether a notation has no other sugars; false where nothing was read."""
    return F.coalesce(F.size(F.array_except(parsed["sugars"], F.array(*map(F.lit, allowed)))) == 0, F.lit(False))


def single_braces(helm: Column) -> Column:
    """A notation with single curly brackets; closing ones only where the ending follows."""
    return F.regexp_replace(F.regexp_replace(helm, r"\{+", "{"), r"\}+(?=\$\$\$\$)", "}")


def features(parsed: Column) -> Column:
    """Numbers of a notation: base, sugar and link at each place up to REACH, shares of neighbouring bases, and length; all 0 under two units."""
    n = F.least(F.size(parsed["bases"]), F.lit(REACH))
    pairs = F.zip_with(F.slice(parsed["bases"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(parsed["bases"], F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("/"), b))
    return let(F.struct(n.alias("n"), pairs.alias("pairs"), *[parsed[c].alias(c) for c in ("bases", "sugars", "backbones")]), _features)


def _features(parsed: Column) -> Column:
    n, pairs = parsed["n"], parsed["pairs"]
    hot = lambda values, names, reach: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda j: F.transform(F.array(*map(F.lit, names)), lambda x: F.when((j < reach - REACH + n) & (F.get(values, j) == x), 1.0).otherwise(0.0))))
    kinds = F.array(*[F.lit(f"{a}/{b}") for a in BASES for b in BASES])
    shares = F.transform(kinds, lambda k: F.size(F.filter(pairs, lambda x: x == k)) / F.greatest(n - 1, F.lit(1)).cast("double"))
    own = F.concat(hot(parsed["bases"], BASES, REACH), hot(parsed["sugars"], KINDS, REACH), hot(parsed["backbones"], BONDS, REACH - 1), shares, F.array(n.cast("double")))
    width = REACH * (len(BASES) + len(KINDS)) + (REACH - 1) * len(BONDS) + len(BASES) ** 2 + 1
    return F.when(n >= 2, own).otherwise(F.array_repeat(F.lit(0.0), width))


def agreement(df: DataFrame, key: str, gold: str, found: str) -> DataFrame:
    """key and, for sequence, sugars and links, whether all notations of a key agree with the gold one (strict) or any does (best)."""
    same = {"sequence": "sequence", "sugars": "sugars", "links": "backbones"}
    each = [(n, F.coalesce(F.col(gold)[c] == F.col(found)[c], F.lit(False))) for n, c in same.items()]
    return df.groupBy(key).agg(*[f(c).alias(f"{kind}_{n}") for n, c in each for kind, f in (("strict", F.bool_and), ("best", F.bool_or))])
