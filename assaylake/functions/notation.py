"""Strict reading and checking of oligonucleotide notation, sign by sign.

`helm` reads what can be read; here a notation is read whole or not at all, and what is wrong with it is told with its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .helm import let

#: Sugars by their sign in a strict notation, and the letters that motifs write them with.
LETTERS = {"[moe]": "e", "[cet]": "k", "[lna]": "l", "[m]": "m", "d": "d"}
#: Signs by which a unit's sugar and base are known, and bases without a warning.
KNOWN_SUGAR = r"\[(?:moe|fR|lna|cet|am)\]|[drm]\("
ANY_BASE, USUAL_BASE = r"\(([A-Z5me\[\]]+)\)", r"A|C|G|T|U|\[5meC\]|\[m5C\]"
WHOLE = r"(?s)^(CHEM\d+\{.*?\}\|)?RNA1\{(.*?)\}(\|CHEM\d+\{.*?\})?\$\$\$\$"
STRICT = r"^(\[[a-zA-Z0-9]+\]|d)\(([^)]+)\)(\[sp\])?$"
PAIRS = {")": "(", "]": "[", "}": "{"}


def nesting(text: Column) -> Column:
    """struct<place, kind> of the first bracket that doesn't nest, null where all do. Place counts from 1.

    A machine over the signs, whose state is the open brackets and where they stand. kind: `unopened`, a closing bracket without an
    opening one; `crossed`, one that closes another kind; else `unclosed`, the first that stays open.
    """
    closes = F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv])
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("kind"))

    def step(state: Column, i: Column) -> Column:
        sign = F.substring(text, i, F.lit(1))
        opens, other = sign.isin(*PAIRS.values()), F.element_at(closes, sign)
        top, depth = F.substring(state["open"], F.length(state["open"]), F.lit(1)), F.length(state["open"])
        to = lambda open_, at, place, kind: F.struct(open_.alias("open"), at.alias("at"), place.alias("place"), kind.alias("kind"))
        kind = F.when(depth == 0, "unopened").when(top != other, "crossed")
        popped = to(F.substring(state["open"], F.lit(1), depth - 1), F.slice(state["at"], F.lit(1), F.greatest(depth - 1, F.lit(0))), F.when(kind.isNotNull(), i), kind)
        pushed = to(F.concat(state["open"], sign), F.concat(state["at"], F.array(i)), state["place"], state["kind"])
        return F.when(state["kind"].isNotNull(), state).when(opens, pushed).when(other.isNotNull(), popped).otherwise(state)

    def told(end: Column) -> Column:
        left = F.size(end["at"]) > 0
        return F.when(end["kind"].isNotNull() | left, F.struct(F.coalesce(end["place"], F.get(end["at"], F.lit(0))).alias("place"), F.coalesce(end["kind"], F.lit("unclosed")).alias("kind")))

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)).isin(*PAIRS, *PAIRS.values()))
    return F.when(text.isNotNull(), let(F.aggregate(places, start, step), told))


def check(text: Column) -> Column:
    """struct<is_valid, errors, warnings, structure<five, three, units>, nesting> of a notation in single curly brackets.

    A null or what doesn't end as a notation is its own error, and so is one without an RNA1 polymer; then each unit: `base:<k>`,
    none can be read; `last_link:<k>`, the last has a link; warnings `sugar:<k>`, none that is known; `unusual_base:<k>`. Units count
    from 1; blank ones count, but aren't checked. Last the numbers of brackets (`square`, `curly`, `round`) and `no_units`.
    """
    inside, has = F.regexp_extract(text, WHOLE, 2), text.rlike(WHOLE)
    parts = F.split(inside, r"\.", -1)
    numbered = F.filter(F.transform(parts, lambda p, i: F.struct((i + 1).alias("k"), p.alias("p"))), lambda x: F.trim(x["p"]) != "")
    named = lambda kind, x: F.concat(F.lit(f"{kind}:"), x["k"].cast("string"))
    kept = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    base = lambda x: F.regexp_extract(x["p"], ANY_BASE, 1)
    linked = lambda x: x["p"].contains("[sp]") | x["p"].contains("[am]")
    unit_errors = F.flatten(F.transform(numbered, lambda x: F.array(F.when(base(x) == "", named("base", x)), F.when((x["k"] == F.size(parts)) & linked(x), named("last_link", x)))))
    unit_warnings = F.flatten(F.transform(numbered, lambda x: F.array(F.when(~x["p"].rlike(KNOWN_SUGAR), named("sugar", x)), F.when((base(x) != "") & ~base(x).rlike(USUAL_BASE), named("unusual_base", x)))))
    n = lambda sign: F.length(text) - F.length(F.translate(text, sign, ""))
    whole = F.array(F.when(F.size(numbered) == 0, "no_units"), *[F.when(n(a) != n(b), k) for a, b, k in (("[", "]", "square"), ("{", "}", "curly"), ("(", ")", "round"))])
    early = F.when(text.isNull(), F.array(F.lit("none"))).when(~text.endswith("$$$$"), F.array(F.concat(F.lit("message:"), text))).when(~has, F.array(F.lit("no_polymer")))
    errors = F.coalesce(early, kept(F.concat(unit_errors, whole)))
    fine = early.isNull()
    structure = F.when(fine, F.struct((F.regexp_extract(text, WHOLE, 1) != "").alias("five"), (F.regexp_extract(text, WHOLE, 3) != "").alias("three"), F.size(numbered).alias("units")))
    return let(errors, lambda e: F.struct((F.size(e) == 0).alias("is_valid"), e.alias("errors"), F.when(fine, kept(unit_warnings)).otherwise(F.array().cast("array<string>")).alias("warnings"), structure.alias("structure"), nesting(text).alias("nesting")))


def read_strict(text: Column) -> Column:
    """struct<bases, sequence, sugars, links, methyl> in the letters of motifs; null unless every unit can be read."""
    parts = F.transform(F.split(F.nullif(F.regexp_extract(text, r"(?s)RNA1\{\{(.*)\}\}", 1), F.lit("")), r"\.", -1), F.trim)
    letter = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    unit = lambda p: F.struct(F.element_at(letter, F.regexp_extract(p, STRICT, 1)).alias("sugar"), F.regexp_extract(p, STRICT, 2).alias("base"), F.when(F.regexp_extract(p, STRICT, 3) != "", "s").otherwise("o").alias("link"))
    return let(F.transform(parts, unit), _read)


def _read(units: Column) -> Column:
    bases, links = F.transform(units, lambda u: u["base"]), F.transform(F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0))), lambda u: u["link"])
    whole = F.struct(bases.alias("bases"), F.array_join(F.transform(bases, lambda b: F.when(b == "[5meC]", "C").otherwise(b)), "").alias("sequence"), F.array_join(F.transform(units, lambda u: u["sugar"]), "").alias("sugars"), F.array_join(links, "").alias("links"), F.array_contains(bases, "[5meC]").alias("methyl"))
    return F.when(F.forall(units, lambda u: u["sugar"].isNotNull()), whole)


def build_strict(sequence: Column, sugars: Column, links: Column, methyl: Column) -> Column:
    """The notation of a sequence with its sugars and links by letter, methylated where it has a C; null where lengths or a sugar don't fit. Null links are none."""
    own = F.struct(F.upper(F.regexp_replace(sequence, r"[^ACGTUacgtu]", "")).alias("q"), sugars.alias("s"), links.alias("l"), methyl.alias("m"))
    return let(own, lambda x: _built(x["q"], x["s"], x["l"], x["m"]))


def _built(clean: Column, sugars: Column, links: Column, methyl: Column) -> Column:
    sign = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (v, k)])
    at = F.sequence(F.lit(1), F.greatest(F.length(clean), F.lit(1)))
    base = lambda i: F.when(methyl & (F.substring(clean, i, F.lit(1)) == "C"), "[5meC]").otherwise(F.substring(clean, i, F.lit(1)))
    unit = lambda i: F.concat(F.element_at(sign, F.substring(sugars, i, F.lit(1))), F.lit("("), base(i), F.lit(")"), F.when(F.substring(links, i, F.lit(1)) == "s", "[sp]").otherwise(""))
    fits = lambda units: (F.length(clean) > 0) & (F.length(sugars) == F.length(clean)) & (links.isNull() | (F.coalesce(F.length(links), F.lit(0)) == 0) | (F.length(links) == F.length(clean) - 1)) & F.forall(units, lambda u: u.isNotNull())
    return let(F.transform(at, unit), lambda units: F.when(fits(units), F.concat(F.lit("RNA1{{"), F.array_join(units, "."), F.lit("}}$$$$"))))


def without_methyl(text: Column) -> Column:
    """A notation with plain C for 5-methyl-C, and d for [d]; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("[5meC]"), F.lit("C")), F.lit("[d]("), F.lit("d("))
