"""Measurements of two sources under rules that are data: what is wrong with a record, its identity and context, and the ledger of a match."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import unique
from .match import match_compatible

REQUIRED, COMPARED = "required", "compared"
#: Words that state nothing.
UNSTATED = ("", "na", "n/a", "none", "null")


@dataclass(frozen=True)
class Rule:
    """A field of an endpoint's records: required for identity, or compared once records are paired; and how it is read."""

    endpoint: str
    field: str
    role: str = REQUIRED
    normaliser: str = "text"


def stated(c: Column) -> Column:
    """c, or null where it is blank or a word for nothing."""
    return F.when(~F.lower(F.trim(c)).isin(*UNSTATED), c)


def _text(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def _number(c: Column) -> Column:
    """A number to six places, else the text."""
    return F.coalesce(F.round(c.try_cast("double"), 6).cast("string"), _text(c))


def _compound(c: Column) -> Column:
    """12 and 12.0 are one compound; others by their signs without blanks."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.lower(F.regexp_replace(c, r"\s+", "")))


#: Ways to read a field, by name, so that a rule can be a row of a table.
NORMALISERS: dict[str, Callable[[Column], Column]] = {"text": _text, "number": _number, "compound": _compound}


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules in a table (endpoint, field, role, normaliser), a row a field: a new family is rows, not code."""
    out = [Rule(*r) for r in table.select("endpoint", "field", "role", "normaliser").orderBy("endpoint", "role", "field").collect()]
    check(out)
    return out


def check(rules: Iterable[Rule]) -> None:
    seen = set()
    for r in rules:
        if r.role not in (REQUIRED, COMPARED) or r.normaliser not in NORMALISERS:
            raise ValueError(f"unknown role or normaliser: {r}")
        if (r.endpoint, r.field) in seen:
            raise ValueError(f"two rules for {r.endpoint}.{r.field}")
        seen.add((r.endpoint, r.field))


def demoted(rules: list[Rule], fields: set[str]) -> list[Rule]:
    """The rules with these fields compared, no longer required: identity gets coarser, and what it told apart is judged after pairing."""
    return [replace(r, role=COMPARED) if r.field in fields else r for r in rules]


def _by_endpoint(rules: list[Rule], of: Callable[[list[Rule]], Column], role: str) -> Column:
    out = F.lit(None)
    for e in sorted({r.endpoint for r in rules}):
        own = sorted((r for r in rules if r.endpoint == e and r.role == role), key=lambda r: r.field)
        out = F.when(F.col("endpoint") == e, of(own)).otherwise(out)
    return out


def judged(records: DataFrame, rules: list[Rule], scope: DataFrame) -> DataFrame:
    """records with family, table_class, identity_key, context and problem, the first in this order or null: no id, endpoint, channel,
    compound; a table outside scope; an endpoint without rules; required fields that are not stated, by name.

    records (measurement_id, table_ref, endpoint, channel, compound, identity map, outcome), scope (table_ref, family, table_class).
    Fields not stated are null in the context.
    """
    check(rules)
    field = lambda r: stated(F.col("identity")[r.field])
    read = lambda r: NORMALISERS[r.normaliser](field(r))
    texts = lambda xs: F.array(*xs).cast("array<string>")
    gone = _by_endpoint(rules, lambda own: F.concat_ws(",", *[F.when(field(r).isNull(), F.lit(r.field)) for r in own]), REQUIRED)
    known = sorted({r.endpoint for r in rules})
    seen = records.join(unique(scope.select("table_ref", "family", "table_class"), ["table_ref"]), "table_ref", "left")
    problems = [
        (stated(F.col("measurement_id").cast("string")).isNull(), F.lit("missing_measurement_id")),
        *[(stated(F.col(c)).isNull(), F.lit(f"missing_{n}")) for c, n in (("endpoint", "endpoint"), ("channel", "channel"), ("compound", "compound_id"))],
        (F.col("table_class").isNull(), F.lit("table_not_in_equivalence_scope")),
        (~F.col("endpoint").isin(*known), F.lit("no_identity_rule_for_endpoint")),
        (gone != "", F.concat(F.lit("missing_required_identity:"), gone)),
    ]
    problem = F.coalesce(*[F.when(wrong, name) for wrong, name in problems])
    outcome = _number(stated(F.col("outcome").cast("string")))
    return seen.select(
        *records.columns, "family", "table_class", _text(F.col("channel")).alias("channel_key"), _compound(F.col("compound")).alias("compound_key"),
        F.coalesce(_by_endpoint(rules, lambda own: texts(map(read, own)), REQUIRED), texts([])).alias("identity_key"),
        F.coalesce(_by_endpoint(rules, lambda own: texts(map(read, own)), COMPARED), texts([])).alias("context"), outcome.alias("outcome_key"), problem.alias("problem"),
    )


BUCKET = ["family", "table_class", "endpoint", "channel_key", "compound_key", "identity_key"]


def ledger(gold: DataFrame, found: DataFrame, rules: list[Rule], scope: DataFrame) -> DataFrame:
    """side, measurement_id, status, counterpart_id, reason, value_correct, context_correct and the identity bucket, for every record of both sides.

    Records with a problem are unresolved, for that reason. The others are paired one to one within an identity that no outcome
    is part of, `match.match_compatible`: most equal outcomes, then most contexts that agree in what gold states. A pair is
    matched_value_correct or matched_value_incorrect; gold left alone is missing, found left alone is extra. Outcomes are equal as
    numbers to six places, or as texts. An id that occurs twice on a side is an error.
    """
    sides = {s: unique(judged(d, rules, scope), ["measurement_id"]) for s, d in (("gold", gold), ("found", found))}
    a, b = (d.where("problem IS NULL").select(*BUCKET, F.col("measurement_id").alias(s), "outcome_key", "context") for s, d in sides.items())
    pairs = match_compatible(a, b, BUCKET, "gold", "found", "outcome_key", "context")
    status = F.when(F.col("gold").isNull() | F.col("found").isNull(), None).when(F.col("value_equal"), "matched_value_correct").otherwise("matched_value_incorrect")
    no_text = F.lit(None).cast("string")
    rows = [
        pairs.where(F.col(s).isNotNull()).select(*BUCKET, F.lit(s).alias("side"), F.col(s).cast("string").alias("measurement_id"), F.coalesce(status, F.lit(alone)).alias("status"), F.col(o).cast("string").alias("counterpart_id"), no_text.alias("reason"), F.col("value_equal").alias("value_correct"), F.col("context_equal").alias("context_correct"))
        for s, o, alone in (("gold", "found", "missing"), ("found", "gold", "extra"))
    ]
    flag = F.lit(None).cast("boolean")
    for s, d in sides.items():
        odd = d.where("problem IS NOT NULL")
        rows.append(odd.select(*BUCKET, F.lit(s).alias("side"), F.col("measurement_id").cast("string"), F.lit("unresolved").alias("status"), no_text.alias("counterpart_id"), F.col("problem").alias("reason"), flag.alias("value_correct"), flag.alias("context_correct")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def match_summary(told: DataFrame, by: list[str]) -> DataFrame:
    """by, and a ledger's counts: pairs, those right in value, in context, in both, and records missing, extra and unresolved on each side."""
    gold = F.col("side") == "gold"
    pair = gold & F.col("counterpart_id").isNotNull()
    counts = {
        "matched": pair, "value_correct": pair & F.col("value_correct"), "value_incorrect": pair & ~F.col("value_correct"),
        "context_correct": pair & F.col("context_correct"), "context_incorrect": pair & ~F.col("context_correct"), "fully_correct": pair & F.col("value_correct") & F.col("context_correct"),
        "missing": F.col("status") == "missing", "extra": F.col("status") == "extra",
        "unresolved_gold": gold & (F.col("status") == "unresolved"), "unresolved_found": ~gold & (F.col("status") == "unresolved"),
    }
    return told.groupBy(*by).agg(*[F.count_if(c).alias(f"n_{n}") for n, c in counts.items()])
