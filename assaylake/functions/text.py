"""Text expressions: normal forms of names, doses and score lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
#: What stands for a missing number.
MISSING = ("NA", "N/A", "NONE", "NULL", "-", "")
#: Whole words that tell a species, in the order in which they are tried.
SPECIES = (("mice", "mouse"), ("mouse", "mouse"), ("rats", "rat"), ("rat", "rat"), ("rhesus", "monkey"), ("monkey", "monkey"), ("human", "human"))
#: Names of control arms.
CONTROLS = "pbs|saline|vehicle|untreated|control|utc|ltc"


def name_key(c: Column) -> Column:
    """Upper case without the signs that names of cell lines are written with or without."""
    return F.translate(F.upper(c), "- .:/(),_", "")


def plain(c: Column) -> Column:
    """Lower case, and one space for white space, underscores, hyphens and slashes."""
    return F.trim(F.regexp_replace(F.trim(F.lower(c)), r"[\s_\-/]+", " "))


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Whether any of some patterns is found, whatever the case."""
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def canonical(c: Column, aliases: dict[str, str], strip: str = "- .") -> Column:
    """The name that an alias stands for; an unknown one stays as it is."""
    if not aliases:
        return c
    key = F.translate(F.upper(F.translate(F.trim(c), "–_", "--")), strip, "")
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, key), c)


def table_number(c: Column) -> Column:
    """The number after table_ in a file's name, without leading zeros."""
    return F.regexp_replace(F.nullif(F.regexp_extract(c, r"table_(\d+)", 1), F.lit("")), r"^0+(?=.)", "")


def first_number(c: Column, low: int = 4, high: int = 7) -> Column:
    """The first run of low to high digits."""
    return F.nullif(F.regexp_extract(c, rf"\d{{{low},{high}}}", 0), F.lit(""))


def species(c: Column) -> Column:
    """The species that a text names by a whole word, else the text itself, plain."""
    p = plain(c)
    return reduce(lambda rest, k: F.when(p.rlike(rf"\b{k[0]}\b"), k[1]).otherwise(rest), reversed(SPECIES), p)


def ascii_signs(c: Column) -> Column:
    """Typographic minus signs and dashes as hyphens; soft hyphens go."""
    return F.translate(c, "\u2212\u2013\u2014\u2010\u00ad", "----")


def scalar(c: Column) -> Column:
    """A number as it is printed; else the first number in the text; null for signs of a missing one."""
    t = F.trim(ascii_signs(c))
    return F.when(~F.upper(t).isin(*MISSING), F.coalesce(F.regexp_replace(t, ",", "").try_cast("double"), F.nullif(F.regexp_extract(t, r"-?\d*\.?\d+", 0), F.lit("")).try_cast("double")))


def vector(c: Column) -> Column:
    """A list of numbers, in brackets or with separators of its own; null for a single number such as 1,000."""
    t = F.trim(ascii_signs(c))
    bracketed = t.startswith("[") & t.endswith("]")
    body = F.trim(F.when(bracketed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    listed = bracketed | (~body.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$") & body.rlike(r"^[\d.\s,;/+-]+$") & body.rlike("[,;/]"))
    parts = F.transform(F.filter(F.split(body, r"[\s,;/]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    return F.when(listed & (body != "") & (F.size(parts) > 0) & F.forall(parts, lambda x: x.isNotNull()), parts)


def printed(c: Column) -> Column:
    """The numbers that a cell prints, by which it is compared: its list, its one number, else null. Of six decimals."""
    t = F.trim(ascii_signs(c))
    one = F.translate(t, ",", "")
    number = F.when(one.rlike(r"^[+-]?\d*\.?\d+$"), one.try_cast("double"))
    parts = F.transform(F.filter(F.split(t, r"[\s,;/]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    listed = t.rlike("[,;/]") & ~t.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$") & (F.size(parts) > 0) & F.forall(parts, lambda x: x.isNotNull())
    return F.when(listed, F.transform(parts, lambda x: F.round(x, 6))).when(number.isNotNull(), F.array(F.round(number, 6)))


def compound_number(c: Column) -> Column:
    """The first run of digits of a compound's name; null where it has three or fewer."""
    found = F.regexp_extract(c, r"\d+", 0)
    return F.when(F.length(found) > 3, found)


def application_key(c: Column) -> Column:
    """An application's number without white space and slashes."""
    return F.regexp_replace(c, r"[\s/]", "")


def context(sequence: Column, start: Column, size: Column, strand: Column, flank: int = 50) -> Column:
    """RNA of a site and up to `flank` bases on either side, as the strand reads; start counts from 0."""
    first = F.greatest(start - flank, F.lit(0))
    last = F.least(start + size + flank, F.length(sequence))
    own = F.substring(sequence, first + 1, last - first)
    return F.translate(F.when(strand == "-", reverse_complement(own)).otherwise(own), "T", "U")


def clean_sequence(c: Column) -> Column:
    """Bases of a printed sequence; empty for signs of a missing one."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("(?i)^(na|n/a|none|-|\u2014)?$"), "").otherwise(F.regexp_replace(F.upper(t), "[^ACGTU]", ""))


def expand_sugars(motif: Column) -> Column:
    """Letters a base of a motif such as 5-10-5 MOE; a motif that is letters already as it is; else null."""
    t = F.trim(motif)
    gapmer = r"(?i)^(\d+)\s*-\s*(\d+)\s*-\s*(\d+)\s*(MOE|cET|LNA)?$"
    part = lambda i: F.regexp_extract(t, gapmer, i)
    wing = F.when(F.lower(part(4)) == "cet", "k").when(F.lower(part(4)) == "lna", "l").otherwise("e")
    run = lambda s, i: F.repeat(s, part(i).cast("int"))
    return F.when(t.rlike("(?i)^[dekl]+$"), F.lower(t)).when(t.rlike(gapmer), F.concat(run(wing, 1), run(F.lit("d"), 2), run(wing, 3)))


def expand_links(links: Column, n: Column) -> Column:
    """Letters a link: s for phosphorothioate, o for phosphodiester; null where neither is told or there are no links."""
    t = F.trim(links)
    sign = F.when(t.rlike("(?i)^PS$|phosphorothioate"), "s").when(t.rlike("(?i)^PO$|phosphodiester"), "o")
    return F.when(t.rlike("(?i)^[so]+$"), F.lower(t)).when(n > 0, F.repeat(sign, n))


def same_value(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two printed values agree: as lists, as numbers, else as texts."""
    va, vb, na, nb = vector(a), vector(b), scalar(a), scalar(b)
    blank = lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("", "NA", "N/A", "NONE", "NULL")
    lists = (F.size(va) == F.size(vb)) & F.forall(F.zip_with(va, vb, lambda x, y: F.abs(x - y)), lambda d: d < tolerance)
    numbers = (F.abs(na - nb) < tolerance) | (F.abs(na - nb) / F.greatest(F.abs(na), F.abs(nb), F.lit(1.0)) < 1e-6)
    one = lambda v, n: (F.size(v) == 1) & n.isNotNull() & (F.abs(F.get(v, F.lit(0)) - n) < tolerance)
    return F.coalesce(
        F.when(va.isNotNull() & vb.isNotNull(), lists).when(va.isNotNull(), one(va, nb)).when(vb.isNotNull(), one(vb, na)).when(na.isNotNull() & nb.isNotNull(), numbers)
        .when(blank(a) | blank(b), blank(a) & blank(b)).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b))),
        F.lit(False),
    )


def score_list(c: Column, low: float = 0, high: float = 7) -> Column:
    """Scores in [low, high] of a text with one or, by commas, several; null where there are none."""
    found = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double")), lambda v: v.between(low, high))
    return F.when(F.size(found) > 0, found)


def dose_parts(c: Column) -> Column:
    """struct<value, unit> of a dose such as 14 mg/kg/wk."""
    return F.struct(F.nullif(F.regexp_extract(c, r"^\s*([\d.]+)", 1), F.lit("")).try_cast("double").alias("value"), F.trim(F.regexp_extract(c, r"^\s*[\d.]+\s*(.*)", 1)).alias("unit"))


def dose_nm(c: Column) -> Column:
    """A dose with a molar unit in nM."""
    units = F.create_map(*[F.lit(x) for pair in (("pm", 1e-3), ("nm", 1.0), ("um", 1e3), ("µm", 1e3), ("μm", 1e3), ("mm", 1e6)) for x in pair])
    return F.regexp_extract(c, rf"({NUMBER})\s*([pnuµμm][mM])", 1).try_cast("double") * F.element_at(units, F.lower(F.regexp_extract(c, rf"({NUMBER})\s*([pnuµμm][mM])", 2)))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def table_id(patent: Column, number: Column) -> Column:
    return F.format_string("%s_table_%05d.xml", patent, number)


def occurrences(text: Column, probe: Column) -> Column:
    """How often probe is in text, without overlaps."""
    return F.when(F.length(probe) > 0, ((F.length(text) - F.length(F.replace(text, probe, F.lit("")))) / F.length(probe)).cast("int"))


def header(c: Column) -> Column:
    """A column's printed head as a name."""
    out = F.lower(c)
    for a, b in (("%", " pct "), ("/", " per "), ("µ|μ", "u"), ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("[^a-z0-9]+", "_"), ("^_|_$", "")):
        out = F.regexp_replace(out, a, b)
    return out


def source_context(prose: Column) -> list[Column]:
    """motif, linkage, methylated and hours as prose about a table tells them; null, mixed or false where it doesn't."""
    t = F.lower(prose)
    only = t.contains("phosphorothioate") & ~t.contains("phosphodiester")
    motif = F.nullif(F.regexp_extract(t, r"\b(\d+-\d+-\d+)\b", 1), F.lit(""))
    hours = F.when(t.rlike(r"\b24[ -]?(h|hours?|hrs?)\b"), 24)
    return [motif.alias("motif"), F.when(only, "PS").otherwise("mixed").alias("linkage"), t.rlike(r"5-?\s?methyl\s?cytosine|5mec").alias("methylated"), hours.alias("hours")]
