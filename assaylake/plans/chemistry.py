"""Chemistry notation, built from part keys in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import helm as H
from ..functions import notation as N
from ..operators import joins
from .registry import Tables, query

#: A 20-mer a part: bases from its key's MD5, sugars by p_size % 5 (5-10-5 MOE, 3-14-3 cEt, 4-12-4 LNA, all DNA, 2-16-2 MOE), links by p_partkey % 3.
NOTED = """s AS (SELECT p_partkey, p_size % 5 AS kind, p_partkey % 3 AS link, translate(substr(md5(p_partkey::VARCHAR), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
u AS (SELECT p_partkey, kind, link, seq, i, substr(seq, i, 1) AS b,
 CASE WHEN kind = 0 AND (i <= 5 OR i > 15) THEN 'MOE' WHEN kind = 1 AND (i <= 3 OR i > 17) THEN 'cEt' WHEN kind = 2 AND (i <= 4 OR i > 16) THEN 'LNA' WHEN kind = 4 AND (i <= 2 OR i > 18) THEN 'MOE' ELSE 'DNA' END AS sugar,
 i < 20 AND (link = 0 OR (link = 1 AND i % 2 = 0)) AS ps FROM s, range(1, 21) r(i))"""


def noted(t: Tables):
    """p_partkey, helm: the notation that NOTED describes."""
    seq = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    kind, link = F.col("p_size") % 5, F.col("p_partkey") % 3
    sugars = F.when(kind == 0, "e" * 5 + "d" * 10 + "e" * 5).when(kind == 1, "k" * 3 + "d" * 14 + "k" * 3).when(kind == 2, "l" * 4 + "d" * 12 + "l" * 4).when(kind == 4, "ee" + "d" * 16 + "ee").otherwise("d" * 20)
    links = F.when(link == 0, "s" * 19 + "o").when(link == 1, "os" * 9 + "oo").otherwise("o" * 20)
    return joins.dealt(t.part.select("p_partkey", "p_size"), "p_partkey").select("p_partkey", H.build(seq, sugars, links).alias("helm"))


def parsed(t: Tables):
    return noted(t).withColumn("p", H.parse(F.col("helm")))


@query(f"WITH {NOTED} SELECT p_partkey, seq AS sequence, 20 AS length, string_agg(sugar, ',' ORDER BY i) AS sugars, string_agg(CASE WHEN ps THEN 'PS' ELSE 'PO' END, ',' ORDER BY i) FILTER (i < 20) AS backbones FROM u GROUP BY 1, 2")
def helm_parse(t: Tables):
    return parsed(t).select("p_partkey", "p.sequence", "p.length", F.array_join("p.sugars", ",").alias("sugars"), F.array_join("p.backbones", ",").alias("backbones"))


@query(f"WITH {NOTED} SELECT DISTINCT p_partkey, CASE kind WHEN 0 THEN 5 WHEN 4 THEN 2 ELSE 0 END AS five, CASE kind WHEN 0 THEN 10 WHEN 1 THEN 14 WHEN 2 THEN 12 WHEN 3 THEN 20 ELSE 16 END AS gap, CASE kind WHEN 0 THEN 5 WHEN 4 THEN 2 ELSE 0 END AS three, CASE link WHEN 0 THEN 19 WHEN 1 THEN 9 ELSE 0 END AS ps FROM s")
def helm_wings(t: Tables):
    return parsed(t).withColumn("w", H.wings(F.col("p"))).select("p_partkey", "w.five", "w.gap", "w.three", H.ps_count(F.col("p")).alias("ps"))


@query(f"WITH {NOTED} SELECT p_partkey, CASE WHEN kind = 3 THEN 'all_dna' ELSE '' END AS reasons, kind <> 2 AS allowed FROM s")
def helm_quality_filter(t: Tables):
    return parsed(t).select("p_partkey", H.doubts(F.col("helm"), F.col("p")).alias("reasons"), H.valid_chemistry(F.col("helm")).alias("allowed"))


@query(f"WITH {NOTED} SELECT p_partkey, count(*) FILTER (sugar='MOE')::INTEGER AS moe, count(*) FILTER (sugar='cEt')::INTEGER AS cet, count(*) FILTER (sugar='DNA')::INTEGER AS dna, count(*) FILTER (ps AND i<20)::INTEGER AS ps, count(*) FILTER (NOT ps AND i<20)::INTEGER AS po FROM u GROUP BY 1")
def chemistry_counts(t: Tables):
    c = H.chemistry_counts(F.col("p"))
    return parsed(t).select("p_partkey", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("moe", "cet", "dna", "ps", "po"))])


@query(f"WITH {NOTED} SELECT p_partkey, CASE kind WHEN 0 THEN '5-10-5 MOE gapmer' WHEN 1 THEN 'cET gapmer' WHEN 2 THEN 'LNA-containing' WHEN 4 THEN 'MOE gapmer (other wing)' ELSE 'other' END AS class FROM s")
def chemistry_class(t: Tables):
    return parsed(t).select("p_partkey", H.chemistry_class(F.col("p")).alias("class"))


@query(f"""WITH {NOTED}, f AS (SELECT p_partkey, seq, length(seq) - length(replace(seq,'A','')) AS a, length(seq) - length(replace(seq,'C','')) AS c, length(seq) - length(replace(seq,'T','')) AS t, length(seq) - length(replace(seq,'G','')) AS g, length(regexp_extract(seq, '[^G]*$')) AS r FROM s)
SELECT p_partkey, round(136.0430::DOUBLE - 3.1263::DOUBLE*a - 5.1100::DOUBLE*c - 4.7217::DOUBLE*t - 10.1264::DOUBLE*g + 1.3577::DOUBLE*(CASE WHEN r = length(seq) THEN 20 ELSE least(r, 20) END), 1) + 0 AS score FROM f""")
def seq_score(t: Tables):
    return parsed(t).select("p_partkey", H.sequence_score(F.col("p")).alias("score"))


@query(f"WITH {NOTED} SELECT p_partkey, CASE kind WHEN 0 THEN '5(MOE)-10(DNA)-5(MOE)' WHEN 1 THEN '3(cEt)-14(DNA)-3(cEt)' WHEN 2 THEN '4(LNA)-12(DNA)-4(LNA)' WHEN 3 THEN '20(DNA)' ELSE '2(MOE)-16(DNA)-2(MOE)' END AS runs FROM s")
def helm_shorthand(t: Tables):
    return parsed(t).select("p_partkey", H.shorthand(F.col("p")).alias("runs"))


@query(f"WITH {NOTED} SELECT p_partkey, p_partkey % 5 = 0 AS is_valid, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 1 END AS n_errors FROM s")
def helm_validate(t: Tables):
    """Four of five notations are broken: no ending, a bracket lost with its unit, another polymer, a unit that is none."""
    h, k = F.col("helm"), F.col("p_partkey") % 5
    broken = F.when(k == 1, F.regexp_replace(h, r"\$+$", "")).when(k == 2, F.regexp_replace(h, r"\)(?=[^)]*$)", "")).when(k == 3, F.replace(h, F.lit("RNA1"), F.lit("PEP1"))).when(k == 4, F.replace(h, F.lit("}}$$$$"), F.lit(".d(X)}}$$$$"))).otherwise(h)
    return noted(t).withColumn("v", H.validate(broken)).select("p_partkey", "v.is_valid", F.size("v.errors").alias("n_errors"))


#: What a part's notation has wrong, by p_partkey % 9, and its strict reading.
_SPOILT = """o AS (SELECT p_partkey, p_partkey % 9 AS c, substr(translate(substr(md5(p_partkey::VARCHAR), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) AS s FROM part),
x AS (SELECT *, substr(s, 1, 1) AS a, substr(s, 2, 1) AS b, substr(s, 3, 1) AS d FROM o),
y AS (SELECT p_partkey, c, CASE c WHEN 0 THEN '[moe](' || a || ')[sp].d(' || b || ').[cet](' || d || ')' WHEN 1 THEN '[moe](' || a || ')[sp].d(' || b || ').[cet](' || d || ')[sp]' WHEN 2 THEN '(' || a || ').d(' || b || ')' WHEN 3 THEN 'd().d(' || b || ')' WHEN 4 THEN '[moe](' || a || '.d(' || b || ')' WHEN 5 THEN '[moe](Z).d(' || b || ')' WHEN 6 THEN '' WHEN 7 THEN '[moe)(' || a || '].d(' || b || ')' ELSE 'd(' || a || ').d(' || b || ')' END AS body FROM x)"""


def _spoilt(t: Tables):
    s = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    a, b, d, c = *(F.substring(s, k, 1) for k in (1, 2, 3)), F.col("p_partkey") % 9
    plain = F.concat(F.lit("[moe]("), a, F.lit(")[sp].d("), b, F.lit(").[cet]("), d, F.lit(")"))
    after = F.concat(F.lit(".d("), b, F.lit(")"))
    body = (
        F.when(c == 0, plain).when(c == 1, F.concat(plain, F.lit("[sp]"))).when(c == 2, F.concat(F.lit("("), a, F.lit(")"), after)).when(c == 3, F.concat(F.lit("d()"), after)).when(c == 4, F.concat(F.lit("[moe]("), a, after))
        .when(c == 5, F.concat(F.lit("[moe](Z)"), after)).when(c == 6, "").when(c == 7, F.concat(F.lit("[moe)("), a, F.lit("]"), after)).otherwise(F.concat(F.lit("d("), a, F.lit(")"), after))
    )
    text = F.concat(F.lit("RNA1{"), body, F.when(c == 8, "}").otherwise("}$$$$"))
    return t.part.select("p_partkey", F.when(c == 0, F.concat(F.lit("CHEM1{[x]}|"), text)).otherwise(text).alias("text"))


@query(f"""WITH {_SPOILT}, z AS (SELECT p_partkey, c, CASE WHEN c = 0 THEN 'CHEM1{{[x]}}|' ELSE '' END || 'RNA1{{' || body || CASE WHEN c = 8 THEN '}}' ELSE '}}$$$$' END AS text FROM y)
SELECT p_partkey, CASE c WHEN 1 THEN 'last_link:3' WHEN 3 THEN 'base:1' WHEN 4 THEN 'base:1|round' WHEN 6 THEN 'no_units' WHEN 7 THEN 'base:1' WHEN 8 THEN 'message:' || text ELSE '' END AS errors,
CASE c WHEN 2 THEN 'sugar:1' WHEN 5 THEN 'unusual_base:1' WHEN 7 THEN 'sugar:1' ELSE '' END AS warnings, CASE c WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 6 THEN 0 WHEN 8 THEN NULL ELSE 2 END AS units, CASE WHEN c <> 8 THEN c = 0 END AS five,
CASE c WHEN 4 THEN length(text) - 4 WHEN 7 THEN 10 END AS place, CASE c WHEN 4 THEN 'crossed' WHEN 7 THEN 'crossed' END AS kind FROM z""")
def notation_check(t: Tables):
    """Errors, warnings and structure of notations, and the first bracket that doesn't nest."""
    seen = _spoilt(t).withColumn("v", N.check(F.col("text")))
    return seen.select("p_partkey", F.array_join("v.errors", "|").alias("errors"), F.array_join("v.warnings", "|").alias("warnings"), "v.structure.units", "v.structure.five", "v.nesting.place", "v.nesting.kind")


@query(f"""WITH {NOTED}, g AS (SELECT p_partkey, any_value(seq) AS sequence, string_agg(CASE sugar WHEN 'MOE' THEN 'e' WHEN 'cEt' THEN 'k' WHEN 'LNA' THEN 'l' ELSE 'd' END, '' ORDER BY i) AS sugars, string_agg(CASE WHEN ps THEN 's' ELSE 'o' END, '' ORDER BY i) FILTER (i < 20) AS links FROM u GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN sequence END AS sequence, CASE WHEN p_partkey % 7 <> 0 THEN sugars END AS sugars, CASE WHEN p_partkey % 7 <> 0 THEN links END AS links, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 2 = 0 AND contains(sequence, 'C') END AS methyl, p_partkey % 7 <> 0 AS same FROM g""")
def strict_round_trip(t: Tables):
    """Notations read strictly and built again; one with a unit that can't be read is not read at all."""
    own = noted(t).withColumn("text", F.when(F.col("p_partkey") % 7 == 0, F.regexp_replace("helm", r"\}\}", ".?}}")).when(F.col("p_partkey") % 2 == 0, F.replace(F.col("helm"), F.lit("(C)"), F.lit("([5meC])"))).otherwise(F.col("helm")))
    read = own.withColumn("r", N.read_strict(F.col("text")))
    again = N.build_strict(F.col("r.sequence"), F.col("r.sugars"), F.col("r.links"), F.col("r.methyl"))
    same = (again == F.col("text")) & (N.without_methyl(again) == F.col("helm"))
    return read.select("p_partkey", "r.sequence", "r.sugars", "r.links", "r.methyl", F.coalesce(same, F.lit(False)).alias("same"))
