"""Names, printed numbers and motifs: spellings are dealt to rows by their keys, and what they stand for is written out beside them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cell_lines as C
from ..functions import helm as H
from ..functions import text as X
from .chemistry import NOTED, parsed
from .registry import Tables, query


def _sql(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _dealt(t: Tables, values: list[str | None], name: str):
    """Parts with one of some texts each, by key."""
    texts = F.array(*[F.lit(v).cast("string") for v in values])
    return t.part.select("p_partkey", F.get(texts, (F.col("p_partkey") % len(values)).cast("int")).alias(name))


def _oracle(*columns: tuple[str, list]) -> str:
    return "SELECT p_partkey, " + ", ".join(f"{_sql(v)}[p_partkey % {len(v)} + 1] AS {n}" for n, v in columns) + " FROM part"


CELLS = ["HepG2", "primary mouse hepatocytes", "iCell neurons", "GM04281", "vero C1008", "HeLa", "human IPS cell", "xGM04281", "HEK293", "hek 293 (SORT1)", "F09-152", "Huvec", "MCF7", None, "4t1"]


@query(_oracle(("cell", CELLS), ("is_primary", [False, True, True, True, True, False, True, False, False, True, True, True, False, False, True])))
def primary_cells(t: Tables):
    return _dealt(t, CELLS, "cell").withColumn("is_primary", C.is_primary(F.col("cell")))


SPELLED = ["hep g2", "A–431", " T_24 ", "Ts 24", "unknown line ", "A459", "mouse primary hepatocyte cells", "T-24", "SHSY5Y", "cd4 tcells", None, "HUH-7", "hepb3", "iCell cardiomyocytes2"]


@query(_oracle(("cell", SPELLED), ("in_vitro", ["HepG2", "A431", "T24", "T24", "unknown line ", "A549", "mouse primary hepatocytes", "T24", "SH-SY5Y", "cd4 tcells", None, "Huh7", "Hep3B", "iCell cardiomyocytes"]),
               ("dose_response", ["HepG2", "A–431", "T_24", "Ts 24", "unknown line", "A459", "mouse primary hepatocyte cells", "T-24", "SH-SY5Y", "CD4 T-cells", None, "Huh7", "Hep3B", "iCell cardiomyocytes2"])))
def cell_aliases(t: Tables):
    return _dealt(t, SPELLED, "cell").withColumn("in_vitro", C.in_vitro(F.col("cell"))).withColumn("dose_response", C.dose_response(F.col("cell")))


@query("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) > 3 THEN p_partkey::VARCHAR END AS number, CASE WHEN p_partkey % 4 = 0 THEN 'US20040220395A1' ELSE 'US' || p_partkey || 'B2' END AS application FROM part")
def compound_numbers(t: Tables):
    name = F.concat(F.lit("ISIS No. "), F.col("p_partkey").cast("string"), F.lit(" (SEQ 12345)"))
    key = F.when(F.col("p_partkey") % 4 == 0, "US 2004/0220395 A1").otherwise(F.concat(F.lit("US "), F.col("p_partkey").cast("string"), F.lit("\tB2")))
    return t.part.select("p_partkey", X.compound_number(name).alias("number"), X.application_key(key).alias("application"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [c_acctbal] WHEN 1 THEN [c_acctbal] WHEN 2 THEN [c_acctbal, 5.0::DOUBLE, -1.25::DOUBLE] END::VARCHAR AS printed FROM customer""")
def printed_values(t: Tables):
    plain = F.format_number("c_acctbal", 2)
    cell = F.when(F.col("c_custkey") % 4 == 0, F.translate(plain, "-", "−")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" "), F.col("c_acctbal").cast("string")))
    cell = cell.when(F.col("c_custkey") % 4 == 2, F.concat(F.translate(F.round("c_acctbal", 2).cast("string"), "-", "–"), F.lit(", 5; −1.25"))).otherwise("n/d")
    # As the other engine prints a list.
    shown = lambda v: F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]")))
    return t.customer.select("c_custkey", shown(X.printed(cell)).alias("printed"))


SITE = "SELECT p_partkey, translate(md5(p_partkey::VARCHAR) || md5((p_partkey + 1)::VARCHAR) || md5((p_partkey + 2)::VARCHAR) || md5((p_partkey + 3)::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s, (p_partkey % 110)::INTEGER AS site, p_partkey % 2 = 0 AS back FROM part"


@query(f"""WITH x AS ({SITE}), w AS (SELECT p_partkey, back, substr(s, greatest(site - 50, 0) + 1, least(site + 70, 128) - greatest(site - 50, 0)) AS own FROM x)
SELECT p_partkey, translate(CASE WHEN back THEN reverse(translate(own, 'ACGT', 'TGCA')) ELSE own END, 'T', 'U') AS context FROM w""")
def context_window(t: Tables):
    md = lambda k: F.md5((F.col("p_partkey") + k).cast("string"))
    s = F.translate(F.concat(md(0), md(1), md(2), md(3)), "0123456789abcdef", "ACGTACGTACGTACGT")
    at, strand = (F.col("p_partkey") % 110).cast("int"), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("+")
    return t.part.select("p_partkey", X.context(s, at, F.lit(20), strand).alias("context"))


MOTIFS = ["5-10-5 MOE", "3 - 14 - 3 cET", "eeedddeee", "2-16-2", "4-8-4 lna", "mixed", None, "EEKDD"]
LINKS = ["PS", "soos", "phosphorothioate", "po", "Phosphodiester bonds", "unknown", None, "SSO"]
SEQS = ["acg tU", "N/A", "5'-ACGT-3'", "—", None, "none", "GGXNCC", "  "]


@query(_oracle(("sugars", ["e" * 5 + "d" * 10 + "e" * 5, "k" * 3 + "d" * 14 + "k" * 3, "eeedddeee", "ee" + "d" * 16 + "ee", "l" * 4 + "d" * 8 + "l" * 4, None, None, "eekdd"]), ("links", ["s" * 6, "soos", "s" * 6, "o" * 6, "o" * 6, None, None, "sso"]), ("bases", ["ACGTU", "", "ACGT", "", "", "", "GGCC", ""])))
def motif_expansion(t: Tables):
    own = _dealt(t, MOTIFS, "motif").join(_dealt(t, LINKS, "link"), "p_partkey").join(_dealt(t, SEQS, "seq"), "p_partkey")
    return own.select("p_partkey", X.expand_sugars(F.col("motif")).alias("sugars"), X.expand_links(F.col("link"), F.lit(6)).alias("links"), X.clean_sequence(F.col("seq")).alias("bases"))


@query(f"WITH {NOTED} SELECT p_partkey, kind <> 2 AS allowed FROM s")
def sugar_subset(t: Tables):
    return parsed(t).select("p_partkey", H.only_sugars(F.col("p"), ["MOE", "DNA", "cEt"]).alias("allowed"))


@query(f"""WITH {NOTED}, o AS (SELECT p_partkey, min(kind) AS kind, min(seq) AS seq, string_agg(CASE WHEN i < 20 THEN CASE WHEN ps THEN 's' ELSE 'o' END END, '' ORDER BY i) AS links, string_agg(sugar[1], '' ORDER BY i) AS sugars FROM u GROUP BY 1)
SELECT p_partkey, kind, place, b FROM (SELECT p_partkey, 'base' AS kind, (i - 1) * 6 + position(b IN 'ACGT')::BIGINT - 1 AS place, 1.0::DOUBLE AS b FROM u
UNION ALL SELECT p_partkey, 'sugar', (i - 1) * 7 + CASE sugar WHEN 'MOE' THEN 0 WHEN 'DNA' THEN 1 WHEN 'LNA' THEN 2 ELSE 3 END, 1.0 FROM u
UNION ALL SELECT p_partkey, 'link', (i - 1) * 2 + CASE WHEN ps THEN 0 ELSE 1 END, 1.0 FROM u WHERE i < 20
UNION ALL SELECT p_partkey, 'pair', (position(x.b IN 'ACGT') - 1) * 6 + position(y.b IN 'ACGT') - 1, round(count(*) / 19.0::DOUBLE, 6) FROM u x JOIN (SELECT p_partkey, i - 1 AS i, b FROM u) y USING (p_partkey, i) GROUP BY ALL
UNION ALL SELECT p_partkey, 'length', 0, 20.0 FROM s)""")
def notation_features(t: Tables):
    parts = {"base": (0, 180), "sugar": (180, 210), "link": (390, 58), "pair": (448, 36), "length": (484, 1)}
    own = parsed(t).select("p_partkey", F.posexplode(H.features(F.col("p"))).alias("at", "b")).where("b <> 0")
    kind, place = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, (first, n) in parts.items():
        mine = F.col("at").between(first, first + n - 1)
        kind, place = F.when(mine, name).otherwise(kind), F.when(mine, F.col("at") - first).otherwise(place)
    return own.select("p_partkey", kind.alias("kind"), place.cast("long").alias("place"), F.round("b", 6).alias("b"))


ODD = ["RNA1{{[moe](G)[sp].d([5meC])[sp].(A)}}$$$$", "RNA1{{d(A).d(T)}}$$$$", "RNA1{{[lna](g)}}$$$$", "no notation", None, "RNA1{{}}$$$$", "RNA1{{[moe](G}}$$$$", "RNA1{{?}}$$$$", "RNA1{d(A)}$$$$", "PEP{{d(A)}}$$$", "RNA1{{(U)p.r(A)}}$$$$"]


@query(_oracle(("sequence", ["GCA", "AT", "G", None, None, None, None, None, None, "A", None]), ("sugars", ["MOE,DNA,RNA", "DNA,DNA", "LNA", None, None, None, None, None, None, "DNA", None]), ("backbones", ["PS,PS", "PO", "", None, None, None, None, None, None, "", None]),
               ("errors", ["", "", "units", "ending|polymer|units", None, "units", "round_brackets|units", "units", "units", "ending|polymer", ""]), ("braces", ["RNA1{[moe](G)[sp].d([5meC])[sp].(A)}$$$$", "RNA1{d(A).d(T)}$$$$", "RNA1{[lna](g)}$$$$", "no notation", None, "RNA1{}$$$$", "RNA1{[moe](G}$$$$", "RNA1{?}$$$$", "RNA1{d(A)}$$$$", "PEP{d(A)}}$$$", "RNA1{(U)p.r(A)}$$$$"])))
def odd_notation(t: Tables):
    p = H.parse(F.col("helm"))
    own = _dealt(t, ODD, "helm").withColumn("p", p).withColumn("v", H.validate(F.col("helm")))
    return own.select("p_partkey", "p.sequence", F.array_join("p.sugars", ",").alias("sugars"), F.array_join("p.backbones", ",").alias("backbones"), F.array_join("v.errors", "|").alias("errors"), H.single_braces(F.col("helm")).alias("braces"))


@query(f"""WITH {NOTED}, g AS (SELECT p_partkey // 3 AS compound, p_partkey, seq, kind, link FROM s), r AS (SELECT compound, min(p_partkey) AS k FROM g GROUP BY 1), z AS (SELECT g.compound, g.seq = a.seq AS q, g.kind = a.kind OR (g.kind IN (3) AND a.kind IN (3)) AS u, g.link = a.link AS l FROM g JOIN r USING (compound) JOIN g a ON a.p_partkey = r.k)
SELECT compound, bool_and(q) AS strict_sequence, bool_or(q) AS best_sequence, bool_and(u) AS strict_sugars, bool_or(u) AS best_sugars, bool_and(l) AS strict_links, bool_or(l) AS best_links FROM z GROUP BY 1""")
def notation_agreement(t: Tables):
    parts = parsed(t).select(F.floor(F.col("p_partkey") / 3).alias("compound"), "p_partkey", F.struct(*[F.col(f"p.{c}").alias(c) for c in ("sequence", "sugars", "backbones")]).alias("p"))
    gold = F.first("p").over(Window.partitionBy("compound").orderBy("p_partkey"))
    return H.agreement(parts.withColumn("gold", gold), "compound", "gold", "p")
