"""Names, doses, score lists, look-ups and printed grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as S
from ..operators import audit, joins
from .registry import Tables, query


@query("SELECT p_partkey, translate(upper(p_name), '- .:/(),_', '') AS key, trim(regexp_replace(trim(lower(p_name)), '[\\s_\\-/]+', ' ', 'g')) AS plain FROM part")
def name_normalise(t: Tables):
    return t.part.select("p_partkey", S.name_key(F.col("p_name")).alias("key"), S.plain(F.col("p_name")).alias("plain"))


@query("SELECT p_partkey, regexp_matches(p_type, '(?i)(brass|steel.*|^eco.*tin$)') AS primary_like FROM part")
def primary_classifier(t: Tables):
    return t.part.select("p_partkey", S.matches_any(F.col("p_type"), ["brass", "steel.*", "^eco.*tin$"]).alias("primary_like"))


PREFIX = """a AS (SELECT DISTINCT substr(replace(replace(upper(p_name),' ',''),'#',''), 1, 3 + CAST(p_partkey % 6 AS INTEGER)) AS k FROM part),
b AS (SELECT DISTINCT replace(replace(upper(p_name),' ',''),'#','') AS key FROM part)"""


def _prefixes(t: Tables):
    whole = F.replace(F.replace(F.upper("p_name"), F.lit(" "), F.lit("")), F.lit("#"), F.lit(""))
    a = t.part.select(F.substring(whole, F.lit(1), (F.lit(3) + F.col("p_partkey") % 6).cast("int")).alias("k")).distinct()
    return a, t.part.select(whole.alias("key")).distinct()


@query(f"WITH {PREFIX} SELECT k, min(key) AS key FROM a JOIN b ON starts_with(key, k) AND length(k) >= 3 GROUP BY k HAVING count(*) = 1")
def prefix_unique_join(t: Tables):
    a, b = _prefixes(t)
    return joins.unique_prefix(a, "k", b, "key")


@query(f"""WITH {PREFIX}, m AS (SELECT k, CASE WHEN length(k) = 5 THEN '' ELSE k || 'X' END AS mapped FROM a WHERE length(k) IN (5, 6)),
u AS (SELECT k, min(key) AS key FROM a JOIN b ON starts_with(key, k) AND length(k) >= 3 GROUP BY k HAVING count(*) = 1)
SELECT a.k, CASE WHEN m.k IS NOT NULL THEN CASE WHEN m.mapped <> '' THEN e.key END WHEN a.k LIKE '%Q%' THEN NULL WHEN e.key IS NOT NULL THEN e.key ELSE u.key END AS match,
CASE WHEN a.k LIKE '%Q%' THEN 'primary' WHEN m.k IS NOT NULL THEN 'manual' WHEN e.key IS NOT NULL THEN 'exact' WHEN u.key IS NOT NULL THEN 'prefix' ELSE 'unmapped' END AS source
FROM a LEFT JOIN m ON m.k = a.k LEFT JOIN b e ON e.key = coalesce(nullif(m.mapped, ''), a.k) LEFT JOIN u ON u.k = a.k""")
def lookup_cascade(t: Tables):
    a, b = _prefixes(t)
    manual = a.where(F.length("k").isin(5, 6)).select("k", F.when(F.length("k") == 5, "").otherwise(F.concat("k", F.lit("X"))).alias("mapped"))
    return joins.lookup_cascade(a.select("k", F.col("k").alias("norm")), "k", "norm", manual, b, F.col("k").contains("Q"))


DOSE = "format('{} mg/kg{}', p_size, CASE WHEN p_partkey % 2 = 0 THEN '/wk' ELSE '' END)"


def _dosed(t: Tables):
    dose = F.concat(F.col("p_size").cast("string"), F.lit(" mg/kg"), F.when(F.col("p_partkey") % 2 == 0, "/wk").otherwise(""))
    doses = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 3).cast("double"))
    return t.part.select("p_partkey", S.dose_parts(dose).alias("d"), doses.alias("doses"))


@query(f"SELECT p_partkey, regexp_extract({DOSE}, '^\\s*([\\d.]+)', 1)::DOUBLE AS value, trim(regexp_extract({DOSE}, '^\\s*[\\d.]+\\s*(.*)', 1)) AS unit FROM part")
def dose_split(t: Tables):
    return _dosed(t).select("p_partkey", "d.value", "d.unit")


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN p_size::DOUBLE * 14 / 7 / (p_partkey % 3) ELSE p_size::DOUBLE END, 6) AS dose FROM part""")
def dose_weekly_convert(t: Tables):
    return _dosed(t).select("p_partkey", F.round(N.per_dose(F.col("d.value"), F.col("d.unit"), F.col("doses"), F.lit(14.0)), 6).alias("dose"))


@query("""SELECT user_id, count(*) AS n, round(avg(s), 6) AS mean FROM (SELECT user_id, list_avg(list_filter([round(value) % 10, round(value) % 7], lambda v: v BETWEEN 0 AND 7)) AS s FROM events) WHERE s IS NOT NULL GROUP BY 1""")
def fob_parse(t: Tables):
    digits = lambda m: (F.round("value") % m).cast("int").cast("string")
    scores = S.score_list(F.concat_ws(", ", digits(10), digits(7)))
    rows = t.events.select("user_id", N.array_mean(scores).alias("s")).where("s IS NOT NULL")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 50000 AND 150000 THEN o_totalprice END AS kept FROM orders")
def range_null(t: Tables):
    return t.orders.select("o_orderkey", N.within(F.col("o_totalprice"), 50000, 150000).alias("kept"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 1000.0 * p_size WHEN 2 THEN NULL ELSE -p_size::DOUBLE END AS value FROM part""")
def scalar_parse(t: Tables):
    size = F.col("p_size").cast("string")
    c = F.col("p_partkey") % 4
    text = F.when(c == 0, F.concat(F.lit(" "), size)).when(c == 1, F.concat(size, F.lit(",000"))).when(c == 2, F.lit("n/a")).otherwise(F.concat(F.lit("about -"), size, F.lit(" nM")))
    return t.part.select("p_partkey", S.scalar(text).alias("value"))


@query("SELECT p_partkey, CAST(p_partkey % 50 <> 0 AS BOOLEAN) AS same FROM part")
def value_agreement(t: Tables):
    a = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(". 7. 5.]"))
    b = F.concat((F.col("p_size") + F.when(F.col("p_partkey") % 50 == 0, 1).otherwise(0)).cast("string"), F.lit(", 7, 5"))
    return t.part.select("p_partkey", S.same_value(a, b).alias("same"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'uninformative' WHEN 1 THEN 'correct' WHEN 2 THEN 'unflipped' ELSE 'other' END AS orientation FROM orders")
def percent_control_flip(t: Tables):
    c = F.col("o_orderkey") % 4
    printed = F.when(c == 0, 50.0).otherwise(30.0)
    found = F.when(c == 0, 50.0).when(c == 1, 70.0).when(c == 2, 30.0).otherwise(45.0)
    return t.orders.select("o_orderkey", N.orientation(found, printed).alias("orientation"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN -2 WHEN 2 THEN 1 END AS power FROM orders")
def pow10_errors(t: Tables):
    c, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    return t.orders.select("o_orderkey", N.power_of_ten(F.when(c == 0, price * 1000).when(c == 1, price / 100).when(c == 2, price * 10).otherwise(price), price).alias("power"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'times_1000' ELSE 'by_1000' END AS scale FROM orders")
def dose_scale_errors(t: Tables):
    c, price = F.col("o_orderkey") % 3, F.col("o_totalprice")
    return t.orders.select("o_orderkey", N.dose_scale(F.when(c == 0, price).when(c == 1, price * 1000).otherwise(price / 1000), price).alias("scale"))


@query("""SELECT p_partkey, translate(reverse(translate(s, 'ACGT', '1234')), '1234', 'TGCA') AS probe, (length(s) - length(replace(s, substr(s, 1, 2), ''))) // 2 AS n
FROM (SELECT p_partkey, translate(substr(md5(p_partkey::VARCHAR), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part)""")
def probe_occurrences(t: Tables):
    s = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    return t.part.select("p_partkey", S.reverse_complement(s).alias("probe"), S.occurrences(s, F.substring(s, 1, 2)).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, column_, value FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, unnest(['quantity','discount','tax']) AS column_, unnest([100 - l_quantity, 100 - l_discount, 100 - l_tax]) AS value FROM lineitem) WHERE value > 60""")
def grid_unpivot(t: Tables):
    cells = F.array(*[F.struct(F.lit(c).alias("column_"), (100 - F.col(f"l_{c}")).alias("value")) for c in ("quantity", "discount", "tax")])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.inline(cells)).where("value > 60")


@query("""WITH p AS (SELECT l_suppkey k, l_quantity v, count(*) a FROM lineitem WHERE l_returnflag='A' GROUP BY 1,2), c AS (SELECT l_suppkey k, l_quantity v, count(*) b FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2)
SELECT k AS l_suppkey, CAST(sum(coalesce(a,0)) AS BIGINT) AS n_printed, CAST(sum(coalesce(b,0)) AS BIGINT) AS n_claimed, CAST(sum(least(coalesce(a,0), coalesce(b,0))) AS BIGINT) AS n_found FROM p FULL JOIN c USING (k, v) GROUP BY 1""")
def grid_completeness(t: Tables):
    part = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_suppkey", "l_quantity")
    return audit.consumed(part("A"), part("R"), ["l_suppkey"], "l_quantity")


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'too_few' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'unexplained' END AS rule FROM lineitem) GROUP BY 1""")
def rule_attribution(t: Tables):
    rule = audit.first_rule([("too_few", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R")])
    return t.lineitem.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'mixed: ' || string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) ELSE min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY 1""")
def class_labels(t: Tables):
    return audit.label_classes(t.orders, "o_custkey", "o_orderstatus")


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_identity(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sha256(string_agg(text, '|||' ORDER BY turn)) AS key FROM conversations GROUP BY 1""")
def cache_keys(t: Tables):
    own = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return own.select("conv_id", "turns", F.array_join("x.role", ">").alias("roles"), F.sha2(F.array_join("x.text", "|||"), 256).alias("key"))
