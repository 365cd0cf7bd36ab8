"""Review of what was extracted: reasons, maps, ledgers, lineage, agreement and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, dedup, graph, review
from .registry import Tables, query

FLAWS = "concat_ws('|', CASE WHEN l_quantity < 10 THEN 'few' END, CASE WHEN l_discount > 0.06 THEN 'discount' END, CASE WHEN l_tax > 0.05 THEN 'tax' END)"


@query(f"""WITH x AS (SELECT l_returnflag, l_linestatus, {FLAWS} AS f FROM lineitem), e AS (SELECT l_returnflag, l_linestatus, unnest(string_split(CASE WHEN f = '' THEN 'none' ELSE f END, '|')) AS reason FROM x), c AS (SELECT *, count(*) AS n FROM e GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, reason) AS place FROM c) WHERE place <= 3""")
def omission_modes(t: Tables):
    return review.top_reasons(t.lineitem.withColumn("f", F.expr(FLAWS)), ["l_returnflag", "l_linestatus"], "f")


@query("""WITH e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS target FROM documents), n AS (SELECT doc_id, doc_id - doc_id % 10 AS far FROM documents WHERE doc_id % 3 = 0) SELECT e.doc_id, coalesce(n.far, e.target) AS target FROM e LEFT JOIN n ON n.doc_id = e.target""")
def compose_canonical(t: Tables):
    own = t.documents.select("doc_id", F.md5("text").alias("h"))
    exact = own.join(own.groupBy("h").agg(F.min("doc_id").alias("target")), "h").select("doc_id", "target")
    near = t.documents.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") - F.col("doc_id") % 10).alias("target"))
    return review.composed(exact, near, "doc_id", "target")


@query("""WITH m AS (SELECT c_custkey AS item, c_custkey // 5 AS component, c_mktsegment AS family FROM customer) SELECT component, count(*) AS n, CASE WHEN count(DISTINCT family) > 1 THEN 'mixed: ' || string_agg(DISTINCT family, ' | ' ORDER BY family) ELSE min(family) END AS family FROM m GROUP BY 1""")
def mixed_components(t: Tables):
    """Customers in rows of five, each linked to the next; the component's least key by five is the row."""
    c = t.customer
    edges = c.where("c_custkey % 5 < 4").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 1).alias("v")).join(c.select(F.col("c_custkey").alias("v")), "v", "left_semi")
    found = graph.components(c.select(F.col("c_custkey").alias("item")), edges, "item", "u", "v").join(c.select(F.col("c_custkey").alias("item"), "c_mktsegment"), "item")
    rows = found.select(F.floor(F.col("component") / 5).alias("component"), F.col("c_mktsegment").alias("family"))
    return audit.label_classes(rows, "component", "family").join(rows.groupBy("component").agg(F.count("*").alias("n")), "component")


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber = min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey) AS is_first FROM lineitem")
def first_seen(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return review.first_seen(rows, ["l_suppkey", "l_partkey"], "at").drop("at")


@query("""WITH a AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text) HAVING count(*) = 1) SELECT doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id + 1 FROM labels WHERE toxic = 1)""")
def isolation_proof(t: Tables):
    links = t.labels.where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return review.isolated(t.documents.withColumn("h", F.md5("text")), "doc_id", "h", links, "a", "b")


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT coalesce(a.l_suppkey, r.l_suppkey) AS l_suppkey, count(*) FILTER (r.l_partkey IS NULL) AS only_left, count(*) FILTER (a.l_partkey IS NULL) AS only_right FROM a FULL JOIN r USING (l_suppkey, l_partkey) GROUP BY 1) SELECT * FROM f WHERE only_left > 0 OR only_right > 0""")
def nested_set_differences(t: Tables):
    return review.set_differences(t.lineitem.where("l_returnflag = 'A'"), t.lineitem.where("l_returnflag = 'R'"), "l_suppkey", "l_partkey")


@query("""WITH f AS (SELECT l_suppkey AS item, count(*) FILTER (l_quantity < 5) AS missed_found, count(*) FILTER (l_quantity > 48) AS invented_found FROM lineitem WHERE l_quantity < 5 OR l_quantity > 48 GROUP BY 1),
g AS (SELECT l_suppkey AS item, sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) AS missed_told, sum(CASE WHEN l_quantity > 48 AND l_linenumber < 6 THEN 1 ELSE 0 END) AS invented_told FROM lineitem WHERE l_quantity < 5 OR (l_quantity > 48 AND l_linenumber < 6) GROUP BY 1)
SELECT item, coalesce(missed_found, 0) AS missed_found, coalesce(invented_found, 0) AS invented_found, coalesce(missed_told, 0)::BIGINT AS missed_told, coalesce(invented_told, 0)::BIGINT AS invented_told, coalesce(missed_found, 0) = coalesce(missed_told, 0) AND coalesce(invented_found, 0) = coalesce(invented_told, 0) AS agrees FROM f FULL JOIN g USING (item)""")
def adjudication(t: Tables):
    kind = F.when(F.col("l_quantity") < 5, "missed").when(F.col("l_quantity") > 48, "invented")
    found = t.lineitem.select(F.col("l_suppkey").alias("item"), kind.alias("kind"), "l_linenumber").where("kind IS NOT NULL")
    ledger = found.where("kind = 'missed' OR l_linenumber < 6").groupBy("item", "kind").agg(F.count("*").alias("n"))
    return review.reconciled(found, ledger, "item", ["missed", "invented"])


@query("""SELECT l_returnflag || l_linenumber AS k, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT l_returnflag, l_linenumber, sha256(concat_ws(chr(31), l_orderkey, l_partkey, l_linestatus)) AS h FROM lineitem) GROUP BY 1""")
def frozen_evidence(t: Tables):
    rows = t.lineitem.withColumn("k", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    return review.evidence(rows, "k", ["l_orderkey", "l_partkey", "l_linestatus"])


@query("""WITH j AS (SELECT CASE WHEN l_orderkey % 5 > 0 THEN l_returnflag END AS a1, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'N' END END AS b1, l_linestatus AS a2, nullif(o_orderstatus, 'P') AS b2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT 'flag' AS field, count(*) FILTER (a1 IS NOT NULL AND b1 IS NOT NULL) AS n_both, count(*) FILTER (a1 = b1) AS n_same, count(*) FILTER (a1 IS NOT NULL AND b1 IS NULL) AS only_left, count(*) FILTER (a1 IS NULL AND b1 IS NOT NULL) AS only_right FROM j
UNION ALL SELECT 'status', count(*) FILTER (a2 IS NOT NULL AND b2 IS NOT NULL), count(*) FILTER (a2 = b2), count(*) FILTER (a2 IS NOT NULL AND b2 IS NULL), count(*) FILTER (a2 IS NULL AND b2 IS NOT NULL) FROM j""")
def field_agreement(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.when(F.col("o_orderkey") % 7 > 0, F.when(F.col("o_orderstatus") == "F", "A").otherwise("N"))
    return review.field_agreement(j, [("flag", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_returnflag")), flag), ("status", F.col("l_linestatus"), F.nullif(F.col("o_orderstatus"), F.lit("P")))])


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS c, l_quantity AS arm FROM lineitem), f AS (SELECT DISTINCT k, CASE WHEN k % 3 = 0 THEN 8 - c ELSE c END AS c, CASE WHEN k % 5 = 0 AND c = 1 THEN arm + 100 ELSE arm END AS arm FROM g WHERE NOT (k % 7 = 0 AND c = 2)),
m AS (SELECT k, count(*) AS missing FROM (SELECT DISTINCT k, arm FROM g EXCEPT SELECT DISTINCT k, arm FROM f) GROUP BY 1), i AS (SELECT k, count(*) AS invented FROM (SELECT DISTINCT k, arm FROM f EXCEPT SELECT DISTINCT k, arm FROM g) GROUP BY 1), x AS (SELECT DISTINCT k FROM (SELECT k, c, arm FROM g EXCEPT SELECT k, c, arm FROM f)), a AS (SELECT DISTINCT k FROM g)
SELECT a.k, coalesce(missing, 0) AS missing, coalesce(invented, 0) AS invented, missing IS NULL AND invented IS NULL AND x.k IS NOT NULL AS transposed FROM a LEFT JOIN m ON m.k = a.k LEFT JOIN i ON i.k = a.k LEFT JOIN x ON x.k = a.k""")
def arm_gaps(t: Tables):
    gold = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("arm")).distinct()
    arm = F.when((F.col("k") % 5 == 0) & (F.col("c") == 1), F.col("arm") + 100).otherwise(F.col("arm"))
    found = gold.where(~((F.col("k") % 7 == 0) & (F.col("c") == 2))).select("k", F.when(F.col("k") % 3 == 0, 8 - F.col("c")).otherwise(F.col("c")).alias("c"), arm.alias("arm"))
    return review.arm_gaps(gold, found, "k", "arm", "c")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) FILTER (l_quantity > 5) / count(*)::DOUBLE, 6) AS filter_recall, round(count(*) FILTER (l_quantity > 5 AND l_tax < 0.08) / count(*) FILTER (l_quantity > 5)::DOUBLE, 6) AS extraction_recall, round(count(*) FILTER (l_quantity > 5 AND l_tax < 0.08) / count(*)::DOUBLE, 6) AS recall FROM lineitem GROUP BY 1, 2""")
def recall_split(t: Tables):
    return review.recall_split(t.lineitem, ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 5, F.col("l_tax") < 0.08)


@query("""WITH v AS (SELECT l_partkey AS g, l_linenumber AS ch, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2), s AS (SELECT DISTINCT l_partkey AS g, l_suppkey AS src FROM lineitem), c AS (SELECT DISTINCT l_partkey AS g, l_linenumber AS ch, l_suppkey AS src FROM lineitem WHERE l_linenumber <= 2 AND l_discount > 0.05)
SELECT s.src, v.ch, v.value FROM v JOIN s USING (g) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.g = v.g AND c.ch = v.ch) OR EXISTS (SELECT 1 FROM c WHERE c.g = v.g AND c.ch = v.ch AND c.src = s.src)""")
def lifted_values(t: Tables):
    li = t.lineitem.select(F.col("l_partkey").alias("g"), F.col("l_linenumber").alias("ch"), F.col("l_suppkey").alias("src"), "l_quantity", "l_discount")
    release = li.groupBy("g", "ch").agg(F.max("l_quantity").alias("value"))
    return review.lifted(release, li.select("g", "src"), li.where("ch <= 2 AND l_discount > 0.05"), "g", "src", "ch", "value")


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_quantity < 8 THEN 'absent' WHEN l_quantity < 16 THEN 'partial' ELSE 'present' END AS s FROM lineitem) SELECT l_orderkey, CASE WHEN bool_and(s = 'absent') THEN 'absent' WHEN bool_or(s = 'absent') THEN 'mixed' WHEN bool_or(s = 'partial') THEN 'partial' ELSE 'equivalent' END AS relationship FROM x GROUP BY 1""")
def class_relationship(t: Tables):
    state = F.when(F.col("l_quantity") < 8, "absent").when(F.col("l_quantity") < 16, "partial").otherwise("present")
    return review.relationship(t.lineitem.withColumn("s", state), "l_orderkey", "s")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN (c_custkey + 10000)::VARCHAR WHEN 1 THEN 'saline' WHEN 2 THEN '54321' WHEN 3 THEN NULL ELSE 'utc' END AS id FROM customer")
def row_identifiers(t: Tables):
    k = F.col("c_custkey")
    own = (k + 10000).cast("string")
    cells = F.when(k % 5 == 0, F.array(F.lit("row 12"), F.concat(F.lit("ISIS "), own), F.lit("54321"))).when(k % 5 == 1, F.array(F.lit("9999999"), F.lit("Saline, 3 doses"))).when(k % 5 == 2, F.array(F.lit("PBS"), F.lit("No. 54321")))
    cells = cells.when(k % 5 == 3, F.array(F.lit("12345678"), F.lit("phosphate"))).otherwise(F.array(F.lit("—"), F.lit("UTC")))
    return t.customer.select("c_custkey", review.row_identifier(cells, F.array(own, F.lit("54321")), X.CONTROLS).alias("id"))


@query("""WITH x AS (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) = doc_id AS f, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) SELECT CASE WHEN n_chars < 50 THEN 'failed' WHEN NOT f THEN 'exact' WHEN doc_id % 6 = 0 AND n = 1 THEN 'false_similarity' ELSE 'self' END AS category, count(*) AS n FROM x GROUP BY 1""")
def provenance_categories(t: Tables):
    own = t.documents.select("doc_id", "n_chars", F.md5("text").alias("h"))
    return review.provenance(own, "doc_id", "h", F.col("doc_id") % 6 == 0, F.col("n_chars") >= 50).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, count(*) AS n, CASE WHEN count(DISTINCT l_linenumber) >= 3 THEN 'dose-series' ELSE 'single-dose' END AS format, count(DISTINCT l_returnflag || l_linestatus) AS n_contexts, count(DISTINCT l_returnflag || l_linestatus) > 1 AS multi_column, l_suppkey % 3 = 0 AS pct_control, l_suppkey % 3 = 1 AS dose_unit FROM lineitem GROUP BY l_suppkey""")
def table_strata(t: Tables):
    caption = F.when(F.col("l_suppkey") % 3 == 0, "mRNA levels as % UTC").when(F.col("l_suppkey") % 3 == 1, "Doses of 0.5 μM and 2 µM").otherwise("percent inhibition")
    return audit.table_strata(t.lineitem.withColumn("caption", caption), "l_suppkey", "l_linenumber", ["l_returnflag", "l_linestatus"], "caption")


@query("""WITH f AS (SELECT l_orderkey % 5 AS fold, l_orderkey * 10 + l_linenumber AS row, l_quantity AS y FROM lineitem), n AS (SELECT (l_orderkey + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END) % 5 AS fold, l_orderkey * 10 + l_linenumber AS row, l_quantity + CASE WHEN l_linenumber = 7 THEN 0.5 ELSE 0 END AS y FROM lineitem WHERE l_orderkey % 90 <> 7)
SELECT fold, count(*) AS n, count(*) FILTER (n.y IS NULL) AS n_missing, count(*) FILTER (f.y IS NULL) AS n_extra, count(*) FILTER (abs(f.y - n.y) > 1e-6) AS n_off FROM f FULL JOIN n USING (fold, row) GROUP BY 1""")
def fold_replay(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_quantity").alias("y"))
    frozen = li.withColumn("fold", F.col("l_orderkey") % 5)
    moved = F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)
    now = li.where("l_orderkey % 90 <> 7").withColumn("fold", (F.col("l_orderkey") + moved) % 5).withColumn("y", F.col("y") + F.when(F.col("l_linenumber") == 7, 0.5).otherwise(0.0))
    return review.replayed(frozen, now, ["fold"], "y")


@query("""SELECT c_custkey, 0 AS entry, c_name AS name, c_acctbal::VARCHAR AS value, NULL AS unit FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment, NULL, 'segment' FROM customer WHERE c_custkey % 2 = 0""")
def mapped_rows(t: Tables):
    """One row to some, by a spec."""
    full = F.create_map(F.lit("n"), F.col("c_name"), F.lit("v"), F.col("c_acctbal").cast("string"), F.lit("s"), F.col("c_mktsegment"), F.lit("u"), F.lit("segment"))
    short = F.create_map(F.lit("n"), F.col("c_name"), F.lit("v"), F.col("c_acctbal").cast("string"))
    own = t.customer.withColumn("m", F.when(F.col("c_custkey") % 2 == 0, full).otherwise(short))
    return review.mapped(own, ["c_custkey"], "m", [{"name": "n", "value": "v"}, {"name": "s", "unit": "u"}])


@query("""SELECT c_custkey, c_custkey % 3 < 2 AS ok, CASE c_custkey % 3 WHEN 0 THEN c_custkey * 1000.5::DOUBLE WHEN 1 THEN 100.0::DOUBLE - c_custkey % 90 END AS value, CASE WHEN c_custkey % 3 = 2 THEN 'not a number: <LOD' END AS error FROM customer""")
def vetted_conversions(t: Tables):
    k = F.col("c_custkey")
    number = review.converted(F.when(k % 3 == 0, F.format_number(k * 1000.5, 1)).otherwise("<LOD"), "number")
    share = review.converted(F.concat((k % 90).cast("string"), F.lit(" %")), "inhibition")
    return t.customer.withColumn("x", F.when(k % 3 == 1, share).otherwise(number)).select("c_custkey", "x.ok", "x.value", "x.error")


@query("""SELECT l_suppkey, 'ISIS ' || l_partkey AS item, count(*) AS n, list_sort(list(l_linenumber))::VARCHAR AS lines FROM lineitem WHERE l_partkey > 999 GROUP BY 1, 2""")
def stage_tree(t: Tables):
    own = t.lineitem.select("l_suppkey", F.concat(F.lit("ISIS "), F.col("l_partkey").cast("string")).alias("item"), "l_linenumber")
    return review.stage_tree(own, "l_suppkey", "item", "l_linenumber").select("l_suppkey", "item", "n", F.concat(F.lit("["), F.array_join(F.col("values").cast("array<string>"), ", "), F.lit("]")).alias("lines"))


@query("""SELECT l_orderkey, l_linenumber, ch, value, value IS NOT NULL AS has_value, to_json(value)::VARCHAR AS cleaned FROM (SELECT l_orderkey, l_linenumber, unnest(['alt', 'ast', 'bun']) AS ch, unnest([l_quantity, CASE WHEN l_discount > 0.02 THEN l_discount END, CASE WHEN l_tax BETWEEN 0.01 AND 0.07 THEN l_tax END]) AS value FROM lineitem)""")
def contributor_rows(t: Tables):
    """A row for each channel of a raw row, with its cleaned value as JSON."""
    channels = {"alt": F.col("l_quantity"), "ast": F.when(F.col("l_discount") > 0.02, F.col("l_discount")), "bun": F.when(F.col("l_tax").between(0.01, 0.07), F.col("l_tax"))}
    rows = F.array(*[F.struct(F.lit(n).alias("ch"), v.alias("value")) for n, v in channels.items()])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.inline(rows)).select("*", F.col("value").isNotNull().alias("has_value"), F.col("value").cast("string").alias("cleaned"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN l_quantity NOT BETWEEN 3 AND 48 THEN 'range' END, CASE WHEN l_discount = 0 THEN 'dose' END, CASE WHEN l_linenumber > 5 THEN 'unit' END, CASE WHEN l_linestatus <> 'F' THEN 'route' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'source' END) AS reasons FROM lineitem""")
def endpoint_reasons(t: Tables):
    """Why a raw row can't be used, in the order in which its parts are read."""
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", dedup.reasons({"range": ~q.between(3, 48), "dose": F.col("l_discount") == 0, "unit": F.col("l_linenumber") > 5, "route": F.col("l_linestatus") != "F", "source": ~F.col("l_returnflag").isin("A", "N")}).alias("reasons"))


@query("""WITH s AS (SELECT c_custkey, 'moe ' || c_mktsegment || ' phosphorothioate' AS t FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '5-10-5' WHEN c_custkey % 3 = 1 THEN '3-10-3' END AS motif, CASE WHEN c_custkey % 2 = 0 THEN 'PS' ELSE 'mixed' END AS linkage, c_custkey % 4 = 0 AS methylated, CASE WHEN c_custkey % 5 = 0 THEN 24 END AS hours FROM s""")
def source_context(t: Tables):
    """What the prose about a table says of its compounds."""
    k = F.col("c_custkey")
    prose = F.concat_ws(" ", F.when(k % 3 == 0, "Chimeric 5-10-5 MOE gapmers").when(k % 3 == 1, "were 3-10-3 cEt gapmers;").otherwise("compounds"), F.when(k % 2 == 0, "linkages are phosphorothioate throughout").otherwise("links are phosphorothioate and phosphodiester"), F.when(k % 4 == 0, "all cytosines are 5-methylcytosines"), F.when(k % 5 == 0, "after approximately 24 hours"))
    return t.customer.withColumn("prose", prose).select("c_custkey", *X.source_context(F.col("prose")))
