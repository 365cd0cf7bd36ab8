"""Cohorts, joins, aggregates, sets and first-wins rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import array_mean, readouts, threshold
from ..operators import audit, dedup, joins, metrics
from ..sources.readers import scaled_union
from ..streaming.events import windowed
from .registry import Tables, query


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A','R') AND l_linestatus = 'F' AND l_quantity > 0")
def cohort_filter(t: Tables):
    c = F.col("l_discount").between(0.02, 0.06) & F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 0)
    return t.lineitem.where(c).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(CASE WHEN l_quantity < 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS low_rate,
 round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS high_rate FROM lineitem GROUP BY ALL""")
def threshold_pass_rate(t: Tables):
    rate = lambda c, op, v, name: F.round(F.avg(threshold(F.col(c), op, v).cast("double")), 6).alias(name)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), rate("l_quantity", "<", 25, "low_rate"), rate("l_discount", ">=", 0.05, "high_rate"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def value_map_replace(t: Tables):
    return t.orders.replace({"F": "final", "O": "open"}, subset="o_orderstatus").select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS dosage_nm, 'F' AS source FROM lineitem WHERE l_linestatus='F'
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity*1000, 'O' FROM lineitem WHERE l_linestatus='O'""")
def union_unit_scale(t: Tables):
    part = lambda s: t.lineitem.where(F.col("l_linestatus") == s).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("dosage"), F.lit(s).alias("source"))
    return scaled_union(part("F"), part("O"))


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS symbol FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def gene_fallthrough_join(t: Tables):
    found = joins.small(t.nation.where("n_regionkey < 3"))
    return t.customer.join(found, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", "c_mktsegment").alias("symbol"))


@query("SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def first_wins_dimension(t: Tables):
    rows = t.lineitem.withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return joins.first_wins(rows, "l_partkey", "l_suppkey", "o")


@query("SELECT o_orderkey, o_custkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey")
def validated_merge(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.validated_left(t.orders.select("o_orderkey", "o_custkey"), c, ["o_custkey"], "many_to_one")
    return joins.validated_left(out, n, ["c_nationkey"], "many_to_one").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_join_members(t: Tables):
    return t.part.join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_join_members(t: Tables):
    return t.customer.join(t.orders.where("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag='R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def gated_semi(t: Tables):
    key = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(key("l_returnflag='R'"), "p_partkey", "left_semi").join(key("l_quantity >= 48"), "p_partkey", "left_semi")


@query("""WITH m AS (SELECT l_partkey, round(avg(l_quantity),6) AS mean_m FROM lineitem WHERE l_returnflag='A' GROUP BY 1), r AS (SELECT l_partkey, round(avg(l_quantity),6) AS mean_r FROM lineitem WHERE l_returnflag='R' GROUP BY 1)
SELECT l_partkey, mean_m, mean_r FROM m JOIN r USING (l_partkey)""")
def complete_case_join(t: Tables):
    one = lambda f, n: t.lineitem.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias(n))
    return one("A", "mean_m").join(one("R", "mean_r"), "l_partkey")


@query("""SELECT l_partkey, l_discount, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_discount ORDER BY l_suppkey DESC, l_orderkey, l_linenumber, l_extendedprice, l_quantity) k FROM lineitem) WHERE k=1""")
def dedup_latest_wins(t: Tables):
    out = dedup.first_rows(t.lineitem, ["l_partkey", "l_discount"], F.desc("l_suppkey"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return out.select("l_partkey", "l_discount", "l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) k FROM events) WHERE k=1""")
def dedup_input_order(t: Tables):
    return dedup.first_rows(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, min(l_orderkey) OVER (PARTITION BY l_partkey) AS cv_group FROM lineitem")
def earliest_group(t: Tables):
    return dedup.earliest_group(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "cv_group")


@query("SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def compound_max(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.max(F.nullif("l_extendedprice", F.lit(float("nan")))).alias("best"))


@query("""SELECT label, count(*) AS n, round(avg(m), 5) AS mean FROM (SELECT label, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings) GROUP BY 1""")
def array_mean_per_key(t: Tables):
    m = array_mean(F.col("embedding").cast("array<double>"))
    return t.embeddings.select("label", m.alias("m")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("m"), 5).alias("mean"))


@query("""SELECT o_custkey, count(*) AS n, round(avg(o_totalprice),4) AS mean, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status FROM orders GROUP BY 1""")
def first_nonnull_collapse(t: Tables):
    o = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min_by("o_orderpriority", o).alias("first_priority"), F.min_by("o_orderstatus", o).alias("first_status"))


@query("""SELECT user_id, event_type, array_to_string(list(cast(event_id AS VARCHAR) ORDER BY event_id) FILTER (value > 10), ',') AS ids, arg_min(event_id, event_id) AS first_id FROM events GROUP BY 1, 2""")
def collect_array_collapse(t: Tables):
    rows = t.events.withColumn("v", F.when(F.col("value") > 10, F.col("event_id").cast("string"))).withColumn("first_id", F.col("event_id"))
    out = dedup.collapse(rows, ["user_id", "event_type"], "event_id", ["v"], ["first_id"])
    return out.select("user_id", "event_type", F.when(F.size("v") > 0, F.array_join("v", ",")).alias("ids"), "first_id")


@query("""SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem""")
def distinct_counts(t: Tables):
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1,2), m AS (SELECT o_custkey, o_orderpriority AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) k FROM c) WHERE k=1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN coalesce(mode, 'none') ELSE o_orderpriority END AS priority FROM orders LEFT JOIN m USING (o_custkey)""")
def mode_majority_vote(t: Tables):
    known = t.orders.where("o_orderstatus <> 'O'")
    votes = metrics.modes(known, ["o_custkey"], "o_orderpriority").withColumnRenamed("o_orderpriority", "mode")
    value = F.when(F.col("o_orderstatus") == "O", F.coalesce("mode", F.lit("none"))).otherwise(F.col("o_orderpriority"))
    return t.orders.join(votes, "o_custkey", "left").select("o_orderkey", value.alias("priority"))


@query("""SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1""")
def union_counts_ranked(t: Tables):
    a, b = t.customer.groupBy(F.col("c_nationkey").alias("k")).count(), t.supplier.groupBy(F.col("s_nationkey").alias("k")).count()
    return a.unionByName(b).groupBy("k").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "k")


@query("""SELECT o_custkey, CAST(sum(a) AS BIGINT) AS readouts FROM (SELECT o_custkey, CASE WHEN len(list_filter([o_totalprice], lambda x: x > 100000)) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter([o_totalprice], lambda x: x > 200000)) > 0 THEN 1 ELSE 0 END AS a FROM orders) GROUP BY 1""")
def nonnull_readout_count(t: Tables):
    keep = lambda v: F.filter(F.array("o_totalprice"), lambda x: x > v)
    return t.orders.groupBy("o_custkey").agg(F.sum(readouts(keep(100000), keep(200000))).alias("readouts"))


@query("""SELECT n_sets, count(*) AS n FROM (SELECT i, count(DISTINCT s) AS n_sets FROM (SELECT l_partkey i, 'A' s FROM lineitem WHERE l_returnflag='A' UNION ALL SELECT l_partkey, 'R' FROM lineitem WHERE l_returnflag='R' UNION ALL SELECT l_partkey, 'N' FROM lineitem WHERE l_returnflag='N') GROUP BY 1) GROUP BY 1""")
def membership_linkage(t: Tables):
    return audit.membership([(f, t.lineitem.where(F.col("l_returnflag") == f)) for f in "ARN"], "l_partkey")


@query("""WITH x AS (SELECT doc_id, quality=1 AS a, toxic=1 AS b FROM labels) SELECT count(*) FILTER (a AND b) AS hh, count(*) FILTER (a AND NOT b) AS hl, count(*) FILTER (NOT a AND b) AS lh, count(*) FILTER (NOT a AND NOT b) AS ll, round(100.0::DOUBLE * count(*) FILTER (a = b) / count(*), 4) AS concordance FROM x""")
def crosstab_concordance(t: Tables):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return t.labels.agg(F.count_if(a & b).alias("hh"), F.count_if(a & ~b).alias("hl"), F.count_if(~a & b).alias("lh"), F.count_if(~a & ~b).alias("ll"), F.round(100.0 * F.count_if(a == b) / F.count("*"), 4).alias("concordance"))


@query("""SELECT r.i AS l_linenumber, count(*) FILTER (l_returnflag='A') AS A, count(*) FILTER (l_returnflag='N') AS N, count(*) FILTER (l_returnflag='R') AS R FROM range(0, 9) r(i) LEFT JOIN lineitem ON l_linenumber = r.i GROUP BY 1""")
def count_matrix(t: Tables):
    wide = t.lineitem.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).count()
    return t.spark.range(9).withColumnRenamed("id", "l_linenumber").join(F.broadcast(wide.withColumn("l_linenumber", F.col("l_linenumber").cast("long"))), "l_linenumber", "left").na.fill(0)


@query("""SELECT l_partkey, round(avg(l_quantity) FILTER (l_linestatus='F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus='O'), 6) AS O FROM lineitem GROUP BY 1 HAVING F IS NOT NULL AND O IS NOT NULL""")
def pivot_wide(t: Tables):
    return t.lineitem.groupBy("l_partkey").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_quantity"), 6)).dropna()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus='F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='O'")
def set_intersect(t: Tables):
    return t.orders.where("o_orderstatus='F'").select(F.col("o_custkey").alias("k")).intersect(t.orders.where("o_orderstatus='O'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus='F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def set_except(t: Tables):
    return t.orders.where("o_orderstatus='F'").select(F.col("o_custkey").alias("k")).subtract(t.orders.where("o_orderstatus='P'").select("o_custkey"))


@query("""SELECT 'only_left' AS side, count(*) AS n FROM (SELECT l_quantity FROM lineitem WHERE l_returnflag='A' EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_returnflag='R')
UNION ALL SELECT 'only_right', count(*) FROM (SELECT l_quantity FROM lineitem WHERE l_returnflag='R' EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_returnflag='A')""")
def multiset_equal(t: Tables):
    part = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_quantity")
    return dedup.reconcile(part("A"), part("R"))


@query("""WITH s AS (SELECT 0 p, 'customers' s, c_custkey i FROM customer UNION SELECT 1, 'ordered', o_custkey FROM orders UNION SELECT 2, 'large', o_custkey FROM orders WHERE o_totalprice > 200000 UNION SELECT 3, 'rich', c_custkey FROM customer WHERE c_acctbal > 5000)
SELECT a.p AS position, a.s AS stage, count(*) AS n, (SELECT count(*) FROM s b WHERE b.p = a.p - 1 AND b.i NOT IN (SELECT i FROM s c WHERE c.p = a.p)) AS dropped, count(*) FILTER (a.p > 0 AND a.i NOT IN (SELECT i FROM s b WHERE b.p = a.p - 1)) AS strays FROM s a GROUP BY 1, 2""")
def ladder_funnel(t: Tables):
    c = lambda d, x: d.select(F.col(x).alias("i"))
    return audit.ladder([("customers", c(t.customer, "c_custkey")), ("ordered", c(t.orders, "o_custkey")), ("large", c(t.orders.where("o_totalprice > 200000"), "o_custkey")), ("rich", c(t.customer.where("c_acctbal > 5000"), "c_custkey"))], "i")


@query("""SELECT stratum, level, k, n, round(100.0::DOUBLE*k/n, 2) AS pct FROM (
SELECT 'l_returnflag' AS stratum, l_returnflag AS level, count(*) FILTER (l_quantity > 25) AS k, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL
SELECT 'l_linestatus', l_linestatus, count(*) FILTER (l_quantity > 25), count(*) FROM lineitem GROUP BY 2 UNION ALL
SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FILTER (l_quantity > 25), count(*) FROM lineitem GROUP BY 2)""")
def strata_rates(t: Tables):
    return metrics.strata_rates(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], F.col("l_quantity") > 25)


@query("SELECT o_orderstatus, o_orderpriority, count(*) FILTER (o_totalprice > 150000) AS k, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (o_totalprice > 150000)/count(*), 2) AS pct FROM orders GROUP BY 1, 2")
def cross_tab_rate(t: Tables):
    k = F.count_if(F.col("o_totalprice") > 150000)
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(k.alias("k"), F.count("*").alias("n"), F.round(100.0 * k / F.count("*"), 2).alias("pct"))


@query("""SELECT user_id, event_type, n, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) k FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2)) WHERE k <= 3""")
def top_modes(t: Tables):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")).cast("long")).where("place <= 3")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(24,6))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def event_windows(t: Tables):
    """An extension: hourly windows over events."""
    return windowed(t.events)
