"""Records of two sources under rules, and the ledger of their match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from .registry import Tables, query

#: Orders as measurements: a finished order needs its quarter, an open one its year too; what else is stated is compared.
RULES = [
    ("F", "quarter", "required", "number"), ("F", "priority", "compared", "text"), ("F", "year", "compared", "number"),
    ("O", "quarter", "compared", "number"), ("O", "priority", "compared", "text"), ("O", "year", "required", "number"),
]


def _rules(t: Tables) -> list[records.Rule]:
    return records.rules_of(t.spark.createDataFrame(RULES, "endpoint string, field string, role string, normaliser string"))


def _records(t: Tables, side: int) -> DataFrame:
    """Orders of one parity as measurements; some leave out what others state."""
    o, k = t.orders.where(F.col("o_orderkey") % 2 == side), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    identity = {"priority": F.when(k % 3 != 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(""), "quarter": F.when(k % 10 > 1, F.concat(text(F.quarter("o_orderdate")), F.lit(".0"))).otherwise("n/a"), "year": F.when(k % 37 != 0, text(F.year("o_orderdate")))}
    return o.select(
        k.alias("measurement_id"), F.col("o_custkey").alias("table_ref"), F.col("o_orderstatus").alias("endpoint"), F.when(k % 29 < 2, "NA").otherwise(F.when(k % 4 < 2, "low").otherwise("High ")).alias("channel"),
        F.when(k % 31 < 2, " ").otherwise(F.concat(text(F.col("o_custkey")), F.lit(".0"))).alias("compound"), F.create_map(*[x for n, c in identity.items() for x in (F.lit(n), c)]).alias("identity"), F.floor(F.col("o_totalprice") / 60000).alias("outcome"),
    )


def _scope(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 41 <> 0").select(F.col("c_custkey").alias("table_ref"), F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("table_class"))


#: The records as SQL, with their problem; _BUCKETS adds each bucket's best score by trying all ways to pair it, a bit a record.
_SEEN = """s AS (SELECT o_orderkey AS id, o_orderkey % 2 AS side, o_custkey AS cust, o_orderstatus AS endpoint, CASE WHEN o_orderkey % 29 < 2 THEN NULL WHEN o_orderkey % 4 < 2 THEN 'low' ELSE 'high' END AS channel, o_orderkey % 31 < 2 AS nameless,
  CASE WHEN o_orderkey % 3 <> 0 THEN lower(o_orderpriority) END AS priority, CASE WHEN o_orderkey % 10 > 1 THEN quarter(o_orderdate) END AS quarter, CASE WHEN o_orderkey % 37 <> 0 THEN year(o_orderdate) END AS year, floor(o_totalprice / 60000) AS v FROM orders),
j AS (SELECT *, CASE WHEN channel IS NULL THEN 'missing_channel' WHEN nameless THEN 'missing_compound_id' WHEN cust % 41 = 0 THEN 'table_not_in_equivalence_scope' WHEN endpoint NOT IN ('F', 'O') THEN 'no_identity_rule_for_endpoint'
  WHEN endpoint = 'F' AND quarter IS NULL THEN 'missing_required_identity:quarter' WHEN {year} THEN 'missing_required_identity:year' END AS problem FROM s)"""
_BUCKETS = """b AS (SELECT *, hash(cust, endpoint, channel, {key}) AS b FROM j WHERE problem IS NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY b, side ORDER BY id) AS k FROM b),
n AS (SELECT b, any_value(cust) AS cust, any_value(endpoint) AS endpoint, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS f FROM b GROUP BY 1),
w AS (SELECT p.b, p.k, 1 << (q.k - 1)::INTEGER AS bit, CASE WHEN p.v = q.v THEN 1000 ELSE 0 END + CASE WHEN (p.priority IS NULL OR coalesce(p.priority = q.priority, false)) AND {fits} THEN 1 ELSE 0 END AS s FROM x p JOIN x q ON p.b = q.b AND p.side = 0 AND q.side = 1
  UNION ALL SELECT b, k, 0, 0 FROM x WHERE side = 0),
r AS (SELECT DISTINCT b, 0::BIGINT AS k, 0 AS mask, 0 AS s FROM x WHERE side = 0 UNION SELECT r.b, w.k, r.mask | w.bit, r.s + w.s FROM r JOIN w ON w.b = r.b AND w.k = r.k + 1 WHERE r.mask & w.bit = 0),
m AS (SELECT b, max(s) AS s FROM r GROUP BY 1)
SELECT cust, endpoint, sum(least(g, f))::BIGINT AS n_matched, sum(coalesce(s, 0) // 1000)::BIGINT AS n_value_correct, sum(coalesce(s, 0) % 1000)::BIGINT AS n_context_correct, sum(greatest(g - f, 0))::BIGINT AS n_missing, sum(greatest(f - g, 0))::BIGINT AS n_extra FROM n LEFT JOIN m USING (b) GROUP BY 1, 2"""
_YEAR = "endpoint = 'O' AND year IS NULL"


def _told(t: Tables, rules: list[records.Rule]) -> DataFrame:
    told = records.ledger(_records(t, 0), _records(t, 1), rules, _scope(t)).where("status <> 'unresolved'")
    out = records.match_summary(told.withColumn("cust", F.col("table_class")), ["cust", "endpoint"])
    return out.select("cust", "endpoint", "n_matched", "n_value_correct", "n_context_correct", "n_missing", "n_extra")


@query(f"WITH {_SEEN.format(year=_YEAR)} SELECT CASE WHEN side = 0 THEN 'gold' ELSE 'found' END AS side, problem AS reason, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY 1, 2")
def record_problems(t: Tables):
    """The first problem of each record that can't be matched."""
    told = records.ledger(_records(t, 0), _records(t, 1), _rules(t), _scope(t))
    return told.where("status = 'unresolved'").groupBy("side", "reason").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_SEEN.format(year=_YEAR)}, " + _BUCKETS.format(key="CASE WHEN endpoint = 'F' THEN quarter ELSE year END", fits="CASE WHEN p.endpoint = 'F' THEN p.year IS NULL OR coalesce(p.year = q.year, false) ELSE p.quarter IS NULL OR coalesce(p.quarter = q.quarter, false) END"))
def match_dispositions(t: Tables):
    """Pairs under contexts of which either side may be silent, and what is left over; SQL tries all ways to pair a bucket."""
    return _told(t, _rules(t))


@query(f"WITH RECURSIVE {_SEEN.format(year='false')}, " + _BUCKETS.format(key="CASE WHEN endpoint = 'F' THEN quarter END", fits="(p.year IS NULL OR coalesce(p.year = q.year, false)) AND (p.endpoint = 'F' OR p.quarter IS NULL OR coalesce(p.quarter = q.quarter, false))"))
def rule_rewrite(t: Tables):
    """The same match once the year is compared, not required."""
    return _told(t, records.demoted(_rules(t), {"year"}))
