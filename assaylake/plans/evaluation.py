"""Top shares, rank correlations, quantiles and classification figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, topk
from .registry import Tables, query


def _scored(t: Tables):
    """orders as predictions: the score is the price's part below 1000, the outcome the price."""
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_totalprice") % 1000).alias("score"), F.col("o_totalprice").alias("y"))


SCORED = "x AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice % 1000 AS score, o_totalprice AS y FROM orders)"


def _top(order: str, passes: str, size: str = "greatest(1, floor(0.2::DOUBLE * n))") -> str:
    return f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY {order}) k, count(*) OVER () n FROM x), s AS (SELECT count(*) AS n, count(*) FILTER (k <= {size}) AS n_selected, avg(CASE WHEN {passes} THEN 1.0::DOUBLE ELSE 0 END) AS b, avg(CASE WHEN {passes} THEN 1.0::DOUBLE ELSE 0 END) FILTER (k <= {size}) AS s FROM r)
SELECT n, n_selected, round(b, 4) AS base_rate, round(s, 4) AS selected_rate, round(s / b, 3) AS factor FROM s"""


@query(_top("score, o_orderkey", "y < 150000"))
def enrichment_topk_low(t: Tables):
    return topk.enrichment(_scored(t), "score", "y", F.col("y") < 150000, "o_orderkey", low=True)


@query(_top("score DESC, o_orderkey DESC", "y > 150000"))
def enrichment_topk_high(t: Tables):
    return topk.enrichment(_scored(t), "score", "y", F.col("y") > 150000, "o_orderkey", low=False)


@query(_top("score, o_orderkey", "y < 150000", "greatest(1, round_even(0.1::DOUBLE * n, 0))"))
def topk_round_rule(t: Tables):
    return topk.enrichment(_scored(t), "score", "y", F.col("y") < 150000, "o_orderkey", low=True, share=0.1, size=topk.size_round)


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score, o_orderkey) k, count(*) OVER (PARTITION BY o_custkey) n FROM x), s AS (SELECT count(*) AS n, count(*) FILTER (n >= 10 AND k <= greatest(1, floor(0.2::DOUBLE * n))) AS n_selected, avg(CASE WHEN y < 150000 THEN 1.0::DOUBLE ELSE 0 END) AS b, avg(CASE WHEN y < 150000 THEN 1.0::DOUBLE ELSE 0 END) FILTER (n >= 10 AND k <= greatest(1, floor(0.2::DOUBLE * n))) AS s FROM r)
SELECT n, n_selected, round(b, 4) AS base_rate, round(s, 4) AS selected_rate, round(s / b, 3) AS factor FROM s""")
def enrichment_stratified(t: Tables):
    return topk.stratified(_scored(t), "score", "y", F.col("y") < 150000, "o_orderkey", "o_custkey", low=True)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) k FROM orders) WHERE k = 1")
def best_row_per_group(t: Tables):
    return topk.best_rows(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


SHARES = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score, o_orderkey) k, count(*) OVER () n FROM x), f AS (SELECT unnest({SHARES})::DOUBLE AS share), b AS (SELECT avg(CASE WHEN y < 150000 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM x)
SELECT share, count(*) AS n_selected, round(avg(CASE WHEN y < 150000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS selected_rate, round(avg(CASE WHEN y < 150000 THEN 1.0::DOUBLE ELSE 0 END) / any_value(b), 3) AS factor FROM r, f, b WHERE k <= greatest(1, floor(share * n)) GROUP BY share""")
def k_sweep(t: Tables):
    return topk.sweep(_scored(t), "score", "y", F.col("y") < 150000, "o_orderkey", True, SHARES)


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT k, n, round((sum(n) OVER (ORDER BY n DESC, k) - n / 2.0::DOUBLE) / sum(n) OVER () * 360, 6) AS angle FROM c) SELECT k, n, angle FROM a WHERE angle <= 270""")
def cumulative_cutoff(t: Tables):
    return topk.cumulative_cut(t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")), "k", "n", 270)


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, any_value(m.median) AS median, median(abs(l_extendedprice - m.median)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, round(median, 6) AS median, round(mad, 6) AS mad, round(median + 3 * mad, 6) AS upper FROM d""")
def median_mad_uln(t: Tables):
    return metrics.median_limit(t.lineitem, ["l_returnflag"], "l_extendedprice")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, round(coalesce(v, (SELECT median(v) FROM x)), 6) AS v FROM x""")
def median_impute(t: Tables):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    return metrics.impute_median(rows, "v").select("o_orderkey", F.round("v", 6).alias("v"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS q025, round(quantile_cont(l_extendedprice, 0.5), 6) AS q500, round(quantile_cont(l_extendedprice, 0.975), 6) AS q975 FROM lineitem GROUP BY 1")
def quantiles(t: Tables):
    return metrics.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.025, 0.5, 0.975])


@query("""WITH e AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 50) + 1, 50)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def histogram50(t: Tables):
    return metrics.histogram(t.orders, "o_totalprice", 50)


RANKED = """SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0::DOUBLE AS ry FROM {t}"""


@query(f"""WITH r AS ({RANKED.format(k="l_returnflag", x="l_quantity", y="l_extendedprice", t="lineitem")}), c AS (SELECT l_returnflag, count(*) AS n, corr(rx, ry) AS r FROM r GROUP BY 1)
SELECT l_returnflag, n, round(r, 6) AS rho, round(tanh(atanh(r) - 1.96::DOUBLE / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.96::DOUBLE / sqrt(n - 3)), 6) AS high FROM c""")
def spearman(t: Tables):
    return metrics.spearman(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")


def _means(t: Tables):
    """A part's means, added exactly: whether one of them is half way between two roundings must not depend on the order of its rows."""
    exact = lambda c: F.avg(F.col(f"l_{c}").try_cast("decimal(20,8)"))
    return t.lineitem.groupBy("l_partkey").agg(*[F.round(exact(c), 6).cast("double").alias(c) for c in ("quantity", "discount", "tax")])


@query(f"""WITH w AS (SELECT l_partkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
p AS (SELECT 'quantity' a, 'discount' b, round(quantity, 6) x, round(discount, 6) y FROM w UNION ALL SELECT 'quantity', 'tax', round(quantity, 6), round(tax, 6) FROM w UNION ALL SELECT 'discount', 'tax', round(discount, 6), round(tax, 6) FROM w),
q AS (SELECT a || b AS ab, a, b, x, y FROM p), r AS (SELECT a, b, rank() OVER (PARTITION BY ab ORDER BY x) + (count(*) OVER (PARTITION BY ab, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY ab ORDER BY y) + (count(*) OVER (PARTITION BY ab, y) - 1) / 2.0::DOUBLE AS ry FROM q),
c AS (SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2) SELECT * FROM c UNION ALL SELECT b, a, n, rho FROM c""")
def corr_matrix(t: Tables):
    means = _means(t)
    return metrics.correlations(means, "l_partkey", ["quantity", "discount", "tax"])


_TESTED = f"""w AS (SELECT l_partkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
p AS (SELECT 'quantity' a, 'discount' b, round(quantity, 6) x, round(discount, 6) y FROM w UNION ALL SELECT 'quantity', 'tax', round(quantity, 6), round(tax, 6) FROM w UNION ALL SELECT 'discount', 'tax', round(discount, 6), round(tax, 6) FROM w),
q AS (SELECT a || b AS ab, a, b, x, y FROM p), r AS (SELECT a, b, rank() OVER (PARTITION BY ab ORDER BY x) + (count(*) OVER (PARTITION BY ab, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY ab ORDER BY y) + (count(*) OVER (PARTITION BY ab, y) - 1) / 2.0::DOUBLE AS ry FROM q),
c AS (SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_TESTED}, x AS (SELECT *, 1 - rho * rho AS x0, (n - 2) / 2.0::DOUBLE AS a0 FROM c), k AS (SELECT *, x0 > (a0 + 1) / (a0 + 2.5) AS up FROM x), s AS (SELECT a, b, n, rho, up, CASE WHEN up THEN 1 - x0 ELSE x0 END AS x, CASE WHEN up THEN 0.5::DOUBLE ELSE a0 END AS p, CASE WHEN up THEN a0 ELSE 0.5::DOUBLE END AS q FROM k),
z AS (SELECT *, 0 AS i, 1.0::DOUBLE AS f, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM s UNION ALL SELECT a, b, n, rho, up, x, p, q, i + 1, f * (1 + num / c) / (1 + num * d), 1 + num / c, 1 / (1 + num * d) FROM
  (SELECT *, CASE WHEN i = 0 THEN 1.0 WHEN i % 2 = 0 THEN (i // 2) * (q - i // 2) * x / ((p + 2 * (i // 2) - 1) * (p + 2 * (i // 2))) ELSE -(p + i // 2) * (p + q + i // 2) * x / ((p + 2 * (i // 2)) * (p + 2 * (i // 2) + 1)) END AS num FROM z WHERE i < {metrics.STEPS})),
v AS (SELECT a, b, n, rho, up, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(x) + q * ln(1 - x)) / p * (f - 1) AS beta FROM z WHERE i = {metrics.STEPS}), t AS (SELECT a, b, n, rho, CASE WHEN up THEN 1 - beta ELSE beta END AS p FROM v)
SELECT a, b, n, rho, round(p, 6) AS p, round(least(p * 3, 1), 6) AS corrected FROM t UNION ALL SELECT b, a, n, rho, round(p, 6), round(least(p * 3, 1), 6) FROM t""")
def corr_significance(t: Tables):
    """Correlations with their p by Student's t and Bonferroni's correction by the number of pairs, as columns."""
    means = _means(t)
    out = metrics.significances(metrics.correlations(means, "l_partkey", ["quantity", "discount", "tax"]))
    return out.select("a", "b", "n", "rho", F.round("p", 6).alias("p"), F.round("corrected", 6).alias("corrected"))


@query("""WITH x AS (SELECT d.doc_id, n_chars AS s, quality AS y FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT s, count(*) FILTER (y=1) p, count(*) FILTER (y=0) q FROM x GROUP BY 1),
w AS (SELECT s, p, q, sum(q) OVER (ORDER BY s) - q AS below, sum(p) OVER (ORDER BY s DESC) tp, sum(q) OVER (ORDER BY s DESC) fp, sum(p) OVER () pp, sum(q) OVER () qq FROM g), j AS (SELECT *, round(tp::DOUBLE / pp - fp::DOUBLE / qq, 9) AS j FROM w)
SELECT round(sum(p * (below + q / 2.0::DOUBLE)) / (max(pp)::DOUBLE * max(qq)), 6) AS auc, arg_max(s, (j, s)) AS threshold, round(max(j), 6) AS youden FROM j""")
def auc_youden(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return metrics.auc(rows, [], "n_chars", "quality")


@query("""WITH x AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(corr(y, p), 6) AS pearson, round(corr(y, p) * corr(y, p), 6) AS r2, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS determination FROM x GROUP BY 1""")
def regression_metrics(t: Tables):
    rows = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return metrics.regression(rows, ["l_returnflag"], "y", "p")


@query("""WITH x AS (SELECT lang, toxic = 1 AS y, n_chars > 1500 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM x GROUP BY 1)
SELECT *, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy FROM c""")
def confusion_rates(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").select("lang", (F.col("toxic") == 1).alias("y"), (F.col("n_chars") > 1500).alias("p"))
    return metrics.confusion(rows, ["lang"], "y", "p")
