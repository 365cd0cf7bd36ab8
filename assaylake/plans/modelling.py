"""Curve fits, resampling and models. Their results are numeric, so tests hold them against plain versions, not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, funnel, learn, resample
from .funnels import COSTS
from .registry import Tables, query

#: Draws, as many as the reference makes.
BOOTSTRAPS, COST_DRAWS, PERMUTATIONS = 5000, 100_000, 20


def _curves(t: Tables):
    """A rising response a part: the dose by line number, the response by a known curve of the part's size."""
    dose = F.pow(F.lit(10.0), F.col("l_linenumber") / 2.0)
    ic50 = 5.0 + F.col("l_partkey") % 50
    return t.lineitem.select("l_partkey", dose.alias("dose"), (5 + 90 / (1 + F.pow(ic50 / dose, F.lit(1.5))) + F.col("l_discount") * 10).alias("response"))


@query()
def hill_ic50(t: Tables):
    return curves.fit_groups(_curves(t), ["l_partkey"], "dose", "response")


@query()
def hill_four_parameter(t: Tables):
    return curves.fit_groups(_curves(t), ["l_partkey"], "dose", "response", curves.FOUR_PARAMETER)


@query(f"""WITH u AS (SELECT c_nationkey, c_acctbal, draw, ('0x' || substr(md5('4274|' || c_custkey || '|' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM customer, range({BOOTSTRAPS}) r(draw)),
w AS (SELECT c_nationkey, draw, c_acctbal, {" + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in resample.POISSON)} AS w FROM u), m AS (SELECT c_nationkey, draw, sum(w * c_acctbal) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2)
SELECT c_nationkey, round(quantile_cont(m, 0.025) + 1e-9, 4) AS low, round(quantile_cont(m, 0.5) + 1e-9, 4) AS median, round(quantile_cont(m, 0.975) + 1e-9, 4) AS high FROM m GROUP BY 1""")
def bootstrap_ci(t: Tables):
    means = resample.bootstrap_means(t.customer, "c_nationkey", "c_custkey", "c_acctbal", BOOTSTRAPS, 4274)
    # Means of a few rows often end half way between two roundings; what adds up in another order goes the same way, up.
    return means.groupBy("c_nationkey").agg(*[F.round(F.expr(f"percentile(mean, {q}D)") + 1e-9, 4).alias(n) for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))])


@query()
def mc_cost(t: Tables):
    rates, sizes = [0.1181, 0.3144, 0.5139, 0.4451, 0.3996, 0.3522, 1.0], [2000, 400, 300, 300, 200, 200, 50]
    draws = resample.rate_draws(t.spark, rates, sizes, COST_DRAWS, 4274).join(resample.cost_draws(t.spark, COSTS, COST_DRAWS, 4274), "draw")
    return draws.select("draw", F.round(funnel.cost(funnel.counts(F.col("rates"), ceil=False), F.col("costs")), 4).alias("cost"))


@query(f"""WITH r AS (SELECT doc_id, lang, quality FROM labels JOIN documents USING (doc_id)), a AS (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM r),
b AS (SELECT lang, seed, quality AS shuffled, row_number() OVER (PARTITION BY lang, seed ORDER BY md5(seed || '|' || doc_id), doc_id) AS k FROM r, range({PERMUTATIONS}) s(seed)) SELECT lang, seed, round(avg((quality = shuffled)::INT), 6) AS agreement FROM a JOIN b USING (lang, k) GROUP BY 1, 2""")
def permutation_floor(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    agree = lambda seed: resample.permuted(rows, "lang", "doc_id", "quality", seed).groupBy("lang").agg(F.avg((F.col("quality") == F.col("shuffled")).cast("double")).alias("agreement")).select("lang", F.lit(seed).alias("seed"), F.round("agreement", 6).alias("agreement"))
    out = agree(0)
    for seed in range(1, PERMUTATIONS):
        out = out.unionByName(agree(seed))
    return out


@query("""WITH o AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('2026|' || doc_id), doc_id) AS k FROM documents), s AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('2026|' || source), source) AS g FROM o WHERE k = 1) SELECT doc_id, lang, source FROM s WHERE g <= 25""")
def stratified_sample(t: Tables):
    return resample.sample_groups(t.documents.select("doc_id", "lang", "source"), "lang", "source", "doc_id", 25, 2026)


@query("""WITH q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: x::DOUBLE) u FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS neighbour, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings),
s AS (SELECT query, neighbour, round(list_cosine_similarity(u, v), 6) AS similarity FROM q JOIN b ON query <> neighbour), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM s) SELECT query, neighbour, similarity, place::INTEGER AS place FROM k WHERE place <= 10""")
def knn10(t: Tables):
    """The ten nearest of a stated query set: every row whose id is divisible by 100."""
    return learn.neighbours(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 10)


def _features(t: Tables):
    return t.part.select("p_partkey", (F.pmod(F.xxhash64("p_partkey"), F.lit(5)) + 1).alias("fold"), F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name"), F.length("p_type").cast("double").alias("kind"), (F.col("p_partkey") % 1000).cast("double").alias("key"), F.col("p_retailprice").alias("y"))


def _cv(t: Tables, model: str):
    out = learn.cross_validated(_features(t), ["size", "name", "kind", "key"], "y", "fold", "p_partkey", model)
    return out.select("p_partkey", "fold", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 4).alias("y_pred"))


@query()
def ridge_cv(t: Tables):
    return _cv(t, "ridge")


@query()
def rf_cv(t: Tables):
    return _cv(t, "forest")


@query()
def boosted_cv(t: Tables):
    return _cv(t, "boosted")
