"""Plans over columns with NaN, infinities and decimals, made from the given tables: one rule for all
statistics.  NaN is missing; infinities are values, but edges and curves come from finite ones; a fill keeps
its fraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import classify, common, distribution, missing, reshape
from strata.operators.cluster import KMeansModel
from strata.operators.score import Scorer
from strata.plans.registry import register, rounded, table

_INF = "'inf'::DOUBLE"
ODD_SQL = f"""(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 50 = 1 THEN {_INF} WHEN o_orderkey % 50 = 2 THEN -{_INF}
  ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE (o_custkey % 5)::DOUBLE END AS code FROM orders)"""


def odd_orders(spark, sf_dir):
    """Orders with NaN, infinities and a decimal code; NaN where the SQL has NULL."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = (F.when(key % 10 == 3, float("nan")).when(key % 50 == 1, float("inf")).when(key % 50 == 2, float("-inf"))
             .otherwise(F.col("o_totalprice")))
    code = F.when(key % 9 == 4, None).otherwise(F.col("o_custkey") % 5).cast("decimal(10,0)")
    return o.select("o_orderkey", "o_orderstatus", price.alias("price"), code.alias("code"))


@register("odd_quality", f"""
SELECT count(*) FILTER (price IS NULL) AS n_null_features, 0::BIGINT AS n_null_target, count(DISTINCT o_orderstatus) AS n_classes,
  count(*) FILTER (price IS NULL) > 0 AS price_has_null, false AS o_orderkey_has_null FROM {ODD_SQL}""")
def odd_quality(spark, sf_dir):
    """FI4 + FI6: NaN is missing."""
    o = odd_orders(spark, sf_dir)
    return o.agg(*common.quality_exprs(o, ["price", "o_orderkey"], "o_orderstatus"), *common.any_null_exprs(o, ["price", "o_orderkey"]))


@register("odd_histogram", f"""
WITH e AS (SELECT min(price) AS lo, max(price) AS hi FROM {ODD_SQL} WHERE abs(price) < {_INF}),
b AS (SELECT greatest(0, least(7, floor((greatest(lo, least(hi, price)) - lo) * 8 / (hi - lo))))::INT AS bin FROM {ODD_SQL}, e WHERE price IS NOT NULL)
SELECT g.bin::INT AS bin, round(lo + g.bin * (hi - lo) / 8, 6) AS bin_lo, round(lo + (g.bin + 1) * (hi - lo) / 8, 6) AS bin_hi, count(b.bin) AS count
FROM range(8) g(bin) CROSS JOIN e LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin, lo, hi""")
def odd_histogram(spark, sf_dir):
    """AG12 with infinite values: edges from the finite ones, infinite ones in the end bins."""
    return rounded(distribution.histogram(odd_orders(spark, sf_dir), "price", bins=8))


@register("odd_bins", f"""
WITH e AS (SELECT min(price) AS lo, (max(price) - min(price)) / 10 AS w FROM {ODD_SQL} WHERE abs(price) < {_INF})
SELECT CASE WHEN price IS NOT NULL THEN greatest(1, least(10, ceil(greatest(0, least(10, (price - lo) / w)))))::INT END AS price_bin, count(*) AS n FROM {ODD_SQL}, e GROUP BY ALL""")
def odd_bins(spark, sf_dir):
    """RS2 with infinite and missing values."""
    return reshape.bin_equal_width(odd_orders(spark, sf_dir), "price", 10).groupBy("price_bin").agg(F.count(F.lit(1)).alias("n"))


@register("odd_fill", f"""
SELECT o_orderstatus, count(*) AS n, round(sum(coalesce(code, (SELECT avg(code) FROM {ODD_SQL}))), 4) AS total FROM {ODD_SQL} GROUP BY 1""")
def odd_fill(spark, sf_dir):
    """MV1, MV3, MV6: the mean of decimal codes keeps its fraction."""
    d = missing.fill_mean(odd_orders(spark, sf_dir), ["code"])
    return d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("code").cast("double")), 4).alias("total"))


@register("odd_scores", f"""
WITH z AS (SELECT CASE WHEN price IS NULL THEN 0 ELSE price END AS x, coalesce(code, 0) AS c FROM {ODD_SQL}),
p AS (SELECT CASE WHEN x = {_INF} THEN 1.0 WHEN x = -{_INF} THEN 0.0 ELSE 1 / (1 + exp(-(x / 100000.0 - c))) END AS p,
  CASE WHEN abs(x) < {_INF} AND abs(x - 300000) < abs(x - 100000) THEN 1 ELSE 0 END AS cluster FROM z)
SELECT cluster, CASE WHEN p > 0.5 THEN 'Survived' ELSE 'Deceased' END AS prediction, count(*) AS n FROM p GROUP BY 1, 2""")
def odd_scores(spark, sf_dir):
    """ML17, SF6, ML2, FI7: missing features are scored as 0, infinite ones as the largest
    number (as far from every centre: the first one's)."""
    d = odd_orders(spark, sf_dir)
    scorer = Scorer(scaler=None, kmeans=KMeansModel(["price"], [[100000.0], [300000.0]]), logistic=classify.LogisticModel(["price", "code"], [1e-5, -1.0], 0.0))
    return scorer.transform(d).groupBy("cluster", "prediction").agg(F.count(F.lit(1)).alias("n"))


@register("odd_scores_left_out", f"""
SELECT CASE WHEN price IS NULL OR code IS NULL THEN NULL WHEN price / 100000.0 - code > 0 THEN 'Survived' ELSE 'Deceased' END AS prediction, count(*) AS n
FROM {ODD_SQL} GROUP BY 1""")
def odd_scores_left_out(spark, sf_dir):
    """ML17, SF6: with ``missing='null'`` rows with a missing feature get no label."""
    scorer = Scorer(scaler=None, kmeans=None, logistic=classify.LogisticModel(["price", "code"], [1e-5, -1.0], 0.0), missing="null")
    return scorer.transform(odd_orders(spark, sf_dir)).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
