"""Plans that write what Spark derives from the given tables, and read it back: a table that a job reads and
replaces, a stored scorer, the prediction sink, CSV with malformed cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.functions.expr import recode
from strata.functions.vocab import METRIC_LABELS, PROBABILITY_BAND_EDGES, PROBABILITY_BAND_NAMES
from strata.operators import classify, features, metrics, missing
from strata.operators.cluster import KMeansModel
from strata.operators.reshape import melt
from strata.operators.score import Scorer
from strata.plans.classification import SCORE_CENTRES, SCORE_COEF, SCORE_FEATS, SCORE_INTERCEPT, SCORE_RISK, _LDP_SQL, _labelled
from strata.plans.registry import ORACLE, register, rounded, table
from strata.session import checkpoint_dir
from strata.sources import csv_rejects, read_csv, write_prediction
from strata.sources.versions import VersionedTable, load_scorer, save_scorer


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- SK1
@register("versioned_replace", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice * 1.1 * 1.1), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def versioned_replace(spark, sf_dir):
    """SK1: a job reads its own table and replaces it, twice."""
    store = VersionedTable(spark, _folder(spark, "orders"))
    store.write(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"))
    for _ in range(2):
        store.replace(lambda d: d.withColumn("o_totalprice", F.col("o_totalprice") * 1.1))
    store.expire(keep=1)
    return store.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- SK2 + SC5
@register("score_with_reloaded_bundle", ORACLE["score_records"])
def score_with_reloaded_bundle(spark, sf_dir):
    """ML17 by a scorer that was stored whole and loaded again."""
    p = table(spark, sf_dir, "part")
    scorer = Scorer(scaler=features.fit_scaler(p, SCORE_FEATS), kmeans=KMeansModel(SCORE_FEATS, SCORE_CENTRES),
                    logistic=classify.LogisticModel(SCORE_FEATS, SCORE_COEF, SCORE_INTERCEPT), positive="high", negative="low",
                    band_edges=PROBABILITY_BAND_EDGES, band_names=PROBABILITY_BAND_NAMES, risk_rules=SCORE_RISK,
                    imputer=missing.fit_mean_imputer(p, SCORE_FEATS), pca=features.fit_pca(p, SCORE_FEATS, 2))
    root = _folder(spark, "scorer")
    save_scorer(spark, scorer, root)
    return rounded(load_scorer(spark, root).transform(p, keep=["p_partkey"]))


# ---------------------------------------------------------------- SK3
@register("prediction_sink", f"""
SELECT "Cluster", "Prediction", count(*) AS n, round(avg("Survival_Probability"), 6) AS mean_probability
FROM (SELECT cluster AS "Cluster", prediction AS "Prediction", probability AS "Survival_Probability" FROM ({ORACLE["score_records"]})) GROUP BY 1, 2""")
def prediction_sink(spark, sf_dir):
    """SK3: Cluster, Survival_Probability, Prediction as CSV, read back."""
    path = _folder(spark, "predictions")
    write_prediction(score_with_reloaded_bundle(spark, sf_dir), path)
    back = read_csv(spark, path, "Cluster int, Survival_Probability double, Prediction string")
    return rounded(back.groupBy("Cluster", "Prediction").agg(F.count(F.lit(1)).alias("n"), F.avg("Survival_Probability").alias("mean_probability")))


# ---------------------------------------------------------------- SC1
_CSV_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey || 'abc' WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_totalprice::VARCHAR END AS price,
  CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS cust FROM orders)"""


def _written_csv(spark, sf_dir):
    key = F.col("o_orderkey")
    price = F.when(key % 11 == 0, F.concat(key.cast("string"), F.lit("abc"))).when(key % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string"))
    cust = F.when(key % 13 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    path = _folder(spark, "orders-csv")
    table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), cust.alias("cust")).write.option("header", True).csv(path)
    return path


_CSV_SCHEMA = "o_orderkey long, price double, cust long"


@register("csv_rejected_cells", f"""
SELECT "column", raw, count(*) AS n FROM (SELECT 'price' AS "column", price AS raw FROM {_CSV_SQL} WHERE o_orderkey % 11 = 0
  UNION ALL SELECT 'cust', cust FROM {_CSV_SQL} WHERE o_orderkey % 13 = 0) GROUP BY 1, 2""")
def csv_rejected_cells(spark, sf_dir):
    """SC1: cells that are not of their column's type."""
    found = csv_rejects(spark, _written_csv(spark, sf_dir), _CSV_SCHEMA)
    return found.groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"))


@register("csv_typed_cells", f"""
SELECT count(*) AS n, count(price) AS n_price, count(cust) AS n_cust, round(sum(price), 2) AS total, sum(cust)::BIGINT AS custs FROM (
  SELECT try_cast(price AS DOUBLE) AS price, try_cast(cust AS BIGINT) AS cust FROM {_CSV_SQL})""")
def csv_typed_cells(spark, sf_dir):
    """SC1: the same scan with malformed cells as missing."""
    d = read_csv(spark, _written_csv(spark, sf_dir), _CSV_SCHEMA, on_malformed="null")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.count("cust").alias("n_cust"),
                 F.round(F.sum("price"), 2).alias("total"), F.sum("cust").alias("custs"))


# ---------------------------------------------------------------- LK2
_METRIC_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_LABELS.items())


@register("labelled_metrics", f"""
WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
    count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS tn FROM {_LDP_SQL}),
m AS (SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([(tp + tn) / (tp + fp + fn + tn), coalesce(tp / nullif(tp + fp, 0), 0),
    coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)]) AS value FROM c)
SELECT CASE metric {_METRIC_CASE} END AS label, round(value, 6) AS value FROM m""")
def labelled_metrics(spark, sf_dir):
    """LK2: metrics under their display names."""
    m = metrics.binary_metrics(_labelled(spark, sf_dir), "y", "pred")
    long = melt(m, [], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    return rounded(long.select(recode("metric", METRIC_LABELS).alias("label"), "value"))


