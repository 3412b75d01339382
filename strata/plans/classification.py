"""Plans: class weights, majority baseline, logistic regression (Newton, ml, grid search),
coefficients, batch scoring, and classification metrics (ML9-ML15, ML17, SF6-SF9, ME1-ME7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.expr import indicator, recode
from strata.functions.vocab import PROBABILITY_BAND_EDGES, PROBABILITY_BAND_NAMES
from strata.operators import classify, features, metrics
from strata.operators.cluster import KMeansModel
from strata.operators.score import Scorer
from strata.plans.registry import register, rounded, table
from strata.plans.tables import PRIORITY_CODES

# ---------------------------------------------------------------- ML11 / ML12


@register("class_weights", """
SELECT is_finished AS class, count(*) AS n, round((SELECT count(*) FROM orders) / (2.0 * count(*)), 6) AS weight
FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_finished FROM orders) GROUP BY 1""")
def class_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(indicator("o_orderstatus", "F").alias("is_finished"))
    counts = classify.class_counts(o, "is_finished")
    w = classify.balanced_weights(counts)
    rows = [(int(c), int(counts[c]), float(w[c])) for c in counts]
    return rounded(spark.createDataFrame(rows, "class int, n long, weight double"))


@register("majority_baseline", """
WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT v FROM c ORDER BY n DESC, v LIMIT 1)
SELECT (SELECT v FROM m) AS majority_class,
       round(avg(CASE WHEN o_orderpriority = (SELECT v FROM m) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders""")
def majority_baseline(spark, sf_dir):
    """ML12 + ME1: constant most-frequent prediction and its accuracy."""
    o = table(spark, sf_dir, "orders")
    best, pred = classify.majority_baseline(o, "o_orderpriority")
    acc = pred.agg(F.avg((F.col("prediction") == F.col("o_orderpriority")).cast("double")).alias("accuracy"))
    return rounded(acc.select(F.lit(best).alias("majority_class"), "accuracy"))


# ---------------------------------------------------------------- ML9 Newton (1 feature, oracle by unrolled CTEs)
NEWTON_SQL_ITERS = 12


def _newton_1d_sql() -> str:
    ctes = ["d AS (SELECT value / 100.0 AS x, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y FROM events)",
            "cw AS (SELECT y, (SELECT count(*) FROM d) / (2.0 * count(*)) AS w FROM d GROUP BY y)",
            "t AS (SELECT d.x, d.y, cw.w FROM d JOIN cw USING (y))",
            "b0 AS (SELECT 0.0 AS i0, 0.0 AS i1)"]
    for i in range(1, NEWTON_SQL_ITERS + 1):
        ctes.append(f"""b{i} AS (SELECT i0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS i0,
  i1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS i1 FROM (
  SELECT i0, i1, i0 + sum(w * (p - y)) AS g0, i1 + sum(w * (p - y) * x) AS g1, 1 + sum(w * p * (1 - p)) AS h00,
         sum(w * p * (1 - p) * x) AS h01, 1 + sum(w * p * (1 - p) * x * x) AS h11
  FROM (SELECT t.x, t.y, t.w, b.i0, b.i1, 1 / (1 + exp(-(b.i0 + b.i1 * t.x))) AS p FROM t, b{i - 1} b)
  GROUP BY i0, i1))""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT round(i0, 6) AS intercept, round(i1, 6) AS coef FROM b{NEWTON_SQL_ITERS}"


def _events_xy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.select((F.col("value") / 100.0).alias("x"), indicator("event_type", "purchase").alias("y"))
    return classify.with_class_weight(d, "y")


@register("logistic_newton_1d", _newton_1d_sql())
def logistic_newton_1d(spark, sf_dir):
    """ML9 + ML11: balanced weights, C = 1, penalised intercept (the liblinear objective)."""
    m = classify.logistic_newton(_events_xy(spark, sf_dir), ["x"], "y", C=1.0, weight_col="weight",
                                 penalize_intercept=True)
    return rounded(spark.createDataFrame([(m.intercept, m.coef[0])], "intercept double, coef double"))


LR_FEATS = ["x_qty", "x_disc", "x_tax"]


def _lineitem_xy(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.select((F.col("l_quantity") / 50.0).alias("x_qty"), (F.col("l_discount") * 10.0).alias("x_disc"),
                  (F.col("l_tax") * 10.0).alias("x_tax"), indicator("l_returnflag", "R").alias("y"))
    return classify.with_class_weight(d, "y")


@register("logistic_gradient_check", "SELECT * FROM (VALUES ('x_qty', 0.0), ('x_disc', 0.0), ('x_tax', 0.0), "
                                     "('intercept', 0.0)) t(feature, gradient)")
def logistic_gradient_check(spark, sf_dir):
    """ML9 property on three features: the penalised gradient at the fitted point is 0
    (rounded to 4 decimals)."""
    d = _lineitem_xy(spark, sf_dir)
    m = classify.logistic_newton(d, LR_FEATS, "y", C=1.0, weight_col="weight")
    p = m.probability()
    r = F.col("weight") * (p - F.col("y"))
    g = d.agg(*[F.sum(r * F.col(f)).alias(f) for f in LR_FEATS], F.sum(r).alias("intercept")).first()
    beta = dict(zip(LR_FEATS, m.coef), intercept=m.intercept)
    rows = [(f, float(round(g[f] + beta[f], 4)) + 0.0) for f in [*LR_FEATS, "intercept"]]
    return spark.createDataFrame(rows, "feature string, gradient double")


@register("coefficients_ranked")
def coefficients_ranked(spark, sf_dir):
    """ML15: coefficient, odds ratio, |coefficient|, ranked (rows-only: fitted values)."""
    m = classify.logistic_newton(_lineitem_xy(spark, sf_dir), LR_FEATS, "y", C=1.0, weight_col="weight")
    return rounded(classify.coefficient_table(spark, m))


@register("logistic_ml_lbfgs")
def logistic_ml_lbfgs(spark, sf_dir):
    """ML10: unweighted L2 logistic through pyspark.ml (rows-only)."""
    m = classify.logistic_ml(_lineitem_xy(spark, sf_dir), LR_FEATS, "y", C=1.0)
    return rounded(classify.coefficient_table(spark, m))


@register("logistic_grid_search")
def logistic_grid_search(spark, sf_dir):
    """ML13: C in {0.1, 1, 10}, stratified 3-fold, weighted F1; one aggregate per Newton
    iteration for all nine fits (rows-only)."""
    o = table(spark, sf_dir, "orders")
    d = o.select("o_orderkey", (F.col("o_totalprice") / 100000.0).alias("x_price"),
                 recode("o_orderpriority", PRIORITY_CODES).cast("double").alias("x_priority"),
                 indicator("o_orderstatus", "F").alias("y"))
    _, scores = classify.grid_search_logistic(d, ["x_price", "x_priority"], "y", "o_orderkey")
    return rounded(scores)


# ---------------------------------------------------------------- ML17 scoring + SF6 / SF8 / SF9
SCORE_FEATS = ["p_size", "p_retailprice"]
SCORE_CENTRES = [[-1.0, -1.0], [0.0, 0.0], [1.0, 1.0]]
SCORE_COEF, SCORE_INTERCEPT = [0.8, -0.5], 0.2
SCORE_RISK = [("p_size", "<", 25), ("p_retailprice", "<", 1500)]


@register("score_records", f"""
WITH s AS (SELECT avg(p_size) AS m1, coalesce(nullif(stddev_pop(p_size), 0), 1) AS s1,
                  avg(p_retailprice) AS m2, coalesce(nullif(stddev_pop(p_retailprice), 0), 1) AS s2 FROM part),
z AS (SELECT p_partkey, p_size, p_retailprice, (p_size - m1) / s1 AS z1, (p_retailprice - m2) / s2 AS z2 FROM part, s),
c AS (SELECT *, (z1 - (-1.0)) * (z1 - (-1.0)) + (z2 - (-1.0)) * (z2 - (-1.0)) AS d0,
                (z1 - 0.0) * (z1 - 0.0) + (z2 - 0.0) * (z2 - 0.0) AS d1,
                (z1 - 1.0) * (z1 - 1.0) + (z2 - 1.0) * (z2 - 1.0) AS d2,
                1.0 / (1.0 + exp(-(0.2 + z1 * 0.8 + z2 * -0.5))) AS prob FROM z)
SELECT p_partkey, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster,
  round(prob, 6) AS probability, CASE WHEN prob > 0.5 THEN 'high' ELSE 'low' END AS prediction,
  CASE WHEN prob * 100 >= 0 AND prob * 100 < 25 THEN '{PROBABILITY_BAND_NAMES[0]}'
       WHEN prob * 100 >= 25 AND prob * 100 < 50 THEN '{PROBABILITY_BAND_NAMES[1]}'
       WHEN prob * 100 >= 50 AND prob * 100 < 75 THEN '{PROBABILITY_BAND_NAMES[2]}'
       WHEN prob * 100 >= 75 AND prob * 100 <= 100 THEN '{PROBABILITY_BAND_NAMES[3]}' END AS band,
  CASE WHEN p_size < 25 THEN 0 ELSE 1 END AS p_size_risk,
  CASE WHEN p_retailprice < 1500 THEN 0 ELSE 1 END AS p_retailprice_risk,
  (CASE WHEN p_size < 25 THEN 0 ELSE 1 END) + (CASE WHEN p_retailprice < 1500 THEN 0 ELSE 1 END) AS n_risk_factors
FROM c""")
def score_records(spark, sf_dir):
    """ML17 + SF6 + SF8 + SF9: scaler, nearest centre, probability, label, band and
    risk flags as one projection."""
    p = table(spark, sf_dir, "part")
    scaler = features.fit_scaler(p, SCORE_FEATS)
    sc = Scorer(scaler=scaler, kmeans=KMeansModel(SCORE_FEATS, SCORE_CENTRES),
                logistic=classify.LogisticModel(SCORE_FEATS, SCORE_COEF, SCORE_INTERCEPT),
                positive="high", negative="low", band_edges=PROBABILITY_BAND_EDGES,
                band_names=PROBABILITY_BAND_NAMES, risk_rules=SCORE_RISK)
    return rounded(sc.transform(p, keep=["p_partkey"]))


# ---------------------------------------------------------------- ME1-ME6 on labels x documents
_LD_SQL = ("(SELECT l.doc_id, l.quality AS y, floor(d.n_chars / 1000.0) / (floor(d.n_chars / 1000.0) + 5.0) AS score "
           "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")
_LDP_SQL = f"(SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM {_LD_SQL})"


def _labelled(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")  # text is never read
    k = F.floor(F.col("n_chars") / 1000.0)
    d = lab.join(docs, "doc_id").select("doc_id", "y", (k / (k + 5.0)).alias("score"))
    return d.withColumn("pred", (F.col("score") > 0.5).cast("int"))


@register("confusion", f"""
SELECT g.actual, g.predicted, coalesce(c.n, 0) AS count
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(actual, predicted)) g
LEFT JOIN (SELECT y AS actual, pred AS predicted, count(*) AS n FROM {_LDP_SQL} GROUP BY 1, 2) c
ON g.actual = c.actual AND g.predicted = c.predicted""")
def confusion(spark, sf_dir):
    return metrics.confusion(_labelled(spark, sf_dir), "y", "pred")


@register("binary_metrics", f"""
WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
                  count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS tn
           FROM {_LDP_SQL})
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp, fp, fn, tn FROM c""")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(_labelled(spark, sf_dir), "y", "pred"))


@register("weighted_f1", f"""
WITH t AS {_LDP_SQL},
cls AS (SELECT y AS c FROM t UNION SELECT pred FROM t),
per AS (SELECT c, (SELECT count(*) FROM t WHERE y = c AND pred = c) AS tp, (SELECT count(*) FROM t WHERE y = c) AS support,
               (SELECT count(*) FROM t WHERE pred = c) AS npred FROM cls)
SELECT round(sum(coalesce(2.0 * tp / nullif(support + npred, 0), 0) * support) / sum(support), 6) AS f1_weighted FROM per""")
def weighted_f1(spark, sf_dir):
    return rounded(metrics.weighted_f1(_labelled(spark, sf_dir), "y", "pred"))


@register("roc_auc", f"""
WITH s AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
           FROM {_LD_SQL} GROUP BY score),
c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM s)
SELECT round(sum(pos * ((cum_neg - neg) + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_labelled(spark, sf_dir), "y", "score"))


@register("roc_curve", f"""
WITH s AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
           FROM {_LD_SQL} GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s),
c AS (SELECT score AS threshold,
             CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tps,
             CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fps,
             row_number() OVER (ORDER BY score DESC) AS i FROM s),
p AS (SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tps, CAST(0 AS BIGINT) AS fps, CAST(0 AS BIGINT) AS i
      UNION ALL SELECT * FROM c),
q AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tp1, lead(tps) OVER (ORDER BY i) AS tn1,
             lag(fps) OVER (ORDER BY i) AS fp1, lead(fps) OVER (ORDER BY i) AS fn1 FROM p)
SELECT i, round(threshold, 6) AS threshold, round(fps / (SELECT N FROM tot), 6) AS fpr,
       round(tps / (SELECT P FROM tot), 6) AS tpr
FROM q WHERE tp1 IS NULL OR tn1 IS NULL OR fp1 - 2 * fps + fn1 <> 0 OR tp1 - 2 * tps + tn1 <> 0""")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(_labelled(spark, sf_dir), "y", "score"))
