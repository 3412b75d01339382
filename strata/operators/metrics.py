"""Classification metrics: confusion matrix, accuracy / precision / recall / F1, weighted
F1, ROC-AUC (ties count half) and the ROC curve.

Counts come from one aggregate.  AUC / ROC first reduce the rows to one row per distinct
score (map-side combine), then need running totals in score order.  A global running sum
would put every distinct score in one task, so ``running_totals`` deals the rows out by
ranges of the score: each range gets a window of its own, and the ranges' totals, a row
each, shift them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.expr import safe_div
from strata.operators.common import broadcast_bounded, number
from strata.session import cut_lineage

BUCKET_ROWS = None  # rows of a range, about; None leaves the number of ranges to the caller or to Spark
GRID_CLASSES = 200  # a confusion matrix of more classes has no cells for pairs that don't occur


# --------------------------------------------------------------------------- ME5 / ME1-ME3


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """ME5: ``(actual, predicted, count)`` over the given ``labels`` and every class that occurs, so that
    no row is left out (NULLs count nowhere).  Up to ``GRID_CLASSES`` classes cells without rows are
    there too, with count 0; beyond, only the cells that have rows."""
    counts = cut_lineage(df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count")))
    t = df.schema[actual].dataType.simpleString()
    seen = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).where("c IS NOT NULL")
    if labels:
        seen = seen.unionByName(df.sparkSession.createDataFrame([(c,) for c in labels], f"c {t}"))
    seen = cut_lineage(seen.distinct())
    counts = counts.where("actual IS NOT NULL AND predicted IS NOT NULL")
    if seen.limit(GRID_CLASSES + 1).count() > GRID_CLASSES:
        return counts.orderBy("actual", "predicted")
    classes = F.array(*[F.lit(r["c"]).cast(t) for r in seen.orderBy("c").collect()])
    grid = seen.select(F.col("c").alias("actual"), F.explode(classes).alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["count"]).orderBy("actual", "predicted")


def _counts(actual: str, predicted: str, positive=1):
    y, p = F.col(actual), F.col(predicted)
    return (F.count_if((y == positive) & (p == positive)), F.count_if((y != positive) & (p == positive)),
            F.count_if((y == positive) & (p != positive)), F.count_if((y != positive) & (p != positive)))


def binary_metrics(df: DataFrame, actual: str, predicted: str, positive=1) -> DataFrame:
    """ME1 + ME2: accuracy and precision / recall / F1 of the positive class (0 when
    undefined), one aggregate."""
    tp, fp, fn, tn = _counts(actual, predicted, positive)
    c = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    prec = F.coalesce(safe_div("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(safe_div("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    acc = safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return c.select(acc.alias("accuracy"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    "tp", "fp", "fn", "tn")


def weighted_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """ME3: per-class F1 weighted by the class support (any number of classes)."""
    y, p = F.col(actual), F.col(predicted)
    classes = df.select(y.alias("c")).union(df.select(p.alias("c"))).distinct()
    pairs = df.groupBy(y.alias("a"), p.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    tp = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("c"), F.col("n").alias("tp"))
    sup = pairs.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("support"))
    pred = pairs.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("npred"))
    per = (classes.join(tp, "c", "left").join(sup, "c", "left").join(pred, "c", "left")
           .fillna(0, ["tp", "support", "npred"]))
    f1 = F.coalesce(safe_div(2 * F.col("tp"), F.col("support") + F.col("npred")), F.lit(0.0))
    return per.agg(safe_div(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"))


# --------------------------------------------------------------------------- running totals


def running_totals(d: DataFrame, order: str, cols: Sequence[str], ranges: int | None = None, following: Sequence[str] = (),
                   bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Add ``cum_<c>``, the sum of ``c`` over rows with ``order`` <= this row's (``order`` unique), and
    ``next_<c>``, the value of the next row, for ``following`` (NULL for the last).  No task holds
    more than a range of the rows; ``ranges`` sets their number, or ``bucket_rows`` the rows of each."""
    if bucket_rows and not ranges:
        ranges = max(1, -(-d.count() // bucket_rows))
    dealt = d.repartitionByRange(ranges, order) if ranges else d.repartitionByRange(order)
    parts = cut_lineage(dealt.withColumn("_p", F.spark_partition_id()))
    ends = parts.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols], *[F.min_by(c, order).alias(f"_f_{c}") for c in following])
    over = Window.orderBy("_p")  # a row for each range
    shifts = ends.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{c}") for c in cols],
                         *[F.lead(f"_f_{c}").over(over).alias(f"_n_{c}") for c in following])
    w = Window.partitionBy("_p").orderBy(order)
    within = parts.join(broadcast_bounded(cut_lineage(shifts)), "_p")
    last = F.lead(F.lit(1)).over(w).isNull()
    return within.select(
        *d.columns, *[(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols],
        *[F.when(last, F.col(f"_n_{c}")).otherwise(F.lead(c).over(w)).alias(f"next_{c}") for c in following])


def score_counts(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """One row per distinct score: ``(score, pos, neg)``; rows without a score, or with NaN, have no place."""
    y = F.col(actual)
    return df.where(number(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(y == positive).alias("pos"), F.count_if(y != positive).alias("neg"))


# --------------------------------------------------------------------------- ME4 / ME6


def roc_auc(df: DataFrame, actual: str, score: str, positive=1, ranges: int | None = None) -> DataFrame:
    """ME4: ``sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N)`` over distinct scores
    (the exact Mann-Whitney form, ties count half).  NULL when a class is absent."""
    sc = running_totals(score_counts(df, actual, score, positive), "score", ["neg"], ranges, ())
    term = F.col("pos").cast("double") * ((F.col("cum_neg") - F.col("neg")).cast("double")
                                          + F.col("neg").cast("double") / F.lit(2.0))
    return sc.agg(safe_div(F.sum(term), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def roc_curve(df: DataFrame, actual: str, score: str, positive=1, drop_intermediate: bool = True,
              ranges: int | None = None) -> DataFrame:
    """ME6: ``(fpr, tpr, threshold)`` by descending threshold, starting at (0, 0) with a
    NULL threshold; with ``drop_intermediate`` collinear interior points are removed
    (a point stays when the second difference of fps or tps is non-zero)."""
    sc = cut_lineage(score_counts(df, actual, score, positive).withColumns({"_neg_order": -F.col("score"), "_one": F.lit(1)}))
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    cum = running_totals(sc, "_neg_order", ["pos", "neg", "_one"], ranges, following=["pos", "neg"])
    if drop_intermediate:
        # a point is collinear if the step to it equals the step from it; the last has none
        cum = cum.where("next_pos IS NULL OR next_pos <> pos OR next_neg <> neg")
    points = cum.select(F.col("cum__one").cast("long").alias("i"), F.col("score").alias("threshold"), F.col("cum_neg").alias("fps"), F.col("cum_pos").alias("tps"))
    start = df.sparkSession.createDataFrame([(0, None, 0, 0)], "i long, threshold double, fps long, tps long")
    return start.unionByName(points).select("i", "threshold", safe_div("fps", F.lit(tot["N"])).alias("fpr"),
                                            safe_div("tps", F.lit(tot["P"])).alias("tpr"))
