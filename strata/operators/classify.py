"""Classification: class weights, majority baseline, L2 logistic regression (exact Newton
on Spark aggregates, or ``pyspark.ml``), stratified k-fold grid search, predictions,
ranked coefficients and the one-class repair.

Newton design: one pass per iteration adds up, in blocks of rows, the gradient and the weighted Gram
matrix of EVERY model being fitted - e.g. all grid values x all folds of a cross-validation -
so a 3x3 grid search costs about as many scans as a single fit.  The rows never leave the
executors; what moves is ``O(models * features^2)`` numbers a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import clamp_decrement, clamp_increment, nan_to_null, safe_div
from strata.operators.blocks import Blocks, ship
from strata.operators.common import broadcast_bounded, materialize_small, missing_cell, number
from strata.operators.quantiles import kth_smallest
from strata.operators.reshape import flag_first_m, hash_column
from strata.session import cut_lineage

ship(__name__)

# --------------------------------------------------------------------------- ML11 / ML12


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows by class, on the driver: for targets of few classes."""
    return {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()
            if r[target] is not None}


def balanced_weights(counts: Mapping) -> dict:
    """``n / (n_classes * n_c)`` per class."""
    n = sum(counts.values())
    k = len(counts)
    return {c: n / (k * v) for c, v in counts.items()}


def with_class_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """ML11: balanced weight column; the classes' weights stay a table, joined to the rows (broadcast
    behind a check of its size)."""
    counts = cut_lineage(df.where(~missing_cell(df, target)).groupBy(F.col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = counts.select("_class", safe_div(F.lit(total["n"]), F.col("_n") * F.lit(total["k"])).alias(out))
    return df.drop(out).join(broadcast_bounded(weights), F.col(target) == F.col("_class"), "left").drop("_class")


def majority_baseline(df: DataFrame, target: str, out: str = "prediction") -> tuple[object, DataFrame]:
    """ML12: the most frequent class (ties -> smallest) as a constant prediction."""
    counts = df.where(~missing_cell(df, target)).groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.desc("_n"), target).first()
    if best is None:
        raise ValueError("no row has a class")
    return best[target], df.withColumn(out, F.lit(best[target]))


# --------------------------------------------------------------------------- linear predictor


def linear_predictor(features: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for f, c in zip(features, coef):
        z = z + F.col(f).cast("double") * F.lit(float(c))
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@dataclass
class LogisticModel:
    features: list[str]
    coef: list[float]
    intercept: float
    C: float = 1.0
    iterations: int = 0
    info: dict = field(default_factory=dict)

    def probability(self) -> Column:
        return sigmoid(linear_predictor(self.features, self.coef, self.intercept))

    def transform(self, df: DataFrame, prob: str = "probability", pred: str = "prediction",
                  threshold: float = 0.5) -> DataFrame:
        """ML14: probability of class 1 and the class (``p > threshold``) as a projection; a row with a
        missing feature has neither."""
        return df.withColumn(prob, nan_to_null(self.probability())).withColumn(pred, (F.col(prob) > threshold).cast("int"))

    def params(self) -> dict:
        return {"features": self.features, "coef": self.coef, "intercept": self.intercept, "C": self.C}


# --------------------------------------------------------------------------- ML9 Newton


class NotConverged(RuntimeError):
    """A fit that its passes left unconverged."""


@dataclass
class _Spec:
    C: float
    class_weight: Mapping[float, float] | None = None
    without_fold: int | None = None  # rows of this fold have no part in the fit


def _weights(spec: _Spec, y: np.ndarray, w: np.ndarray, fold: np.ndarray) -> np.ndarray:
    if spec.class_weight is not None:
        w = w * np.select([y == c for c in spec.class_weight], list(spec.class_weight.values()), 0.0)
    return w if spec.without_fold is None else np.where(fold == spec.without_fold, 0.0, w)


def _training_blocks(df: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, fold: Column | None = None) -> Blocks:
    """Features, target, weight and fold of the rows in which none is missing."""
    extra = {"_y": number(target), "_w": F.lit(1.0) if weight is None else weight.cast("double"), "_f": F.lit(-1.0) if fold is None else fold.cast("double")}
    rows = df.select(*[number(f).alias(f"_x{i}") for i, f in enumerate(features)], *[c.alias(n) for n, c in extra.items()]).dropna()
    return Blocks(rows, rows.columns)


def _newton_many(blocks: Blocks, n_features: int, specs: Sequence[_Spec], penalize_intercept: bool, max_iter: int,
                 tol: float) -> list[tuple[np.ndarray, int, bool]]:
    """Fit len(specs) penalised logistic models together: per pass each task adds up, for every model that
    still moves, loss, gradient and weighted Gram matrix of its blocks.  A step that raises a model's
    objective is halved.  Returns coefficients (intercept last), passes and convergence."""
    d = n_features + 1
    size = 1 + d + d * d
    reg = np.ones(d)
    if not penalize_intercept:
        reg[-1] = 0.0
    betas, steps = [np.zeros(d) for _ in specs], [np.zeros(d) for _ in specs]
    best, iters, done = [math.inf] * len(specs), [0] * len(specs), [False] * len(specs)
    weigh = _weights
    for _ in range(max_iter):
        live = [m for m in range(len(specs)) if not done[m]]
        if not live:
            break
        now = [(specs[m], betas[m]) for m in live]

        def make(x: np.ndarray) -> np.ndarray:
            y, w, fold = x[:, d - 1], x[:, d], x[:, d + 1]
            x1 = np.column_stack([x[:, :d - 1], np.ones(len(x))])
            out = []
            for spec, beta in now:
                s = weigh(spec, y, w, fold)
                z = x1 @ beta
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                h = s * p * (1 - p)
                out += [[(s * (np.logaddexp(0, z) - y * z)).sum()], x1.T @ (s * (p - y)), ((x1 * h[:, None]).T @ x1).ravel()]
            return np.concatenate(out)

        sums = blocks.sum(make, size * len(live)).reshape(len(live), size)
        for m, row in zip(live, sums, strict=True):
            C, beta = specs[m].C, betas[m]
            iters[m] += 1
            value = C * row[0] + (reg * beta * beta).sum() / 2
            if value > best[m] + 1e-9 * abs(best[m]):
                steps[m] = steps[m] / 2
                betas[m] = beta + steps[m]  # back half the way
                continue
            best[m] = value
            steps[m] = np.linalg.solve(C * row[1 + d:].reshape(d, d) + np.diag(reg), C * row[1:1 + d] + reg * beta)
            betas[m] = beta - steps[m]
            done[m] = bool(np.max(np.abs(steps[m])) < tol)
    return list(zip(betas, iters, done, strict=True))


def _converged(iters: int, done: bool, strict: bool) -> dict:
    if strict and not done:
        raise NotConverged(f"no convergence after {iters} passes")
    return {"converged": done}


def logistic_newton(df: DataFrame, features: Sequence[str], target: str, C: float = 1.0,
                    weight_col: str | None = None, penalize_intercept: bool = True,
                    max_iter: int = 2000, tol: float = 1e-10, strict: bool = True) -> LogisticModel:
    """ML9: minimises ``1/2 |beta|^2 + C * sum_i w_i * logloss_i`` exactly (Newton).  With
    ``penalize_intercept`` the intercept is in the penalty too (liblinear's objective).  Rows with a missing
    feature, target or weight have no part.  Without convergence it raises, or says so in ``info`` if not ``strict``."""
    with _training_blocks(df, features, target, F.col(weight_col) if weight_col else None) as blocks:
        [(beta, it, done)] = _newton_many(blocks, len(features), [_Spec(C)], penalize_intercept, max_iter, tol)
    return LogisticModel(list(features), [float(x) for x in beta[:-1]], float(beta[-1]), C, it, _converged(it, done, strict))


def logistic_ml(df: DataFrame, features: Sequence[str], target: str, C: float = 1.0,
                weight_col: str | None = None, max_iter: int = 5000, strict: bool = True) -> LogisticModel:
    """ML9 / ML10 through ``pyspark.ml``: ``regParam = 1 / (C * sum w)`` gives the same
    objective with an unpenalised intercept (exact for the lbfgs reference fit)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    wsum = df.agg(F.sum(F.col(weight_col).cast("double")) if weight_col else F.count(F.lit(1))).first()[0]
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    lr = LogisticRegression(featuresCol="_features", labelCol=target, regParam=1.0 / (C * float(wsum)),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True,
                            maxIter=max_iter, tol=1e-10, family="binomial")
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    m = lr.fit(va.transform(df.withColumn(target, F.col(target).cast("double"))))
    it = m.summary.totalIterations
    return LogisticModel(list(features), [float(x) for x in m.coefficients], float(m.intercept), C, it, _converged(it, it < max_iter, strict))


# --------------------------------------------------------------------------- ML13 grid search


def stratified_folds(df: DataFrame, target: str, key: str, k: int = 3, seed: int = 42,
                     method: str = "xxhash64", out: str = "fold") -> DataFrame:
    """Exactly stratified k folds: within each class, rows ordered by (hash(key), key) are
    cut at the exact order statistics ``j * n_c / k`` (distributed selection per class; no
    window over a whole class)."""
    h = hash_column(key, seed, method).cast("double")
    data = df.select(F.col(target).alias("_cls"), h.alias("_v"))
    st = materialize_small(data.groupBy("_cls").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"),
                                                    F.max("_v").alias("hi")))
    rows = st.collect()
    spark = df.sparkSession
    tg = []
    for r in rows:
        for j in range(1, k):
            rank = int(math.ceil(j * r["n"] / k)) - 1
            if 0 <= rank < r["n"]:
                tg.append((r["_cls"], j, rank, r["n"], r["lo"], r["hi"]))
    if not tg:
        return df.withColumn(out, F.lit(0))
    cls_type = data.schema["_cls"].dataType.simpleString()
    tgt = spark.createDataFrame(tg, f"_cls {cls_type}, tid int, k long, n long, lo double, hi double")
    cuts = {(r["_cls"], r["tid"]): r["kth"] for r in kth_smallest(data, tgt, by=["_cls"]).collect()}
    # fold = number of cut points strictly below the row's hash (ties on a cut go low)
    fold = F.lit(0)
    for (c, j), v in cuts.items():
        fold = fold + F.when((F.col(target) == F.lit(c)) & (h > F.lit(v)), 1).otherwise(0)
    return df.withColumn(out, fold.cast("int"))


def _weighted_f1_from_counts(tp1, fp1, fn1, tp0, fp0, fn0) -> float:
    def f1(tp, fp, fn):
        d = 2 * tp + fp + fn
        return 0.0 if d == 0 else 2 * tp / d
    n1, n0 = tp1 + fn1, tp0 + fn0
    n = n1 + n0
    return 0.0 if n == 0 else (f1(tp1, fp1, fn1) * n1 + f1(tp0, fp0, fn0) * n0) / n


def grid_search_logistic(df: DataFrame, features: Sequence[str], target: str, key: str,
                         grid: Sequence[float] = (0.1, 1.0, 10.0), k: int = 3, balanced: bool = True,
                         seed: int = 42, penalize_intercept: bool = True, max_iter: int = 2000,
                         tol: float = 1e-10, method: str = "xxhash64", strict: bool = True) -> tuple[LogisticModel, DataFrame]:
    """ML13: stratified k-fold CV over ``C``, scored by weighted F1; ties keep the first
    candidate; the best ``C`` is refitted on all rows.  All grid x fold fits share each pass
    of Newton's method, and all scores one pass.  Rows with a missing feature or target have no part."""
    n = len(features)
    known = df.where(~reduce(or_, [number(c).isNull() for c in (*features, target)]))
    folded = stratified_folds(known, target, key, k, seed, method)
    with _training_blocks(folded, features, target, fold=F.col("fold")) as blocks:
        def counts(x: np.ndarray) -> np.ndarray:  # rows by fold and class
            return np.array([[(x[:, n + 2] == f) & (x[:, n] == c) for c in (0, 1)] for f in range(k)]).sum(axis=2).ravel().astype(float)

        cnt = blocks.sum(counts, 2 * k).reshape(k, 2)

        def weights(rows: np.ndarray) -> dict | None:
            found = {float(c): v for c, v in enumerate(rows) if v}
            return balanced_weights(found) if balanced else None

        specs = [_Spec(C, weights(cnt.sum(axis=0) - cnt[f]), f) for C in grid for f in range(k)]
        fits = _newton_many(blocks, n, specs, penalize_intercept, max_iter, tol)
        for _, it, done in fits:
            _converged(it, done, strict)
        held = [(spec.without_fold, beta) for spec, (beta, _, _) in zip(specs, fits, strict=True)]

        def outcomes(x: np.ndarray) -> np.ndarray:  # tp1, fp1, fn1, tp0 of each fit on the fold that it left out
            out = []
            for f, beta in held:
                own = x[x[:, n + 2] == f]
                y, p = own[:, n] == 1, own[:, :n] @ beta[:-1] + beta[-1] > 0
                out += [(y & p).sum(), (~y & p).sum(), (y & ~p).sum(), (~y & ~p).sum()]
            return np.array(out, float)

        found = blocks.sum(outcomes, 4 * len(specs)).reshape(-1, 4)
        rows = [(float(spec.C), spec.without_fold, float(_weighted_f1_from_counts(tp1, fp1, fn1, tp0, fn1, fp1)))
                for spec, (tp1, fp1, fn1, tp0) in zip(specs, found, strict=True)]
        mean = {C: np.mean([s for c, _, s in rows if c == C]) for C in grid}
        best = max(grid, key=lambda c: (mean[c], -list(grid).index(c)))
        [(beta, it, done)] = _newton_many(blocks, n, [_Spec(best, weights(cnt.sum(axis=0)))], penalize_intercept, max_iter, tol)
    scores = df.sparkSession.createDataFrame(rows, "C double, fold int, f1_weighted double")
    info = {**_converged(it, done, strict), "cv_mean_f1": {float(c): float(v) for c, v in mean.items()}}
    return LogisticModel(list(features), [float(x) for x in beta[:-1]], float(beta[-1]), float(best), it, info), scores


# --------------------------------------------------------------------------- ML15 coefficients


def coefficient_table(spark, model: LogisticModel, k: int | None = None) -> DataFrame:
    """ML15: ``(feature, coefficient, odds_ratio, abs_coefficient)`` ranked by
    ``|coefficient|`` desc (ties by name); ``k`` keeps the top k (the report's feature)."""
    df = spark.createDataFrame(list(zip(model.features, model.coef)), "feature string, coefficient double")
    out = df.withColumns({"odds_ratio": F.exp("coefficient"), "abs_coefficient": F.abs("coefficient")}) \
        .orderBy(F.desc("abs_coefficient"), "feature")
    return out.limit(k) if k else out


# --------------------------------------------------------------------------- ML16 one-class repair

_RULES = {
    "decrement": lambda c, a: clamp_decrement(c, a),
    "increment": lambda c, a: clamp_increment(c, a),
    "set": lambda c, a: F.lit(a),
    "add": lambda c, a: F.col(c) + F.lit(a),
}


def synthesize_missing_class(df: DataFrame, target: str, key: str, fraction: float = 0.2, seed: int = 42,
                             rules: Mapping | None = None, method: str = "xxhash64",
                             flag: str = "is_synthetic") -> DataFrame:
    """ML16: when ``target`` holds a single class, copy an exact ``int(fraction * n)``
    keyed sample, flip its label and shift its features by ``rules`` (``{col: (op, arg)}``
    with op in decrement/increment/set/add, or ``{missing_class: {...}}``); columns absent
    from the table are skipped.  Off (flag only) when both classes exist."""
    st = df.agg(F.count_distinct(target).alias("k"), F.min(target).alias("c"), F.count(F.lit(1)).alias("n")).first()
    base = df.withColumn(flag, F.lit(False))
    if st["k"] != 1:
        return base
    existing = st["c"]
    missing_cls = 1 if existing == 0 else 0
    rules = rules or {}
    if missing_cls in rules and isinstance(rules[missing_cls], Mapping):
        rules = rules[missing_cls]
    m = int(fraction * st["n"])
    picked = flag_first_m(df, key, m, seed, method, "_pick").where("_pick").drop("_pick")
    shifted = {c: _RULES[op](c, arg).cast(df.schema[c].dataType)
               for c, (op, arg) in rules.items() if c in df.columns}
    shifted[target] = F.lit(missing_cls).cast(df.schema[target].dataType)
    syn = picked.withColumns(shifted).withColumn(flag, F.lit(True))
    return base.unionByName(syn)
