"""End-to-end workflows of the original patient analysis, composed from the operators:

A. raw table -> impute -> encode -> project -> mean-impute -> scale -> k-means -> profile
B. features -> rule fill -> (one-class repair) -> split -> grid search -> metrics -> coefficients
C. a fitted bundle scores any DataFrame (batch or stream) in one projection

Each step is lazy except the small fits; the scaled feature table is persisted once before
the iterative fits and released after.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import vocab
from strata.operators import classify, cluster, features, metrics, missing, profile, reshape
from strata.operators.encode import encode_table
from strata.operators.score import Scorer

RECODES = {
    "TumorType_encoded": ("TumorType", vocab.TUMOR_TYPE_CODES),
    "TreatmentType_encoded": ("TreatmentType", vocab.TREATMENT_TYPE_CODES),
    "CancerStage_encoded": ("CancerStage", vocab.CANCER_STAGE_CODES),
    "SmokingStatus_encoded": ("SmokingStatus", vocab.SMOKING_STATUS_CODES),
    "AlcoholUse_encoded": ("AlcoholUse", vocab.ALCOHOL_USE_CODES),
}
INDICATORS = {f"{c}_{'Male' if c == 'Gender' else v}": (c, v) for c, v in vocab.BINARY_INDICATORS.items()}
KEEP = ["PatientID", "Age", "TumorSize", "ChemotherapySessions", "RadiationSessions", "CancerStage_encoded",
        "TreatmentType_encoded", "SmokingStatus_encoded", "AlcoholUse_encoded", "Gender_Male", "Metastasis_Yes",
        "TumorType_encoded", "SurvivalStatus_Survived", "FollowUpMonths"]


def preprocess(raw: DataFrame, recodes: Mapping = RECODES, indicators: Mapping = INDICATORS,
               keep: Sequence[str] = KEEP) -> DataFrame:
    """A1-A4: numeric mean fill, string mode fill, recode + indicators, projection."""
    filled = missing.fill_mode(missing.fill_mean(raw))
    return encode_table(filled, recodes, indicators, keep)


@dataclass
class ClusterResult:
    clustered: DataFrame
    scaler: features.ScalerModel
    kmeans: cluster.KMeansModel
    profile: DataFrame
    sweep: DataFrame | None


def cluster_table(df: DataFrame, feats: Sequence[str] = vocab.CLUSTER_FEATURES, k: int = 3, n_init: int = 10,
                  sweep: Sequence[int] | None = None, profile_cols: Sequence[str] = vocab.PROFILE_FEATURES,
                  seed: int = 42) -> ClusterResult:
    """A6-A13: mean-impute the features, standardise, optional k sweep, best-of-restarts
    k-means, labels back on the rows (a projection), per-cluster profile."""
    imp = missing.fit_mean_imputer(df, feats)
    base = imp.transform(df)
    scaler = features.fit_scaler(base, feats)
    scaled = scaler.transform(base, "__z").persist(StorageLevel.MEMORY_AND_DISK)
    zf = [f"{f}__z" for f in feats]
    try:
        sw = cluster.k_sweep(scaled, zf, sweep, n_init, seed) if sweep else None
        km = cluster.kmeans_best_of(scaled, zf, k, n_init, seed)
    finally:
        scaled.unpersist()
    model = cluster.KMeansModel(list(feats), km.centres, km.iterations, km.cost)
    clustered = scaler.transform(base, "__z").withColumn("Cluster", cluster.nearest_centre(zf, km.centres)).drop(*zf)
    prof = cluster.cluster_profile(clustered, "Cluster", [c for c in profile_cols if c in clustered.columns])
    return ClusterResult(clustered, scaler, model, prof, sw)


@dataclass
class ClassifierResult:
    model: classify.LogisticModel
    cv_scores: DataFrame
    test_metrics: DataFrame
    auc: DataFrame
    confusion: DataFrame
    coefficients: DataFrame
    weighted_f1: DataFrame
    roc: DataFrame


def train_classifier(df: DataFrame, feats: Sequence[str], target: str, key: str, rules: Mapping = vocab.FILL_RULES,
                     grid: Sequence[float] = (0.1, 1.0, 10.0), test_fraction: float = 0.2, seed: int = 42,
                     repair_rules: Mapping | None = None) -> ClassifierResult:
    """B2-B10: rule fill (+ zero fill), one-class repair when asked, split FIRST (no
    leakage), grid search on train, metrics on the held-out rows, ranked coefficients."""
    d = missing.fill_zero(missing.fill_by_rules(df, rules, vocab.MEDIAN_FALLBACKS))
    if repair_rules is not None:
        d = classify.synthesize_missing_class(d, target, key, 0.2, seed, repair_rules)
    split = reshape.split_train_test(d, key, test_fraction, seed)
    train = split.where(~F.col("is_test"))
    test = split.where(F.col("is_test") & ~F.col("is_synthetic") if "is_synthetic" in split.columns else F.col("is_test"))
    model, scores = classify.grid_search_logistic(train, feats, target, key, grid, seed=seed)
    scored = model.transform(test)
    return ClassifierResult(model, scores, metrics.binary_metrics(scored, target, "prediction"),
                            metrics.roc_auc(scored, target, "probability"),
                            metrics.confusion(scored, target, "prediction"),
                            classify.coefficient_table(df.sparkSession, model),
                            metrics.weighted_f1(scored, target, "prediction"), metrics.roc_curve(scored, target, "probability"))


@dataclass
class Evaluation:
    scored: DataFrame
    agreement: DataFrame
    profile: DataFrame
    survival_by_cluster: DataFrame
    metrics: DataFrame
    weighted_f1: DataFrame
    auc: DataFrame
    confusion: DataFrame
    roc: DataFrame
    coefficients: DataFrame


def evaluate(df: DataFrame, scorer: Scorer, target: str, stored_cluster: str | None = "Cluster",
             profile_cols: Sequence[str] = vocab.PROFILE_FEATURES, rules: Mapping = vocab.FILL_RULES) -> Evaluation:
    """Re-score a table with a (loaded) bundle: rule fill, clusters again and their agreement with the stored
    ones (100 % if none are), profiles, target rate by cluster, metrics, curve and coefficients.  Rows
    without a target are scored but have no part in the metrics."""
    filled = missing.fill_by_rules(df, rules, vocab.MEDIAN_FALLBACKS)
    stored = "stored_cluster" if stored_cluster in df.columns else None
    filled = filled.withColumnRenamed(stored_cluster, stored) if stored else filled  # names differ in more than case
    scored = scorer.transform(filled, keep=filled.columns).withColumn("predicted_class", (F.col("prediction") == scorer.positive).cast("int"))
    known = scored.where(F.col(target).isNotNull())
    return Evaluation(
        scored, cluster.cluster_agreement(scored, stored, "cluster"),
        cluster.cluster_profile(scored, "cluster", [c for c in profile_cols if c in df.columns]),
        profile.group_rate(scored, ["cluster"], target, "rate"),
        metrics.binary_metrics(known, target, "predicted_class"), metrics.weighted_f1(known, target, "predicted_class"),
        metrics.roc_auc(known, target, "probability"), metrics.confusion(known, target, "predicted_class"),
        metrics.roc_curve(known, target, "probability"), classify.coefficient_table(df.sparkSession, scorer.logistic))


def scorer_bundle(cl: ClusterResult, clf: ClassifierResult, threshold: float = 0.5, inclusive: bool = False
                  ) -> Scorer:
    """C: one scaler for the centres, and the classifier on the raw features it was
    trained on (no mixed scaling): cluster, probability, label, band, risk flags."""
    return Scorer(scaler=cl.scaler, kmeans=cl.kmeans, logistic=clf.model, scale_logistic=False,
                  threshold=threshold, inclusive=inclusive,
                  positive=vocab.POSITIVE_LABEL, negative=vocab.NEGATIVE_LABEL,
                  band_edges=vocab.PROBABILITY_BAND_EDGES, band_names=vocab.PROBABILITY_BAND_NAMES,
                  risk_rules=vocab.RISK_RULES)
