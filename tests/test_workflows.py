"""The original analysis end to end on a small hand-made patient table."""

from pyspark.sql import functions as F

from strata.functions import vocab
from strata.plans import workflows

STAGES = ["Stage I", "Stage II", "Stage III", "Stage IV"]


def _raw(spark, n=40):
    rows = []
    for i in range(n):
        rows.append((f"P{i:03d}", float(40 + i % 30) if i % 11 else None, "Male" if i % 2 else "Female",
                     ["Lung", "Breast", "Liver", "Other"][i % 4], STAGES[i % 4], 1.0 + (i % 7) * 0.8,
                     "Yes" if i % 3 == 0 else "No", ["Surgery", "Combined", "Radiation"][i % 3],
                     float(i % 12), float(i % 20), ["Never", "Former", "Current"][i % 3],
                     ["None", "Moderate", "Heavy"][i % 3] if i % 13 else None,
                     "Survived" if (i % 4) < 2 else "Deceased", float(6 + i)))
    schema = ("PatientID string, Age double, Gender string, TumorType string, CancerStage string, TumorSize double, "
              "Metastasis string, TreatmentType string, ChemotherapySessions double, RadiationSessions double, "
              "SmokingStatus string, AlcoholUse string, SurvivalStatus string, FollowUpMonths double")
    return spark.createDataFrame(rows, schema)


def test_preprocess_cluster_classify_score(spark):
    pre = workflows.preprocess(_raw(spark))
    assert pre.columns == workflows.KEEP
    assert pre.where(F.col("Age").isNull()).count() == 0  # mean fill
    assert pre.where(F.col("AlcoholUse_encoded").isNull()).count() == 0  # mode fill then code
    cl = workflows.cluster_table(pre, k=3, n_init=2, sweep=[2, 3])
    assert cl.clustered.select("Cluster").distinct().count() <= 3
    assert cl.sweep.count() == 2
    clf = workflows.train_classifier(pre, vocab.CLUSTER_FEATURES, "SurvivalStatus_Survived", "PatientID",
                                     grid=(0.1, 1.0))
    assert clf.cv_scores.count() == 2 * 3
    m = clf.test_metrics.first()
    assert 0.0 <= m.accuracy <= 1.0
    sc = workflows.scorer_bundle(cl, clf)
    out = sc.transform(pre, keep=["PatientID"])
    assert set(out.columns) >= {"cluster", "probability", "prediction", "band", "n_risk_factors"}
    assert out.count() == 40
    again = load_scorer_after_saving(spark, sc)
    ev = workflows.evaluate(cl.clustered, again, "SurvivalStatus_Survived")
    assert ev.agreement.first()[0] == 100.0 and ev.scored.count() == 40
    assert ev.confusion.agg(F.sum("count")).first()[0] == 40 and 0 <= ev.auc.first().auc <= 1
    assert ev.roc.orderBy("i").first().fpr == 0 and 0 <= ev.weighted_f1.first()[0] <= 1
    assert {r.cluster for r in ev.survival_by_cluster.collect()} == {r.cluster for r in ev.profile.collect()}
    assert ev.coefficients.count() == len(vocab.CLUSTER_FEATURES)
    assert workflows.evaluate(pre, again, "SurvivalStatus_Survived").agreement.first()[0] == 100.0  # no stored clusters


def load_scorer_after_saving(spark, scorer):
    import uuid

    from strata.session import checkpoint_dir
    from strata.sources.versions import load_scorer, save_scorer

    root = f"{checkpoint_dir(spark)}/scorer-{uuid.uuid4().hex}"
    save_scorer(spark, scorer, root)
    return load_scorer(spark, root)
