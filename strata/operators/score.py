"""Batch scoring: records -> cluster, probability, label, probability band and risk flags,
as ONE projection over any DataFrame (N = 1 is not special; no shuffle, no join), so the
same function scores a table, a stream or a single form record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import band, compare, nan_to_null, nan_to_num, threshold_label
from strata.operators.classify import LogisticModel
from strata.operators.cluster import KMeansModel
from strata.operators.common import number, require_columns
from strata.operators.features import PCAModel, ScalerModel
from strata.operators.missing import MeanImputerModel

FORMAT = 1  # of the parameters
_PLAIN = ("threshold", "inclusive", "positive", "negative", "band_edges", "band_names", "scale_logistic", "missing")


@dataclass
class Scorer:
    scaler: ScalerModel | None
    kmeans: KMeansModel | None
    logistic: LogisticModel
    threshold: float = 0.5
    inclusive: bool = False
    positive: str = "Survived"
    negative: str = "Deceased"
    band_edges: Sequence[float] = (0, 25, 50, 75, 100)
    band_names: Sequence[str] | None = None
    risk_rules: Sequence[tuple[str, str, float]] = ()
    scale_logistic: bool = True  # False: the classifier was trained on unscaled features
    missing: str = "zero"  # a missing (NULL, NaN) feature scores as 0, an infinite one as the largest double; "null": not scored
    imputer: MeanImputerModel | None = None  # applied first
    pca: PCAModel | None = None  # kept with the bundle

    def params(self) -> dict:
        """Plain values that ``from_params`` rebuilds the scorer from."""
        plain = {f: getattr(self, f) for f in _PLAIN}
        return {"format": FORMAT, **plain, "risk_rules": [list(r) for r in self.risk_rules],
                "scaler": self.scaler.params() if self.scaler else None, "logistic": self.logistic.params(),
                "kmeans": {"features": list(self.kmeans.features), "centres": [list(map(float, c)) for c in self.kmeans.centres],
                           "cost": self.kmeans.cost} if self.kmeans else None,
                "imputer": self.imputer.means if self.imputer else None, "pca": self.pca.params() if self.pca else None}

    @classmethod
    def from_params(cls, p: dict) -> Scorer:
        if p.get("format") != FORMAT:
            raise ValueError(f"bundle of format {p.get('format')}, not {FORMAT}")
        k, lo = p["kmeans"], p["logistic"]
        return cls(scaler=ScalerModel(**p["scaler"]) if p["scaler"] else None,
                   kmeans=KMeansModel(k["features"], k["centres"], cost=k["cost"]) if k else None,
                   logistic=LogisticModel(lo["features"], lo["coef"], lo["intercept"], lo["C"]),
                   imputer=MeanImputerModel(p["imputer"]) if p["imputer"] else None,
                   pca=PCAModel.from_params(p["pca"]) if p["pca"] else None,
                   risk_rules=[tuple(r) for r in p["risk_rules"]], **{f: p[f] for f in _PLAIN})

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        feats = list(self.logistic.features)
        need = feats + [f for f in (self.kmeans.features if self.kmeans else []) if f not in feats]
        d = require_columns(df, need, missing="zero")  # an absent feature scores as 0
        if self.imputer is not None:
            d = self.imputer.transform(d)
        if self.missing not in ("zero", "null"):
            raise ValueError(f"unknown policy for missing features: {self.missing}")
        cleaned = {f: nan_to_num(f) if self.missing == "zero" else number(f) for f in need}
        kept = {f"__own_{c}": F.col(c) for c in keep if c in cleaned}  # columns asked for come back as given
        d = d.withColumns(kept).withColumns(cleaned)
        out = self.scaler.transform(d, "__s") if self.scaler else d
        sfx = "__s" if self.scaler else ""
        if self.kmeans is not None:
            km = KMeansModel([f"{f}{sfx}" for f in self.kmeans.features], self.kmeans.centres)
            out = km.transform(out, "cluster")
        lsfx = sfx if self.scale_logistic else ""
        lm = LogisticModel([f"{f}{lsfx}" for f in feats], self.logistic.coef, self.logistic.intercept)
        out = out.withColumn("probability", nan_to_null(lm.probability()))
        out = out.withColumn("prediction", threshold_label("probability", self.threshold, self.inclusive,
                                                           self.positive, self.negative))
        out = out.withColumn("band", band(F.col("probability") * 100, list(self.band_edges),
                                          list(self.band_names) if self.band_names else None))
        flags = []
        for c, op, v in self.risk_rules:
            name = f"{c}_risk"
            out = out.withColumn(name, (~compare(c, op, v)).cast("int"))
            flags.append(name)
        if flags:
            total = None
            for f in flags:
                total = F.col(f) if total is None else total + F.col(f)
            out = out.withColumn("n_risk_factors", total)
        cols = [*[F.col(f"__own_{c}").alias(c) if c in cleaned else c for c in keep], *(["cluster"] if self.kmeans is not None else []), "probability", "prediction", "band",
                *flags, *(["n_risk_factors"] if flags else [])]
        return out.select(*cols)
