"""Feature transforms: standardisation (fit / apply) and PCA.

Fits are one aggregate each (means + population sd; the covariance matrix as
``d(d+1)/2`` stable co-moment aggregates); the small ``d x d`` eigenproblem is solved on
the driver; transforms are projections with the fitted numbers as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.common import number


@dataclass
class ScalerModel:
    features: list[str]
    means: list[float]
    scales: list[float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """FT3: ``(x - mean) / scale`` (a zero scale was replaced by 1 at fit time)."""
        return df.withColumns({f"{f}{suffix}": (F.col(f).cast("double") - F.lit(m)) / F.lit(s)
                               for f, m, s in zip(self.features, self.means, self.scales)})

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.features, self.means, self.scales)),
                                     "feature string, mean double, scale double")

    def params(self) -> dict:
        return {"features": self.features, "means": self.means, "scales": self.scales}


def fit_scaler(df: DataFrame, features: Sequence[str]) -> ScalerModel:
    """FT1 / FT2: mean and POPULATION standard deviation per feature in one aggregate; a
    constant feature gets scale 1 (so it standardises to 0)."""
    r = df.agg(*[F.avg(number(f)).alias(f"m{i}") for i, f in enumerate(features)],
               *[F.stddev_pop(number(f)).alias(f"s{i}") for i, f in enumerate(features)]).first()
    means = [r[f"m{i}"] for i in range(len(features))]
    scales = [(r[f"s{i}"] if r[f"s{i}"] not in (None, 0.0) else 1.0) for i in range(len(features))]
    return ScalerModel(list(features), means, scales)


def standardize(df: DataFrame, features: Sequence[str], suffix: str = "") -> tuple[DataFrame, ScalerModel]:
    m = fit_scaler(df, features)
    return m.transform(df, suffix), m


@dataclass
class PCAModel:
    features: list[str]
    means: list[float]
    components: np.ndarray  # k x d, rows are unit loadings
    explained_variance: list[float]

    def transform(self, df: DataFrame, prefix: str = "PC") -> DataFrame:
        """FT6: the component scores as a projection of the same row (no join)."""
        out = {}
        for j, comp in enumerate(self.components):
            s = F.lit(0.0)
            for f, m, w in zip(self.features, self.means, comp):
                s = s + (F.col(f).cast("double") - F.lit(m)) * F.lit(float(w))
            out[f"{prefix}{j + 1}"] = s
        return df.withColumns(out)

    def params(self) -> dict:
        return {"features": list(self.features), "means": [float(m) for m in self.means],
                "components": [[float(w) for w in c] for c in self.components], "explained_variance": [float(v) for v in self.explained_variance]}

    @classmethod
    def from_params(cls, p: dict) -> PCAModel:
        return cls(p["features"], p["means"], np.array(p["components"]), p["explained_variance"])

    def loadings(self, spark) -> DataFrame:
        rows = [(j + 1, f, float(w), float(self.explained_variance[j]))
                for j, comp in enumerate(self.components) for f, w in zip(self.features, comp)]
        return spark.createDataFrame(rows, "component int, feature string, loading double, explained_variance double")


def covariance(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sample covariance matrix and means in one aggregate (rows with a NULL feature are
    dropped first, as PCA needs complete rows)."""
    d = len(features)
    cols = [F.col(f).cast("double") for f in features]
    full = df.select(*[c.alias(f) for c, f in zip(cols, features)]).dropna()
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]
    aggs += [F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    r = full.agg(*aggs).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return cov, np.array([r[f"m{i}"] for i in range(d)]), r["n"]


def canonical_signs(components: np.ndarray) -> np.ndarray:
    """Sign rule: the loading of largest magnitude of each component is positive."""
    out = components.copy()
    for j in range(out.shape[0]):
        if out[j, int(np.argmax(np.abs(out[j])))] < 0:
            out[j] = -out[j]
    return out


WIDE_FEATURES = 16  # above this, the d(d+1)/2 co-moment aggregates get too wide for one codegen stage


def fit_pca(df: DataFrame, features: Sequence[str], k: int = 2) -> PCAModel:
    """FT4 / FT5: principal axes of the centred data (feed standardised columns for FT4).

    Up to ``WIDE_FEATURES`` columns the covariance is one SQL aggregate; wider inputs use
    ``pyspark.ml.feature.PCA`` (tree-aggregated covariance on the JVM) and one aggregate of
    means and variances to turn its variance ratios back into eigenvalues."""
    feats = list(features)
    if len(feats) <= WIDE_FEATURES:
        cov, means, _ = covariance(df, feats)
        vals, vecs = np.linalg.eigh(cov)
        order = np.argsort(vals)[::-1][:k]
        comps = canonical_signs(vecs[:, order].T)
        return PCAModel(feats, [float(m) for m in means], comps, [float(vals[i]) for i in order])
    from pyspark.ml.feature import PCA, VectorAssembler

    full = df.select(*[F.col(f).cast("double").alias(f) for f in feats]).dropna()
    r = full.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(feats)],
                 *[F.var_samp(f).alias(f"v{i}") for i, f in enumerate(feats)]).first()
    means = [r[f"m{i}"] for i in range(len(feats))]
    trace = sum((r[f"v{i}"] or 0.0) for i in range(len(feats)))
    vec = VectorAssembler(inputCols=feats, outputCol="_x").transform(full).select("_x")
    m = PCA(k=k, inputCol="_x").fit(vec)
    comps = canonical_signs(m.pc.toArray().T)
    return PCAModel(feats, means, comps, [float(x) * trace for x in m.explainedVariance.toArray()])


def pca(df: DataFrame, features: Sequence[str], k: int = 2, scale: bool = True, keep: Sequence[str] = ()
        ) -> tuple[DataFrame, PCAModel]:
    """``scale=True``: standardise then project (FT4); ``scale=False``: centre only (FT5)."""
    src = df
    feats = list(features)
    if scale:
        src, _ = standardize(df, feats)
    model = fit_pca(src, feats, k)
    out = model.transform(src).select(*keep, *[f"PC{j + 1}" for j in range(k)])
    return out, model
