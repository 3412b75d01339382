"""Sinks and model persistence.

A job never overwrites the table it read in the same plan (the patient pipeline overwrote
its own input); writes go to a new path or a new version folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.vocab import PREDICTION_COLUMNS


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None, header: bool = True) -> str:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def save_params(spark: SparkSession, params: dict, path: str, mode: str = "overwrite") -> str:
    """Persist a small fitted model (means, scales, centres, coefficients) as a one-column
    JSON parquet row: readable from any language, no pickles."""
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1) \
        .write.mode(mode).parquet(path)
    return path


def load_params(spark: SparkSession, path: str) -> dict:
    row = spark.read.parquet(path).first()
    return json.loads(row["params"])


def write_prediction(scored: DataFrame, path: str, cluster_col: str = "cluster",
                     prob_col: str = "probability", label_col: str = "prediction",
                     fmt: str = "csv") -> str:
    """SK3, the prediction sink: ``(Cluster, Survival_Probability, Prediction)`` per record."""
    named = zip((cluster_col, prob_col, label_col), PREDICTION_COLUMNS, strict=True)
    return write_table(scored.select(*[F.col(c).alias(n) for c, n in named]), path, fmt=fmt, mode="overwrite")
