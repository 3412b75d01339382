"""The ad-hoc explorer: each dashboard request becomes a function that returns the
DataFrame behind the picture (scatter points, bar means, box statistics, histogram
counts, cluster drill-down)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.expr import recode, row_hash
from strata.operators import distribution, missing, reshape
from strata.operators.common import drop_null_keys
from strata.operators.profile import group_rate


def _prepare(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    for c in (x, y, by):
        if c not in df.columns:
            raise ValueError(f"column not found: {c}")
    # MV5: if x or y holds a missing value, zero-fill x, y and the group column
    return missing.fill_zero_if_any_missing(df, [x, y], [c for c in {x, y, by}
                                                         if isinstance(df.schema[c].dataType, T.NumericType)])


def scatter(df: DataFrame, x: str, y: str, by: str = "cluster", fraction: float | None = None,
            key: str | None = None, seed: int = 42) -> DataFrame:
    """EX1: the ``(x, y, by)`` points; with ``fraction`` a repeatable hash sample (the sampling
    operator, for plots of very large tables), by ``key`` or else by the point itself."""
    d = _prepare(df, x, y, by)
    if fraction is not None and key is None:
        chosen = F.pmod(row_hash([x, y, by], seed), F.lit(1_000_000)) < F.lit(int(round(fraction * 1_000_000)))
        d = d.where(chosen)
    elif fraction is not None:
        d = reshape.sample_approx(d, key, fraction, seed)
    return d.select(x, y, by)


def bar(df: DataFrame, x: str, y: str, by: str = "cluster", bins: int = 10, max_distinct: int = 10) -> DataFrame:
    """EX2: mean of ``y`` per (x, by); a numeric ``x`` with more than ``max_distinct``
    values is cut into ``bins`` equal-width bins and the (bin, group) grid is completed.
    ``x == y`` gives the histogram of ``x`` by group."""
    d = _prepare(df, x, y, by)
    if x == y:
        return histogram(d, x, by)
    d2, key, edges = reshape.adaptive_key(d, x, bins, max_distinct)
    if edges is not None:
        g = distribution.group_mean_grid(d2, key, bins, by, y)
        return g.withColumns(reshape.bin_edge_columns(key, *edges))
    return drop_null_keys(d2, [key, by]).groupBy(key, by).agg(F.avg(F.col(y).cast("double")).alias(y))


def box(df: DataFrame, x: str, y: str, by: str = "cluster") -> DataFrame:
    """EX3: box statistics of ``y`` per (x, by)."""
    return distribution.box_stats(_prepare(df, x, y, by), y, [x, by])


def histogram(df: DataFrame, x: str, by: str = "cluster", bins: int | str = "auto") -> DataFrame:
    """EX4 / AG13: counts of ``x`` per bin and group."""
    return distribution.histogram(df, x, bins=bins, by=by)


def explore(df: DataFrame, x: str, y: str, kind: str = "histogram", by: str = "cluster", **kw) -> DataFrame:
    """EX5: dispatch on the plot kind with column validation."""
    if kind == "scatter":
        return scatter(df, x, y, by, **kw)
    if kind == "bar":
        return bar(df, x, y, by, **kw)
    if kind == "box":
        return box(df, x, y, by)
    return histogram(_prepare(df, x, y, by), x, by, **kw)


def cluster_drilldown(df: DataFrame, cluster: int, cluster_col: str = "cluster",
                      category: str | None = None, labels: Mapping | None = None,
                      target: str | None = None, fallback: str | None = None,
                      bins: int | str = "auto") -> DataFrame:
    """EX6: one cluster -> target rate per labelled category; without category/target
    columns the histogram of ``fallback``; else an empty frame."""
    if cluster_col not in df.columns:
        raise ValueError(f"column not found: {cluster_col}")
    sub = df.where(F.col(cluster_col) == F.lit(cluster))
    if category and target and category in df.columns and target in df.columns:
        lab = recode(category, labels) if labels else F.col(category)
        return group_rate(sub.withColumn("category_label", lab), ["category_label"], target, "rate")
    if fallback and fallback in df.columns:
        return distribution.histogram(sub, fallback, bins=bins)
    return df.sparkSession.createDataFrame([], "category_label string, rate double")
