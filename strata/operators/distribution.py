"""Distributions: histograms (numpy 'auto' bins), Gaussian density curve, histograms by
group, box statistics and the bin x group grid completion.

All of them aggregate the rows first (map-side partial aggregation) and only complete or
reshape the tiny aggregated result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.blocks import Blocks
from strata.operators.common import broadcast_bounded, drop_null_keys, finite, materialize_small, number
from strata.operators.quantiles import quantiles

# --------------------------------------------------------------------------- bin layout


def auto_bin_count(n: int, lo: float, hi: float, q25: float | None, q75: float | None) -> int:
    """numpy ``bins='auto'``: the narrower of Sturges and Freedman-Diaconis widths (FD
    ignored when the IQR is 0)."""
    if n == 0 or hi is None or lo is None:
        return 1
    rng = hi - lo
    if rng == 0:
        return 1
    sturges = rng / (math.log2(n) + 1.0)
    iqr = (q75 - q25) if q75 is not None and q25 is not None else 0.0
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(rng / width)))


def bin_layout(df: DataFrame, column: str, bins: int | str = "auto") -> dict:
    """``{n, lo, hi, bins}`` from one moments pass (+ exact quartiles for 'auto'), of the finite values."""
    x = finite(number(column))
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                F.stddev_samp(x).alias("sd")).first()
    n, lo, hi = st["n"], st["lo"], st["hi"]
    if bins == "auto":
        q = {r["prob"]: r["value"] for r in quantiles(df.select(x.alias(column)), [column], [0.25, 0.75]).collect()}
        nb = auto_bin_count(n, lo, hi, q.get(0.25), q.get(0.75))
    else:
        nb = int(bins)
    if lo is not None and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return {"n": n, "lo": lo, "hi": hi, "bins": nb, "sd": st["sd"]}


def _bin_index(column: str, lo: float, hi: float, nb: int):
    """numpy ``histogram`` rule: bins ``[e_i, e_{i+1})``, the last closed, with the
    edge correction against ``e_i = lo + i * (hi - lo) / nb``; infinite values fall into the end bins."""
    x = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(column).cast("double")))
    step = (hi - lo) / nb
    idx = F.least(F.lit(nb - 1), F.floor((x - F.lit(lo)) * F.lit(nb / (hi - lo))).cast("int"))
    edge = lambda i: F.when(i >= nb, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))
    idx = F.when(x < edge(idx), idx - 1).otherwise(idx)
    idx = F.when((x >= edge(idx + 1)) & (idx != nb - 1), idx + 1).otherwise(idx)
    return idx


def _edges_of(b: DataFrame, lo: float, hi: float, nb: int) -> DataFrame:
    step = (hi - lo) / nb
    return b.withColumns({
        "bin_lo": F.col("bin").cast("double") * F.lit(step) + F.lit(lo),
        "bin_hi": F.when(F.col("bin") == nb - 1, F.lit(hi))
                   .otherwise((F.col("bin") + 1).cast("double") * F.lit(step) + F.lit(lo))})


def _edges(spark, lo: float, hi: float, nb: int) -> DataFrame:
    return _edges_of(spark.range(nb).select(F.col("id").cast("int").alias("bin")), lo, hi, nb)


# --------------------------------------------------------------------------- AG12 / AG13 / AG14


def histogram(df: DataFrame, column: str, bins: int | str = "auto", by: str | None = None) -> DataFrame:
    """Counts per bin ``(bin, bin_lo, bin_hi, [by], count)``, empty bins included (with
    ``by``: every bin for every group that has rows).  Bins are global (shared by groups); edges come
    from the finite values, and infinite ones count in the end bins.  Without a finite value there
    are no bins."""
    lay = bin_layout(df, column, bins)
    spark = df.sparkSession
    keys = [by] if by else []
    if lay["n"] == 0:
        group = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
        return spark.createDataFrame([], f"bin int, bin_lo double, bin_hi double, {group}count long")
    lo, hi, nb = lay["lo"], lay["hi"], lay["bins"]
    base = drop_null_keys(df.where(number(column).isNotNull()), keys)
    counts = (base.select(*keys, _bin_index(column, lo, hi, nb).alias("bin"))
              .groupBy("bin", *keys).agg(F.count(F.lit(1)).alias("count")))
    if by:
        # every bin for every group: a generator over the distinct groups, not a join
        grid = _edges_of(base.select(by).distinct().withColumn(
            "bin", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))), lo, hi, nb)
    else:
        grid = _edges(spark, lo, hi, nb)
    out = grid.join(counts, ["bin", *keys], "left").fillna(0, ["count"])
    return out.select("bin", "bin_lo", "bin_hi", *keys, "count")


def density_curve(df: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density, Scott bandwidth ``sd * n^(-1/5)``, on ``gridsize`` points
    from ``min - cut*bw`` to ``max + cut*bw``.  Exact: every task adds up the kernels of its
    blocks of rows on the grid; one array of ``gridsize`` sums a task moves.  Infinite values have no place
    on the curve: it is that of the finite ones."""
    x = number(column)
    x = finite(x)
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                F.stddev_samp(x).alias("sd")).first()
    spark = df.sparkSession
    n, lo, hi, sd = st["n"], st["lo"], st["hi"], st["sd"]
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "point int, x double, density double")
    bw = sd * n ** (-0.2)
    g0, g1 = lo - cut * bw, hi + cut * bw
    step = (g1 - g0) / (gridsize - 1)
    pts = [g0 + i * step for i in range(gridsize)]
    pts[-1] = g1
    coef = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    grid = np.array(pts)

    def make(values: np.ndarray) -> np.ndarray:
        v = values[np.isfinite(values[:, 0]), 0]
        return np.exp(-0.5 * ((grid[None, :] - v[:, None]) / bw) ** 2).sum(axis=0)

    with Blocks(df, [x], keep=False) as blocks:
        sums = blocks.sum(make, gridsize)
    rows = [(i, p, float(k * coef)) for i, (p, k) in enumerate(zip(pts, sums, strict=True))]
    return spark.createDataFrame(rows, "point int, x double, density double")


# --------------------------------------------------------------------------- AG16 box


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per group: n, min, q1, median, q3, max, whiskers (extreme points inside
    ``[q1 - 1.5 iqr, q3 + 1.5 iqr]``) and the outlier count.  Quartiles are exact
    (linear interpolation); the whisker pass joins the rows to the per-group fences."""
    by = list(by)
    base = drop_null_keys(df.where(number(value).isNotNull()), by)
    q = quantiles(base, [value], [0.25, 0.5, 0.75], by=by)
    qw = q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(nm)
                              for p, nm in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    qw = materialize_small(qw)
    fences = qw.withColumns({"_lf": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                             "_uf": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    v = F.col(value).cast("double")
    j = base.select(*by, v.alias("_x")).join(broadcast_bounded(fences), by, "inner")
    inside = (F.col("_x") >= F.col("_lf")) & (F.col("_x") <= F.col("_uf"))
    agg = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"), F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))
    return agg.join(broadcast_bounded(qw), by, "inner").select(*by, "n", "min", "q1", "median", "q3", "max",
                                            "whisker_lo", "whisker_hi", "n_outliers")


# --------------------------------------------------------------------------- AG5 grid


def group_mean_grid(df: DataFrame, bin_col: str, bins: int, group: str, target: str,
                    name: str | None = None) -> DataFrame:
    """Mean of ``target`` per (bin, group) over the completed grid: every bin 1..bins for
    every group, NULL where empty (pandas categorical ``groupby`` with unobserved
    categories).  The grid is bins x distinct groups, both small aggregates."""
    name = name or target
    base = drop_null_keys(df, [bin_col, group])
    agg = base.groupBy(bin_col, group).agg(F.avg(number(target)).alias(name))
    grid = base.select(group).distinct().withColumn(bin_col, F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return grid.join(agg, [bin_col, group], "left").select(bin_col, group, name)
