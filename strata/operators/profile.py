"""Profiling and aggregation: schema / null summaries, describe, group statistics,
value counts, cross-tabs and the pairwise correlation matrix.

Every statistic over many columns is ONE aggregate job (partial + final hash
aggregation, so hot groups are combined map-side), and wide results are reshaped to
long form only after aggregation, on a handful of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import safe_div
from strata.operators.blocks import Blocks
from strata.operators.common import drop_null_keys, is_float_column, number
from strata.operators.quantiles import quantiles


def _stack(row_df: DataFrame, names: Sequence[str], fields: dict[str, list]) -> DataFrame:
    """Turn the one-row result of a wide aggregate into long form, one row per column
    name: ``fields`` maps output field -> list of the wide aggregate's column names."""
    structs = [F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("position"),
                        *[F.col(fields[f][i]).alias(f) for f in fields])
               for i, n in enumerate(names)]
    return row_df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def info(df: DataFrame) -> DataFrame:
    """PF1: ``(column, position, non_null, dtype)``, one count job for all columns; NaN is missing."""
    cols = df.columns
    present = [number(f"`{c}`") if is_float_column(df, c) else F.col(f"`{c}`") for c in cols]
    wide = df.agg(*[F.count(x).alias(f"_n{i}") for i, x in enumerate(present)])
    out = _stack(wide, cols, {"non_null": [f"_n{i}" for i in range(len(cols))]})
    types = {c: t for c, t in df.dtypes}
    dtype = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])[F.col("column_name")]
    return out.withColumn("dtype", dtype)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = False
                   ) -> DataFrame:
    """PF2 (+FI2 with ``only_missing``): ``(column, position, n_missing)``; NaN counts as
    missing in float columns.  One pass for all columns."""
    cols = list(columns) if columns is not None else df.columns
    aggs = []
    for i, c in enumerate(cols):
        m = F.col(f"`{c}`").isNull()
        if is_float_column(df, c):
            m = m | F.isnan(F.col(f"`{c}`"))
        aggs.append(F.count_if(m).alias(f"_m{i}"))
    wide = df.agg(*aggs)
    out = _stack(wide, cols, {"n_missing": [f"_m{i}" for i in range(len(cols))]})
    return out.where(F.col("n_missing") > 0) if only_missing else out


def total_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """PF3: one row ``total_missing``."""
    cols = list(columns) if columns is not None else df.columns
    terms = []
    for c in cols:
        m = F.col(f"`{c}`").isNull()
        if is_float_column(df, c):
            m = m | F.isnan(F.col(f"`{c}`"))
        terms.append(F.count_if(m))
    return df.agg(sum(terms[1:], terms[0]).cast("long").alias("total_missing"))


def describe(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """PF4: ``(column, count, mean, std, min, q25, q50, q75, max)`` with the sample
    standard deviation and interpolated quartiles (not ``DataFrame.summary``, whose
    quartiles are not interpolated).  Moments: one wide aggregate; quartiles: exact
    distributed selection (``exact=False``: sketch)."""
    cols = list(columns)
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [F.count(x).alias(f"_c{i}"), F.avg(x).alias(f"_a{i}"),
                 F.stddev_samp(x).alias(f"_s{i}"), F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    w = df.agg(*aggs).first()  # one row of 5 x columns scalars
    n = range(len(cols))
    rows = [(c, i, w[f"_c{i}"], w[f"_a{i}"], w[f"_s{i}"], w[f"_lo{i}"], w[f"_hi{i}"]) for i, c in enumerate(cols)]
    mom = df.sparkSession.createDataFrame(rows, "column_name string, position int, count long, mean double, "
                                                "std double, min double, max double")
    stats = [{"column_name": c, "n": w[f"_c{i}"], "lo": w[f"_lo{i}"], "hi": w[f"_hi{i}"]} for i, c in enumerate(cols)]
    q = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact, stats=stats if exact else None)
    qw = q.groupBy("column_name").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(nm)
                                   for p, nm in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return (mom.join(qw, "column_name", "left")
            .select("column_name", "position", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "") -> DataFrame:
    """AG1/AG2: ``groupBy(keys).avg(columns)``; NULL keys dropped (pandas rule); output
    sorted by key.  Only the listed columns that exist are averaged (PR6)."""
    keys = list(keys)
    cols = [c for c in columns if c in df.columns]
    return (drop_null_keys(df, keys).groupBy(*keys)
            .agg(*[F.avg(number(c)).alias(f"{c}{suffix}") for c in cols])
            .orderBy(*keys))


def group_size(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """AG3: rows per key, NULL keys dropped."""
    return drop_null_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(*keys)


def group_rate(df: DataFrame, keys: Sequence[str], target: str, name: str | None = None) -> DataFrame:
    """AG4: mean of one (0/1) target per key."""
    return (drop_null_keys(df, keys).groupBy(*keys)
            .agg(F.avg(number(target)).alias(name or f"{target}_rate")).orderBy(*keys))


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """AG6: counts by value, descending, ties by value; NULL dropped."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.col(column)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """AG7: sorted distinct non-null values."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def n_distinct(df: DataFrame, columns: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """AG7: number of distinct non-null values per column (one row).  ``approx`` uses the
    HyperLogLog++ sketch, bounded memory at any cardinality."""
    f = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.agg(*[f(F.col(c)).alias(f"{c}_nunique") for c in columns])


def agreement_pct(df: DataFrame, a: str, b: str | None, name: str = "agreement_pct") -> DataFrame:
    """AG9 / ML8: percentage of rows where ``a == b`` (100 when there is nothing stored);
    a missing value agrees with nothing."""
    if b is None or b not in df.columns:
        return df.sparkSession.range(1).select(F.lit(100.0).alias(name))
    return df.agg((F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")) * 100).alias(name))


def crosstab(df: DataFrame, row: str, col: str, col_values: Sequence | None = None) -> DataFrame:
    """AG10: counts of ``row`` x ``col`` with absent cells 0 and NULL keys dropped.  Pass
    ``col_values`` to skip the distinct job of ``pivot``."""
    base = drop_null_keys(df, [row, col])
    g = base.groupBy(row)
    p = g.pivot(col, list(col_values)) if col_values is not None else g.pivot(col)
    out = p.agg(F.count(F.lit(1)))
    return out.na.fill(0).orderBy(row)


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """AG10 in long form ``(row, col, n)`` for high-cardinality columns (no pivot)."""
    return drop_null_keys(df, [row, col]).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG11: Pearson correlation of every ordered pair, pairwise-complete: two passes of blocks of rows, the
    first for a value of each column to count from, the second for the matrix products of values, squares
    and presence.  A column that is constant over a pair's rows (a variance below 1e-13 of its mean
    square, from the first value) gives NULL."""
    cols = list(columns)
    n = len(cols)
    least = df.agg(*[F.min(number(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    origin = np.array([0.0 if v is None or not math.isfinite(v) else v for v in least])

    def make(x: np.ndarray) -> np.ndarray:
        m = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x - origin, nan=0.0, posinf=np.inf, neginf=-np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            return np.concatenate([(m.T @ m).ravel(), (x.T @ m).ravel(), ((x * x).T @ m).ravel(), (x.T @ x).ravel()])

    with Blocks(df, [number(c) for c in cols], keep=False) as blocks:
        count, total, square, product = blocks.sum(make, 4 * n * n).reshape(4, n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = total / count
        var = square / count - mean * mean  # of the row's column, over the rows where the other is present
        var = np.where(var <= 1e-13 * square / count, np.nan, var)
        corr = (product / count - mean * mean.T) / np.sqrt(var * var.T)
    rows = [(cols[i], cols[j], float(corr[i, j]) if math.isfinite(corr[i, j]) else None) for i in range(n) for j in range(n)]
    return df.sparkSession.createDataFrame(rows, "col_x string, col_y string, corr double")


def labelled_share(counts: DataFrame, count_col: str = "count", name: str = "share") -> DataFrame:
    """AG15: share of each category, of a total that is added up first (one number)."""
    total = counts.agg(F.sum(count_col)).first()[0]
    return counts.withColumn(name, safe_div(count_col, F.lit(total)))
