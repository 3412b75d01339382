"""Missing-value operators: mean / mode / median / rule-table / zero fills, a mean
imputer (fit + transform) and the fill report.

Fill values come from ONE aggregate per statistic family; only O(columns) scalars reach
the driver and are applied as literals in a single projection (no join, no shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.common import is_float_column, numeric_columns, string_columns
from strata.operators.quantiles import quantiles


def _missing(df: DataFrame, c: str):
    m = F.col(c).isNull()
    return (m | F.isnan(F.col(c))) if is_float_column(df, c) else m


def _null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    r = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in cols]).first()
    return {c: int(r[c]) for c in cols}


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    r = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c)
                 for c in cols]).first()
    return {c: r[c] for c in cols}


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties -> smallest value (numbers as numbers).  Distributed:
    unpivot to ``(column, value)``, count with map-side combine, then pick per column with
    ``min(struct(-count, value))`` (no value map held in one task)."""
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column_name", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    rank = F.when(F.col("column_name").isin(numbers), F.col("value").try_cast("double")) if numbers else F.lit(None)
    best = counts.groupBy("column_name").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), rank.alias("rank"), F.col("value"))).alias("b"))
    out = {c: None for c in cols}
    for r in best.collect():
        out[r["column_name"]] = r["b"]["value"]
    return out


def column_medians(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, float | None]:
    if not cols:
        return {}
    out = {c: None for c in cols}
    for r in quantiles(df, cols, [0.5], exact=exact).collect():
        out[r["column_name"]] = r["value"]
    return out


def _apply(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        src = F.nanvl(F.col(c), F.lit(None).cast("double")) if is_float_column(df, c) else F.col(c)
        kind = df.schema[c].dataType
        if isinstance(v, float) and (isinstance(kind, T.IntegralType) and not v.is_integer()
                                     or isinstance(kind, T.DecimalType) and round(v, kind.scale) != v):
            kind = T.DoubleType()  # a mean or median between the type's values keeps its fraction
        exprs[c] = F.coalesce(src.cast(kind), F.lit(v).cast(kind))
    return df.withColumns(exprs) if exprs else df


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """MV1: every numeric column having missing values gets its mean; an all-missing
    column stays NULL."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    counts = _null_counts(df, cols)
    todo = [c for c in cols if counts[c] > 0]
    return _apply(df, column_means(df, todo))


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """MV2: every string column having NULLs gets its mode (ties -> smallest)."""
    cols = list(columns) if columns is not None else string_columns(df)
    counts = _null_counts(df, cols)
    todo = [c for c in cols if counts[c] > 0]
    return _apply(df, column_modes(df, todo))


def resolve_rules(df: DataFrame, rules: Mapping[str, object], fallbacks: Mapping[str, object] | None = None,
                  exact: bool = True) -> dict[str, object]:
    """Turn a rule table ``{column: constant | 'mean' | 'median' | 'mode'}`` into
    constants for the columns that exist; a statistic that is undefined (all-missing
    column) takes ``fallbacks[column]`` when given."""
    present = {c: r for c, r in rules.items() if c in df.columns}
    stat_cols = {k: [c for c, r in present.items() if r == k] for k in ("mean", "median", "mode")}
    vals: dict[str, object] = {c: r for c, r in present.items() if r not in ("mean", "median", "mode")}
    vals.update(column_means(df, stat_cols["mean"]))
    vals.update(column_medians(df, stat_cols["median"], exact=exact))
    vals.update(column_modes(df, stat_cols["mode"]))
    for c, v in list(vals.items()):
        if v is None and fallbacks and c in fallbacks:
            vals[c] = fallbacks[c]
    return vals


def fill_by_rules(df: DataFrame, rules: Mapping[str, object], fallbacks: Mapping[str, object] | None = None,
                  exact: bool = True) -> DataFrame:
    """MV3: per-column constant or statistic; only columns present are touched."""
    return _apply(df, resolve_rules(df, rules, fallbacks, exact))


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """MV4: numeric NULL/NaN -> 0.  String columns stay NULL (writing 0 into text is not
    useful); this is ``na.fill(0)`` plus NaN handling."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    return _apply(df, {c: 0 for c in cols})


def fill_zero_if_any_missing(df: DataFrame, check: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """MV5: when any of ``check`` holds a missing value, zero-fill ``fill``.  The decision
    is one aggregate; the fill itself is a projection."""
    counts = _null_counts(df, list(check))
    return fill_zero(df, fill) if any(counts.values()) else df


def fill_report(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """MV7: ``(column, n_missing, fill_value)`` for the columns that have missing values."""
    cols = [c for c in values if c in df.columns]
    counts = _null_counts(df, cols)
    rows = [(c, counts[c], None if values[c] is None else str(values[c])) for c in cols if counts[c] > 0]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_missing long, fill_value string")


@dataclass
class MeanImputerModel:
    """MV6: fitted means, applied to any DataFrame."""
    means: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return _apply(df, self.means)

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.means.items()), "column_name string, mean double")


def fit_mean_imputer(df: DataFrame, columns: Sequence[str]) -> MeanImputerModel:
    """MV6: mean per column; an all-missing column is an error that names it."""
    means = column_means(df, columns)
    bad = [c for c, m in means.items() if m is None]
    if bad:
        raise ValueError(f"cannot impute all-missing columns: {bad}")
    return MeanImputerModel(means)
