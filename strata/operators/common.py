"""Schema guards and small-state helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.expr import nan_to_null
from strata.session import cut_lineage

# Per-group / per-feature state collected between passes of an iterative operator.  It is
# bounded by (groups x targets) or (k x features); anything larger is checkpointed instead.
SMALL_STATE_ROWS = 100_000


def materialize_small(df: DataFrame, limit: int = SMALL_STATE_ROWS) -> DataFrame:
    """Freeze a small intermediate as a local relation (plans of iterative loops stay
    flat); if it turns out larger than ``limit`` rows, use a reliable checkpoint."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return cut_lineage(df)
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def broadcast_bounded(df: DataFrame, limit: int = SMALL_STATE_ROWS) -> DataFrame:
    """Broadcast a join side only behind a checked row count; a larger side stays a
    normal (shuffle) join input."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def number(c: str) -> Column:
    """A column as double with NaN as NULL: what every statistic counts, sums and orders."""
    return nan_to_null(F.col(c).cast("double"))


def finite(c: Column) -> Column:
    """A double, or NULL for an infinity (and for NaN)."""
    return F.when(F.abs(c) < float("inf"), c)


def is_float_column(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """``kind`` in {'number', 'string'}: the projection by dtype."""
    cols = numeric_columns(df) if kind == "number" else string_columns(df)
    return df.select(*cols)


def require_columns(df: DataFrame, cols: Sequence[str], missing: str = "error") -> DataFrame:
    """Guard for a feature list: ``missing='error'`` raises naming the absent columns,
    ``'zero'`` adds them as constant 0 (the scoring default), ``'drop'`` keeps the
    existing subset."""
    absent = [c for c in cols if c not in df.columns]
    if not absent:
        return df
    if missing == "error":
        raise ValueError(f"missing columns: {absent}")
    if missing == "zero":
        return ensure_columns(df, absent, F.lit(0))
    if missing == "drop":
        return df
    raise ValueError(missing)


def ensure_columns(df: DataFrame, cols: Sequence[str], value: Column) -> DataFrame:
    add = {c: value for c in cols if c not in df.columns}
    return df.withColumns(add) if add else df


def existing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` / ``crosstab`` / ``value_counts`` drop a NULL key; Spark keeps a
    NULL group, so filter first (also lets the filter reach the scan)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def missing_cell(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a column of floats."""
    return F.col(c).isNull() | F.isnan(c) if is_float_column(df, c) else F.col(c).isNull()


def any_null_exprs(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    return [(F.count_if(missing_cell(df, c)) > 0).alias(f"{c}_has_null") for c in cols]


def any_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FI4: one row of ``<col>_has_null`` booleans, one pass."""
    return df.agg(*any_null_exprs(df, cols))


def quality_exprs(df: DataFrame, features: Sequence[str], target: str) -> list[Column]:
    nulls = [F.count_if(missing_cell(df, c)) for c in features]
    return [sum(nulls[1:], nulls[0]).cast("long").alias("n_null_features"),
            F.count_if(missing_cell(df, target)).cast("long").alias("n_null_target"),
            F.count_distinct(F.when(~missing_cell(df, target), F.col(target))).alias("n_classes")]


def quality_violations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """FI6: one aggregate row of violation counts: nulls in X, nulls in y, classes of y."""
    return df.agg(*quality_exprs(df, features, target))


def assert_quality(df: DataFrame, features: Sequence[str], target: str) -> None:
    r = quality_violations(df, features, target).first()
    if r["n_null_features"] or r["n_null_target"]:
        raise ValueError(f"missing values remain: X={r['n_null_features']} y={r['n_null_target']}")
    if r["n_classes"] < 2:
        raise ValueError("target has fewer than two classes")
