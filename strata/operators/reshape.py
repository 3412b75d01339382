"""Reshape, binning, ordering, unions, keyed sampling and train/test splitting."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.expr import arith_hash, row_hash
from strata.operators.blocks import ship
from strata.operators.common import finite, number
from strata.operators.quantiles import kth_value

ship(__name__)

# --------------------------------------------------------------------------- RS1 melt


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "feature",
         value_name: str = "value") -> DataFrame:
    """RS1: wide -> long; values are cast to double so they share a type."""
    sel = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return sel.unpivot(list(ids), list(values), var_name, value_name)


# --------------------------------------------------------------------------- RS2 / RS3 bins


def equal_width_edges(df: DataFrame, column: str, bins: int = 10) -> tuple[float, float, float] | None:
    """``(lo, width, first_edge)`` of ``bins`` right-closed equal-width bins over
    ``[min, max]``; the lowest edge is widened by 0.1 % of the range so the minimum falls
    in bin 1.  A constant column is widened by 0.1 % of its value on both sides.  The range is that of
    the finite values; infinite ones fall into the end bins."""
    x = finite(number(column))
    r = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    mn, mx = r["mn"], r["mx"]
    if mn is None:
        return None
    if mn == mx:
        d = 0.001 * abs(mn) if mn != 0 else 0.001
        lo, hi = mn - d, mx + d
        return lo, (hi - lo) / bins, lo
    w = (mx - mn) / bins
    return mn, w, mn - (mx - mn) * 0.001


def bin_expr(column: str, lo: float, width: float, bins: int) -> Column:
    """Bin number 1..bins of right-closed bins ``(lo + (i-1) w, lo + i w]``; no bin for NaN, the end bins
    for all beyond the edges."""
    x = number(column)
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(bins)), (x - F.lit(lo)) / F.lit(width)))
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(place).cast("int")))
    return F.when(x.isNotNull(), b)


def bin_equal_width(df: DataFrame, column: str, bins: int = 10, out: str | None = None,
                    edges: tuple[float, float, float] | None = None) -> DataFrame:
    """RS2: adds ``<out>`` (bin 1..bins), ``<out>_lo`` and ``<out>_hi`` edges."""
    out = out or f"{column}_bin"
    e = edges if edges is not None else equal_width_edges(df, column, bins)
    if e is None:
        return df.withColumns({out: F.lit(None).cast("int"), f"{out}_lo": F.lit(None).cast("double"),
                               f"{out}_hi": F.lit(None).cast("double")})
    lo, w, first = e
    b = bin_expr(column, lo, w, bins)
    return df.withColumn(out, b).withColumns(bin_edge_columns(out, lo, w, first))


def bin_edge_columns(out: str, lo: float, w: float, first: float) -> dict[str, Column]:
    return {f"{out}_lo": F.when(F.col(out) == 1, F.lit(first)).otherwise(F.lit(lo) + (F.col(out) - 1) * F.lit(w)),
            f"{out}_hi": F.lit(lo) + F.col(out) * F.lit(w)}


def few_distinct(df: DataFrame, column: str, most: int) -> list[float] | None:
    """AG7: the sorted values of a numeric column, or None if there are more than ``most``.  Each task
    stops collecting at ``most`` + 1 values, so that no more than those are ever shuffled."""
    def some(batches):
        seen: set[float] = set()
        for batch in batches:
            if len(seen) <= most:
                seen.update(itertools.islice((v for v in batch.column(0).unique().to_pylist() if v not in seen), most + 1))
        yield pa.RecordBatch.from_arrays([pa.array(itertools.islice(seen, most + 1), pa.float64())], ["v"])

    x = number(column)
    found = df.select(x.alias("v")).where(F.col("v").isNotNull()).mapInArrow(some, "v double").distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted(r["v"] for r in found)


def adaptive_key(df: DataFrame, column: str, bins: int = 10, max_distinct: int = 10
                 ) -> tuple[DataFrame, str, tuple[float, float, float] | None]:
    """RS3: bin a numeric column with more than ``max_distinct`` values, else use it raw.
    Returns ``(df, key_column, edges or None)``."""
    if isinstance(df.schema[column].dataType, T.NumericType) and few_distinct(df, column, max_distinct) is None:
        edges = equal_width_edges(df, column, bins)
        if edges is not None:
            key = f"{column}_binned"
            return bin_equal_width(df, column, bins, key, edges), key, edges
    return df, column, None


# --------------------------------------------------------------------------- ST sort / top-k


def sort_desc(df: DataFrame, key: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """ST1: descending on ``key`` with an explicit tie order."""
    return df.orderBy(F.desc(key), *tiebreak)


def top_k(df: DataFrame, key: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """ST2: the k largest (TakeOrderedAndProject: each task keeps only k rows)."""
    return df.orderBy(F.desc(key), *tiebreak).limit(k)


def most_frequent(df: DataFrame, column: str):
    """ST3: the most frequent value (ties -> smallest)."""
    r = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
         .agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(column).alias("v"))).alias("b")).first())
    return None if r["b"] is None else r["b"]["v"]


# --------------------------------------------------------------------------- SO union


def union_all(*dfs: DataFrame) -> DataFrame:
    """SO1 / SO2: bag union by column name (missing columns -> NULL)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------------- SA keyed sampling

CUT_BUCKETS = 4096  # a power of 2
RANKED = 200_000  # rows of a bucket that are put in order
HASH_52 = (1 << 52)  # doubles represent every integer below 2^53 exactly


def hash_column(key: str, seed: int, method: str = "xxhash64") -> Column:
    """Deterministic, partition-independent row hash as a long (< 2^52)."""
    if method == "arith":
        return arith_hash(key, seed)
    return F.pmod(row_hash([key], seed), F.lit(HASH_52))


def _tiebreak(df: DataFrame, key: str, seed: int) -> Column:
    """Second sort key among equal hashes: the key itself when numeric (exact below 2^53),
    else an independent 52-bit hash of it."""
    if isinstance(df.schema[key].dataType, T.NumericType):
        return F.col(key).cast("double")
    return F.pmod(row_hash([key], seed + 1_000_003), F.lit(HASH_52)).cast("double")


def _threshold(df: DataFrame, key: str, m_of: Callable[[int], int], seed: int, method: str) -> tuple[float, float] | None:
    """The ``m_of(n)``-th smallest (hash, key) pair of ``n`` rows.  One pass counts the rows of every bucket
    of hashes, which gives n too; only the bucket with the cut is looked at again: counted in finer
    buckets while it has more than ``RANKED`` rows, then put in order."""
    h = hash_column(key, seed, method).cast("double")
    data = df.select(F.when(F.col(key).isNotNull(), h).alias("_v"), _tiebreak(df, key, seed).alias("_key"))
    lo, width = 0.0, float(2 ** 20 if method == "arith" else HASH_52)  # powers of 2, so that edges are exact
    m, below = None, 0
    while True:
        here = data if m is None else data.where((F.col("_v") >= lo) & (F.col("_v") < lo + width))
        bucket = F.floor((F.col("_v") - F.lit(lo)) * F.lit(CUT_BUCKETS / width))
        counts = {r["b"]: r["n"] for r in here.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        without = counts.pop(None, 0)
        if m is None:
            m = min(m_of(sum(counts.values()) + without), sum(counts.values()))
            if m <= 0:
                return None
        for j in sorted(counts):
            if below + counts[j] >= m:
                break
            below += counts[j]
        lo, width = lo + j * (width / CUT_BUCKETS), width / CUT_BUCKETS
        cut = data.where((F.col("_v") >= lo) & (F.col("_v") < lo + width))
        if counts[j] <= RANKED:
            last = cut.orderBy("_v", "_key").offset(m - below - 1).limit(1).first()
            return last["_v"], last["_key"]
        if width <= 1:  # one hash alone: the keys decide
            ends = cut.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).first()
            return lo, kth_value(cut.select(F.col("_key").alias("_v")), m - below - 1, counts[j], ends["lo"], ends["hi"])


def _flagged(df: DataFrame, key: str, th: tuple[float, float] | None, seed: int, method: str, flag: str) -> DataFrame:
    if th is None:
        return df.withColumn(flag, F.lit(False))
    t, kt = th
    h = hash_column(key, seed, method).cast("double")
    k = _tiebreak(df, key, seed)
    inside = (h < F.lit(t)) | ((h == F.lit(t)) & (k <= F.lit(kt)))
    return df.withColumn(flag, F.col(key).isNotNull() & F.coalesce(inside, F.lit(False)))  # a row without a key is never drawn


def flag_first_m(df: DataFrame, key: str, m: int, seed: int = 42, method: str = "xxhash64",
                 flag: str = "in_sample") -> DataFrame:
    """Flag exactly ``m`` rows: those with the smallest (hash(key), key).  ``key`` must be
    unique.  No global sort and no row limit: the threshold is an exact distributed
    order statistic, the flag a projection."""
    return _flagged(df, key, _threshold(df, key, lambda n: m, seed, method), seed, method, flag)


def sample_exact(df: DataFrame, key: str, fraction: float, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """SA1: exactly ``int(fraction * n)`` rows, repeatable, independent of partitioning."""
    th = _threshold(df, key, lambda n: int(fraction * n), seed, method)
    return _flagged(df, key, th, seed, method, "_s").where("_s").drop("_s")


def sample_approx(df: DataFrame, key: str, fraction: float, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """SA1, approximate size: a pure filter ``hash mod 10^6 < fraction * 10^6``."""
    h = hash_column(key, seed, method)
    return df.where(F.pmod(h, F.lit(1_000_000)) < F.lit(int(round(fraction * 1_000_000))))


def split_train_test(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42,
                     method: str = "xxhash64", flag: str = "is_test") -> DataFrame:
    """SA2: ``ceil(test_fraction * n)`` test rows (the scikit-learn count), chosen by hash;
    the flag is a projection, so train and test are two filters of one plan."""
    th = _threshold(df, key, lambda n: math.ceil(test_fraction * n), seed, method)
    return _flagged(df, key, th, seed, method, flag)


def class_balance(df: DataFrame, split_flag: str, target: str) -> DataFrame:
    """ME7: class counts per split."""
    return (df.groupBy(F.when(F.col(split_flag), "test").otherwise("train").alias("split"), target)
            .agg(F.count(F.lit(1)).alias("count")))
