"""Exact and approximate quantiles that never gather a group into one task.

Spark's exact ``percentile`` keeps a value->count map per group and merges it in one
task, so a hot group (a third of a 100 TB table) or a high-cardinality column would be
held in one task's memory.  ``kth_smallest`` instead finds exact order statistics by
histogram refinement:

* every pass is one aggregate ``groupBy(group, interval, bucket).agg(count, min, max)``
  over the rows still inside a candidate interval; partial aggregation runs map-side,
  so a hot group is split across all map tasks;
* for each target rank the bucket holding it becomes the next interval (its exact
  ``[min, max]``, so no float edge is lost) and the interval shrinks ``buckets``-fold;
* once an interval holds at most ``finish_below`` rows it is finished by ranking those
  rows (bounded work per target), or at once when ``min == max``.

The driver only sees the per-(group, target) state between passes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.common import SMALL_STATE_ROWS, broadcast_bounded, materialize_small

_V = "_v"


def kth_smallest(data: DataFrame, targets: DataFrame, by: Sequence[str] = (),
                 buckets: int = 4096, finish_below: int = 200_000, max_passes: int = 40) -> DataFrame:
    """Exact k-th smallest (0-based) ``_v`` per group.

    ``data``: columns ``by + ['_v']`` (non-null doubles).
    ``targets``: columns ``by + ['tid', 'k', 'n', 'lo', 'hi']`` where ``n`` is the number
    of values of the group and ``lo``/``hi`` its min / max.
    Returns ``by + ['tid', 'kth']``.
    """
    by = list(by)
    key = by if by else ["_g"]
    if not by:
        data = data.withColumn("_g", F.lit(0))
        targets = targets.withColumn("_g", F.lit(0))

    state = (targets.select(*key, "tid", F.col("k").cast("long").alias("k"),
                            F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"),
                            F.lit(0).cast("long").alias("below"), F.col("n").cast("long").alias("cnt")))
    done_parts: list[DataFrame] = []
    state = materialize_small(state)
    for _ in range(max_passes):
        # a point interval is its own answer (state is a small local relation: no job)
        done_parts.append(state.where(F.col("lo") == F.col("hi"))
                          .select(*key, "tid", F.col("lo").alias("kth")))
        state = state.where(F.col("lo") < F.col("hi"))
        small = state.where(F.col("cnt") <= finish_below)
        if not small.isEmpty():
            done_parts.append(materialize_small(_finish(data, small, key)))
        state = state.where(F.col("cnt") > finish_below)
        if state.isEmpty():
            break
        state = materialize_small(_refine(data, state, key, buckets))
    else:
        done_parts.append(materialize_small(_finish(data, state, key)))

    out = done_parts[0]
    for p in done_parts[1:]:
        out = out.unionByName(p)
    if not by:
        out = out.drop("_g")
    return out


def _side(df: DataFrame, known_small: bool) -> DataFrame:
    return F.broadcast(df) if known_small else broadcast_bounded(df)


def kth_smallest_local(data: DataFrame, targets: list[dict], key: list[str], buckets: int = 4096,
                       finish_below: int = 200_000, max_passes: int = 40) -> dict:
    """Same algorithm with the per-(group, target) state held on the driver (it is at most
    ``SMALL_STATE_ROWS`` rows): no jobs to size or test the state, and the state tables
    are broadcast with a known size.  ``targets``: dicts with ``key`` values, tid, k, n,
    lo, hi.  Returns ``{(key values..., tid): kth}``."""
    spark = data.sparkSession
    fields = [data.schema[k] for k in key]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [
        T.StructField("tid", T.LongType()), T.StructField("k", T.LongType()), T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()), T.StructField("below", T.LongType()), T.StructField("cnt", T.LongType())])
    cols = [*key, "tid", "k", "lo", "hi", "below", "cnt"]
    state = [tuple([t[k] for k in key] + [int(t["tid"]), int(t["k"]), float(t["lo"]), float(t["hi"]), 0, int(t["n"])])
             for t in targets]
    out: dict = {}
    nk = len(key)
    for _ in range(max_passes):
        active = []
        small = []
        for r in state:
            if r[nk + 2] == r[nk + 3]:
                out[tuple(r[:nk + 1])] = r[nk + 2]
            elif r[nk + 5] <= finish_below:
                small.append(r)
            else:
                active.append(r)
        if small:
            fin = _finish(data, spark.createDataFrame(small, schema), key, known_small=True).collect()
            for r in fin:
                out[tuple([r[k] for k in key] + [r["tid"]])] = r["kth"]
        if not active:
            return out
        nxt = _refine(data, spark.createDataFrame(active, schema), key, buckets, known_small=True).collect()
        state = [tuple(r[c] for c in cols) for r in nxt]
    if state:
        fin = _finish(data, spark.createDataFrame(state, schema), key, known_small=True).collect()
        for r in fin:
            out[tuple([r[k] for k in key] + [r["tid"]])] = r["kth"]
    return out


def _candidates(data: DataFrame, state: DataFrame, key: list[str], known_small: bool = False) -> DataFrame:
    """Rows of each group inside an active interval.  The state has one row per
    (group, target): broadcast it when its size is known to be small, else after a count."""
    iv = state.select(*key, "lo", "hi").distinct()
    cond = [data[k].eqNullSafe(iv[k]) for k in key] + [data[_V] >= iv["lo"], data[_V] <= iv["hi"]]
    j = data.join(_side(iv, known_small), cond, "inner")
    return j.select(*[data[k] for k in key], data[_V], iv["lo"], iv["hi"])


def _refine(data: DataFrame, state: DataFrame, key: list[str], buckets: int, known_small: bool = False
            ) -> DataFrame:
    cand = _candidates(data, state, key, known_small)
    # infinities take the place of the largest doubles, so that they fall in the end buckets;
    # halves keep the difference finite for any pair of finite doubles
    most = F.lit(sys.float_info.max)
    half = lambda c: F.greatest(F.least(F.col(c), most), -most) * 0.5
    pos = (half(_V) - half("lo")) / F.nullif(half("hi") - half("lo"), F.lit(0.0))
    bucket = F.least(F.lit(buckets - 1), F.floor(pos * buckets).cast("long"))
    hist = (cand.withColumn("b", F.coalesce(bucket, F.lit(0).cast("long")))
            .groupBy(*key, "lo", "hi", "b")
            .agg(F.count(F.lit(1)).alias("c"), F.min(_V).alias("bmin"), F.max(_V).alias("bmax")))
    s = state.alias("s")
    h = hist.alias("h")
    cond = [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key] + \
           [F.col("s.lo") == F.col("h.lo"), F.col("s.hi") == F.col("h.hi")]
    j = s.join(h, cond, "inner").select(
        *[F.col(f"s.{k}").alias(k) for k in key], F.col("s.tid").alias("tid"), F.col("s.k").alias("k"),
        F.col("s.below").alias("below"), F.col("h.b").alias("b"), F.col("h.c").alias("c"),
        F.col("h.bmin").alias("bmin"), F.col("h.bmax").alias("bmax"))
    # at most `buckets` rows per (group, target): a bounded window
    w = Window.partitionBy(*key, "tid").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("cum", F.sum("c").over(w))
    pick = j.where((F.col("below") + F.col("cum") - F.col("c") <= F.col("k")) &
                   (F.col("k") < F.col("below") + F.col("cum")))
    return pick.select(*key, "tid", "k", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"),
                       (F.col("below") + F.col("cum") - F.col("c")).alias("below"), F.col("c").alias("cnt"))


def _finish(data: DataFrame, state: DataFrame, key: list[str], known_small: bool = False) -> DataFrame:
    """Rank the (at most ``finish_below``) candidates of each interval once, then let every
    target sharing that interval pick its rank (no per-target copies of the rows)."""
    iv = state.select(*key, "lo", "hi").distinct()
    cond = [data[k].eqNullSafe(iv[k]) for k in key] + [data[_V] >= iv["lo"], data[_V] <= iv["hi"]]
    cand = data.join(_side(iv, known_small), cond, "inner").select(
        *[iv[k] for k in key], iv["lo"], iv["hi"], data[_V])
    w = Window.partitionBy(*key, "lo", "hi").orderBy(_V)
    ranked = cand.withColumn("rn", F.row_number().over(w)).alias("r")
    s = state.select(*key, "tid", "lo", "hi", (F.col("k") - F.col("below") + 1).alias("want")).alias("s")
    jc = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key] + \
         [F.col("r.lo") == F.col("s.lo"), F.col("r.hi") == F.col("s.hi"), F.col("r.rn") == F.col("s.want")]
    return ranked.join(_side(s, known_small), jc, "inner").select(
        *[F.col(f"s.{k}").alias(k) for k in key], F.col("s.tid").alias("tid"), F.col(f"r.{_V}").alias("kth"))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              exact: bool = True, accuracy: int = 100_000, drop_null_keys: bool = True,
              stats: list[dict] | None = None) -> DataFrame:
    """Linear-interpolated quantiles (position ``q * (n - 1)``, the rule of pandas
    ``quantile``, Spark ``percentile`` and SQL ``quantile_cont``).

    Returns long format ``by + ['column', 'prob', 'value']``; ``value`` is NULL for a group
    with no non-null value.  ``exact=False`` uses ``percentile_approx`` (a mergeable sketch,
    rank error ``n / accuracy``).
    """
    by = list(by)
    base = df
    if drop_null_keys:
        for k in by:
            base = base.where(F.col(k).isNotNull())
    sel = base.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = sel.unpivot(by, list(columns), "column_name", _V)
    long = long.where(F.col(_V).isNotNull() & ~F.isnan(F.col(_V)))
    gkey = by + ["column_name"]
    probs = [float(p) for p in probs]

    if not exact:
        r = long.groupBy(*gkey).agg(
            F.percentile_approx(_V, probs, accuracy).alias("_q"))
        r = r.select(*gkey, F.posexplode("_q").alias("_i", "value"))
        pr = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
        return r.select(*gkey, pr.alias("prob"), "value")

    if stats is not None:  # per-(group, column) n / lo / hi already known to the caller
        srows = [r for r in stats if r["n"]]
        return _quantiles_local(long.select(*gkey, _V), srows, gkey, probs, df.sparkSession, long.schema)
    stats = long.groupBy(*gkey).agg(F.count(F.lit(1)).alias("n"), F.min(_V).alias("lo"),
                                    F.max(_V).alias("hi"))
    srows = stats.limit(SMALL_STATE_ROWS // max(1, 2 * len(probs)) + 1).collect()
    if len(srows) * 2 * len(probs) <= SMALL_STATE_ROWS:
        return _quantiles_local(long.select(*gkey, _V), srows, gkey, probs, df.sparkSession,
                                long.schema)
    stats = materialize_small(stats)
    parr = F.array(*[F.lit(p) for p in probs])
    t = stats.select(*gkey, "n", "lo", "hi", F.posexplode(parr).alias("pi", "prob"))
    t = t.withColumn("pos", F.col("prob") * (F.col("n") - 1))
    t = t.withColumn("k1", F.floor("pos").cast("long")) \
         .withColumn("k2", F.least(F.col("k1") + 1, F.col("n") - 1)) \
         .withColumn("frac", F.col("pos") - F.col("k1"))
    ranks = t.select(*gkey, "n", "lo", "hi", F.explode(F.array("k1", "k2")).alias("k")).distinct() \
        .withColumn("tid", F.col("k"))
    data = long.select(*gkey, _V)
    kth = kth_smallest(data, ranks, by=gkey)
    a = kth.alias("a")
    b = kth.alias("b")
    tt = t.alias("t")
    ja = [F.col(f"t.{k}").eqNullSafe(F.col(f"a.{k}")) for k in gkey] + [F.col("t.k1") == F.col("a.tid")]
    jb = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in gkey] + [F.col("t.k2") == F.col("b.tid")]
    r = tt.join(a, ja, "left").join(b, jb, "left")
    v1, v2 = F.col("a.kth"), F.col("b.kth")
    val = F.when((F.col("t.frac") == 0) | (v1 == v2), v1).otherwise(v1 + (v2 - v1) * F.col("t.frac"))
    return r.select(*[F.col(f"t.{k}").alias(k) for k in gkey], F.col("t.prob").alias("prob"), val.alias("value"))


def quantiles_wide(df: DataFrame, column: str, probs: Sequence[float], names: Sequence[str],
                   by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """One row per group with one column per probability (``names``)."""
    by = list(by)
    q = quantiles(df, [column], probs, by=by, exact=exact)
    exprs = [F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    if by:
        return q.groupBy(*by).agg(*exprs)
    return q.agg(*exprs)


def median_of(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict:
    """Exact medians of several columns (one small result row per column)."""
    q = quantiles(df, columns, [0.5], exact=exact).collect()
    out = {c: None for c in columns}
    for r in q:
        out[r["column_name"]] = r["value"]
    return out


def _quantiles_local(data: DataFrame, srows, gkey: list[str], probs: list[float], spark, schema) -> DataFrame:
    """Quantiles when (groups x probabilities) is small: order statistics found with the
    driver-held state, interpolation on the handful of collected values."""
    targets, plan = [], []
    for r in srows:
        n = r["n"]
        ks = set()
        for p in probs:
            pos = p * (n - 1)
            k1 = int(math.floor(pos))
            k2 = min(k1 + 1, n - 1)
            plan.append((r, p, k1, k2, pos - k1))
            ks.update((k1, k2))
        for k in ks:
            targets.append({**{g: r[g] for g in gkey}, "tid": k, "k": k, "n": n, "lo": r["lo"], "hi": r["hi"]})
    kth = kth_smallest_local(data, targets, gkey)
    rows = []
    for r, p, k1, k2, frac in plan:
        kv = tuple(r[g] for g in gkey)
        v1, v2 = kth.get(kv + (k1,)), kth.get(kv + (k2,))
        val = v1 if frac == 0 or v1 is None or v2 is None or v1 == v2 else v1 + (v2 - v1) * frac
        rows.append((*kv, p, val))
    out_schema = T.StructType([T.StructField(g, schema[g].dataType, True) for g in gkey] +
                              [T.StructField("prob", T.DoubleType()), T.StructField("value", T.DoubleType())])
    return spark.createDataFrame(rows, out_schema)


def kth_value(data: DataFrame, k: int, n: int, lo: float, hi: float) -> float:
    """The exact k-th smallest (0-based) of the single double column ``_v`` of ``data``."""
    d = data.select(F.lit(0).alias("_g"), _V)
    return kth_smallest_local(d, [{"_g": 0, "tid": 0, "k": k, "n": n, "lo": lo, "hi": hi}], ["_g"])[(0, 0)]
