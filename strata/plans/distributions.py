"""Plans: histograms, density, box statistics and the explorer (AG5, AG12-AG16, RS3, EX1-EX6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.expr import indicator, recode
from strata.operators import distribution, explore
from strata.plans.registry import register, rounded, table
from strata.plans.tables import ORDERS_N_SQL, orders_with_nulls

# order status -> group id used as the explorer's "cluster" column
STATUS_GROUP = {"F": 0, "O": 1, "P": 2}
STATUS_GROUP_SQL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END"
PRIORITY_LABELS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified",
                   "5-LOW": "low"}


def _orders_grouped(spark, sf_dir, with_nulls=False):
    o = orders_with_nulls(spark, sf_dir) if with_nulls else table(spark, sf_dir, "orders")
    return o.withColumn("cluster", recode("o_orderstatus", STATUS_GROUP))


def _auto_hist_sql(src: str, x: str, by: str | None = None) -> str:
    """numpy 'auto' bins + numpy bin assignment, as SQL."""
    keys = f", {by}" if by else ""
    grid = (f"(SELECT DISTINCT {by} FROM {src} WHERE {x} IS NOT NULL AND {by} IS NOT NULL) g, " if by else "")
    return f"""
WITH s AS (SELECT count({x}) AS n, min({x}) AS lo, max({x}) AS hi, quantile_cont({x}, 0.25) AS q1,
                  quantile_cont({x}, 0.75) AS q3 FROM {src}),
w AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM s),
b AS (SELECT lo, hi, CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) AS INTEGER) AS nb
      FROM w),
p AS (SELECT lo, hi, nb, (hi - lo) / nb AS step, nb / (hi - lo) AS norm FROM b),
i0 AS (SELECT {x} AS x{keys}, least(nb - 1, CAST(floor(({x} - lo) * norm) AS INTEGER)) AS idx, lo, hi, nb, step
       FROM {src}, p WHERE {x} IS NOT NULL {f"AND {by} IS NOT NULL" if by else ""}),
i1 AS (SELECT x{keys}, lo, hi, nb, step,
         CASE WHEN x < (CASE WHEN idx >= nb THEN hi ELSE idx * step + lo END) THEN idx - 1 ELSE idx END AS idx FROM i0),
i2 AS (SELECT x{keys}, CASE WHEN x >= (CASE WHEN idx + 1 >= nb THEN hi ELSE (idx + 1) * step + lo END)
                          AND idx <> nb - 1 THEN idx + 1 ELSE idx END AS bin FROM i1),
c AS (SELECT bin{keys}, count(*) AS count FROM i2 GROUP BY bin{keys}),
e AS (SELECT CAST(r.range AS INTEGER) AS bin{f", g.{by}" if by else ""}, round(r.range * step + lo, 6) AS bin_lo,
        round(CASE WHEN r.range = nb - 1 THEN hi ELSE (r.range + 1) * step + lo END, 6) AS bin_hi
      FROM {grid}p, range(0, (SELECT nb FROM p)) r)
SELECT e.bin, e.bin_lo, e.bin_hi{f", e.{by}" if by else ""}, coalesce(c.count, 0) AS count
FROM e LEFT JOIN c ON e.bin = c.bin {f"AND e.{by} = c.{by}" if by else ""}"""


# ---------------------------------------------------------------- AG12 / AG13 / AG14
@register("histogram", _auto_hist_sql("lineitem", "l_extendedprice"))
def histogram(spark, sf_dir):
    return rounded(distribution.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("histogram_by_group", _auto_hist_sql("lineitem", "l_extendedprice", "l_returnflag"))
def histogram_by_group(spark, sf_dir):
    return rounded(distribution.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", by="l_returnflag"))


_O1 = "(SELECT * FROM orders WHERE o_orderstatus = 'O')"


@register("histogram_filtered", _auto_hist_sql(_O1, "o_totalprice"))
def histogram_filtered(spark, sf_dir):
    """AG14: one group's histogram (the filter reaches the scan)."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O")
    return rounded(distribution.histogram(o, "o_totalprice"))


@register("density_curve", """
WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM events),
p AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS bw FROM s),
q AS (SELECT n, bw, lo - 3.0 * bw AS g0, hi + 3.0 * bw AS g1 FROM p),
g AS (SELECT CAST(r.range AS INTEGER) AS point,
             CASE WHEN r.range = 199 THEN g1 ELSE g0 + r.range * ((g1 - g0) / 199) END AS x, n, bw
      FROM q, range(0, 200) r)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - value) / bw, 2))) * (1.0 / (n * bw * sqrt(2.0 * pi()))), 9) AS density
FROM g, events WHERE value IS NOT NULL GROUP BY point, x, n, bw""")
def density_curve(spark, sf_dir):
    d = distribution.density_curve(table(spark, sf_dir, "events"), "value")
    return d.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _box_sql(src: str, v: str, by: list[str]) -> str:
    k = ", ".join(by)
    on = " AND ".join(f"t.{c} = q.{c}" for c in by)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in [v, *by])
    inside = f"t.{v} >= q.q1 - 1.5 * (q.q3 - q.q1) AND t.{v} <= q.q3 + 1.5 * (q.q3 - q.q1)"
    return f"""
WITH t AS (SELECT * FROM {src} WHERE {notnull}),
q AS (SELECT {k}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
             quantile_cont({v}, 0.75) AS q3 FROM t GROUP BY {k})
SELECT {", ".join(f"t.{c}" for c in by)}, count(*) AS n, round(min(t.{v}), 6) AS min, round(q.q1, 6) AS q1,
  round(q.median, 6) AS median, round(q.q3, 6) AS q3, round(max(t.{v}), 6) AS max,
  round(min(t.{v}) FILTER (WHERE {inside}), 6) AS whisker_lo, round(max(t.{v}) FILTER (WHERE {inside}), 6) AS whisker_hi,
  count(*) FILTER (WHERE NOT ({inside})) AS n_outliers
FROM t JOIN q ON {on} GROUP BY {", ".join(f"t.{c}" for c in by)}, q.q1, q.median, q.q3"""


# ---------------------------------------------------------------- AG16
@register("box_stats", _box_sql("events", "value", ["event_type"]))
def box_stats(spark, sf_dir):
    return rounded(distribution.box_stats(table(spark, sf_dir, "events"), "value", ["event_type"]))


# ---------------------------------------------------------------- EX1-EX6 / AG5 / RS3
_OG_SQL = f"(SELECT *, {STATUS_GROUP_SQL} AS cluster FROM {ORDERS_N_SQL})"


@register("explore_scatter", f"""
SELECT round(coalesce(o_totalprice, 0), 6) AS o_totalprice, coalesce(o_custkey, 0) AS o_custkey, cluster
FROM {_OG_SQL}""")
def explore_scatter(spark, sf_dir):
    """EX1 + MV5: x has missing values, so x, y and the group are zero-filled."""
    return rounded(explore.scatter(_orders_grouped(spark, sf_dir, True), "o_totalprice", "o_custkey"))


@register("explore_bar_binned", f"""
WITH s AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
t AS (SELECT greatest(1, least(10, CAST(ceil((o_totalprice - mn) / ((mx - mn) / 10)) AS INTEGER))) AS o_totalprice_binned,
             {STATUS_GROUP_SQL} AS cluster, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_urgent
      FROM orders, s),
g AS (SELECT b.range AS o_totalprice_binned, c.cluster FROM range(1, 11) b, (SELECT DISTINCT cluster FROM t) c),
a AS (SELECT o_totalprice_binned, cluster, avg(is_urgent) AS is_urgent FROM t GROUP BY 1, 2)
SELECT CAST(g.o_totalprice_binned AS INTEGER) AS o_totalprice_binned, g.cluster, round(a.is_urgent, 6) AS is_urgent,
  round(CASE WHEN g.o_totalprice_binned = 1 THEN mn - (mx - mn) * 0.001
             ELSE mn + (g.o_totalprice_binned - 1) * ((mx - mn) / 10) END, 6) AS o_totalprice_binned_lo,
  round(mn + g.o_totalprice_binned * ((mx - mn) / 10), 6) AS o_totalprice_binned_hi
FROM g LEFT JOIN a ON g.o_totalprice_binned = a.o_totalprice_binned AND g.cluster = a.cluster, s""")
def explore_bar_binned(spark, sf_dir):
    """EX2 + RS3 + AG5: numeric x with > 10 values is cut into 10 bins; grid completed."""
    o = _orders_grouped(spark, sf_dir).withColumn("is_urgent", indicator("o_orderpriority", "1-URGENT"))
    return rounded(explore.bar(o, "o_totalprice", "is_urgent"))


@register("explore_bar_categorical", """
SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS cluster,
       round(avg(o_totalprice), 6) AS o_totalprice
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def explore_bar_categorical(spark, sf_dir):
    """EX2 with a categorical x: plain group means, no grid."""
    return rounded(explore.bar(_orders_grouped(spark, sf_dir), "o_orderpriority", "o_totalprice"))


@register("explore_box", _box_sql(f"(SELECT *, {STATUS_GROUP_SQL} AS cluster FROM orders)", "o_totalprice",
                                  ["o_orderpriority", "cluster"]))
def explore_box(spark, sf_dir):
    """EX3: box statistics of y per (x, cluster)."""
    return rounded(explore.box(_orders_grouped(spark, sf_dir), "o_orderpriority", "o_totalprice"))


@register("explore_hist", _auto_hist_sql(f"(SELECT *, {STATUS_GROUP_SQL} AS cluster FROM orders)",
                                         "o_totalprice", "cluster"))
def explore_hist(spark, sf_dir):
    """EX4 / EX5 default kind: histogram of x per cluster."""
    return rounded(explore.explore(_orders_grouped(spark, sf_dir), "o_totalprice", "o_totalprice", "histogram"))


@register("cluster_drilldown", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
         WHEN '4-NOT SPECIFIED' THEN 'unspecified' WHEN '5-LOW' THEN 'low' END AS category_label,
       round(avg(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END), 6) AS rate
FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def cluster_drilldown(spark, sf_dir):
    """EX6: in one cluster, the rate of a binary target per labelled category."""
    o = _orders_grouped(spark, sf_dir).withColumn("high_value", (F.col("o_totalprice") > 200000).cast("int"))
    return rounded(explore.cluster_drilldown(o, 1, category="o_orderpriority", labels=PRIORITY_LABELS,
                                             target="high_value"))


@register("cluster_drilldown_fallback", _auto_hist_sql(
    "(SELECT * FROM orders WHERE o_orderstatus = 'P')", "o_totalprice"))
def cluster_drilldown_fallback(spark, sf_dir):
    """EX6 fallback: no category column -> histogram of the fallback column."""
    o = _orders_grouped(spark, sf_dir)
    return rounded(explore.cluster_drilldown(o, 2, fallback="o_totalprice"))
