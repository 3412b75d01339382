"""Plans: flagship, profiling and aggregation (PF1-PF4, FI2-FI6, AG1-AG4, AG6-AG11, AG15, RS1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.expr import indicator, recode
from strata.operators import common, profile
from strata.plans.registry import register, rounded, table
from strata.plans.tables import (
    LINEITEM_N_SQL, ORDERS_N_SQL, PRIORITY_CASE_SQL, PRIORITY_CODES, lineitem_with_nulls,
    orders_with_nulls,
)

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- flagship (minimum slice)
def priority_status_means(spark, sf_dir):
    """LK1 recode of the priority, SF1 indicator of a finished order, AG1 group means."""
    o = table(spark, sf_dir, "orders")
    enc = o.select(recode("o_orderpriority", PRIORITY_CODES).alias("priority_code"),
                   indicator("o_orderstatus", "F").alias("is_finished"), "o_totalprice")
    out = (common.drop_null_keys(enc, ["priority_code"]).groupBy("priority_code")
           .agg(F.count(F.lit(1)).alias("n_orders"), F.avg("is_finished").alias("finished_rate"),
                F.avg("o_totalprice").alias("mean_totalprice"))
           .orderBy("priority_code"))
    return rounded(out)


register("priority_status_means", f"""
SELECT priority_code, count(*) AS n_orders, round(avg(is_finished), 6) AS finished_rate,
       round(avg(o_totalprice), 6) AS mean_totalprice
FROM (SELECT {PRIORITY_CASE_SQL} AS priority_code,
             CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_finished, o_totalprice FROM orders)
WHERE priority_code IS NOT NULL GROUP BY priority_code ORDER BY priority_code""")(priority_status_means)


# ---------------------------------------------------------------- PF1 / PF2 / PF3 / FI2
@register("profile_info", _union([
    f"SELECT '{c}' AS column_name, {i} AS position, count({c}) AS non_null, '{t}' AS dtype FROM {ORDERS_N_SQL}"
    for i, (c, t) in enumerate(ORDERS_COLS)]))
def profile_info(spark, sf_dir):
    return profile.info(orders_with_nulls(spark, sf_dir))


@register("profile_missing", "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS column_name, {i} AS position, count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if t == "double" else "") + f") AS n_missing FROM {ORDERS_N_SQL}"
    for i, (c, t) in enumerate(ORDERS_COLS)]) + ") WHERE n_missing > 0")
def profile_missing(spark, sf_dir):
    return profile.missing_counts(orders_with_nulls(spark, sf_dir), only_missing=True)


@register("missing_all_columns", _union([
    f"SELECT '{c}' AS column_name, {i} AS position, count(*) FILTER (WHERE {c} IS NULL) AS n_missing "
    f"FROM {LINEITEM_N_SQL}" for i, c in enumerate(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])]))
def missing_all_columns(spark, sf_dir):
    return profile.missing_counts(lineitem_with_nulls(spark, sf_dir))


@register("total_missing", "SELECT CAST(" + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c, _ in ORDERS_COLS) + f" AS BIGINT) AS total_missing FROM {ORDERS_N_SQL}")
def total_missing(spark, sf_dir):
    return profile.total_missing(orders_with_nulls(spark, sf_dir))


@register("quality_checks", f"""
SELECT CAST(count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_custkey IS NULL) AS BIGINT)
         AS n_null_features,
       count(*) FILTER (WHERE o_orderstatus IS NULL) AS n_null_target,
       count(DISTINCT o_orderstatus) AS n_classes,
       count(*) FILTER (WHERE o_totalprice IS NULL) > 0 AS o_totalprice_has_null,
       count(*) FILTER (WHERE o_orderpriority IS NULL) > 0 AS o_orderpriority_has_null,
       count(*) FILTER (WHERE o_custkey IS NULL) > 0 AS o_custkey_has_null
FROM {ORDERS_N_SQL}""")
def quality_checks(spark, sf_dir):
    """FI4 + FI6: violation counts and any-null flags, one aggregate over one scan."""
    o = orders_with_nulls(spark, sf_dir)
    return o.agg(*common.quality_exprs(o, ["o_totalprice", "o_custkey"], "o_orderstatus"),
                 *common.any_null_exprs(o, ["o_totalprice", "o_orderpriority", "o_custkey"]))


# ---------------------------------------------------------------- PF4 describe
@register("describe_numeric", _union([
    f"""SELECT '{c}' AS column_name, {i} AS position, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max
FROM {LINEITEM_N_SQL}""" for i, c in enumerate(LI_NUM)]))
def describe_numeric(spark, sf_dir):
    return rounded(profile.describe(lineitem_with_nulls(spark, sf_dir), LI_NUM))


# ---------------------------------------------------------------- AG11 correlation
def _corr_sql(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {both}) * "
            f"stddev_pop({b}) FILTER (WHERE {both}), 0), 6)")


@register("corr_matrix", _union([
    f"SELECT '{a}' AS col_x, '{b}' AS col_y, {_corr_sql(a, b)} AS corr FROM {LINEITEM_N_SQL}"
    for a in LI_NUM for b in LI_NUM]))
def corr_matrix(spark, sf_dir):
    return rounded(profile.corr_matrix(lineitem_with_nulls(spark, sf_dir), LI_NUM))


# ---------------------------------------------------------------- AG10 crosstab
@register("crosstab_counts", f"""
SELECT o_orderstatus,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
  count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH",
  count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
  count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED"
FROM {ORDERS_N_SQL} WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
GROUP BY o_orderstatus ORDER BY o_orderstatus""")
def crosstab_counts(spark, sf_dir):
    return profile.crosstab(orders_with_nulls(spark, sf_dir), "o_orderstatus", "o_orderpriority")


@register("crosstab_long", """
SELECT p_type, p_size, count(*) AS n FROM part GROUP BY p_type, p_size""")
def crosstab_long(spark, sf_dir):
    return profile.crosstab_long(table(spark, sf_dir, "part"), "p_type", "p_size")


# ---------------------------------------------------------------- AG6 / AG7
@register("value_counts", "SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), "p_brand")


@register("distinct_values", "SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "part"), "p_size")


@register("distinct_counts", """
SELECT count(DISTINCT p_type) AS p_type_nunique, count(DISTINCT p_brand) AS p_brand_nunique,
       count(DISTINCT p_size) AS p_size_nunique FROM part""")
def distinct_counts(spark, sf_dir):
    return profile.n_distinct(table(spark, sf_dir, "part"), ["p_type", "p_brand", "p_size"])


# ---------------------------------------------------------------- AG1 / AG2 / RS1
@register("group_means", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def group_means(spark, sf_dir):
    return rounded(profile.group_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], LI_NUM))


@register("group_means_long", "SELECT * FROM (" + _union([
    f"SELECT l_returnflag, '{c}' AS feature, round(avg({c}), 6) AS average_value FROM lineitem "
    f"WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag" for c in LI_NUM]) + ")")
def group_means_long(spark, sf_dir):
    g = profile.group_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], LI_NUM)
    return rounded(g.unpivot(["l_returnflag"], LI_NUM, "feature", "average_value"))


@register("group_means_subset", """
SELECT o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice FROM orders
WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def group_means_subset(spark, sf_dir):
    """AG2 + PR6: the wanted list names a column the table lacks; it is skipped."""
    o = table(spark, sf_dir, "orders")
    return rounded(profile.group_means(o, ["o_orderstatus"], common.existing(o, ["o_totalprice", "no_such_col"])))


# ---------------------------------------------------------------- AG3 / AG4 / AG15 / AG9
@register("group_size", f"""
SELECT o_orderpriority, count(*) AS count FROM {ORDERS_N_SQL} WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority""")
def group_size(spark, sf_dir):
    return profile.group_size(orders_with_nulls(spark, sf_dir), ["o_orderpriority"])


@register("group_rate", """
SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS finished_rate
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def group_rate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("is_finished", indicator("o_orderstatus", "F"))
    return rounded(profile.group_rate(o, ["o_orderpriority"], "is_finished", "finished_rate"))


SEGMENT_LABELS = {"AUTOMOBILE": "auto", "BUILDING": "building", "FURNITURE": "furniture",
                  "HOUSEHOLD": "household", "MACHINERY": "machinery"}


@register("labelled_share", """
SELECT segment_label, count, round(count / sum(count) OVER (), 6) AS share FROM (
  SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'building'
    WHEN 'FURNITURE' THEN 'furniture' WHEN 'HOUSEHOLD' THEN 'household' WHEN 'MACHINERY' THEN 'machinery' END
    AS segment_label, count(*) AS count
  FROM customer GROUP BY 1) WHERE segment_label IS NOT NULL""")
def labelled_share(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lab = c.select(recode("c_mktsegment", SEGMENT_LABELS).alias("segment_label"))
    counts = profile.group_size(lab, ["segment_label"])
    return rounded(profile.labelled_share(counts))


@register("status_agreement", """
SELECT round(avg(CASE WHEN o_orderstatus = CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END
                 THEN 1.0 ELSE 0.0 END) * 100, 6) AS agreement_pct FROM orders""")
def status_agreement(spark, sf_dir):
    """AG9: agreement of a stored label with a rule-derived one."""
    o = table(spark, sf_dir, "orders").withColumn(
        "rule_status", F.when(F.col("o_totalprice") > 150000, "F").otherwise("O"))
    return rounded(profile.agreement_pct(o, "o_orderstatus", "rule_status"))


# ---------------------------------------------------------------- SC6 / PR3 / PR2
@register("shape_report", "SELECT count(*) AS n_rows, 6 AS n_cols FROM orders")
def shape_report(spark, sf_dir):
    """SC6: ``(n_rows, n_cols)`` in one count job."""
    from strata.sources.readers import shape
    return shape(table(spark, sf_dir, "orders"))


@register("select_numeric", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def select_numeric(spark, sf_dir):
    """PR3 (+PR2): the projection by dtype; only the numeric columns reach the scan."""
    return rounded(common.select_by_type(table(spark, sf_dir, "orders"), "number"))


@register("drop_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def drop_columns(spark, sf_dir):
    """PR2: dropping names, including one that does not exist (ignored)."""
    o = table(spark, sf_dir, "orders")
    return o.drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "no_such_column")
