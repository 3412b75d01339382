"""Plans: missing values, missing tokens, recodes, indicators, clamps, binning, sampling and
splitting (SC2, MV1-MV7, LK1, SF1-SF9, RS2, ST, SO1, SA1, SA2, ME7, ML16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.expr import (
    arith_hash_sql, clamp_decrement, clamp_increment, flip_binary, indicator, recode,
)
from strata.operators import missing, reshape
from strata.operators.classify import synthesize_missing_class
from strata.plans.registry import register, rounded, table
from strata.plans.tables import (
    LINEITEM_N_SQL, ORDERS_N_SQL, PRIORITY_CASE_SQL, PRIORITY_CODES, lineitem_with_nulls,
    orders_with_nulls,
)
from strata.sources.readers import normalize_missing

LI_RULES = {"l_quantity": "mean", "l_discount": "median", "l_tax": 0.02, "no_such_col": 1}


# ---------------------------------------------------------------- MV1 / MV2
@register("fill_mean", f"""
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ORDERS_N_SQL})), 6) AS o_totalprice
FROM {ORDERS_N_SQL}""")
def fill_mean(spark, sf_dir):
    o = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_totalprice")
    return rounded(missing.fill_mean(o, ["o_totalprice"]))


_MODE_SQL = f"""(SELECT o_orderpriority FROM (SELECT o_orderpriority, count(*) AS c FROM {ORDERS_N_SQL}
  WHERE o_orderpriority IS NOT NULL GROUP BY 1) ORDER BY c DESC, o_orderpriority ASC LIMIT 1)"""


@register("fill_mode", f"""
SELECT o_orderkey, coalesce(o_orderpriority, {_MODE_SQL}) AS o_orderpriority FROM {ORDERS_N_SQL}""")
def fill_mode(spark, sf_dir):
    o = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return missing.fill_mode(o)


# ---------------------------------------------------------------- MV3 / MV4 / MV7
@register("fill_rules", f"""
SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LINEITEM_N_SQL})), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {LINEITEM_N_SQL})), 6) AS l_discount,
  round(coalesce(l_tax, 0.02), 6) AS l_tax
FROM {LINEITEM_N_SQL}""")
def fill_rules(spark, sf_dir):
    li = lineitem_with_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(missing.fill_by_rules(li, LI_RULES))


@register("fill_zero", f"""
SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(l_discount, 0) AS l_discount, coalesce(l_tax, 0) AS l_tax
FROM {LINEITEM_N_SQL}""")
def fill_zero(spark, sf_dir):
    li = lineitem_with_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_tax")
    return rounded(missing.fill_zero(li))


@register("fill_report", f"""
SELECT * FROM (
  SELECT 'l_discount' AS column_name, count(*) FILTER (WHERE l_discount IS NULL) AS n_missing,
         round(quantile_cont(l_discount, 0.5), 6) AS fill_value FROM {LINEITEM_N_SQL}
  UNION ALL
  SELECT 'l_tax', count(*) FILTER (WHERE l_tax IS NULL), 0.02 FROM {LINEITEM_N_SQL}
  UNION ALL
  SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL), round(avg(l_quantity), 6) FROM {LINEITEM_N_SQL})
WHERE n_missing > 0""")
def fill_report(spark, sf_dir):
    li = lineitem_with_nulls(spark, sf_dir)
    vals = missing.resolve_rules(li, LI_RULES)
    rep = missing.fill_report(li, vals)
    return rounded(rep.withColumn("fill_value", F.col("fill_value").cast("double")))


@register("fill_zero_conditional", f"""
SELECT o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, o_custkey FROM {ORDERS_N_SQL}""")
def fill_zero_conditional(spark, sf_dir):
    """MV5: a missing value in x or y zero-fills both."""
    o = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(missing.fill_zero_if_any_missing(o, ["o_totalprice", "o_custkey"], ["o_totalprice", "o_custkey"]))


@register("mean_imputer", f"""
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ORDERS_N_SQL}
  WHERE o_orderstatus = 'F')), 6) AS o_totalprice FROM {ORDERS_N_SQL} WHERE o_orderstatus <> 'F'""")
def mean_imputer(spark, sf_dir):
    """MV6: fit the imputer on one part of the table, apply it to another."""
    o = orders_with_nulls(spark, sf_dir)
    model = missing.fit_mean_imputer(o.where(F.col("o_orderstatus") == "F"), ["o_totalprice"])
    return rounded(model.transform(o.where(F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice"))


# ---------------------------------------------------------------- SC2
@register("missing_tokens", """
SELECT CASE WHEN trim(o_orderpriority) IN ('5-LOW', 'NA') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       count(*) AS count
FROM orders GROUP BY 1""")
def missing_tokens(spark, sf_dir):
    o = normalize_missing(table(spark, sf_dir, "orders"), ["5-LOW", "NA"], ["o_orderpriority"])
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- LK1 / SF1 / SF2-SF5 / SF7
@register("recode_map", f"""
SELECT o_orderkey, {PRIORITY_CASE_SQL} AS priority_code FROM orders""")
def recode_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", recode("o_orderpriority", PRIORITY_CODES).alias("priority_code"))


@register("binary_flags", f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_finished,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_urgent
FROM {ORDERS_N_SQL}""")
def binary_flags(spark, sf_dir):
    o = orders_with_nulls(spark, sf_dir)
    return o.select("o_orderkey", indicator("o_orderstatus", "F").alias("is_finished"),
                    indicator("o_orderpriority", "1-URGENT").alias("is_urgent"))


@register("clamp_shift", """
SELECT p_partkey, greatest(1, p_size - 1) AS size_down, least(50, p_size + 1) AS size_up, p_size + 2 AS size_plus2,
       CASE WHEN (CASE WHEN p_size > 25 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS is_small,
       round(exp(p_retailprice / 1000.0), 6) AS price_exp, round(abs(p_retailprice - 1500.0), 6) AS price_dev
FROM part""")
def clamp_shift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    big = F.when(F.col("p_size") > 25, 1).otherwise(0)
    return rounded(p.select(
        "p_partkey", clamp_decrement("p_size", 1).alias("size_down"), clamp_increment("p_size", 50).alias("size_up"),
        (F.col("p_size") + 2).alias("size_plus2"), flip_binary(big).alias("is_small"),
        F.exp(F.col("p_retailprice") / 1000.0).alias("price_exp"),
        F.abs(F.col("p_retailprice") - 1500.0).alias("price_dev")))


# ---------------------------------------------------------------- RS2 equal-width bins
@register("bin_equal_width", """
WITH s AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
b AS (SELECT greatest(1, least(10, CAST(ceil((o_totalprice - mn) / ((mx - mn) / 10)) AS INTEGER))) AS bin, mn, mx
      FROM orders, s)
SELECT bin AS o_totalprice_bin,
  round(CASE WHEN bin = 1 THEN mn - (mx - mn) * 0.001 ELSE mn + (bin - 1) * ((mx - mn) / 10) END, 6) AS o_totalprice_bin_lo,
  round(mn + bin * ((mx - mn) / 10), 6) AS o_totalprice_bin_hi, count(*) AS count
FROM b GROUP BY bin, mn, mx""")
def bin_equal_width(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = reshape.bin_equal_width(o, "o_totalprice", 10)
    return rounded(b.groupBy("o_totalprice_bin", "o_totalprice_bin_lo", "o_totalprice_bin_hi")
                   .agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- ST1 / ST2 / ST3
@register("top_customers", """
SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def top_customers(spark, sf_dir):
    """ST1 + ST2: the report is a top-k, the limit is the feature."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rounded(reshape.top_k(c, "c_acctbal", 10, ["c_custkey"]))


@register("most_frequent_flag", """
SELECT l_returnflag FROM (SELECT l_returnflag, count(*) AS c FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
ORDER BY c DESC, l_returnflag LIMIT 1""")
def most_frequent_flag(spark, sf_dir):
    """ST3: the arg-first class of a value count."""
    li = table(spark, sf_dir, "lineitem")
    v = reshape.most_frequent(li, "l_returnflag")
    return spark.createDataFrame([(v,)], "l_returnflag string")


# ---------------------------------------------------------------- SA1 / SA2 / ME7
_H = arith_hash_sql("o_orderkey", 42)


@register("sample_fraction", f"""
SELECT o_orderkey, o_orderstatus FROM (
  SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {_H}, o_orderkey) AS rn FROM orders)
WHERE rn <= (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM orders)""")
def sample_fraction(spark, sf_dir):
    """SA1: exactly int(0.2 n) orders by (hash, key), no global sort."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return reshape.sample_exact(o, "o_orderkey", 0.2, seed=42, method="arith")


@register("sample_approx", f"""
SELECT o_orderkey FROM orders WHERE ({_H}) % 1000000 < 100000""")
def sample_approx(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return reshape.sample_approx(o, "o_orderkey", 0.1, seed=42, method="arith")


@register("split_train_test", f"""
SELECT CASE WHEN rn <= (SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) FROM orders) THEN 'test' ELSE 'train' END AS split,
       o_orderstatus, count(*) AS count
FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY {_H}, o_orderkey) AS rn FROM orders)
GROUP BY 1, 2""")
def split_train_test(spark, sf_dir):
    """SA2 + ME7: split flag, then class balance per split."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    s = reshape.split_train_test(o, "o_orderkey", 0.2, seed=42, method="arith")
    return reshape.class_balance(s, "is_test", "o_orderstatus")


# ---------------------------------------------------------------- ML16 / SO1
_H7 = arith_hash_sql("o_orderkey", 7)


@register("synthesize_missing_class", f"""
WITH base AS (SELECT o_orderkey, o_totalprice, {PRIORITY_CASE_SQL} AS priority_code, 0 AS target,
                     CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent
              FROM orders WHERE o_orderstatus = 'F'),
syn AS (SELECT o_orderkey, o_totalprice + 2 AS o_totalprice, greatest(1, priority_code - 1) AS priority_code,
               1 AS target, 0 AS urgent
        FROM (SELECT *, row_number() OVER (ORDER BY {_H7}, o_orderkey) AS rn FROM base)
        WHERE rn <= (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM base))
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, priority_code, target, urgent, false AS is_synthetic FROM base
UNION ALL
SELECT o_orderkey, round(o_totalprice, 6), priority_code, target, urgent, true FROM syn""")
def synthesize_missing_class_plan(spark, sf_dir):
    """ML16: a one-class target (finished orders only) gets 20 % flipped copies shifted by
    rules (code -1 floored at 1, flag to 0, price +2), appended with ``is_synthetic``."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    base = o.select("o_orderkey", "o_totalprice", recode("o_orderpriority", PRIORITY_CODES).alias("priority_code"),
                    F.lit(0).alias("target"), indicator("o_orderpriority", "1-URGENT").alias("urgent"))
    rules = {"priority_code": ("decrement", 1), "urgent": ("set", 0), "o_totalprice": ("add", 2)}
    out = synthesize_missing_class(base, "target", key="o_orderkey", fraction=0.2, seed=7, rules=rules,
                                   method="arith")
    return rounded(out)
