"""Driver-table views with deliberately missing values (the driver tables have none), in
Spark and as SQL text, so that both engines see exactly the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.expr import arith_hash, arith_hash_sql
from strata.plans.registry import table

# priority text -> ordinal code for the order tables
PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
PRIORITY_CASE_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 "
                     "WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END")

# about 5 % of order prices become missing: hash of the key below this threshold
MISSING_PRICE_BELOW = 50_000


def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumns({
        "o_totalprice": F.when(arith_hash("o_orderkey", 7) < MISSING_PRICE_BELOW, F.lit(None).cast("double"))
                         .otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
                            .otherwise(F.col("o_orderpriority")),
    })


ORDERS_N_SQL = f"""(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN {arith_hash_sql('o_orderkey', 7)} < {MISSING_PRICE_BELOW} THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders)"""


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({"l_discount": F.nullif(F.col("l_discount"), F.lit(0.0)),
                           "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0))})


LINEITEM_N_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  NULLIF(l_discount, 0.0) AS l_discount, NULLIF(l_tax, 0.0) AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem)"""
