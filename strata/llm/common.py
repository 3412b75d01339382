"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value, so that executors need
    no copy of this library on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def words(text: Column) -> Column:
    """Runs of anything but space and the control characters 9 to 13; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.  Only a local
    session without one gets a folder of its own."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strata-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than that)."""
    return df.limit(rows + 1).count() <= rows


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def same(pairs: dict[str, str]) -> Column:
    """Equality of columns, null to null."""
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def placed(df: DataFrame, group: list[str], order: list[str], weight: Column | None = None, at: str = "at",
           total: str = "total") -> DataFrame:
    """``df`` with ``at``, the sum of ``weight`` (1 a row) over the rows before it in its group,
    and ``total``, the group's sum.  Nulls come first; a tie in all of ``group`` and ``order``
    is broken anyhow, so its rows must be alike or have a salt among ``order``.

    Rows are dealt out by ranges of (group, order), so that a group of any size spreads over
    tasks: running sums are made within each range, and the ranges' sums, a row for each range
    and group, shift them.  ``df`` is read twice; rows read again must come out the same.
    """
    weight = F.lit(1) if weight is None else weight
    keys = [F.col(c) for c in (*group, *order)]
    parts = written(df.withColumn("_w", weight.cast("long")).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()),
                    "placed")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(*before)
    rows = parts.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    sums = parts.groupBy("_part", *group).agg(F.sum("_w").alias("_sum"))
    by = Window.partitionBy(*group)
    shift = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group],
                        F.coalesce(F.sum("_sum").over(by.orderBy("_part").rowsBetween(*before)), F.lit(0)).alias("_shift"),
                        F.sum("_sum").over(by).alias(total))
    shift = written(shift, "shifts")
    shift = F.broadcast(shift) if bounded(shift, 100_000) else shift
    on = (F.col("_part") == F.col("_p")) & same({c: f"_g_{c}" for c in group})
    return rows.join(shift, on).select(*df.columns, (F.col("_in") + F.col("_shift")).alias(at), total)
