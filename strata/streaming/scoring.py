"""Structured Streaming: the batch operators that are stateless projections (scoring,
recoding, indicators, fixed-parameter scaling) apply unchanged to a streaming DataFrame,
and group profiles become streaming aggregates with a watermark.

Sinks get a checkpoint location under the session's shared ``spark.checkpoint.dir`` so a
restarted query (or a lost executor) resumes exactly where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strata.operators.common import number
from strata.operators.score import Scorer
from strata.session import checkpoint_dir


def is_file(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system, which the driver's disk knows nothing of."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream over a parquet folder (new files are new micro-batches).  A
    single-file path streams its folder filtered to that file name."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if is_file(spark, path):
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return r.load(path)


def score_stream(stream: DataFrame, scorer: Scorer, keep: Sequence[str] = ()) -> DataFrame:
    """ML17 on a stream: the very same projection as the batch scorer (no state)."""
    return scorer.transform(stream, keep=keep)


def windowed_profile(stream: DataFrame, ts: str, group: str, value: str, window: str = "10 minutes",
                     watermark: str = "30 minutes") -> DataFrame:
    """Streaming AG1/AG3: count and mean of ``value`` per (event-time window, group).  The
    watermark bounds the state kept for late rows; windows close in append mode."""
    # watermarks need TIMESTAMP; a wall-clock TIMESTAMP_NTZ column is read in the session zone
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(group))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(number(value)).alias("mean_value"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "n",
                    "mean_value"))


def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None, mode: str = "append",
          trigger_once: bool = False) -> StreamingQuery:
    """Start a query with a durable checkpoint under the shared checkpoint folder."""
    ck = os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    w = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", ck)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).start(path)
