"""Mixing sources to target weights.

Every source gets a word target: its weight's share of all words, at most ``max_epochs`` times
what it has; the excess is shared again by weight until no target is above.  A target is filled
by complete epochs of the source first, then by a weighted sample without replacement after
Efraimidis and Spirakis: each document draws an exponential key -ln(u) / weight, documents are
ordered by key within their source, and prefix sums cut the order at the rest of the budget.
The document on the cut gives the words that still fit, so a source lands within one word of
its target.  u comes from a hash of the seed and the document id: reruns agree.

The order within a source is never one task's work: keys fall into ``bins`` ranges, a first aggregate sums sizes by (source, range), prefix sums over those few rows
give each range its offset, and only the ranges on a cut are sorted by a window.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a
null weight counts as 1 and no weight is taken under 1e-6; repeated rows are documents of their
own, with their own share (ties in the key are ordered by size, and equal rows may swap, which
no result shows); an empty table gives an empty result.  Only the named columns are read and
returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import words, written

BINS = 1024
MAX_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.size(words(text)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a hash."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` (one row each) -> the same with ``weight`` and ``target``.

    The shared level is found in closed form: sources in the order of cap / weight are capped
    as long as the level that the others would then get is at least their own.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") - 1) % n)
    capped = (sources.withColumn("r", F.row_number().over(order)).withColumn("weight", pick)
              .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
              .withColumn("level", F.col("cap") / F.col("weight")))
    shared = (capped.withColumn("total", F.sum("source_size").over(every).cast("double"))
              .withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(after))
              .withColumn("share", (F.col("total") - F.col("taken")) / F.col("open"))
              # the first source that its cap does not hold back sets the level for all after it
              .withColumn("water", F.max(F.when(F.col("level") >= F.col("share"), F.col("share"))).over(every)))
    return shared.select("source", "source_size", "weight", F.least(
        F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1",
        bins: int = BINS) -> DataFrame:
    """``doc_id, source, size, quality`` (quality: the sampling weight) -> one row per document:
    ``doc_id, source, size, source_size, target, epochs, taken``."""
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.greatest(F.coalesce(F.col("quality"), F.lit(1.0)), F.lit(1e-6))
    docs = written(docs.select("doc_id", "source", "size", "quality"), "sizes")  # texts are read once
    # e^-key is uniform for weight 1; half the exponent keeps the last range small for weights down to 0.2
    ranged = docs.withColumn("key", key).withColumn(
        "bin", F.least(F.floor((1 - F.exp(F.col("key") / -2)) * bins), F.lit(bins - 1)).cast("int"))
    in_bin = ranged.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    t = targets(in_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = in_bin.withColumn("bin_from", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    plan = (edges.alias("e").join(t.alias("t"), F.col("e.source").eqNullSafe(F.col("t.source")))
            .select(F.col("e.source").alias("p_source"), F.col("bin").alias("p_bin"), "bin_from", "bin_size",
                    "source_size", "target", "epochs", "rest"))
    placed = ranged.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bin") == F.col("p_bin")))
    on_cut = (F.col("rest") > F.col("bin_from")) & (F.col("rest") < F.col("bin_from") + F.col("bin_size"))
    running = F.sum("size").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    out = ["doc_id", "source", "size", "source_size", "target", "epochs", "taken"]
    base = F.col("epochs") * F.col("size")
    cut = (placed.where(on_cut).withColumn("before", F.col("bin_from") + F.coalesce(running, F.lit(0)))
           .withColumn("taken", base + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))))
    whole = placed.where(~on_cut).withColumn(
        "taken", base + F.when(F.col("rest") >= F.col("bin_from") + F.col("bin_size"), F.col("size")).otherwise(F.lit(0)))
    return cut.select(*out).unionByName(whole.select(*out))
