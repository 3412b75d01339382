"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, benchmark
decontamination and mixing.

``run`` applies the stages to ``documents``; each stage's rows are written to the shared folder
and read again by the next.  All stages but the last return the columns that they were given.

Defined results, stage by stage, for odd rows: documents without text fail the quality rules; a
null id is never matched with another null id; rows that repeat an id and a text are copies, of
which the near-duplicate stage keeps one; rows of one id with different texts are different
documents; an empty table stays empty; further columns pass through to the mixing stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, line_dedup, minhash, mixing, quality
from strata.llm.common import discard, placed, table, written
from strata.llm.queries import label_weight

SHINGLE = 5  # words; the similarity is minhash.PERCENT


def key() -> Column:
    """Tells texts of one id apart."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches, and ``n_chars`` to suit; a document
    whose lines were all removed goes, as nothing of it is new."""
    given = {c: F.col(f"row.`{c}`") for c in docs.columns}
    # columns of the same name as a count are put aside, so that they come back as they were
    out = line_dedup.dedup(docs.select("doc_id", "text", F.struct("*").alias("row")))
    stays = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in given:
        kind = docs.schema["n_chars"].dataType
        given["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(given["n_chars"])
    given["text"] = F.col("text")
    return stays.select(*[c.alias(name) for name, c in given.items()])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), key()).alias("doc_id"), "text")
    found = written(minhash.near_duplicates(keyed, shingle=SHINGLE), "near").withColumnRenamed("doc_id", "node")
    gone = found.where(~F.col("kept")).select("node").distinct()
    stay = docs.join(gone, key() == F.col("node"), "left_anti").select(*docs.columns)
    repeated = found.where("kept AND node IS NOT NULL").groupBy("node").count().where("count > 1").select("node")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, key() == F.col("node"), "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(repeated, key() == F.col("node"), "left_anti").unionByName(once).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    found = decontaminate.contamination(docs.select(key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, key().eqNullSafe(F.col("bad")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target`` and ``taken``
    (words, repeats counted).  Rows alike in id, text and source share what the mix takes of them as evenly
    as whole words allow, so that no word is lost; a row whose share is nothing goes."""
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    slim = docs.select(key().alias("key"), "doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    slim = slim.join(known, "doc_id", "left").select(F.col("key").alias("doc_id"), "source", "size", label_weight().alias("quality"))
    plan = written(mixing.mix(slim).groupBy(F.struct(F.col("doc_id").alias("key"), "source").alias("of")).agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("taken").alias("sum"), F.count(F.lit(1)).alias("alike")).where("sum > 0"), "mix-plan")
    rows = docs.select(F.struct("*").alias("row"), F.struct(key().alias("key"), "source").alias("id"))
    single, several = plan.where("alike = 1"), plan.where("alike > 1")
    clash = {"size", "source_size", "target", "taken"}
    columns = [*[F.col(f"row.`{c}`") for c in docs.columns if c not in clash], "size", "source_size", "target"]
    out = rows.join(single, F.col("id").eqNullSafe(F.col("of"))).select(*columns, F.col("sum").cast("long").alias("taken"))
    if several.isEmpty():
        return out
    alike = written(rows.join(several, F.col("id").eqNullSafe(F.col("of"))).withColumn("salt", F.rand(13)), "alike-rows")
    nth = placed(alike, ["id"], ["salt"], at="nth", total="all")
    share = F.floor(F.col("sum") / F.col("alike")) + (F.col("nth") < F.col("sum") % F.col("alike")).cast("long")
    return out.unionByName(nth.withColumn("taken", share.cast("long")).where("taken > 0").select(*columns, "taken"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]
ORACLE_SQL = None  # SQL has no near-duplicate stage; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if former is not None:
            discard(former)  # the next stage's rows are written
        former = docs
    return docs
