"""Scans: parquet / CSV with an explicit schema, missing tokens, fallback paths, literal
tables and the shape report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from strata.functions.expr import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Parquet keeps the scan columnar: projections and filters written
    later reach the reader as ReadSchema / PushedFilters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MISSING_TOKENS = ("", "NA", "N/A", "NaN", "null")


class _Csv:
    """A CSV scan as raw text, and what its cells should be."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, tokens: Sequence[str], header: bool):
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        raw = T.StructType([T.StructField(f"r{i}", T.StringType()) for i in range(len(self.schema))] + [T.StructField("_record", T.StringType())])
        reader = spark.read.option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE")
        self.rows = reader.option("columnNameOfCorruptRecord", "_record").schema(raw).csv(path)
        self.tokens = list(tokens)

    def cell(self, i: int) -> tuple[Column, Column]:
        """The typed cell of column i, and whether its text is neither missing nor of the type."""
        raw, kind = F.col(f"r{i}"), self.schema[i].dataType
        text = F.when(~F.trim(raw).isin(self.tokens), raw) if self.tokens else raw
        if isinstance(kind, T.StringType):
            return text, F.lit(False)
        value = F.trim(text).try_cast(kind)
        bad = text.isNotNull() & value.isNull()
        return nan_to_null(value).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else value, bad


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, missing_tokens: Sequence[str] = MISSING_TOKENS,
             header: bool = True, on_malformed: str = "fail") -> DataFrame:
    """CSV scan with a declared schema (inference turns a column holding ``NA`` into string).

    Cells equal, after trimming, to a missing token are NULL.  A cell that is not of its column's type, and a
    row of another number of cells, is malformed: ``on_malformed='fail'`` raises when it is read and names
    column and text, ``'null'`` makes the cell NULL (missing cells of a short row too, those too
    many go); ``csv_rejects`` lists them all."""
    if on_malformed not in ("fail", "null"):
        raise ValueError(f"unknown policy for malformed cells: {on_malformed}")
    scan, out = _Csv(spark, path, schema, missing_tokens, header), []
    for i, f in enumerate(scan.schema):
        value, bad = scan.cell(i)
        if on_malformed == "fail":
            why = F.concat(F.lit(f"malformed cell in column {f.name}: "), F.col(f"r{i}"))
            value = F.when(bad, F.raise_error(why).cast(f.dataType)).otherwise(value)
            if i == 0:
                shape = F.raise_error(F.concat(F.lit("row of a wrong number of cells: "), F.col("_record"))).cast(f.dataType)
                value = F.when(F.col("_record").isNotNull(), shape).otherwise(value)
        out.append(value.alias(f.name))
    return scan.rows.select(*out)


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType | str, missing_tokens: Sequence[str] = MISSING_TOKENS,
                header: bool = True) -> DataFrame:
    """``row, column, raw`` of every malformed cell of a CSV scan: the row's cells as JSON, the column's name
    (NULL: the row has a wrong number of cells; ``raw`` is then the record) and the cell's text."""
    scan = _Csv(spark, path, schema, missing_tokens, header)
    names = [f.name for f in scan.schema]
    whole = F.to_json(F.struct(*[F.col(f"r{i}").alias(n) for i, n in enumerate(names)]))
    found = [F.when(F.col("_record").isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col("_record").alias("raw")))]
    found += [F.when(scan.cell(i)[1], F.struct(F.lit(n).alias("column"), F.col(f"r{i}").alias("raw"))) for i, n in enumerate(names)]
    bad = scan.rows.select(whole.alias("row"), F.explode(F.array_compact(F.array(*found))).alias("bad"))
    return bad.select("row", "bad.column", "bad.raw")


def normalize_missing(df: DataFrame, tokens: Iterable[str] = ("", "NA", "N/A", "NaN", "null"),
                      columns: Iterable[str] | None = None) -> DataFrame:
    """One missing marker: string cells equal (after trim) to a token -> NULL; float NaN
    -> NULL.  ``None`` is deliberately not a default token (it is a category value)."""
    toks = list(tokens)
    cols = set(columns) if columns is not None else None
    exprs = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, T.StringType) and toks:
            exprs[f.name] = F.when(F.trim(F.col(f.name)).isin(toks), F.lit(None).cast("string")) \
                .otherwise(F.col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs[f.name] = nan_to_null(f.name).cast(f.dataType)
    return df.withColumns(exprs) if exprs else df


def read_first_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
                        **options) -> DataFrame:
    """Prefer the first path that exists (clean copy), else the next (raw)."""
    last = None
    for p in paths:
        try:
            return spark.read.format(fmt).options(**options).load(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = e
    raise FileNotFoundError(f"none of {list(paths)} exists") from last


def records_table(spark: SparkSession, rows: Sequence[dict], schema: T.StructType | str | None = None
                  ) -> DataFrame:
    """Literal table from records (scoring records, coefficient tables)."""
    if schema is None:
        return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0].keys()))
    return spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else r for r in rows], schema)


def shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_cols)``: a single count job, the column number is schema-only."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
