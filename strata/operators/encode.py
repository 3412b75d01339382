"""Encoding: dictionary recodes, binary indicators, clamps and label expressions applied
as one projection, plus the report of values a dictionary did not map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import indicator, recode


def recode_columns(df: DataFrame, specs: Mapping[str, tuple[str, Mapping]]) -> DataFrame:
    """LK1: ``{out_col: (in_col, mapping)}``; unmapped -> NULL."""
    return df.withColumns({out: recode(src, m) for out, (src, m) in specs.items() if src in df.columns})


def recode_join(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, out: str,
                broadcast_limit: int = 1_000_000) -> DataFrame:
    """LK1 for a large dictionary held as a DataFrame: left join.  The dictionary is
    broadcast only when its row count is within ``broadcast_limit`` (checked)."""
    n = mapping.count()
    m = mapping.select(F.col(key).alias("_k"), F.col(value).alias(out))
    m = F.broadcast(m) if n <= broadcast_limit else m
    return df.join(m, df[column].eqNullSafe(m["_k"]), "left").drop("_k")


def indicator_columns(df: DataFrame, specs: Mapping[str, tuple[str, object]]) -> DataFrame:
    """SF1: ``{out_col: (in_col, positive_value)}`` -> 0/1 int, NULL -> 0."""
    return df.withColumns({out: indicator(src, v) for out, (src, v) in specs.items() if src in df.columns})


def unmapped_report(df: DataFrame, specs: Mapping[str, tuple[str, Mapping]]) -> DataFrame:
    """D8: per recoded column, how many non-null inputs the dictionary did not map."""
    aggs = []
    names = []
    for out, (src, m) in specs.items():
        if src not in df.columns:
            continue
        miss = F.col(src).isNotNull() & recode(src, m).isNull()
        aggs.append(F.count_if(miss).alias(out))
        names.append(out)
    if not aggs:
        return df.sparkSession.createDataFrame([], "column_name string, n_unmapped long")
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n_unmapped"))
                                           for n in names])).alias("r")).select("r.*")


def encode_table(df: DataFrame, recodes: Mapping[str, tuple[str, Mapping]],
                 indicators: Mapping[str, tuple[str, object]], keep: Sequence[str] | None = None) -> DataFrame:
    """The whole encoding stage in one projection (LK1 + SF1 + PR1)."""
    out = df.withColumns({**{o: recode(s, m) for o, (s, m) in recodes.items() if s in df.columns},
                          **{o: indicator(s, v) for o, (s, v) in indicators.items() if s in df.columns}})
    return out.select(*[c for c in keep if c in out.columns]) if keep else out
