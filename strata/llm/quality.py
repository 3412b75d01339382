"""Quality rules: one projection of length, symbol, stop-word and line ratios.

A threshold table is compiled into a single Spark projection; no user function runs.  A text
is rejected by the base rule (fewer than 50 words, or more than half of its words inside
repeated three-word windows), or by any row of the table.

Defined results: a null or empty text has no words and fails the base rule; equal lines and
windows are counted as often as they occur; input rows are neither merged nor dropped, so a
repeated row gets a repeated result; columns other than the two named ones pass through
``annotate`` untouched unless they carry the name of a result, which replaces them.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import NOT_SPACE, indexes, let, words

SYMBOLS = "[#*$%&|<>]"
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
WINDOW = 3

# Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = """
the of and to in is that it for on with as was be by this are or an from at not have he you
le la les de des et un une en que qui dans pour par sur du au est pas il elle
der die das und den von zu mit sich ist im nicht ein eine auf dem für
el los las y se del con para es lo su una
di che non per sono della o e da no um uma os het een van dat niet
""".split()


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure compare limit``; a measure is a ratio of two counts."""
    name: str
    count: str
    per: str
    compare: str
    limit: float


RULES: tuple[Rule, ...] = (
    Rule("words_too_short", "word_chars", "n_words", "<", 2.0),
    Rule("words_too_long", "word_chars", "n_words", ">", 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", ">", 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", "<", 0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", ">", 0.35),
)
COMPARE = {"<": operator.lt, ">": operator.gt}


def _repeat_words(w: Column) -> Column:
    """Words inside a window of three that the text holds twice or more.  Windows are sorted
    with their positions; equal neighbours are repeats, and the union of their spans is summed
    from the gaps between consecutive starts."""
    windows = F.transform(indexes(F.size(w) - (WINDOW - 1)),
                          lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        hit = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def count(t: Column) -> Column:
        pairs = F.transform(t, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    return let(windows, count)


def measures(text: Column) -> Column:
    """One struct of counts per text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            n_symbols.cast("long").alias("n_symbols"),
            let(lines, lambda s: F.struct(
                F.size(s).cast("long").alias("n_lines"),
                (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))).alias("lines"))

    return let(words(text), counts)


def verdict(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The counts, ``base_failed``, ``failed_rules`` (names) and ``kept`` as one struct."""
    def judged(m: Column) -> Column:
        value = {c: m[c] for c in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")}
        value |= {c: m["lines"][c] for c in ("n_lines", "n_dup_lines")} | {"n_symbols": m["n_symbols"]}
        base = (value["n_words"] < BASE_MIN_WORDS) | (100 * value["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * value["n_words"])
        broken = [F.when(COMPARE[r.compare](value[r.count], F.lit(r.limit) * value[r.per]), F.lit(r.name)) for r in rules]
        failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
        return F.struct(*[v.alias(c) for c, v in value.items()], base.alias("base_failed"), failed.alias("failed_rules"),
                        (~base & (F.size(failed) == 0)).alias("kept"))

    return let(measures(text), judged)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed",
           "failed_rules", "kept")


def annotate(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the counts, ``base_failed``, ``failed_rules`` (names) and ``kept`` to every row."""
    out = df.select(F.struct("*").alias("row"), verdict(F.col(f"`{text}`"), rules).alias("v"))
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in RESULTS], *[F.col(f"v.{c}") for c in RESULTS])


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows whose text passes every rule."""
    return df.where(verdict(F.col(f"`{text}`"), rules)["kept"])
