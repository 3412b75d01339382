"""Line dedup: an exact set-similarity join of all lines, and removal of later matches.

A line's tokens are its distinct ``shingle``-word shingles (all words as one token if it has
fewer); a line is removed if an earlier one, by document id and line number, has a Jaccard
similarity of at least ``percent``, whether or not that one is removed itself.

1. Equal lines are collapsed by an aggregate: all but the first are later matches.  In the same
   pass each line is cut into tokens once, of which the least by hash go on: similar lines share
   ``SHARED`` of their first s - ceil(t s) + ``SHARED`` tokens in any order of all tokens.
2. These are counted exactly.  A line with fewer than ``SHARED`` that other lines have too is
   similar to none and is done; only the others' whole sets are made.
3. Rarity is the exact number of those lines that have a token.  A line's prefix is the
   s - ceil(t s) + 1 rarest of its s tokens: similar lines share one.  A phrase that many lines have
   is their last token, so it is in the prefix only of lines that have hardly any other.
4. Every prefix token pairs its lines with its first line, one row per line, under length and
   positional bounds; pairs are verified on their whole sets of 64-bit hashes.
5. Lines without a match so far are joined with all earlier lines of their tokens under the
   same bounds and verified, so that no match is lost.

Lines, and the texts of one id, are equal if a 128-bit hash of them is.

Defined results: a null text has no lines and stays null; lines without words are neither
compared nor removed; repeated rows of one id and text lose the same lines; rows of one id with
different texts are different documents; a null id comes first in the order; an empty table
gives an empty result; other columns pass through ``dedup`` unchanged.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import bounded, let, placed, same, written

SHINGLE, PERCENT = 5, 80
SHARED = 3
BROADCAST_TOKENS = 1_000_000  # rows of one or two longs
BROADCAST_LINES = 4_000_000  # line numbers, with an id of some 50 bytes for each document
ID = ["doc_id", "h", "line"]


def text_key(text: Column) -> Column:
    """128 bits of a text, as two hashes of different seeds."""
    return F.struct(F.xxhash64(F.lit(0), text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def blanks(text: Column) -> Column:
    """Other white space than the blank and the line feed made blanks; it is rare, so it is only
    replaced where there is some."""
    other = reduce(or_, [F.contains(text, F.lit(c)) for c in "\t\v\f\r"])
    return F.when(other, F.translate(text, "\t\v\f\r", "    ")).otherwise(text)


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def word_hashes(line: Column) -> Column:
    """Hashes of the words of a line (in lower case, parted by blanks)."""
    return F.transform(line_words(line), lambda x: F.xxhash64(x))


def shingle_hashes(line: Column, shingle: int) -> Column:
    """The tokens of a line, repeats included: hashes of the hashes of its words, each made once."""
    def tokens(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, shingle)]))
        return F.when(F.size(w) < shingle, F.array(F.xxhash64(w))).otherwise(F.slice(hashes, F.lit(1), F.size(w) - (shingle - 1)))

    return let(word_hashes(line), tokens)


def needed(size: Column, percent: int) -> Column:
    """Tokens that a line of ``size`` shares at least with a similar one."""
    return F.floor((percent * size + 99) / 100).cast("int")


def first_lines(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The first of every group of equal lines: ``doc_id, h, line, lid, size, least``, a number and its
    least tokens by hash."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("h"), F.lower(blanks(F.col("text"))).alias("text"))
    lines = d.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.trim("s") != "")

    key = text_key(F.col("s"))  # as two longs, which sort faster than a struct
    given = ["a", "b", *ID]
    some = lambda size: F.least(size, size - needed(size, percent) + SHARED)
    # step by step in columns: sorting and telling apart run as compiled code there, within functions of items they do not
    rows = lines.select(key["a"].alias("a"), key["b"].alias("b"), *ID, F.sort_array(shingle_hashes(F.col("s"), shingle)).alias("t"))
    rows = rows.select(*given, "t", some(F.size("t")).alias("n"))
    rows = rows.select(*given, "t", "n", F.array_distinct(F.slice("t", F.lit(1), F.col("n"))).alias("d"))
    # if the first are all different, repeats further on can only make too many of them; else all are told apart
    rows = rows.select(*given, F.when(F.size("d") == F.col("n"), F.col("t")).otherwise(F.array_distinct("t")).alias("t"))
    rows = rows.select(*given, F.size("t").alias("size"), F.slice("t", F.lit(1), some(F.size("t"))).alias("least"))
    firsts = rows.groupBy("a", "b").agg(F.min(F.struct(*ID, "size", "least")).alias("f"))
    return written(firsts.select("f.*", F.monotonically_increasing_id().alias("lid")), "first-lines")


def similar_maybe(firsts: DataFrame, percent: int) -> DataFrame:
    """``doc_id, h, line, at`` of the lines that share tokens enough with any others, numbered in order."""
    rows = firsts.select("lid", F.least(F.lit(SHARED), needed(F.col("size"), percent)).alias("least_shared"), F.explode("least").alias("token"))
    repeated = written(rows.groupBy("token").count().where("count > 1").select("token"), "repeated-tokens")
    repeated = F.broadcast(repeated) if bounded(repeated, BROADCAST_TOKENS) else repeated.hint("merge")
    shared = rows.join(repeated, "token").groupBy("lid", "least_shared").count().where("count >= least_shared")
    lines = firsts.select("lid", *ID).join(shared.select("lid").hint("merge"), "lid", "left_semi")
    lines = written(lines.select(F.lit(0).alias("all"), *ID), "similar-maybe")
    return written(placed(lines, ["all"], ID).select(*ID, "at"), "numbered-lines")


def line_sets(docs: DataFrame, lines: DataFrame, shingle: int) -> DataFrame:
    """``at`` and the tokens ``set`` of the numbered lines."""
    per_doc = written(lines.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", "at")).alias("wanted")), "wanted-lines")
    size = per_doc.agg(F.sum(F.size("wanted") + 16)).first()[0] or 0
    per_doc = F.broadcast(per_doc) if size <= BROADCAST_LINES else per_doc.hint("shuffle_hash")
    per_doc = per_doc.withColumnsRenamed({"doc_id": "n_id", "h": "n_h"})
    d = docs.select("doc_id", text_key(F.col("text")).alias("h"), "text")
    wanted = let(F.split("text", "\n"), lambda lines: F.transform(
        "wanted", lambda i: F.struct(i["at"].alias("at"), F.get(lines, i["line"]).alias("s"))))
    texts = d.join(per_doc, same({"doc_id": "n_id", "h": "n_h"})).select(F.inline(wanted))
    sets = written(texts.select("at", F.array_distinct(shingle_hashes(F.lower(blanks(F.col("s"))), shingle)).alias("set")), "line-sets")
    again = sets.groupBy("at").count().where("count > 1")  # rows that repeat an id and a text give the same sets
    return sets if again.isEmpty() else written(sets.dropDuplicates(["at"]), "line-sets")


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``token, at, size, pos``: the tokens of every line's prefix by rarity that other lines have too,
    and their places in it."""
    rows = sets.select("at", F.size("set").alias("size"), F.explode("set").alias("token"))
    counts = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "token-counts")
    # a line's own tokens from its commonest on: tokens of no other line are the rarest, and come first
    back = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("n"), F.desc("token")))
    common = rows.join(counts.hint("shuffle_hash"), "token").select("at", "size", "token", back.alias("back"))
    length = F.col("size") - needed(F.col("size"), percent) + 1
    pos = F.col("size") - F.col("back")
    return written(common.where(pos < length).select("token", "at", "size", pos.alias("pos")), "rare-prefixes")


def _pairs(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Rows of one token, ``x`` later than ``y``, that lengths and places allow to be similar."""
    x = x.select("token", *[F.col(c).alias(f"x_{c}") for c in ("at", "size", "pos")])
    y = y.select("token", *[F.col(c).alias(f"y_{c}") for c in ("at", "size", "pos")])
    small, large = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    most = F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
    fits = (100 * small >= percent * large) & ((100 + percent) * most >= percent * (small + large))
    return x.join(y.hint("merge"), "token").where((F.col("y_at") < F.col("x_at")) & fits).select("x_at", "y_at").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Numbers of the later lines of those pairs that are similar by their whole sets of tokens."""
    both = written(pairs, "line-pairs")
    for s in "xy":
        both = both.join(sets.select(F.col("at").alias(f"{s}_at"), F.col("set").alias(f"{s}_set")).hint("merge"), f"{s}_at")
    shared = F.size(F.array_intersect("x_set", "y_set"))
    ok = 100 * shared >= percent * (F.size("x_set") + F.size("y_set") - shared)
    return written(both.where(ok).select(F.col("x_at").alias("at")).distinct(), "matched")


def kept_lines(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, h, lines``: the numbers of each text's lines with words that stay."""
    docs = docs.select("doc_id", "text")
    firsts = first_lines(docs, shingle, percent)
    lines = similar_maybe(firsts, percent)
    sets = line_sets(docs, lines, shingle)
    rows = rare_prefixes(sets, percent)
    first = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "size", "pos")).alias("f")).where("n > 1")
    shared = written(rows.join(first.hint("merge"), "token").select("token", "at", "size", "pos", "f"), "shared-tokens")
    matched = _similar(_pairs(shared, shared.select("token", "f.*").distinct(), percent), sets, percent)
    others = shared.where("at <> f.at")
    rest = others.join(matched.hint("merge"), "at", "left_anti")
    matched = matched.unionByName(_similar(_pairs(rest, others, percent), sets, percent)).distinct()
    gone = lines.join(matched.hint("merge"), "at", "left_semi")
    both = firsts.select(*ID, F.lit(True).alias("first")).unionByName(gone.select(*ID, F.lit(False).alias("first")))
    own = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("line")))
    return both.groupBy("doc_id", "h").agg(F.array_except(own(True), own(False)).alias("lines"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with its texts less the removed lines, plus ``n_lines`` (lines with a word) and
    ``n_removed``."""
    kept = kept_lines(docs, shingle, percent).select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), "lines")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d_id"), text_key(F.col("text")).alias("d_h"))
    row = row.join(kept.hint("shuffle_hash"), F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_h") == F.col("k_h")), "left")
    none = F.array().cast("array<int>")
    # most lines begin with a character above the blank, and need no look at the rest
    blank = lambda x: F.when(F.ltrim(x) >= "!", False).otherwise(F.trim(x, F.lit(" \t\v\f\r")) == "")

    def rebuilt(s: Column) -> Column:
        worded = F.size(F.filter(s, lambda x: ~blank(x)))
        return F.struct(s.alias("s"), worded.alias("worded"), (worded - F.size(F.coalesce("lines", none))).alias("gone"))

    def left(s: Column) -> Column:
        return F.array_join(F.filter(s, lambda x, i: F.array_contains(F.coalesce("lines", none), i) | blank(x)), "\n")

    def result(r: Column) -> Column:
        text = F.when(r["gone"] == 0, F.col("row.text")).otherwise(left(r["s"]))
        return F.struct(text.alias("text"), r["worded"].cast("long").alias("n_lines"), r["gone"].cast("long").alias("n_removed"))

    out = row.select("row", let(let(F.split("row.text", "\n"), rebuilt), result).alias("r"))
    text = F.when(F.col("row.text").isNotNull(), F.col("r.text"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    counts = [F.when(F.col("row.text").isNull(), 0).otherwise(F.col(f"r.{c}")).cast("long").alias(c) for c in ("n_lines", "n_removed")]
    return out.select(*columns, *counts)
