"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

A window is ``window`` consecutive words of an item (a shorter item is one window).  Its
shingles of up to ``shingle`` words are ordered by how rare they are in the documents; for
containment of the whole window one shingle, the rarest, is the necessary prefix.

1. One scan cuts documents into words, and a join keeps the positions whose shingle occurs in
   the benchmark, plus one row per document with its length.  The benchmark's shingles are
   broadcast when their checked count is within ``broadcast_rows``; else Spark shuffles.
2. Those hits, over all documents, give each shingle's frequency; each window takes its rarest.
3. Hits on a prefix shingle propose a place for the window (bounds: it starts at or after 0
   and ends within the document).  It counts if the document's hits hold every shingle of the
   window, at consecutive positions: exact, as shingles are compared as text.

Everything after the scan is one row per (document, hit) or per document, whatever the number
of documents that share a passage; no pairs of documents are made.

Defined results: null or empty texts and items have no words, hit nothing and are hit by
nothing; repeated items count once per item id, repeated documents each get their own row;
an empty benchmark leaves every document clean; words inside an item without an id are hit, but
it has no place among ``items``; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import bounded, indexes, let, lower_ascii, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 5
BROADCAST_ROWS = 200_000
CONTAMINATED_PERCENT = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(w: Column, k: int) -> Column:
    """Structs of position and text of every run of ``k`` words."""
    return F.transform(indexes(F.size(w) - (k - 1)), lambda i: F.struct(
        i.alias("p"), F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]).alias("gram")))


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per different window: ``length, grams`` (its shingles in order), ``items``."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = w.select("item", F.explode(F.when(F.size("w") <= window, F.array(F.col("w"))).otherwise(
        F.transform(indexes(F.size("w") - (window - 1)), lambda i: F.slice(F.col("w"), i + 1, window)))).alias("v"))
    k = F.least(F.lit(shingle), F.size("v"))
    grams = F.transform(indexes(F.size("v") - k + 1), lambda i: F.array_join(F.slice(F.col("v"), i + 1, k), " "))
    return (cut.groupBy("v").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select(F.size("v").alias("length"), k.alias("k"), grams.alias("grams"), "items"))


def hits(docs: DataFrame, wins: DataFrame, shingle: int, broadcast_rows: int) -> DataFrame:
    """``row, doc_id, n_words, p, gram``: the shingles of documents that windows hold; p = -1
    marks the one row that every document has."""
    grams = wins.select(F.explode("grams").alias("known")).distinct()
    sizes = sorted(r["k"] for r in wins.select("k").distinct().collect())  # at most ``shingle`` numbers
    first = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("gram")))

    def rows(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.concat(first, *[shingles(w, k) for k in sizes]).alias("all"))

    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(words(F.col("text")), rows).alias("x"))
    cut = cut.select("row", "doc_id", F.col("x.n").cast("long").alias("n_words"), F.explode("x.all").alias("s"))
    cut = cut.select("row", "doc_id", "n_words", "s.p", "s.gram")
    grams = F.broadcast(grams) if bounded(grams, broadcast_rows) else grams
    joined = cut.join(grams, F.col("gram") == F.col("known"), "left")
    return joined.where((F.col("p") < 0) | F.col("known").isNotNull()).drop("known")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (sorted ids of the items with a window in the text) and
    ``contaminated``, one row per document."""
    wins = windows(items.select("item_id", "text"), window, shingle)
    found = written(hits(docs.select("doc_id", "text"), wins, shingle, broadcast_rows), "hits")
    rarity = found.where("p >= 0").groupBy("gram").count()

    # each window's rarest shingle; a shingle without hits means that no document holds the window
    each = wins.select("length", "grams", "items", F.posexplode("grams").alias("offset", "gram"))
    each = each.join(rarity, "gram")
    best = (each.groupBy("length", "grams", "items")
            .agg(F.min(F.struct("count", "gram", "offset")).alias("best"), F.count(F.lit(1)).alias("known"))
            .where(F.col("known") == F.size("grams")))
    anchors = (best.groupBy(F.col("best.gram").alias("anchor"))
               .agg(F.collect_list(F.struct(F.col("best.offset").alias("offset"), "length", "grams", "items")).alias("wins")))
    anchors = F.broadcast(anchors) if bounded(best, broadcast_rows // 20) else anchors  # a window has 13 words at most

    proposed = found.join(anchors, F.col("gram") == F.col("anchor"), "left")
    places = F.transform(F.col("wins"), lambda v: F.struct(
        (F.col("p") - v["offset"]).alias("at"), v["length"].alias("length"), v["grams"].alias("grams"), v["items"].alias("items")))
    places = F.filter(places, lambda v: (v["at"] >= 0) & (v["at"] + v["length"] <= F.col("n_words")))
    per_doc = (proposed.select("row", "doc_id", "n_words", "p", "gram", places.alias("places"))
               .groupBy("row", "doc_id", "n_words")
               .agg(F.sort_array(F.collect_list(F.when(F.col("p") >= 0, F.struct("p", "gram")))).alias("held"),
                    F.flatten(F.collect_list("places")).alias("places")))

    def verified(held: Column, places: Column) -> Column:
        def holds(v: Column) -> Column:
            n = F.size(v["grams"])
            wanted = F.transform(v["grams"], lambda g, j: F.struct((v["at"] + j).alias("p"), g.alias("gram")))
            first = F.array_position(held, F.get(wanted, F.lit(0))).cast("int")
            return (first > 0) & F.when(first > 0, F.slice(held, first, n) == wanted)
        return F.filter(places, holds)

    # shingles of one length only are consecutive in ``held``; short items have their own length
    held = lambda v: F.filter(F.col("held"), lambda h: F.size(F.split(h["gram"], " ")) == F.least(F.lit(shingle), v))
    mixed = F.exists("places", lambda v: v["length"] < shingle)
    full = let(held(F.lit(shingle)), lambda h: verified(h, F.filter("places", lambda v: v["length"] >= shingle)))
    short = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, shingle - 1))), lambda k: let(
        held(k), lambda h: verified(h, F.filter("places", lambda v: v["length"] == k)))))
    found = F.when(F.size("places") > 0, F.when(mixed, F.concat(full, short)).otherwise(full))
    out = per_doc.select("doc_id", "n_words", F.coalesce(found, F.slice("places", 1, 0)).alias("found"))

    spans = F.sort_array(F.transform("found", lambda v: F.struct(v["at"].alias("at"), (v["at"] + v["length"]).alias("to"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    union = F.aggregate(spans, none, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["end"], s["at"]))).cast("long").alias("n"),
        F.greatest(a["end"], s["to"]).alias("end")))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda v: v["items"]))))
    out = out.select("doc_id", "n_words", union["n"].alias("n_hit"), ids.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= CONTAMINATED_PERCENT * F.col("n_words")))
