"""Near-duplicate documents: many universal hash minima with banding, signature verification,
exact confirmation on full shingle sets, and components by alternating stars.

1. One scan hashes each text's distinct ``shingle``-word shingles (64 bits) and takes the minima
   of ``bands * rows`` universal hash functions.
2. Texts with equal sets form a class; only the class's first document goes on, so a group of
   copies costs one row each.
3. Representatives are grouped by band.  First each is paired with the smallest document of its
   buckets: one pair a document.  Pairs whose signatures agree enough are confirmed on their
   full sets, and links become components.
4. A bucket whose members are one component is done.  In the others members are paired with the
   bucket's ends where those are in another component, and confirmed likewise.
5. Buckets still open after that are hot: their members share a band, but mostly little else.  These
   members, and no others, are banded anew by ``FINE_BANDS`` bands of ``FINE_ROWS`` further minima, which
   parts what is not alike, and step 4 is repeated on the fine buckets.
6. In fine buckets still open every remaining pair across components is compared, in blocks of
   bounded size; places in a bucket come from counts by range, not from a window over its sets.

With 40 bands of 6, a pair at similarity 0.8 shares no band with probability 5e-6, and with 85 of 10
no fine band with probability 7e-5; signatures of 240 bytes reject a pair at 0.8 with
probability under 1e-7.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a
text shorter than a shingle is one shingle; rows that repeat an id are in one component (linked if
any of its texts is; texts are compared one by one), and each row is returned; a null id is never
linked.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import placed, ship, written
from strata.llm.components import components

ship(__name__)

BANDS, ROWS = 40, 6
FINE_BANDS, FINE_ROWS = 85, 10
SHINGLE, PERCENT = 4, 80
SIGNATURE_LEAST = 0.65
CHUNK = 2048
CACHE = 400_000
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 2_000_000  # a block has no more of either, or is one document


def shingle_hashes(words: list[bytes], k: int, ids: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; all words at once if fewer."""
    if not words:
        return np.empty(0, np.uint64)
    if len(ids) > CACHE:
        ids.clear()
    for w in set(words).difference(ids):
        ids[w] = xxhash.xxh3_64_intdigest(w)
    x = np.array([ids[w] for w in words], np.uint64)
    k = min(k, len(x))
    h = np.full(len(x) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):
        h = (h ^ x[i:len(x) - k + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every universal function a*x + b (mod 2^64) over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(out, (a[:, None] * hashes[None, i:i + CHUNK] + b[:, None]).min(axis=1), out=out)
    return out


def bands_of(minima: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of the minima."""
    g, x = minima.reshape(bands, -1), np.arange(bands, dtype=np.uint64)
    for j in range(g.shape[1]):
        x = (x ^ g[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


def functions_for(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2 ** 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Words of each text: A-Z lower-cased, cut at the ASCII white space."""
    for t in batch.column("text"):
        s = t.as_py()
        yield s.encode().lower().split() if s else []


def signer(shingle: int, bands: int, rows: int):
    def sign(batches):
        a, b = functions_for(bands * rows)
        ids: dict[bytes, int] = {}
        for batch in batches:
            n, key, sig, band = [], [], [], []
            for words in _texts(batch):
                h = shingle_hashes(words, shingle, ids)
                n.append(len(h))
                if not len(h):
                    key.append(None), sig.append(None), band.append(None)
                    continue
                m = minima(h, a, b)
                key.append(xxhash.xxh3_128_digest(h.tobytes()))
                sig.append((m >> np.uint64(32)).astype(np.uint8).tobytes())
                band.append(bands_of(m, bands))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()),
                 pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig", "band"])
    return sign


def set_maker(shingle: int):
    def make(batches):
        ids: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(w, shingle, ids).tobytes() for w in _texts(batch)]
            keys = [xxhash.xxh3_128_digest(z) for z in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                             ["doc_id", "set_key", "set"])
    return make


def sets_of(nodes: DataFrame, docs: DataFrame, shingle: int, several: bool) -> DataFrame:
    """The full sets of ``nodes`` (``doc_id``; with the text's ``set_key`` if ids have ``several`` texts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    needed = nodes.select(F.col("doc_id.doc_id") if several else F.col("doc_id")).distinct()
    sets = docs.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(
        set_maker(shingle), f"doc_id {kind}, set_key binary, set binary")
    node = F.struct("doc_id", "set_key").alias("doc_id") if several else F.col("doc_id")
    return written(sets.select(node, "set"), "sets")


def agreeing(least: float):
    """Pairs whose signatures agree in a share ``least`` of their bytes."""
    def keep(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("sig_x", "sig_y"))
            yield batch.select(["x", "y"]).filter(pa.array((x == y).mean(axis=1) >= least))
    return keep


def confirming(percent: int):
    """Pairs with 100 * intersection >= percent * union."""
    def keep(batches):
        for batch in batches:
            ok = []
            for u, v in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (u, v))
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))
    return keep


def _open(members: DataFrame, same: DataFrame) -> DataFrame:
    """The members of buckets that hold two components or more, with their component ``c`` and
    those of the bucket's ends."""
    at = (members.join(same.hint("merge"), members.doc_id == same.node, "left")
          .select("key", "doc_id", "n", "first", "last", F.coalesce("component", "doc_id").alias("c")))
    mixed = at.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by("c", "doc_id").alias("c_first"),
                                  F.max_by("c", "doc_id").alias("c_last")).where("c0 < c1").drop("c0", "c1")
    return written(at.join(mixed.hint("merge"), "key"), "open")


def _least_partner(members: DataFrame) -> DataFrame:
    """Each member with the smallest document of all its buckets."""
    return members.groupBy(F.col("doc_id").alias("x")).agg(F.min("first").alias("y")).where("x != y")


def _end_partners(members: DataFrame) -> DataFrame:
    """Each member with the ends of its buckets that are in other components."""
    ends = F.array(F.struct(F.col("first").alias("y"), F.col("c_first").alias("cy")),
                   F.struct(F.col("last").alias("y"), F.col("c_last").alias("cy")))
    ends = F.filter(ends, lambda e: e["cy"] != F.col("c"))
    return members.select(F.col("doc_id").alias("x"), F.explode(ends).alias("e")).select("x", "e.y")


def comparing(percent: int):
    """Links across components among the documents of one pair of blocks (or within one block):
    intersections are counted by products of the incidence matrix of shared shingles."""
    def compare(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(z.as_buffer(), np.uint64) for z in rows["set"]]
        size = np.array([len(z) for z in sets])
        _, column, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = held_by > 1
        place = np.cumsum(shared) - 1
        row, column = np.repeat(np.arange(len(sets)), size)[shared[column]], place[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(shared.sum()), CHUNK):
            part = slice(*np.searchsorted(column, [at, at + CHUNK]))
            dense = np.zeros((len(sets), CHUNK), np.float32)
            dense[row[part], column[part] - at] = 1
            both += dense @ dense.T
        c = np.unique([str(v) for v in rows["c"].to_pylist()], return_inverse=True)[1]  # ids may be structs
        block, across = np.array(rows["block"].to_pylist()), rows["i"][0].as_py() != rows["j"][0].as_py()
        ok = (c[:, None] != c) & (100 * both >= percent * (size[:, None] + size - both))
        ok &= (block[:, None] != block) if across else True
        x, y = np.nonzero(np.triu(ok, 1))
        ids = rows["doc_id"].combine_chunks()
        return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y))})
    return compare


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the fine bands of sets."""
    a, b = functions_for(FINE_BANDS * FINE_ROWS, seed=8)
    for batch in batches:
        keys = [bands_of(minima(np.frombuffer(z.as_buffer(), np.uint64), a, b), FINE_BANDS) for z in batch.column("set")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "band"])


def _fine_sets(members: DataFrame, docs: DataFrame, shingle: int, several: bool) -> DataFrame:
    """Sets of the members of open buckets that neither end of their bucket was tested for."""
    inner = members.where((F.col("n") > 3) & (F.col("doc_id") != F.col("first")) & (F.col("doc_id") != F.col("last")))
    mixed = inner.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    nodes = written(inner.join(mixed.hint("merge"), "key").select("doc_id").distinct(), "inner")
    return sets_of(nodes, docs, shingle, several)


def _buckets(banded: DataFrame, name: str) -> DataFrame:
    """``doc_id, band`` -> the members of buckets of two or more, with the buckets' sizes and ends."""
    buckets = banded.select("doc_id", F.explode("band").alias("key"))
    ends = (buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"),
                                       F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")))
    return written(buckets.join(ends.hint("merge"), "key"), name)


def _remaining(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members that neither end of their bucket was tested for, across
    components.  A bucket is cut into blocks of bounded size; each pair of blocks is compared in
    one go, so that what is passed on are members and links, never pairs."""
    kind = members.schema["doc_id"].dataType.simpleString()
    inner = members.where((F.col("n") > 3) & (F.col("doc_id") != F.col("first")) & (F.col("doc_id") != F.col("last")))
    mixed = inner.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    sizes = sets.select(F.col("doc_id").alias("_d"), (F.octet_length("set") / 8).cast("long").alias("size"))
    inner = inner.join(mixed.hint("merge"), "key").join(sizes.hint("merge"), F.col("doc_id") == F.col("_d"))
    inner = written(inner.select("key", "doc_id", "c", "size"), "inner")
    if inner.isEmpty():
        return inner.select(F.col("doc_id").alias("x"), F.col("doc_id").alias("y"))
    block = lambda c: F.floor(F.col(c) / BLOCK_SHINGLES).cast("int")
    rows = placed(inner, ["key"], ["doc_id"], F.col("size") + BLOCK_SHINGLES // BLOCK_ROWS).select(
        "key", "doc_id", "c", block("at").alias("block"), F.explode(F.sequence(F.lit(0), block("total"))).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "c")
    rows = rows.join(sets.hint("merge"), "doc_id")
    return rows.groupBy("key", "i", "j").applyInArrow(comparing(percent), f"x {kind}, y {kind}").distinct()


def _linked(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, shingle: int, percent: int, several: bool) -> DataFrame:
    """Those of ``x, y`` that pass the signature and the exact test."""
    kind = sigs.schema["doc_id"].dataType.simpleString()
    x = sigs.withColumnsRenamed({"doc_id": "x", "sig": "sig_x"})
    y = sigs.withColumnsRenamed({"doc_id": "y", "sig": "sig_y"})
    near = written(pairs.hint("merge").join(x.hint("merge"), "x").join(y.hint("merge"), "y").select("x", "y", "sig_x", "sig_y")
                   .mapInArrow(agreeing(SIGNATURE_LEAST), f"x {kind}, y {kind}"), "near")
    sets = sets_of(near.select(F.explode(F.array("x", "y")).alias("doc_id")), docs, shingle, several)
    x = sets.withColumnsRenamed({"doc_id": "x", "set": "set_x"})
    y = sets.withColumnsRenamed({"doc_id": "y", "set": "set_y"})
    both = near.join(x.hint("merge"), "x").join(y.hint("merge"), "y").select("x", "y", "set_x", "set_y")
    return written(both.mapInArrow(confirming(percent), f"x {kind}, y {kind}").distinct(), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row: the component is named by its smallest
    id, and the row of that id is kept."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType()),
                           T.StructField("band", T.ArrayType(T.LongType()))])
    signed = written(docs.mapInArrow(signer(shingle, bands, rows), schema), "signed")
    known = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"),
                                                F.min_by(F.struct("sig", "band"), "doc_id").alias("s"))
                   .select("set_key", "doc_id", "s.sig", "s.band"), "reps")
    texts = known.groupBy("doc_id").agg(F.min("set_key").alias("k0"), F.max("set_key").alias("k1")).where("k0 < k1").select("doc_id")
    texts = written(known.select("doc_id", "set_key").join(texts.hint("merge"), "doc_id", "left_semi").distinct(), "texts")
    several = not texts.isEmpty()
    if several:  # from here on each text is a node of its own
        reps = reps.withColumn("doc_id", F.struct("doc_id", "set_key"))

    members = _buckets(reps, "members")
    sigs = reps.select("doc_id", "sig")
    tested = lambda pairs: _linked(pairs.select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), sigs, docs, shingle, percent, several)
    links = tested(_least_partner(members)).toDF("a", "b")
    if several:  # the texts of an id are linked
        at = texts.withColumnRenamed("doc_id", "id").join(reps.select("set_key", F.col("doc_id").alias("b")), "set_key")
        first = at.groupBy("id").agg(F.min("b").alias("a"))
        links = links.unionByName(at.join(first, "id").where("a != b").select("a", "b").distinct())
    same = components(links)

    def joined(links: DataFrame) -> DataFrame:
        known = same.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return components(links.toDF("a", "b").unionByName(known))

    same = joined(tested(_end_partners(_open(members, same))))
    sets = _fine_sets(_open(members, same), docs, shingle, several)
    if not sets.isEmpty():
        kind = sets.schema["doc_id"].dataType.simpleString()
        fine = _buckets(sets.mapInArrow(_fine, f"doc_id {kind}, band array<long>"), "fine-members")
        same = joined(tested(_end_partners(_open(fine, same))))
        same = joined(_remaining(_open(fine, same), sets, percent))

    classes = (reps.select("set_key", F.col("doc_id").alias("rep")).join(same, F.col("rep") == F.col("node"), "left")
               .select("set_key", F.coalesce("component", "rep").alias("component")))
    if several:
        classes = classes.select("set_key", F.col("component.doc_id").alias("component"))
    named = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    out = named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
