"""Substring dedup by recompression: words go that a repeated window of ``WINDOW`` words covers.

A window is removed if its words also start earlier: in a document of smaller id, or earlier in
the same one.  Windows are judged on the input.

Recompression replaces runs of one symbol, then pairs of neighbours, by new names, round by
round.  Names are a function of what they stand for, so all tasks agree on them, and the two
sides that a round's pairs are taken from are drawn from the names: whatever surrounds it, equal
text gets equal symbols, but for a few at its ends.  For each symbol the stretch of words that
settles it is kept; a window that holds this stretch has the symbol as an interior one.

1. Equal texts are one: all copies but the first lose every word (if there are ``WINDOW``).
   The first copies get places in one row of all words, in order.
2. First naming: every window elects, among its interior symbols after ``ROUNDS`` rounds, the one
   whose name is least, so equal windows elect alike.  Spark counts the elected symbols, named
   with the stretch that settles them, over all documents.  A window whose symbol occurs once
   occurs once; only the others go on (and those without interior symbols, such as long runs).
3. Second naming: stretches of candidate windows are cut at rare symbols into long symbols, named
   by 128 bits of their words.  A long symbol that occurs earlier takes all
   windows inside it at once: copies of long passages cost a row for each long symbol.
4. The windows that are left are verified: their words, as 128 bits, are grouped over all
   documents, and all but the earliest go.

Grouping is by aggregates with partial sums before each shuffle, followed by joins on places that
occur once; a passage that a third of all documents share is only a count.  Words are known by 64
and 128 bit hashes: equal 64-bit hashes of different words, in step 2, only add candidates.

Defined results: null and empty texts have no words; a text of fewer than ``WINDOW`` words keeps
them all; a null id comes first; rows of one id with different texts are different documents, in
the order of their texts' digests; rows that repeat an id and its words are one document, so each of
them keeps what the first does; an empty table gives an empty result; texts are read whole; only the
two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, placed, same, ship, written

ship(__name__)

WINDOW = 20
ROUNDS = 2
CUT = 32  # one symbol in so many begins a long symbol
FLUSH = 1 << 17  # words worked on at once
IDS = 400_000  # words whose hashes a task remembers
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(a: np.ndarray, b) -> np.ndarray:
    h = (a ^ ODD) * MIX1
    h ^= h >> np.uint64(31)
    h = (h ^ b) * MIX2
    h ^= h >> np.uint64(29)
    return h


class Ids(dict):
    """64-bit hashes of words, as many as ``IDS`` remembered."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word, self.seed)
        return out

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self) > IDS:
            self.clear()
        n = sum(map(len, texts))
        return np.fromiter((self[w] for t in texts for w in t), np.uint64, n)


class Parsed:
    """The symbols of several documents: words from ``start`` to ``end`` under each ``name``, settled
    by those from ``low`` to ``high``."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.sizes = words, sizes
        self.doc_end = np.cumsum(sizes)
        self.doc_start = self.doc_end - sizes
        n = len(words)
        self.name, self.doc = words, np.repeat(np.arange(len(sizes)), sizes)
        self.start = self.low = np.arange(n)
        self.end = self.high = np.arange(1, n + 1)
        for i in range(ROUNDS if n else 0):
            self._runs()
            self._pairs(i)

    def _neighbours(self):
        """Whether a symbol has a left and a right neighbour, and where these are settled: beyond a text's
        ends if there is none, as nothing tells what might stand there elsewhere."""
        inner = self.doc[1:] == self.doc[:-1]
        left, right = np.r_[False, inner], np.r_[inner, False]
        low = np.where(left, np.r_[0, self.low[:-1]], self.doc_start[self.doc] - 1)
        high = np.where(right, np.r_[self.high[1:], 0], self.doc_end[self.doc] + 1)
        return left, right, low, high

    def _runs(self) -> None:
        new = np.r_[True, (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(new)] - 1
        _, _, low, high = self._neighbours()
        size = (last - first + 1).astype(np.uint64)
        self.name = np.where(size > 1, mix(self.name[first], size), self.name[first])
        self.low, self.high = np.minimum(low[first], self.low[first]), np.maximum(high[last], self.high[last])
        self.start, self.end, self.doc = self.start[first], self.end[last], self.doc[first]

    def _pairs(self, i: int) -> None:
        side = mix(self.name, np.uint64(i)) >> np.uint64(63)  # 0: may be first of a pair, 1: second
        _, right, low, high = self._neighbours()
        first = (side == 0) & right & np.r_[side[1:] == 1, False]
        second = np.r_[False, first[:-1]]
        after = np.r_[np.arange(1, len(side)), len(side) - 1]
        # a pair is settled by its two; one that may be first by what follows, else by what comes before
        self.low = np.where(first, np.minimum(self.low, self.low[after]), np.where(side == 1, np.minimum(low, self.low), self.low))
        self.high = np.where(first, np.maximum(self.high, self.high[after]), np.where(side == 0, np.maximum(high, self.high), self.high))
        self.name = np.where(first, mix(self.name, self.name[after]), self.name)
        self.end = np.where(first, self.end[after], self.end)
        keep = ~second
        self.name, self.start, self.end, self.low, self.high, self.doc = (
            x[keep] for x in (self.name, self.start, self.end, self.low, self.high, self.doc))

    def elected(self) -> tuple[np.ndarray, np.ndarray]:
        """For the window at each word the symbol it elects (-1: none), and whether it is a window."""
        n = len(self.words)
        at = np.arange(n)
        real = at + WINDOW <= np.repeat(self.doc_end, self.sizes)
        lo = np.searchsorted(self.low, at, "left")  # stretches begin and end in order
        hi = np.searchsorted(self.high, at + WINDOW, "right")
        best, value = np.full(n, -1), np.full(n, np.iinfo(np.uint64).max, np.uint64)
        more = np.flatnonzero(real & (lo < hi))
        step = 0
        rank = mix(self.name, np.uint64(ROUNDS))
        while len(more):
            j = lo[more] + step
            less = rank[j] < value[more]
            best[more[less]], value[more[less]] = j[less], rank[j[less]]
            step += 1
            more = more[lo[more] + step < hi[more]]
        return best, real

    def stretch_names(self, j: np.ndarray) -> np.ndarray:
        """Names of the symbols ``j`` together with the stretches that settle them."""
        out = mix(self.name[j], (self.high[j] - self.low[j]).astype(np.uint64))
        longest = int((self.high[j] - self.low[j]).max(initial=0))
        for k in range(longest):
            at = self.low[j] + k
            inside = at < self.high[j]
            out[inside] = mix(out[inside], self.words[at[inside]])
        return out

    def cuts(self) -> np.ndarray:
        """Whether a long symbol begins at each word: at the beginnings of rare symbols."""
        out = np.zeros(len(self.words), bool)
        out[self.start[mix(self.name, np.uint64(ROUNDS + 1)) % np.uint64(CUT) == 0]] = True
        return out


def _words(text: str | None) -> list[bytes]:
    """Words between the ASCII white space."""
    return text.encode().split() if text else []


def _several(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of some rows at a time: first row and the rows' words."""
    rows, size, first = [], 0, 0
    for i, text in enumerate(batch.column("text")):
        rows.append(_words(text.as_py()))
        size += len(rows[-1])
        if size >= FLUSH:
            yield first, rows
            rows, size, first = [], 0, i + 1
    if rows:
        yield first, rows


def _parse(texts: list[list[bytes]], ids: Ids) -> Parsed:
    return Parsed(ids.of(texts), np.array([len(t) for t in texts], np.int64))


def _per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(docs, np.arange(1, n)))


def _elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, digest and elected symbols of each text."""
    ids = Ids()
    for batch in batches:
        n, key, names, loose = [], [], [], []
        for _, rows in _several(batch):
            n += map(len, rows)
            key += (sha256(b" ".join(r)).digest() for r in rows)
            kept = [r if len(r) >= WINDOW else [] for r in rows]
            p = _parse(kept, ids)
            best, real = p.elected()
            j = np.unique(best)
            j = j[j >= 0]
            names += _per_doc(p.stretch_names(j).view(np.int64), p.doc[j], len(rows))
            without = np.zeros(len(rows), bool)
            without[np.repeat(np.arange(len(rows)), p.sizes)[real & (best < 0)]] = True
            loose += without.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
             pa.array(names, pa.list_(pa.int64())), pa.array(loose, pa.bool_())], ["doc_id", "h", "n_words", "key", "names", "loose"])


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the runs of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of candidate windows of each text, and the long symbols inside them; rows whose words are
    not those of ``key`` (another text of the same hash) go."""
    ids = Ids()
    for batch in batches:
        take, runs, longs, names = [], [], [], []
        for first, rows in _several(batch):
            for k, r in enumerate(rows):
                if sha256(b" ".join(r)).digest() != batch.column("key")[first + k].as_py():
                    rows[k] = []
            p = _parse(rows, ids)
            best, real = p.elected()
            j = np.unique(best)
            j = j[j >= 0]
            repeated = np.zeros(len(p.name), bool)
            for k, mine in enumerate(_per_doc(j, p.doc[j], len(rows))):
                seen = batch.column("repeated")[first + k].values
                if seen is not None and len(mine):
                    repeated[mine[seen.to_numpy()]] = True
            chosen = real & ((best < 0) | repeated[best])
            cut = p.cuts()
            for k, r in enumerate(rows):
                here = chosen[p.doc_start[k]:p.doc_end[k]]
                if not here.any():
                    continue
                a, b = _spans(here)
                take.append(first + k)
                runs.append(np.column_stack([a, b]).ravel())
                # long symbols: stretches between cuts that lie within a run's words and hold a window
                at = np.flatnonzero(cut[p.doc_start[k]:p.doc_end[k]])
                s, e = at[:-1], at[1:]
                of = np.searchsorted(a, s, "right") - 1
                fits = (e - s >= WINDOW) & (of >= 0) & (e <= b[of] + WINDOW - 1)
                longs.append(np.column_stack([s[fits], e[fits]]).ravel())
                names.append([xxhash.xxh3_128_digest(b" ".join(r[x:y])) for x, y in zip(s[fits], e[fits], strict=True)])
        rows = batch.take(pa.array(take, pa.int64())).select(["at", "text"])
        yield pa.RecordBatch.from_arrays(
            [rows.column("at"), rows.column("text"), pa.array(runs, pa.list_(pa.int64())), pa.array(longs, pa.list_(pa.int64())),
             pa.array(names, pa.list_(pa.binary()))], ["at", "text", "runs", "longs", "names"])


def _pairs_of(values) -> np.ndarray:
    return np.empty((0, 2), np.int64) if values is None else values.to_numpy(zero_copy_only=False).reshape(-1, 2)


def _inside(longs: np.ndarray, n: int) -> np.ndarray:
    """Windows inside the long symbols."""
    out = np.zeros(n + 1, np.int8)
    out[longs[:, 0]] += 1
    np.add.at(out, longs[:, 1] - WINDOW + 1, -1)
    return np.cumsum(out)[:n] > 0


def _left(runs: np.ndarray, longs: np.ndarray, n: int) -> np.ndarray:
    """Candidate windows that no repeated long symbol takes."""
    flags = np.zeros(n + 1, np.int8)
    flags[runs[:, 0]] += 1
    np.add.at(flags, runs[:, 1], -1)
    return np.flatnonzero((np.cumsum(flags)[:n] > 0) & ~_inside(longs, n))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place, at, a, b``: the places of the windows that are left, their documents' and 128 bits of
    their words."""
    low, high = Ids(), Ids(1)
    for batch in batches:
        i = 0
        for _, rows in _several(batch):
            places, docs, words, seen = [], [], [], 0
            for r in rows:
                left = _left(_pairs_of(batch.column("runs")[i].values), _pairs_of(batch.column("taken")[i].values), len(r))
                start = batch.column("at")[i].as_py()
                places.append(left + start), docs.append(np.full(len(left), start)), words.append(left + seen)
                seen += len(r)
                i += 1
            at = np.concatenate(words)
            both = []
            for ids in (low, high):
                x, h = ids.of(rows), np.full(len(at), ODD, np.uint64)
                for k in range(WINDOW):
                    h = mix(h, x[at + k])
                both.append(pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(docs)), *both], ["place", "at", "a", "b"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words removed from each text, and the digest of the others: all windows go that a repeated long
    symbol takes, and of the others those that are not ``earliest``."""
    for batch in batches:
        removed, digest = [], []
        for i, text in enumerate(batch.column("text")):
            words = _words(text.as_py())
            n = len(words)
            taken = _pairs_of(batch.column("taken")[i].values)
            left = _left(_pairs_of(batch.column("runs")[i].values), taken, n)
            gone = _inside(taken, n)
            gone[left] = True
            first = batch.column("earliest")[i].values
            if first is not None:
                gone[first.to_numpy() - batch.column("at")[i].as_py()] = False
            at = np.flatnonzero(gone)
            cover = np.zeros(n + 1, np.int64)
            cover[at] += 1
            cover[at + WINDOW] -= 1
            stays = np.cumsum(cover)[:n] == 0
            removed.append(n - int(stays.sum()))
            digest.append(sha256(b" ".join(w for w, s in zip(words, stays, strict=True) if s)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(removed, pa.int64()), pa.array(digest)], ["at", "removed", "digest"])


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row: the digest of the kept words, joined by one
    space."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parsed = written(docs.mapInArrow(_elect, f"doc_id {kind}, h long, n_words long, key binary, names array<long>, loose boolean"), "elected")

    # 1: the first of every group of equal texts, placed in one row of words
    firsts = parsed.where(f"n_words >= {WINDOW}").groupBy("key").agg(F.min(F.struct("doc_id")).alias("d"), F.max("n_words").alias("n"))
    firsts = written(firsts.select(F.lit(0).alias("all"), F.col("d.doc_id").alias("doc_id"), "key", "n"), "first-texts")
    places = placed(firsts, ["all"], ["doc_id", "key"], F.col("n"))
    places = written(places.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "at"), "places")
    first_text = same({"doc_id": "_d"}) & (F.col("key") == F.col("_k"))
    symbols = written(parsed.join(places.hint("merge"), first_text).select("at", "doc_id", "h", "key", "names", "loose"), "symbols")

    # 2: symbols that occur once rule their windows out
    rows = symbols.select("at", F.posexplode("names").alias("i", "name"))
    several = written(rows.groupBy("name").count().where("count > 1").select("name"), "repeated-names")
    flagged = rows.join(several.hint("merge"), "name").groupBy("at").agg(F.collect_set("i").alias("repeated"))
    texts = symbols.select("at", "doc_id", "h", "key", "loose").distinct().join(flagged.hint("merge"), "at", "left")
    texts = texts.where("loose OR repeated IS NOT NULL").withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    mine = docs.join(texts.hint("merge"), same({"doc_id": "_d"}) & (F.col("h") == F.col("_h")))
    found = written(mine.select("at", "key", "text", "repeated").mapInArrow(
        _candidates, "at long, text string, runs array<long>, longs array<long>, names array<binary>"), "candidates")
    discard(firsts, symbols, several)

    # 3: long symbols that occur earlier take their windows
    longs = found.select("at", F.posexplode("names").alias("i", "name"), "longs").select(
        "at", "name", F.get("longs", 2 * F.col("i")).alias("s"), F.get("longs", 2 * F.col("i") + 1).alias("e"))
    longs = written(longs.withColumn("place", F.col("at") + F.col("s")), "long-symbols")
    earliest = longs.groupBy("name").agg(F.min("place").alias("place")).select("place")
    taken = longs.join(earliest.hint("merge"), "place", "left_anti").groupBy("at").agg(F.flatten(F.collect_set(F.array("s", "e"))).alias("taken"))
    taken = written(taken, "taken")
    mine = found.select("at", "text", "runs").join(taken.hint("merge"), "at", "left")

    # 4: the others are verified; documents and places ascend together, so both least values are one window's
    first = mine.mapInArrow(_windows, "place long, at long, a long, b long").groupBy("a", "b").agg(F.min("place").alias("place"), F.min("at").alias("at"))
    first = written(first.groupBy("at").agg(F.collect_list("place").alias("earliest")), "earliest")
    kept = mine.join(first.hint("merge"), "at", "left").mapInArrow(_kept, "at long, removed long, digest string")
    kept = written(kept.where("removed > 0").distinct().withColumnRenamed("at", "_at"), "kept")
    out = parsed.select("doc_id", "n_words", "key").join(places.hint("merge"), first_text, "left").join(kept.hint("merge"), F.col("at") == F.col("_at"), "left")
    copy = F.col("at").isNull() & (F.col("n_words") >= WINDOW)
    out = written(out.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
                             F.when(copy, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("digest", F.lower(F.hex("key")))).alias("kept_sha256")),
                  "substrings")
    discard(parsed, places, found, longs, taken, first, kept)
    return out
