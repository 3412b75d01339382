"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is read as its character n-grams (3 to 5, with word boundaries) and as a whole, hashed into ``BUCKETS``
rows of an embedding table; its vector is their mean, a text's vector is the mean over words, and
a linear softmax over it gives two classes.  Table and softmax are trained together, so a
misspelling that training never saw still shares most n-gram vectors with the word it imitates.

A few words decide, wherever they stand, so a text is scored by its worst window of ``WINDOW``
words: averaged over whole texts (some hundred words, of which a few count) the same model ranks held-out
texts far worse (README has both figures), so the average is over windows.  Training goes over windows in rounds: a toxic text is represented by the window that the
model now finds worst, a clean one by its worst few and by others.  A text's score is the greatest softmax output over its windows.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of their id, whose
texts have at most ``TRAIN_CHARS`` characters together (whole texts; the bound covers the driver's
memory).  Scoring covers every row: the model, of fixed size, goes out with the tasks, and words
are scored once per task and cached in a map of bounded size.

Defined results: a null or empty text scores what the softmax gives for no words, at most 0.5; a
word over 24 characters is read in pieces of 24; repeated rows get equal scores; with no labelled
rows of both classes the score is the share of toxic rows among the labels (0 without any).  A
label counts as toxic if any of the rows for its id says so.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ship

ship(__name__)

TRAIN_ROWS, TRAIN_CHARS = 2400, 8_000_000
BUCKETS, DIM = 1 << 16, 8
NGRAMS = (3, 4, 5)
WINDOW = 2
PIECE = 24
HARD = 4
START = 3.0
THRESHOLD = 0.7
CACHE = 400_000
WORD = re.compile(r"\w{1,%d}" % PIECE)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def ngram_ids(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one after the other, and where each word's begin."""
    chars = np.array(["\x02" + w + "\x03" for w in words], dtype=f"U{PIECE + 2}")
    chars = chars.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    length = (chars > 0).sum(axis=1)
    grams, owner = [], []
    for n in NGRAMS:
        h = np.full((len(words), max(0, chars.shape[1] - n + 1)), n, np.uint64)
        for j in range(n):
            h = (h ^ chars[:, j:j + h.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        row, col = np.nonzero(np.arange(h.shape[1]) + n <= length[:, None])
        grams.append(h[row, col] % np.uint64(BUCKETS))
        owner.append(row)
    whole = np.full(len(words), 1, np.uint64)
    for j in range(chars.shape[1]):
        whole = np.where(j < length, (whole ^ chars[:, j]) * np.uint64(0x9E3779B97F4A7C15), whole)
        whole ^= whole >> np.uint64(32)
    grams.append(whole % np.uint64(BUCKETS))
    owner.append(np.arange(len(words)))
    grams, owner = np.concatenate(grams).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(words)))


def _mean(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(starts, len(x)))
    return np.add.reduceat(x, starts, axis=0) / n.astype(x.dtype).reshape(-1, *[1] * (x.ndim - 1))


def window_starts(n: int, window: int = WINDOW) -> list[int]:
    """Windows overlap by half and the last one ends with the text."""
    if n <= window:
        return [0] if n else []
    return [*range(0, n - window, max(1, window // 2)), n - window]


@dataclass
class Model:
    """A word's logit for the toxic class less that for the other, averaged over its n-grams."""
    table: np.ndarray  # per bucket, after the softmax's weights
    bias: float
    prior: float | None = None

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        grams, starts = ngram_ids(words)
        return _mean(self.table[grams], starts)

    def scores(self, texts: Sequence[str | None], cache: dict[str, float]) -> list[float]:
        if self.prior is not None:
            return [self.prior] * len(texts)
        lists = [words_of(t) for t in texts]
        fresh = list({w for ws in lists for w in ws if w not in cache})
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
            fresh = list({w for ws in lists for w in ws})
        for i in range(0, len(fresh), 50_000):
            part = fresh[i:i + 50_000]
            cache.update(zip(part, self.word_scores(part).tolist(), strict=True))
        out = []
        for ws in lists:
            if not ws:
                out.append(min(0.5, _sigmoid(self.bias)))
                continue
            total = np.concatenate([[0.0], np.cumsum([cache[w] for w in ws])])
            at = np.array(window_starts(len(ws)))
            to = np.minimum(at + WINDOW, len(ws))
            out.append(_sigmoid(((total[to] - total[at]) / (to - at)).max() + self.bias))
        return out


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


@dataclass
class Bags:
    """Bags of words as n-grams: of each word in use its n-grams, of each bag its words."""
    grams: np.ndarray  # all words' n-grams, one word after the other
    gram_n: np.ndarray  # of each word
    words: np.ndarray  # all bags' words, as places among the words in use
    bag_of: np.ndarray
    starts: np.ndarray  # where each bag's words begin
    share: np.ndarray  # 1 / size of a word's bag
    onehot: np.ndarray
    weight: np.ndarray  # of each bag; both classes weigh alike


def bagged(bags: Sequence[np.ndarray], y: np.ndarray, grams: np.ndarray, gram_starts: np.ndarray, gram_n: np.ndarray) -> Bags:
    used, flat = np.unique(np.concatenate(bags), return_inverse=True)
    own = np.concatenate([grams[gram_starts[i]:gram_starts[i] + gram_n[i]] for i in used])
    size = np.array([len(b) for b in bags])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    return Bags(own, gram_n[used], flat, np.repeat(np.arange(len(bags)), size), np.cumsum(size) - size,
                np.repeat(1 / size, size).astype(np.float32), np.stack([1 - y, y], axis=1).astype(np.float32), weight)


def loss_and_slopes(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, b: Bags) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The weighted cross entropy of averaged embeddings under the softmax, and its slopes by the table, the
    softmax's weights and its bias."""
    vectors = _mean(emb[b.grams], np.cumsum(b.gram_n) - b.gram_n)
    text = np.add.reduceat(vectors[b.words] * b.share[:, None], b.starts, axis=0)
    logits = text @ soft + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -float((b.weight * np.log(np.maximum((p * b.onehot).sum(axis=1), 1e-30))).sum())
    d = (p - b.onehot) * b.weight[:, None]
    to_text = d @ soft.T
    dims = range(emb.shape[1])
    to_word = np.stack([np.bincount(b.words, b.share * to_text[b.bag_of, k], minlength=len(b.gram_n)) / b.gram_n for k in dims], axis=1)
    g_emb = np.stack([np.bincount(b.grams, np.repeat(to_word[:, k], b.gram_n), minlength=len(emb)) for k in dims], axis=1)
    return loss, (g_emb, text.T @ d, d.sum(axis=0))


def train(texts: Sequence[str | None], labels: Sequence[int], steps: int = 60, rounds: int = 5, seed: int = 5) -> Model:
    """Fit the embedding table and the softmax together by gradient descent with momentum over
    windows.  They start along how far each n-gram's texts are toxic beyond expectation, which
    also picks the first windows.  Every step is scaled to a largest change of ``0.1``: an
    n-gram moves as far as the classes differ in it, and one that both share hardly moves.  Words
    of a single training text are left out, as they tell nothing about others."""
    y_all = np.array(labels, np.float64)
    lists = [words_of(t) for t in texts]
    texts_with: dict[str, int] = {}
    for ws in lists:
        for w in set(ws):
            texts_with[w] = texts_with.get(w, 0) + 1
    vocab = {w: i for i, w in enumerate(w for w, n in texts_with.items() if n > 1)}
    if len(y_all) == 0 or y_all.min() == y_all.max() or not vocab:
        return Model(np.zeros(1, np.float32), 0.0, prior=float(y_all.mean()) if len(y_all) else 0.0)
    ids = [np.array([vocab[w] for w in ws if w in vocab], np.int64) for ws in lists]
    grams, gram_starts = ngram_ids(list(vocab))
    gram_n = np.diff(np.append(gram_starts, len(grams)))
    rng = np.random.default_rng(seed)
    found = np.zeros((2, BUCKETS))
    for i, label in zip(ids, y_all, strict=True):
        if len(i):
            here = np.concatenate([grams[gram_starts[j]:gram_starts[j] + gram_n[j]] for j in np.unique(i)])
            found[int(label), np.unique(here)] += 1
    expected = found.sum(axis=0) * found[1].sum() / found.sum()
    surprise = (found[1] - expected) / np.sqrt(expected + 1)
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    side = soft[:, 1] - soft[:, 0]
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    emb += np.outer(surprise * (START / surprise.max()), side / (side @ side)).astype(np.float32)
    bias = np.zeros(2, np.float32)

    def fit(bags: list[np.ndarray], y: np.ndarray, steps: int) -> None:
        batch = bagged(bags, y, grams, gram_starts, gram_n)
        speed = [np.zeros_like(x) for x in (emb, soft, bias)]
        for _ in range(steps):
            _, slope = loss_and_slopes(emb, soft, bias, batch)
            for x, g, v in zip((emb, soft, bias), slope, speed, strict=True):
                v *= 0.8
                v -= g
            rate = 0.1 / max(1e-9, *(np.abs(v).max() for v in speed[:2]))
            for x, v in zip((emb, soft, bias), speed, strict=True):
                x += rate * v if x is emb else min(rate, 1.0) * v

    full = [i for i in range(len(ids)) if len(ids[i])]
    for _ in range(rounds):
        word = _mean((emb @ (soft[:, 1] - soft[:, 0]))[grams], gram_starts)
        bags, y = [], []
        for i in full:
            at = np.array(window_starts(len(ids[i])))
            total = np.concatenate([[0.0], np.cumsum(word[ids[i]])])
            to = np.minimum(at + WINDOW, len(ids[i]))
            rank = np.argsort((total[at] - total[to]) / (to - at))
            chosen = rank[:1].tolist() if y_all[i] else list({*rank[:HARD].tolist(), *rng.integers(0, len(at), HARD).tolist()})
            bags += [ids[i][at[j]:to[j]] for j in chosen]
            y += [y_all[i]] * len(chosen)
        fit(bags, np.array(y), steps)
    odds = y_all.mean() / (1 - y_all.mean())  # training weighs both classes alike
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0] + np.log(odds)))


def held_out(doc_id: Column) -> Column:
    """One third of the ids, by CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts outside the held-out third, within ``chars`` characters: up
    to a third of each are toxic, in the order of a hash of their id."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = ["pick", "doc_id"]
    marks = marks.withColumn("pick", F.xxhash64("doc_id"))
    bad = marks.where("toxic = 1").orderBy(*order).limit(rows // 3)
    marks = bad.unionByName(marks.where("toxic = 0").orderBy(*order).limit(rows - rows // 3))
    sized = marks.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").groupBy("doc_id", "toxic", "pick").agg(F.max("n").alias("n"))
    left, ids = chars, {}
    for r in sized.orderBy(*order).limit(rows).collect():
        if (r["n"] or 0) <= left:
            left -= r["n"] or 0
            ids[r["doc_id"]] = r["toxic"]
    if not ids:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), f"doc_id {kind}, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return [(r["text"], r["toxic"]) for r in sorted(texts.collect(), key=lambda r: r["doc_id"])]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    # plain values: a broadcast object would need this library on the executors
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.prior))

    def run(batches):
        model = Model(*shared.value)
        cache: dict[str, float] = {}
        for batch in batches:
            s = model.scores(batch.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
