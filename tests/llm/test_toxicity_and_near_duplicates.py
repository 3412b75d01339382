"""Toxicity on held-out labels and its slopes by differences; near-duplicate documents of the query against brute
force, and hot buckets."""

import itertools
import random
import zlib

import numpy as np
import pytest

from strata.llm import minhash, queries, toxicity

WORDS = [f"w{i}" for i in range(2000)]


# --- toxicity ----------------------------------------------------------------------------------------------
def held_out_rows(spark, sf):
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    return [(rows[i], y) for i, y in labels.items() if i in rows and zlib.crc32(str(i).encode()) % 3 == 1]


@pytest.mark.parametrize("sf, auc, recall, precision", [("/root/testdata/sf0.01", 0.85, 0.5, 0.9), ("/root/testdata/sf0.1", 0.92, 0.75, 0.85)])
def test_op2_on_held_out_labels(spark, sf, auc, recall, precision):
    rows = held_out_rows(spark, sf)
    assert all(r.held_out for r, _ in rows)
    bad, good = (np.array([r.score for r, y in rows if y == c]) for c in (1, 0))
    good.sort()
    ranked = (np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")).sum() / 2 / len(bad) / len(good)
    hit, false = sum(r.predicted for r, y in rows if y), sum(r.predicted for r, y in rows if not y)
    figures = {"auc": ranked, "recall": hit / len(bad), "precision": hit / (hit + false)}
    assert ranked >= auc and hit / len(bad) >= recall and hit / (hit + false) >= precision, figures


def test_slopes_by_differences():
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "idiot", "1d1ot", "of"]
    grams, starts = toxicity.ngram_ids(words)
    _, grams = np.unique(grams, return_inverse=True)  # a small table
    n = np.diff(np.append(starts, len(grams)))
    bags = [np.array([0, 1]), np.array([3, 5, 5]), np.array([2]), np.array([4, 0])]
    batch = toxicity.bagged(bags, np.array([0.0, 1.0, 0.0, 1.0]), grams, starts, n)
    params = [r.normal(size=(grams.max() + 1, 4)), r.normal(size=(4, 2)), r.normal(size=2)]
    loss, slopes = toxicity.loss_and_slopes(*params, batch)
    for x, g in zip(params, slopes, strict=True):
        for i in itertools.islice(np.ndindex(x.shape), 0, None, max(1, x.size // 25)):
            before, step = x[i], 1e-6
            x[i] = before + step
            up = toxicity.loss_and_slopes(*params, batch)[0]
            x[i] = before - step
            down = toxicity.loss_and_slopes(*params, batch)[0]
            x[i] = before
            assert g[i] == pytest.approx((up - down) / (2 * step), abs=1e-6)
    assert loss > 0


# --- near duplicates ------------------------------------------------------------------------------------------
def brute(rows, k=4, percent=80):
    """Component and set size of each id (ids and texts one to one)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, z in sets.items():
        for g in z:
            holders.setdefault(g, []).append(i)
    both = {}
    for ids in holders.values():
        for a, b in itertools.combinations(ids, 2):
            both[a, b] = both.get((a, b), 0) + 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(z), find(i)) for i, z in sets.items()}


def test_op8_equals_brute_force_on_a_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_minhash_near_dedup(spark, sf).collect()}
    assert got == brute(rows)


def hot_rows(n=260):
    """Texts that share most of a frame but not enough to be alike, and among them a few pairs that are."""
    r = random.Random(9)
    frame = [r.choice(WORDS) for _ in range(110)]
    rows = []
    for i in range(n):
        own = [r.choice(WORDS) for _ in range(30)]
        rows.append((i, " ".join(frame + own)))
        if i % 20 == 0:
            rows.append((10_000 + i, " ".join(frame + own[:-6] + [r.choice(WORDS) for _ in range(6)])))
    return rows


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    rows = hot_rows()
    handed = []
    fine = minhash._fine_sets

    def seen(*args):
        out = fine(*args)
        handed.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_fine_sets", seen)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert handed and handed[0] > 0  # the fine bands had work


def test_recall_of_the_fine_bands():
    r = np.random.default_rng(4)
    a, b = minhash.functions_for(minhash.FINE_BANDS * minhash.FINE_ROWS, seed=8)
    shared = 0
    for _ in range(300):
        x = r.integers(0, 2 ** 63, 180, np.uint64)
        one, two = x[:162], np.concatenate([x[18:162], x[162:]])  # 144 of 180 shared: 0.8
        keys = [minhash.bands_of(minhash.minima(s, a, b), minhash.FINE_BANDS) for s in (one, two)]
        shared += bool((keys[0] == keys[1]).any())
    assert shared >= 299
