"""Clustering: deterministic Lloyd k-means, nearest-centre assignment, best-of-restarts
and k sweeps with all models fitted together, squared and all-pairs Euclidean silhouettes, cluster profiles,
canonical cluster naming and agreement.

Every pass is a projection (assignment: the k centres are literals in the expression)
followed by ONE ``groupBy(cluster)`` aggregate with map-side combine; only ``k x d``
numbers return to the driver per iteration.  The Euclidean silhouette alone needs all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import recode, safe_div
from strata.operators.blocks import Blocks, ship
from strata.operators.common import number
from strata.operators.profile import agreement_pct, group_means
from strata.operators.reshape import melt
from strata.session import cut_lineage

ship(__name__)


def sq_dist(features: Sequence[str], centre: Sequence[float]) -> Column:
    d = None
    for f, c in zip(features, centre):
        diff = F.col(f).cast("double") - F.lit(float(c))
        t = diff * diff
        d = t if d is None else d + t
    return d


def nearest_centre(features: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """ML2: index of the nearest centre (ties -> lowest index) as one expression; NULL if
    any feature is missing (NULL or NaN)."""
    pairs = [F.struct(sq_dist(features, c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]
    known = F.lit(True)
    for f in features:
        known = known & number(f).isNotNull()
    return F.when(known, F.array_min(F.array(*pairs))["j"])


@dataclass
class KMeansModel:
    features: list[str]
    centres: list[list[float]]
    iterations: int = 0
    cost: float | None = None
    converged: bool | None = None

    def transform(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        return df.withColumn(out, nearest_centre(self.features, self.centres))

    def centres_frame(self, spark) -> DataFrame:
        rows = [(j, *map(float, c)) for j, c in enumerate(self.centres)]
        return spark.createDataFrame(rows, ["cluster", *self.features])


def kmeans_lloyd(df: DataFrame, features: Sequence[str], init: Sequence[Sequence[float]], max_iter: int = 10,
                 tol: float = 0.0) -> KMeansModel:
    """ML1 (deterministic form): Lloyd iterations from given centres; an empty cluster
    keeps its centre.  Stops after ``max_iter`` or when no centre moves more than tol."""
    feats = list(features)
    data = df.select(*[F.col(f).cast("double").alias(f) for f in feats]).dropna() \
        .persist(StorageLevel.MEMORY_AND_DISK)
    centres = [list(map(float, c)) for c in init]
    it = 0
    try:
        for it in range(1, max_iter + 1):
            a = data.withColumn("_c", nearest_centre(feats, centres))
            rows = a.groupBy("_c").agg(*[F.avg(f).alias(f) for f in feats]).collect()
            new = [list(c) for c in centres]
            for r in rows:
                new[r["_c"]] = [r[f] for f in feats]
            shift = max(float(np.max(np.abs(np.array(n) - np.array(c)))) for n, c in zip(new, centres))
            centres = new
            if shift <= tol:
                break
        cost = data.agg(F.sum(F.array_min(F.array(*[sq_dist(feats, c) for c in centres]))).alias("c")).first()["c"]
    finally:
        data.unpersist()
    return KMeansModel(feats, centres, it, cost)


HASH_PRIME = 2147483647  # of the seeding's hash; keys below 2^31 keep every product within 63 bits


def seeding_hash(key, salt):
    """A hash in [0, HASH_PRIME) of integers, alike for numpy arrays and SQL."""
    h = (key % HASH_PRIME * 48271 + salt * 69621) % HASH_PRIME
    h = (h * h + salt + 12345) % HASH_PRIME
    return (h * h + h) % HASH_PRIME


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _seeds(blocks: Blocks, d: int, models: Sequence[tuple[int, int]], seed: int) -> list[np.ndarray]:
    """k-means++ for all models at once, a pass for each next centre: a weighted reservoir, in which the
    row with the least -ln(u) / (squared distance to its nearest centre so far) is drawn."""
    centres: list[np.ndarray] = [np.empty((0, d)) for _ in models]
    for j in range(max(k for k, _ in models)):
        open_ = [m for m, (k, _) in enumerate(models) if j < k]
        salts = [seed + (models[m][0] * 1000 + models[m][1]) * 100 + j for m in open_]
        drawn = blocks.least(_drawer([centres[m] for m in open_], salts, d), len(open_), d)
        for m, row in zip(open_, drawn, strict=True):
            centres[m] = np.vstack([centres[m], row])
    return centres


def _drawer(centres: list[np.ndarray], salts: list[int], d: int):
    hashed, prime, squared = seeding_hash, HASH_PRIME, _squared

    def draw(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, rows = x[:, d].astype(np.int64), x[:, :d]
        best, values = [], []
        for c, salt in zip(centres, salts, strict=True):
            u = (hashed(key, salt) + 0.5) / prime
            weight = squared(rows, c).min(axis=1) if len(c) else np.ones(len(rows))
            with np.errstate(divide="ignore"):
                value = np.where(weight > 0, -np.log(u) / weight, np.inf)
            i = int(value.argmin())
            best.append(rows[i]), values.append(value[i])
        return np.array(values), np.array(best)
    return draw


def _stepper(centres: list[np.ndarray]):
    """Per model and cluster: number, sum vector and cost of the rows nearest to its centre."""
    squared = _squared

    def step(x: np.ndarray) -> np.ndarray:
        d = centres[0].shape[1]
        x = x[:, :d]
        dist = squared(x, np.vstack(centres))
        out, at = [], 0
        for c in centres:
            own = dist[:, at:at + len(c)]
            at += len(c)
            label = own.argmin(axis=1)
            member = np.zeros((len(c), len(x)))
            member[label, np.arange(len(x))] = 1
            out.append(np.column_stack([member.sum(axis=1), member @ own.min(axis=1), member @ x]).ravel())
        return np.concatenate(out)
    return step


def _split(sums: np.ndarray, centres: list[np.ndarray]) -> list[np.ndarray]:
    d = centres[0].shape[1]
    return np.split(sums.reshape(-1, d + 2), np.cumsum([len(c) for c in centres])[:-1])


@dataclass
class Restart:
    k: int
    restart: int
    centres: np.ndarray
    iterations: int = 0
    converged: bool = False
    cost: float = 0.0
    sizes: np.ndarray | None = None


def kmeans_all(blocks: Blocks, d: int, models: Sequence[tuple[int, int]], seed: int = 42, max_iter: int = 300,
               tol: float = 1e-4) -> list[Restart]:
    """ML1 for all ``(k, restart)`` at once: every pass over the rows moves the centres of all models that
    have not yet converged, in one aggregate of (number, cost, sum vector) by model and cluster.

    A model has converged once its centres move by no more than ``tol`` times the mean variance of
    the features (sum of squares); an empty cluster keeps its centre.  Costs belong to the last
    centres.  A model that ``max_iter`` passes leave unconverged says so."""
    moments = blocks.sum(lambda x: np.concatenate([[len(x)], x[:, :d].sum(axis=0), (x[:, :d] ** 2).sum(axis=0)]), 1 + 2 * d)
    n = moments[0]
    if not n:
        raise ValueError("no rows without missing values")
    variance = float((moments[1 + d:] / n - (moments[1:1 + d] / n) ** 2).mean())
    fits = [Restart(k, r, c) for (k, r), c in zip(models, _seeds(blocks, d, models, seed), strict=True)]
    for it in range(1, max_iter + 1):
        moving = [f for f in fits if not f.converged]
        if not moving:
            break
        now = [f.centres for f in moving]
        for f, s in zip(moving, _split(blocks.sum(_stepper(now), sum(map(len, now)) * (d + 2)), now), strict=True):
            new = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1), f.centres)
            f.converged = bool(((new - f.centres) ** 2).sum() <= tol * variance)
            f.centres, f.iterations = new, it
    last = [f.centres for f in fits]
    for f, s in zip(fits, _split(blocks.sum(_stepper(last), sum(map(len, last)) * (d + 2)), last), strict=True):
        f.cost, f.sizes = float(s[:, 1].sum()), s[:, 0].astype(int)
    return fits


def _blocks(df: DataFrame, features: Sequence[str], key: str | None) -> Blocks:
    """Rows without a missing feature, and the key that the seeding hashes (the features' own hash if
    there is none; rows of equal keys are drawn alike)."""
    known = df.select(*[number(f).alias(f) for f in features], (F.xxhash64(*features) if key is None else F.col(key).cast("long")).alias("_key"))
    known = known.where(F.col("_key").isNotNull()).dropna(subset=list(features))
    return Blocks(known, [*features, F.pmod("_key", F.lit(HASH_PRIME))])


def _least(fits: Sequence[Restart], k: int) -> Restart:
    return min((f for f in fits if f.k == k), key=lambda f: (f.cost, f.restart))


def kmeans_best_of(df: DataFrame, features: Sequence[str], k: int, n_init: int = 10, seed: int = 42,
                   max_iter: int = 300, key: str | None = None) -> KMeansModel:
    """ML1: ``n_init`` restarts, all fitted together; the one of least cost."""
    with _blocks(df, features, key) as blocks:
        best = _least(kmeans_all(blocks, len(features), [(k, r) for r in range(n_init)], seed, max_iter), k)
    return canonical_order(KMeansModel(list(features), best.centres.tolist(), best.iterations, best.cost, best.converged))


def canonical_order(model: KMeansModel) -> KMeansModel:
    """ML7: cluster ids are arbitrary per fit; renumber by centre (first feature, then the
    next ...) so names attached to ids are stable."""
    order = sorted(range(len(model.centres)), key=lambda j: tuple(model.centres[j]))
    return KMeansModel(model.features, [model.centres[j] for j in order], model.iterations, model.cost, model.converged)


def silhouette_sq(df: DataFrame, features: Sequence[str], cluster: str) -> float | None:
    """ML5 (squared Euclidean): mean silhouette in O(n * k * d) from per-cluster moments
    (count, sum of x, sum of |x|^2); the own-cluster mean excludes the point itself.
    This is the metric of ``ClusteringEvaluator``, not the all-pairs Euclidean one."""
    return silhouette_sq_frame(df, features, cluster).first()["silhouette"]


def silhouette_sq_frame(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    feats = list(features)
    base = df.select(F.col(cluster).alias("_c"), *[F.col(f).cast("double").alias(f) for f in feats]).dropna()
    norm = None
    for f in feats:
        t = F.col(f) * F.col(f)
        norm = t if norm is None else norm + t
    stats = base.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
                                   *[F.sum(f).alias(f"s_{f}") for f in feats]).collect()
    if len(stats) < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")
    nx = norm

    def mean_dist(r):
        dot = None
        for f in feats:
            t = F.col(f) * F.lit(float(r[f"s_{f}"]))
            dot = t if dot is None else dot + t
        return nx - F.lit(2.0) * dot / F.lit(float(r["n"])) + F.lit(float(r["q"]) / r["n"])

    own_n = recode("_c", {r["_c"]: r["n"] for r in stats})
    own = None
    others = []
    for r in stats:
        d = mean_dist(r)
        own = F.when(F.col("_c") == F.lit(r["_c"]), d) if own is None else own.when(F.col("_c") == F.lit(r["_c"]), d)
        others.append(F.when(F.col("_c") != F.lit(r["_c"]), d))
    a = safe_div(own * own_n, own_n - F.lit(1))
    b = F.least(*others)
    s = (F.when(own_n <= 1, F.lit(0.0))
         .when(a < b, F.lit(1.0) - safe_div(a, b))
         .when(a > b, safe_div(b, a) - F.lit(1.0))
         .otherwise(F.lit(0.0)))
    return base.agg(F.avg(s).alias("silhouette"))


TILE = 65_536  # rows of a block, every pair of which is a tile
LEAST_BLOCKS, LEAST_ROWS = 8, 2048  # fewer blocks only if they had fewer rows than that
TILE_NUMBERS, PIECE_NUMBERS = 2 ** 22, 2 ** 15  # of a tile's features or sums, and of sums that are added up together
TILE_TASKS = 10_000


def _add_distances(x: np.ndarray, y: np.ndarray, to_x: np.ndarray, to_y: np.ndarray | None = None, high: int = 32, wide: int = 4096) -> None:
    """Add to ``to_x`` for each column of ``x`` its Euclidean distances to all columns of ``y``, and the other
    way round to ``to_y``.  Features are subtracted before they are squared: near points far from zero
    lose no digits.  A part of ``high * wide`` distances stays in the processor's cache."""
    p, q = x.shape[1], y.shape[1]
    buffers = np.empty((2, min(high, p), min(wide, q)))
    for j in range(0, q, wide):
        for i in range(0, p, high):
            r, c = min(high, p - i), min(wide, q - j)
            dist, square = buffers[:, :r, :c]
            for f, out in zip(range(len(x)), [dist, *[square] * (len(x) - 1)]):
                np.subtract(x[f, i:i + r, None], y[f, j:j + c], out=out)
                np.multiply(out, out, out=out)
                if f:
                    np.add(dist, square, out=dist)
            np.sqrt(dist, out=dist)
            to_x[i:i + r] += dist @ np.ones(c)
            if to_y is not None:
                to_y[j:j + c] += np.ones(r) @ dist


def _dealt(placed: DataFrame, d: int, k: int, n: int) -> tuple[DataFrame, int]:
    """``n`` rows of ``d`` features and a cluster's place, dealt out evenly to blocks ``(block, sizes, rows)``: the
    number of rows of each of the ``k`` clusters, and the features one after another, rows by cluster.
    Blocks are kept reliably, as a row's sums are known by its place in its block."""
    most = max(1, min(TILE, TILE_NUMBERS // max(d, k)))
    count = max(1, -(-n // most), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        parts = [np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d + 1)]).astype(float) for b in batches]
        x = np.concatenate([np.empty((0, d + 1)), *parts])
        if len(x):
            own = x[:, d].astype(int)
            sizes = np.bincount(own, minlength=k).astype(np.int64)
            rows = np.ascontiguousarray(x[np.argsort(own, kind="stable"), :d].T)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sizes.tobytes()], pa.binary()),
                                              pa.array([rows.tobytes()], pa.binary())], ["block", "sizes", "rows"])

    return cut_lineage(placed.repartition(count).mapInArrow(pack, "block long, sizes binary, rows binary")), count


def _meeting(blocks: DataFrame, others: int) -> DataFrame:
    """Every block once for each of the numbers of the ``others``."""
    return blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _scores(tiles: DataFrame, count: int, mutual: bool, d: int, k: int, sizes: np.ndarray) -> DataFrame:
    """The silhouettes ``s`` of the rows of the blocks ``a`` (if ``mutual``, of the blocks ``b`` too).

    ``tiles`` has the two blocks that meet in each tile, the one of ``a`` marked ``left``, or one that meets
    itself.  A tile passes on, for its rows and each cluster, the sum of the distances; a row's sums of all
    tiles are added up, which gives its silhouette."""
    piece, add_distances = max(1, min(TILE, PIECE_NUMBERS // k)), _add_distances
    made, tasks = "block long, start int, other long, sizes binary, sums binary", min(count, TILE_TASKS)

    def tile(table):
        import pyarrow as pa

        table = table.sort_by([("left", "descending")])
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        itself = mutual and a == b
        sides = [(np.frombuffer(s.as_buffer(), np.int64), np.frombuffer(r.as_buffer()).reshape(d, -1)) for s, r in zip(table["sizes"], table["rows"])]
        out = []
        if len(sides) == 2 or itself:
            (na, x), (nb, y) = sides[0], sides[-1]
            to_x, to_y = np.zeros((k, x.shape[1])), np.zeros((k, y.shape[1])) if mutual and not itself else None
            at_x, at_y = np.cumsum([0, *na]), np.cumsum([0, *nb])
            for i in np.flatnonzero(na):
                for j in np.flatnonzero(nb):
                    p, q = slice(at_x[i], at_x[i + 1]), slice(at_y[j], at_y[j + 1])
                    add_distances(x[:, p], y[:, q], to_x[j, p], None if to_y is None else to_y[i, q])
            for block, other, own, sums in [(a, b, na, to_x), *([] if to_y is None else [(b, a, nb, to_y)])]:
                out += [(block, i, other, own.tobytes(), sums[:, i:i + piece].tobytes()) for i in range(0, sums.shape[1], piece)]
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("block", "start", "other", "sizes", "sums"), columns, types)})

    def score(table):
        import pyarrow as pa

        table, start = table.sort_by("other"), table["start"][0].as_py()
        sums = 0
        for part in table["sums"]:
            sums = sums + np.frombuffer(part.as_buffer()).reshape(k, -1)
        at = np.arange(sums.shape[1])
        own = np.repeat(np.arange(k), np.frombuffer(table["sizes"][0].as_buffer(), np.int64))[start:start + len(at)]
        a = sums[own, at] / np.maximum(sizes[own] - 1, 1)
        mean = sums / sizes[:, None]
        mean[own, at] = np.inf
        b = mean.min(axis=0)
        top = np.maximum(a, b)
        return pa.table({"s": np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)})

    dealt = tiles.withColumn("task", F.pmod("tile", F.lit(tasks)).cast("int")).repartitionById(tasks, "task")
    return dealt.groupBy("task", "a", "b").applyInArrow(tile, made).groupBy("block", "start").applyInArrow(score, "s double")


def silhouette_euclidean(df: DataFrame, features: Sequence[str], cluster: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """ML5: the mean Euclidean silhouette ``(silhouette, standard_error, n_scored, n)``.

    All rows are scored, each against all rows, and the standard error is 0.  The rows are dealt out to
    blocks, and every two blocks meet in a tile, which adds up the distances both ways; no pair leaves a
    tile, and one row of numbers goes to the driver.  The time grows with the square of the rows.

    Only a caller that names a ``sample`` and has more rows gets an estimate instead: the ``sample`` rows of
    least hash, each against all rows, with the standard error of their mean.  Rows with a missing
    feature or cluster have no part; fewer than two clusters have no silhouette."""
    feats, d = list(features), len(features)
    rows = df.select(F.col(cluster).alias("_c"), *[number(f).alias(f"x{i}") for i, f in enumerate(feats)]).dropna()
    out = "silhouette double, standard_error double, n_scored long, n long"
    clusters = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).orderBy("_c").collect()
    place = {r["_c"]: i for i, r in enumerate(clusters)}
    sizes = np.array([r["n"] for r in clusters], float)
    n, k = int(sizes.sum()), len(clusters)
    if k < 2:
        return df.sparkSession.createDataFrame([(None, None, 0, n)], out)
    placed = rows.select(*[f"x{i}" for i in range(d)], recode("_c", place).cast("double").alias("_k"))
    blocks, count = _dealt(placed, d, k, n)
    if sample is None or n <= sample:
        a, b = F.least("block", "other"), F.greatest("block", "other")
        tiles = _meeting(blocks, count).select(a.alias("a"), b.alias("b"), (F.col("block") == a).alias("left"), "sizes", "rows")
        tiles = tiles.withColumn("tile", F.shiftright(F.col("b") * (F.col("b") + 1), 1) + F.col("a"))
        scores, error = _scores(tiles, count * (count + 1) // 2, True, d, k, sizes), F.lit(0.0)
    else:
        order = F.xxhash64(F.lit(seed), *placed.columns)
        drawn, few = _dealt(placed.orderBy(order, *placed.columns).limit(sample), d, k, sample)
        left = _meeting(drawn, count).select(F.col("block").alias("a"), F.col("other").alias("b"), F.lit(True).alias("left"), "sizes", "rows")
        right = _meeting(blocks, few).select(F.col("other").alias("a"), F.col("block").alias("b"), F.lit(False).alias("left"), "sizes", "rows")
        tiles = left.unionByName(right).withColumn("tile", F.col("a") * count + F.col("b"))
        scores, error = _scores(tiles, few * count, False, d, k, sizes), F.stddev_samp("s") / F.sqrt(F.count("s"))
    mean = scores.agg(F.avg("s").alias("silhouette"), error.alias("standard_error"), F.count("s").alias("n_scored")).first()
    return df.sparkSession.createDataFrame([(*mean, n)], out)


def _silhouettes(blocks: Blocks, fits: Sequence[Restart]) -> list[float | None]:
    """Mean squared-Euclidean silhouettes of several models in two passes: the moments of all clusters,
    then all rows against them."""
    centres = [f.centres for f in fits]
    d, squared, edges = centres[0].shape[1], _squared, np.cumsum([0, *map(len, centres)])

    def labels(x: np.ndarray) -> list[np.ndarray]:
        dist = squared(x, np.vstack(centres))
        return [dist[:, a:b].argmin(axis=1) for a, b in zip(edges, edges[1:])]

    def moments(x: np.ndarray) -> np.ndarray:
        x = x[:, :d]
        out = []
        for label, c in zip(labels(x), centres, strict=True):
            member = np.zeros((len(c), len(x)))
            member[label, np.arange(len(x))] = 1
            out.append(np.column_stack([member.sum(axis=1), member @ (x * x).sum(axis=1), member @ x]).ravel())
        return np.concatenate(out)

    stats = _split(blocks.sum(moments, edges[-1] * (d + 2)), centres)

    def scores(x: np.ndarray) -> np.ndarray:
        x = x[:, :d]
        out = []
        for label, s in zip(labels(x), stats, strict=True):
            n = s[:, 0]
            full = np.maximum(n, 1)
            mean = (x * x).sum(axis=1)[:, None] - 2 * x @ (s[:, 2:] / full[:, None]).T + s[:, 1] / full
            mean[:, n == 0] = np.inf
            rows = np.arange(len(x))
            own = n[label]
            a = mean[rows, label] * own / np.maximum(own - 1, 1)
            mean[rows, label] = np.inf
            b = mean.min(axis=1)
            top = np.maximum(a, b)
            one = np.isfinite(b) & (own > 1) & (top > 0)
            out += [np.where(one, (b - a) / np.where(one, top, 1), 0).sum(), len(x)]
        return np.array(out)

    found = blocks.sum(scores, 2 * len(fits)).reshape(-1, 2)
    return [float(t / n) if (s[:, 0] > 0).sum() > 1 else None for (t, n), s in zip(found, stats, strict=True)]


def k_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11), n_init: int = 10,
            seed: int = 42, max_iter: int = 300, key: str | None = None) -> DataFrame:
    """ML4: for each k the best of ``n_init`` restarts, all fitted together; returns ``(k, cost,
    silhouette_sq, converged)``.  The caller chooses k (the sweep does not)."""
    with _blocks(df, features, key) as blocks:
        fits = kmeans_all(blocks, len(features), [(k, r) for k in ks for r in range(n_init)], seed, max_iter)
        best = [_least(fits, k) for k in ks]
        rows = [(int(f.k), f.cost, s, f.converged) for f, s in zip(best, _silhouettes(blocks, best), strict=True)]
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette_sq double, converged boolean")


def cluster_profile(df: DataFrame, cluster: str, features: Sequence[str], long: bool = True) -> DataFrame:
    """ML6: per-cluster means (AG1), melted to ``(cluster, feature, average_value)``."""
    g = group_means(df, [cluster], features)
    cols = [c for c in features if c in df.columns]
    return melt(g, [cluster], cols, "feature", "average_value") if long else g


def describe_clusters(df: DataFrame, cluster: str, descriptions: Mapping[int, str], out: str = "description"
                      ) -> DataFrame:
    """ML7: description lookup of a cluster id (unmapped -> NULL)."""
    return df.withColumn(out, recode(cluster, descriptions))


def cluster_agreement(df: DataFrame, stored: str | None, predicted: str) -> DataFrame:
    """ML8: % of rows whose stored cluster equals the re-predicted one (100 when none)."""
    return agreement_pct(df, predicted, stored)
