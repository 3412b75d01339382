"""Plans over many features, and all-pairs statistics added up in blocks: correlation of 64 columns,
grid search over 13 features, the Euclidean silhouette."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.expr import arith_hash_sql
from strata.operators import classify, cluster, profile
from strata.plans.registry import register, rounded, table

DIMS = 64


# ---------------------------------------------------------------- AG11 over 64 columns with made gaps
@register("corr_embeddings", f"""
WITH t AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range({DIMS}) r(i) WHERE (vec_id + i) % 17 <> 0)
SELECT 'e' || a.i AS col_x, 'e' || b.i AS col_y,
  round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 6) AS corr
FROM t a JOIN t b USING (vec_id) GROUP BY a.i, b.i""")
def corr_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    gaps = e.select(*[F.when((F.col("vec_id") + i) % 17 != 0, F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(DIMS)])
    return rounded(profile.corr_matrix(gaps, gaps.columns))


# ---------------------------------------------------------------- ML9 + ML13: 13 features, 9 fits
FEATS = [f"x{i}" for i in range(13)]
GRID = (0.1, 1.0, 10.0)
FOLDS, SEED = 3, 42
SQL_STEPS = 1500  # of the oracle's accelerated gradient descent


def _labelled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), *[(F.col("embedding")[i].cast("double") * 8).alias(f) for i, f in enumerate(FEATS)])


@register("grid_search_wide", f"""
WITH RECURSIVE d AS (SELECT (label < 5)::INT AS y, list_append(list_transform(embedding[1:13], lambda v: v::DOUBLE * 8), 1::DOUBLE) AS x,
    {arith_hash_sql('vec_id', SEED)} AS h FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) - 1 AS place, count(*) OVER (PARTITION BY y) AS n FROM d),
cut AS (SELECT y, j, h AS cut_at FROM o, range(1, {FOLDS}) r(j) WHERE place = ceil(j * n / {FOLDS}.0)::BIGINT - 1),
f AS (SELECT d.y, d.x, (SELECT count(*) FROM cut WHERE cut.y = d.y AND d.h > cut.cut_at) AS fold FROM d),
m AS (SELECT c, k FROM (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS c) a, range({FOLDS}) r(k)),
w AS (SELECT k, y, sum(count(*)) OVER (PARTITION BY k) / (2.0 * count(*)) AS w FROM f, range({FOLDS}) r(k) WHERE fold <> k GROUP BY k, y),
t AS (SELECT k, f.y, x, w FROM f JOIN w ON w.y = f.y AND f.fold <> k),
s AS (SELECT k, sum(w * list_dot_product(x, x)) / 4 AS s FROM t GROUP BY k),
g(c, k, it, b, prior) AS (SELECT c, k, 0, list_transform(range(14), lambda i: 0::DOUBLE), list_transform(range(14), lambda i: 0::DOUBLE) FROM m UNION ALL
  SELECT c, k, it + 1, list(pt - (pt + c * slope) / (1 + c * s) ORDER BY i), any_value(b) FROM (
    SELECT c, k, it, i, any_value(pt) AS pt, sum(r * v) AS slope, any_value(b) AS b, any_value(s) AS s FROM (
      SELECT c, k, it, b, s, unnest(a) AS pt, unnest(x) AS v, unnest(range(14)) AS i, w * (1 / (1 + exp(-list_dot_product(x, a))) - y) AS r FROM (
        SELECT g.c, g.k, g.it, g.b, s.s, t.x, t.y, t.w,
          list_transform(list_zip(g.b, g.prior), lambda z: z[1] + (g.it - 1) / (g.it + 2.0::DOUBLE) * (z[1] - z[2])) AS a
        FROM g JOIN t USING (k) JOIN s USING (k) WHERE g.it < {SQL_STEPS}))
    GROUP BY c, k, it, i) GROUP BY c, k, it),
p AS (SELECT g.c, g.k, f.y, (list_dot_product(x, b) > 0)::INT AS p FROM g JOIN f ON f.fold = g.k WHERE it = {SQL_STEPS}),
q AS (SELECT c, k, v AS class, count(*) FILTER (y = v AND p = v) AS tp, count(*) FILTER (y = v) AS support, count(*) FILTER (p = v) AS found
  FROM p, (SELECT unnest([0, 1]) AS v) GROUP BY c, k, v)
SELECT c AS C, k::INT AS fold, round(sum(coalesce(2.0 * tp / nullif(support + found, 0), 0) * support) / sum(support), 6) AS f1_weighted
FROM q GROUP BY c, k""")
def grid_search_wide(spark, sf_dir):
    """ML13 at the width of the original analysis: 13 features, C in {0.1, 1, 10}, 3 folds, balanced weights."""
    _, scores = classify.grid_search_logistic(_labelled(spark, sf_dir), FEATS, "y", "vec_id", GRID, FOLDS, seed=SEED, method="arith")
    return rounded(scores)


# ---------------------------------------------------------------- ML5 Euclidean silhouette
@register("silhouette_euclidean", """
WITH t AS (SELECT row_number() OVER () AS i, p_size / 10.0 AS a, p_retailprice / 1000.0 AS b, p_size % 3 AS c FROM part),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
d AS (SELECT x.i, x.c AS own, y.c, sum(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS s FROM t x, t y GROUP BY x.i, x.c, y.c),
r AS (SELECT i, max(CASE WHEN own = c THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> c THEN s / n END) AS b FROM d JOIN n USING (c) GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, 0::DOUBLE AS standard_error,
  count(*) AS n_scored, count(*) AS n FROM r""")
def silhouette_euclidean(spark, sf_dir):
    """ML5 as scikit-learn defines it: every row against all rows."""
    p = table(spark, sf_dir, "part")
    d = p.select((F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 1000.0).alias("b"), (F.col("p_size") % 3).alias("c"))
    return rounded(cluster.silhouette_euclidean(d, ["a", "b"], "c"))
