"""Plans: scaling, PCA, k-means, silhouette, class weights, logistic regression, grid search,
coefficients, batch scoring and classification metrics (FT1-FT6, ML1-ML17, ME1-ME7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.expr import indicator, recode
from strata.functions.vocab import CLUSTER_DESCRIPTIONS
from strata.operators import cluster, features
from strata.plans.registry import register, rounded, table
from strata.plans.tables import PRIORITY_CASE_SQL, PRIORITY_CODES

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- FT1 / FT2 / FT3
@register("standardize", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / coalesce(nullif((SELECT stddev_pop({c}) FROM lineitem), 0), 1), 6)"
    f" AS {c}" for c in LI_FEATS) + " FROM lineitem")
def standardize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LI_FEATS)
    out, _ = features.standardize(li, LI_FEATS)
    return rounded(out)


_FIT_R = "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"


@register("standardize_apply", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM {_FIT_R})) / coalesce(nullif((SELECT stddev_pop({c}) FROM {_FIT_R}), 0), 1), 6)"
    f" AS {c}" for c in LI_FEATS) + " FROM lineitem WHERE l_returnflag = 'A'")
def standardize_apply(spark, sf_dir):
    """FT2 + FT3: fit on one part, apply to another."""
    li = table(spark, sf_dir, "lineitem")
    model = features.fit_scaler(li.where(F.col("l_returnflag") == "R"), LI_FEATS)
    return rounded(model.transform(li.where(F.col("l_returnflag") == "A")).select("l_orderkey", "l_linenumber", *LI_FEATS))


@register("scaler_params", _union([
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS scale "
    f"FROM lineitem" for c in LI_FEATS]))
def scaler_params(spark, sf_dir):
    return rounded(features.fit_scaler(table(spark, sf_dir, "lineitem"), LI_FEATS).to_frame(spark))


# ---------------------------------------------------------------- FT4 / FT5 / FT6
@register("pca_2d", """
WITH s AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice) AS mp, var_samp(l_quantity) AS a,
                  covar_samp(l_quantity, l_extendedprice) AS b, var_samp(l_extendedprice) AS c FROM lineitem),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1 FROM s),
v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS v11, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS v12 FROM e),
w AS (SELECT *, CASE WHEN abs(v12) >= abs(v11) THEN v12 ELSE -v12 END AS v21,
                CASE WHEN abs(v12) >= abs(v11) THEN -v11 ELSE v11 END AS v22 FROM v)
SELECT l_orderkey, l_linenumber,
  round((l_quantity - mq) * v11 + (l_extendedprice - mp) * v12, 6) AS PC1,
  round((l_quantity - mq) * v21 + (l_extendedprice - mp) * v22, 6) AS PC2
FROM lineitem, w""")
def pca_2d(spark, sf_dir):
    """FT5 (centring only, two features) with the canonical sign rule."""
    li = table(spark, sf_dir, "lineitem")
    out, _ = features.pca(li, ["l_quantity", "l_extendedprice"], 2, scale=False, keep=["l_orderkey", "l_linenumber"])
    return rounded(out)


EMB = [f"e{i}" for i in range(64)]


def _embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@register("pca_embeddings")
def pca_embeddings(spark, sf_dir):
    """FT4: standardise 64 features, project on 2 components (rows-only check)."""
    out, _ = features.pca(_embeddings(spark, sf_dir), EMB, 2, scale=True, keep=["vec_id", "label"])
    return rounded(out)


@register("pca_loadings")
def pca_loadings(spark, sf_dir):
    e, _ = features.standardize(_embeddings(spark, sf_dir), EMB)
    return rounded(features.fit_pca(e, EMB, 2).loadings(spark))


# ---------------------------------------------------------------- ML1 Lloyd / ML2 / ML6 / ML7 / ML8
KM_FEATS = ["x_price", "x_priority"]
KM_INIT = [[0.5, 1.0], [2.0, 3.0], [4.0, 5.0]]
KM_ITERS = 5


def _km_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 100000.0).alias("x_price"),
                    recode("o_orderpriority", PRIORITY_CODES).cast("double").alias("x_priority"),
                    indicator("o_orderstatus", "F").alias("is_finished"))


_KM_BASE = f"(SELECT o_orderkey, o_totalprice / 100000.0 AS x_price, CAST({PRIORITY_CASE_SQL} AS DOUBLE) AS x_priority FROM orders)"


def _assign_sql(src: str, cents: str) -> str:
    return (f"(SELECT o_orderkey, x_price, x_priority, cluster FROM (SELECT p.*, c.cluster, row_number() OVER "
            f"(PARTITION BY p.o_orderkey ORDER BY (p.x_price - c.cx) * (p.x_price - c.cx) + "
            f"(p.x_priority - c.cy) * (p.x_priority - c.cy), c.cluster) AS rn FROM {src} p, {cents} c) WHERE rn = 1)")


def _lloyd_sql() -> str:
    init = " UNION ALL ".join(f"SELECT {j} AS cluster, {c[0]} AS cx, {c[1]} AS cy" for j, c in enumerate(KM_INIT))
    ctes = [f"c0 AS ({init})"]
    for i in range(1, KM_ITERS + 1):
        ctes.append(f"a{i} AS {_assign_sql(_KM_BASE, f'c{i - 1}')}")
        ctes.append(f"c{i} AS (SELECT p.cluster, coalesce(m.cx, p.cx) AS cx, coalesce(m.cy, p.cy) AS cy FROM c{i - 1} p "
                    f"LEFT JOIN (SELECT cluster, avg(x_price) AS cx, avg(x_priority) AS cy FROM a{i} GROUP BY cluster) m "
                    f"ON p.cluster = m.cluster)")
    ctes.append(f"fin AS {_assign_sql(_KM_BASE, f'c{KM_ITERS}')}")
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT c.cluster, coalesce(n.n, 0) AS n, round(c.cx, 6) AS x_price, round(c.cy, 6) AS x_priority "
            f"FROM c{KM_ITERS} c LEFT JOIN (SELECT cluster, count(*) AS n FROM fin GROUP BY cluster) n "
            f"ON c.cluster = n.cluster")


@register("kmeans_lloyd", _lloyd_sql())
def kmeans_lloyd(spark, sf_dir):
    """ML1 deterministic: 5 Lloyd iterations from fixed centres; final centres and sizes."""
    d = _km_orders(spark, sf_dir)
    m = cluster.kmeans_lloyd(d, KM_FEATS, KM_INIT, max_iter=KM_ITERS, tol=-1.0)
    sizes = m.transform(d, "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    cent = m.centres_frame(spark).withColumn("cluster", F.col("cluster").cast("int"))
    return rounded(cent.join(sizes, "cluster", "left").fillna(0, ["n"]).select("cluster", "n", *KM_FEATS))


_C_FIXED = " UNION ALL ".join(f"SELECT {j} AS cluster, {c[0]} AS cx, {c[1]} AS cy" for j, c in enumerate(KM_INIT))


@register("kmeans_assign", f"SELECT o_orderkey, cluster FROM {_assign_sql(_KM_BASE, '(' + _C_FIXED + ')')}")
def kmeans_assign(spark, sf_dir):
    """ML2: nearest of fixed centres, as a projection."""
    m = cluster.KMeansModel(KM_FEATS, KM_INIT)
    return m.transform(_km_orders(spark, sf_dir), "cluster").select("o_orderkey", "cluster")


_ASSIGNED = (f"(SELECT a.*, o.o_totalprice, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_finished, "
             f"CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS stored "
             f"FROM {_assign_sql(_KM_BASE, '(' + _C_FIXED + ')')} a JOIN orders o USING (o_orderkey))")


@register("cluster_profile", "SELECT * FROM (" + _union([
    f"SELECT cluster, '{c}' AS feature, round(avg({c}), 6) AS average_value FROM {_ASSIGNED} GROUP BY cluster"
    for c in ["x_price", "x_priority", "is_finished"]]) + ")")
def cluster_profile(spark, sf_dir):
    """ML6: per-cluster means, melted."""
    m = cluster.KMeansModel(KM_FEATS, KM_INIT)
    a = m.transform(_km_orders(spark, sf_dir), "cluster")
    return rounded(cluster.cluster_profile(a, "cluster", ["x_price", "x_priority", "is_finished"]))


@register("cluster_agreement", f"""
SELECT round(avg(CASE WHEN cluster = stored THEN 1.0 ELSE 0.0 END) * 100, 6) AS agreement_pct FROM {_ASSIGNED}""")
def cluster_agreement(spark, sf_dir):
    """ML8: stored group id vs re-predicted cluster."""
    m = cluster.KMeansModel(KM_FEATS, KM_INIT)
    a = m.transform(_km_orders(spark, sf_dir), "cluster").withColumn(
        "stored", recode("o_orderstatus", {"F": 0, "O": 1, "P": 2}))
    return rounded(cluster.cluster_agreement(a, "stored", "cluster"))


@register("cluster_descriptions", f"""
SELECT CASE cluster WHEN 0 THEN '{CLUSTER_DESCRIPTIONS[0]}' WHEN 1 THEN '{CLUSTER_DESCRIPTIONS[1]}'
  WHEN 2 THEN '{CLUSTER_DESCRIPTIONS[2]}' END AS description, count(*) AS n FROM {_ASSIGNED} GROUP BY 1""")
def cluster_descriptions(spark, sf_dir):
    """ML7: description lookup per cluster id."""
    m = cluster.KMeansModel(KM_FEATS, KM_INIT)
    a = cluster.describe_clusters(m.transform(_km_orders(spark, sf_dir), "cluster"), "cluster", CLUSTER_DESCRIPTIONS)
    return a.groupBy("description").agg(F.count(F.lit(1)).alias("n"))


def _sweep_sql(ks: str, tail: str) -> str:
    """All restarts of all k in SQL: the same seeding hash, weighted reservoir, Lloyd passes and stopping
    rule; ``best`` has the restart of least cost for each k."""
    p = cluster.HASH_PRIME
    return f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
m AS (SELECT k, r FROM (SELECT unnest({ks}) AS k) a, range(10) b(r)),
limits AS (SELECT 1e-4 * avg(v) AS tol FROM (SELECT var_pop(v) AS v FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS i FROM e) GROUP BY i)),
s(k, r, j, cs) AS (SELECT k, r, 0::BIGINT, []::DOUBLE[][] FROM m UNION ALL
  SELECT k, r, j + 1, list_append(any_value(cs), arg_min(x, key)) FROM (
    SELECT *, CASE WHEN w > 0 THEN -ln((((h2 * h2 + h2) % {p}) + 0.5) / {p}) / w ELSE 'inf'::DOUBLE END AS key FROM (
      SELECT *, (h1 * h1 + salt + 12345) % {p} AS h2 FROM (
        SELECT *, ((id % {p}) * 48271 + salt * 69621) % {p} AS h1 FROM (
          SELECT s.*, e.id, e.x, 42 + (s.k * 1000 + s.r) * 100 + s.j AS salt,
            CASE WHEN s.j = 0 THEN 1 ELSE list_min(list_transform(s.cs, lambda c: list_distance(e.x, c) ** 2)) END AS w
          FROM s, e WHERE s.j < s.k)))) GROUP BY k, r, j),
l(k, r, it, cs, done) AS (SELECT k, r, 0::BIGINT, cs, false FROM s WHERE j = k UNION ALL
  SELECT k, r, it + 1, new, list_sum(list_transform(range(1, k + 1), lambda i: list_distance(new[i], cs[i]) ** 2)) <= tol FROM (
    SELECT k, r, it, any_value(cs) AS cs, any_value(tol) AS tol, list(coalesce(mean, cs[c]) ORDER BY c) AS new FROM (
      SELECT k, r, it, c, any_value(cs) AS cs, any_value(tol) AS tol, list(v ORDER BY i) FILTER (v IS NOT NULL) AS mean FROM (
        SELECT k, r, it, c, i, any_value(cs) AS cs, any_value(tol) AS tol, avg(v) AS v FROM (
          SELECT k, r, it, cs, tol, list_position(ds, list_min(ds))::BIGINT AS c, unnest(x) AS v, unnest(range(len(x))) AS i FROM (
            SELECT l.*, tol, e.x, list_transform(l.cs, lambda c: list_distance(e.x, c)) AS ds FROM l, e, limits WHERE NOT l.done AND l.it < 300)
          UNION ALL SELECT l.k, l.r, l.it, l.cs, tol, unnest(range(1, l.k + 1)), NULL, -1 FROM l, limits WHERE NOT l.done AND l.it < 300)
        GROUP BY k, r, it, c, i) GROUP BY k, r, it, c) GROUP BY k, r, it)),
f AS (SELECT * FROM l QUALIFY it = max(it) OVER (PARTITION BY k, r)),
costs AS (SELECT k, r, any_value(cs) AS cs, any_value(done) AS done, sum(list_min(list_transform(f.cs, lambda c: list_distance(e.x, c) ** 2))) AS cost
  FROM f, e GROUP BY k, r),
best AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, r) = 1),
a AS (SELECT best.k, e.id, e.x, list_position(list_transform(cs, lambda c: list_distance(e.x, c)),
    list_min(list_transform(cs, lambda c: list_distance(e.x, c)))) AS c, cs FROM best, e)
{tail}"""


@register("kmeans_best_of_restarts", _sweep_sql("[3]", """
SELECT (SELECT count(*) FROM (SELECT unnest(a.cs) AS o) WHERE o < a.cs[c])::INT AS cluster, count(*) AS n FROM a GROUP BY k, c, cs"""))
def kmeans_best_of_restarts(spark, sf_dir):
    """ML1: k=3, 10 restarts, lowest cost kept; cluster sizes."""
    e = _embeddings(spark, sf_dir)
    m = cluster.kmeans_best_of(e, EMB, 3, n_init=10, seed=42, key="vec_id")
    return m.transform(e, "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("k_sweep", _sweep_sql("range(2, 11)", """,
v AS (SELECT k, c, i, sum(v) AS v FROM (SELECT k, c, unnest(x) AS v, unnest(range(len(x))) AS i FROM a) GROUP BY k, c, i),
g AS (SELECT k, c, n, q, sums FROM (SELECT k, c, list(v ORDER BY i) AS sums FROM v GROUP BY k, c)
  JOIN (SELECT k, c, count(*) AS n, sum(list_dot_product(x, x)) AS q FROM a GROUP BY k, c) USING (k, c)),
d AS (SELECT a.k, a.id, a.c AS own, g.c, g.n, list_dot_product(x, x) - 2 * list_dot_product(x, sums) / n + q / n AS dist FROM a JOIN g USING (k)),
z AS (SELECT k, id, max(CASE WHEN c = own THEN n END) AS n, max(CASE WHEN c = own THEN dist * n / nullif(n - 1, 0) END) AS a,
    min(CASE WHEN c <> own THEN dist END) AS b FROM d GROUP BY k, id)
SELECT k::INT AS k, round(any_value(cost), 6) AS cost, round(avg(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_sq,
  any_value(done) AS converged FROM z JOIN best USING (k) GROUP BY k"""))
def k_sweep(spark, sf_dir):
    """ML4: k = 2..10, best of 10 restarts each, cost and squared-Euclidean silhouette."""
    return rounded(cluster.k_sweep(_embeddings(spark, sf_dir), EMB, key="vec_id"))


# ---------------------------------------------------------------- ML5 squared silhouette
_SIL_SRC = ("(SELECT p_size / 10.0 AS f1, p_retailprice / 1000.0 AS f2, "
            "CASE WHEN p_size <= 17 THEN 0 WHEN p_size <= 34 THEN 1 ELSE 2 END AS c FROM part)")


@register("silhouette_sq", f"""
WITH t AS (SELECT row_number() OVER () AS rid, * FROM {_SIL_SRC}),
s AS (SELECT c, count(*) AS n, sum(f1 * f1 + f2 * f2) AS q, sum(f1) AS s1, sum(f2) AS s2 FROM t GROUP BY c),
d AS (SELECT t.rid, t.c AS own, s.c AS other, s.n AS n_other,
             (t.f1 * t.f1 + t.f2 * t.f2) - 2.0 * (t.f1 * s.s1 + t.f2 * s.s2) / s.n + s.q / s.n AS dist
      FROM t, s),
p AS (SELECT rid, max(CASE WHEN own = other THEN dist * n_other / nullif(n_other - 1, 0) END) AS a,
             max(CASE WHEN own = other THEN n_other END) AS n_own,
             min(CASE WHEN own <> other THEN dist END) AS b
      FROM d GROUP BY rid)
SELECT round(avg(CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6)
  AS silhouette FROM p""")
def silhouette_sq(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select((F.col("p_size") / 10.0).alias("f1"), (F.col("p_retailprice") / 1000.0).alias("f2"),
                 F.when(F.col("p_size") <= 17, 0).when(F.col("p_size") <= 34, 1).otherwise(2).alias("c"))
    return rounded(cluster.silhouette_sq_frame(d, ["f1", "f2"], "c"))
