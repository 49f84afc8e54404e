"""Nearest-neighbour queries."""

from pyspark.sql import functions as F

from tideline.operators import neighbours as N
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views

EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT a.vec_id AS qid, b.vec_id AS hid, b.label, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, hid) AS rk FROM d)"


def _embeddings(v: Views):
    return v.table("embeddings").withColumn("v", F.col("embedding").cast("array<double>"))


@register("j17_knn_neighbours", f"WITH {EMB} SELECT qid, hid, CAST(rk AS INT) AS rank, ROUND(dist, 7) AS distance FROM n WHERE rk <= 10")
def _(v: Views):
    e = _embeddings(v)
    return us(N.nearest(e.select(F.col("vec_id").alias("hid"), F.col("v").alias("hv")), e.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), 10, pivots=32), digits=7)


@register("j17_knn_vote", f"""WITH {EMB}, k AS (SELECT *, 1 / GREATEST(dist, 1e-6) AS w FROM n WHERE rk <= 25)
SELECT qid, {', '.join(f'ROUND(SUM(CASE WHEN label = {c} THEN w ELSE 0 END) / SUM(w), 7) AS p{c}' for c in range(3))}, ROUND(MIN(dist), 7) AS nearest_distance, ROUND(1 / (1 + MIN(dist)), 7) AS nearest_similarity FROM k GROUP BY 1""")
def _(v: Views):
    e = _embeddings(v)
    n = N.nearest(e.select(F.col("vec_id").alias("hid"), F.col("v").alias("hv")), e.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), 25, pivots=32)
    return us(N.vote(n, e.select(F.col("vec_id").alias("hid"), "label"), range(3)), digits=7)


@register("j16_knn_retrieval", """WITH h AS (SELECT 1000000 + s_suppkey AS hid, s_acctbal / 1000 AS a, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_nationkey AS DOUBLE) END AS b, CAST(s_suppkey % 7 AS DOUBLE) AS c, s_suppkey AS t FROM supplier),
q AS (SELECT c_custkey AS qid, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 7 AS DOUBLE) END AS c, c_custkey % 150 AS t FROM customer),
d AS (SELECT qid, hid, sqrt((pow(q.a - h.a, 2) + COALESCE(pow(q.b - h.b, 2), 0) + COALESCE(pow(q.c - h.c, 2), 0)) / (1 + CASE WHEN h.b IS NULL THEN 0 ELSE 1 END + CASE WHEN q.c IS NULL THEN 0 ELSE 1 END)) AS dist FROM q JOIN h ON h.t < q.t AND h.t + 5 <= q.t),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, hid) AS rk FROM d) SELECT qid, hid, CAST(rk AS INT) AS rank, ROUND(dist, 7) AS distance FROM n WHERE rk <= 5""")
def _(v: Views):
    h = v.table("supplier").select((F.lit(1000000).cast("bigint") + F.col("s_suppkey")).alias("hid"), F.expr("array(s_acctbal / 1000, CASE WHEN s_suppkey % 4 > 0 THEN double(s_nationkey) END, double(s_suppkey % 7))").alias("hv"),
                                   F.col("s_suppkey").alias("ht"), (F.col("s_suppkey") + 5).alias("ha"))
    q = v.table("customer").select(F.col("c_custkey").alias("qid"), F.expr("array(c_acctbal / 1000, double(c_nationkey), CASE WHEN c_custkey % 3 > 0 THEN double(c_custkey % 7) END)").alias("qv"), F.expr("c_custkey % 150").alias("qt"))
    return us(N.nearest(h, q, 5, metric="rms"), digits=7)
