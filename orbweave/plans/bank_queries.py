"""Reductions and diagnostics of vector sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.vectors import cosine, dot
from orbweave.operators import bank, diagnostics
from orbweave.plans.registry import query
from orbweave.sources.tables import load, patches

SEEDS = (111, 333, 999, 2026, 3407)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


@query()
def fewshot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten images for each seed, as a seeded draw from the sorted list gives them."""
    images = patches(_vectors(spark, sf_dir)).where("image_label = 0").select("image_id").distinct()
    out = [bank.few_shot(images, "image_id", 10, s).withColumn("seed", F.lit(s)) for s in SEEDS]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


@query("""WITH n AS (SELECT count(*) AS n, greatest(1, least(64, floor(count(*) * 0.1)))::INTEGER AS k FROM embeddings), p AS (SELECT DISTINCT floor(i * ((n - 1) / (k - 1)::DOUBLE))::BIGINT AS place FROM n, range(0, 64) r(i) WHERE i < k - 1 UNION SELECT n - 1 FROM n)
    SELECT vec_id, label FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) JOIN p USING (place)""")
def linspace_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.evenly_spaced(_vectors(spark, sf_dir), "vec_id").select("vec_id", "label")


@query()
def orbit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(_vectors(spark, sf_dir)).select("category", "image_id", "patch", "vec_id", "embedding")
    return bank.orbit_dedupe(p, ["category"], ["image_id", "patch"], limit=0.3).select("category", "vec_id")


@query()
def kcenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(_vectors(spark, sf_dir))
    return bank.k_centre_coreset(p, "category", 16).select("category", "vec_id")


@query()
def kmeans_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.kmeans_coreset(_vectors(spark, sf_dir), 0.1).select("vec_id", "label")


@query()
def pca_dim95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained variance by component, and whether 95 % is reached there."""
    v = bank.explained_variance(_vectors(spark, sf_dir))
    return v.select("component", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"), (F.col("cumulative") >= 0.95).alias("reaches_95"))


@query("""WITH e AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_pop(x) AS v FROM e GROUP BY i)""")
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the principal variances, which is that of the dimensions'."""
    _, _, variances = bank.principal_axes(_vectors(spark, sf_dir))
    return spark.createDataFrame([(round(float(variances.sum()), 6),)], "total_variance double")


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    mean, axes, _ = bank.principal_axes(e)
    low = bank.project(e, mean, axes[:16])
    return low.select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("energy"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT i, avg(x[i]) AS mx, avg(y[i]) AS my FROM p, range(1, 65) r(i) GROUP BY i), l AS (SELECT list(mx ORDER BY i) AS mx, list(my ORDER BY i) AS my FROM m),
    c AS MATERIALIZED (SELECT vec_id, list_transform(list_zip(x, mx), lambda z: z[1] - z[2]) AS x, list_transform(list_zip(y, my), lambda z: z[1] - z[2]) AS y FROM p, l),
    k AS MATERIALIZED (SELECT list_inner_product(a.x, b.x) AS kx, list_inner_product(a.y, b.y) AS ky FROM c a, c b)
    SELECT 'self' AS pair, round(sum(kx * kx) / sqrt(sum(kx * kx) * sum(kx * kx)), 6) AS cka FROM k UNION ALL SELECT 'next', round(sum(kx * ky) / sqrt(sum(kx * kx) * sum(ky * ky)), 6) FROM k""")
def cka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the vectors with themselves and with their successors."""
    p = _pairs(spark, sf_dir)
    rows = [("self", round(diagnostics.linear_cka(p, "embedding", "embedding"), 6)), ("next", round(diagnostics.linear_cka(p, "embedding", "other"), 6))]
    return spark.createDataFrame(rows, "pair string, cka double")


@query()
def procrustes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    rows = [("self", round(abs(diagnostics.procrustes(p, "embedding", "embedding")), 6)), ("next", round(diagnostics.procrustes(p, "embedding", "other"), 6))]
    return spark.createDataFrame(rows, "pair string, disparity double")


@query("""WITH p AS (SELECT label, list_transform(range(1, 65), lambda i: 0.0::DOUBLE) AS z FROM embeddings LIMIT 0),
    m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY 1)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS to_centre FROM embeddings JOIN c USING (label)""")
def cosine_to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine to the mean of its label (width times labels rows)."""
    e = _vectors(spark, sf_dir)
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", F.col("c.x").alias("centre"))
    return e.join(centres, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("to_centre"))
