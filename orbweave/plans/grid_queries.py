"""Grid analytics: each embedding is an 8 x 8 grid of 64 values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.vectors import doubles, min_max
from orbweave.operators import grids
from orbweave.plans.registry import query
from orbweave.sources.tables import load

SIDE = 8


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("values"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("vec_id", "label", F.posexplode("values").alias("p", "x"))


@query("SELECT vec_id, list_max(embedding)::DOUBLE AS top, embedding[8 * 7 + 1]::DOUBLE AS was_bottom_left FROM embeddings")
def grid_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grids(spark, sf_dir)
    return g.select("vec_id", F.array_max("values").alias("top"), F.get("values", F.lit(SIDE * (SIDE - 1))).alias("was_bottom_left"))


@query("SELECT vec_id, (i - 1)::INTEGER AS p, embedding[8 * ((i - 1) % 8) + 7 - (i - 1) // 8 + 1]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)")
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn anticlockwise."""
    g = _grids(spark, sf_dir)
    return g.select("vec_id", F.posexplode(grids.rotate(F.col("values"), SIDE, 1)).alias("p", "x"))


@query("""SELECT vec_id, v::INTEGER AS view, round(CASE v WHEN 0 THEN embedding[1] WHEN 1 THEN embedding[8] WHEN 2 THEN embedding[64] WHEN 3 THEN embedding[57]
    WHEN 4 THEN embedding[8] WHEN 5 THEN embedding[1] WHEN 6 THEN embedding[57] ELSE embedding[64] END::DOUBLE, 9) AS corner FROM embeddings, range(0, 8) r(v)""")
def p4m_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first corner of each of the eight views."""
    views = grids.orbit(_grids(spark, sf_dir), "values", SIDE)
    return views.select("vec_id", "view", F.round(F.get("values", F.lit(0)), 9).alias("corner"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings), m AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)
    SELECT vec_id, p::INTEGER AS p, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM x JOIN m USING (vec_id)""")
def min_max_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_max(_pixels(spark, sf_dir), "x", ["vec_id"], "scaled").select("vec_id", "p", F.round("scaled", 6).alias("scaled"))


@query("SELECT vec_id, count(*) FILTER (x > 0.1) AS n_on FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1")
def binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("vec_id", F.size(F.filter("values", lambda x: x > 0.1)).cast("long").alias("n_on"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)
    SELECT vec_id, (p // 8 // 2 * 4 + p % 8 // 2)::INTEGER AS q, round(avg(x), 6) AS x FROM x GROUP BY 1, 2""")
def grid_adaptive_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = _grids(spark, sf_dir).select("vec_id", F.posexplode(grids.adaptive_pool(F.col("values"), SIDE, 4)).alias("q", "x"))
    return pooled.withColumn("x", F.round("x", 6))


@query("""SELECT vec_id, p::INTEGER AS p, CASE WHEN p // 8 BETWEEN 2 AND 5 THEN embedding[p - 16 + 1]::DOUBLE ELSE 0 END AS x FROM embeddings, range(0, 64) r(p)""")
def grid_square_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four rows of each grid as a grid of 4 x 8, padded."""
    half = _grids(spark, sf_dir).withColumn("half", F.slice("values", 1, 32))
    return half.select("vec_id", F.posexplode(grids.square_pad(F.col("half"), 4, SIDE)).alias("p", "x"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
    f AS (SELECT vec_id, u, v, sum(x * cos(2 * pi() * (u * (p // 8) + v * (p % 8)) / 8)) AS re, sum(x * sin(2 * pi() * (u * (p // 8) + v * (p % 8)) / 8)) AS im
    FROM x, range(-4, 4) a(u), range(-4, 4) b(v) WHERE sqrt(u * u + v * v) > 3 GROUP BY ALL) SELECT vec_id, round(sum(sqrt(re * re + im * im)), 6) AS energy FROM f GROUP BY 1""")
def high_frequency_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("vec_id", F.round(grids.high_frequency_energy(F.col("values"), SIDE, 3), 6).alias("energy"))


@query("""WITH o AS (SELECT i, (i + 0.5::DOUBLE) / 4 - 0.5 AS x FROM range(0, 32) r(i)),
    c AS (SELECT i, least(7, greatest(0, floor(x) + k))::INTEGER AS j, abs(x - floor(x) - k) AS d FROM o, range(-1, 3) r(k)),
    w AS (SELECT j, sum(CASE WHEN d <= 1 THEN 1.25 * d * d * d - 2.25 * d * d + 1 ELSE -0.75 * (d * d * d - 5 * d * d + 8 * d - 4) END) AS w FROM c GROUP BY 1)
    SELECT vec_id, round(sum(a.w * b.w * embedding[8 * a.j + b.j + 1]), 6) AS total FROM embeddings, w a, w b GROUP BY 1""")
def grid_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = _grids(spark, sf_dir).withColumn("values", grids.upsample(F.col("values"), SIDE, 32))
    return up.select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH g AS (SELECT k, exp(-0.5 * (k / 4.0::DOUBLE) * (k / 4.0::DOUBLE)) AS e FROM range(-16, 17) r(k)), n AS (SELECT k, e / (SELECT sum(e) FROM g) AS w FROM g),
    s AS (SELECT i, ((i + k) % 16 + 16) % 16 AS m, w FROM range(0, 8) r(i), n), w AS (SELECT i, CASE WHEN m < 8 THEN m ELSE 15 - m END AS j, sum(w) AS w FROM s GROUP BY 1, 2),
    b AS (SELECT vec_id, a.i AS r, c.i AS q, sum(a.w * c.w * embedding[8 * a.j + c.j + 1]) AS x FROM embeddings, w a, w c GROUP BY ALL)
    SELECT vec_id, round(sum(x), 6) AS total, round(max(x), 6) AS top FROM b GROUP BY 1""")
def grid_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = _grids(spark, sf_dir).withColumn("values", grids.blur(F.col("values"), SIDE, 4.0, 16))
    return soft.select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("values"), 6).alias("top"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.transform("values", lambda x: (x > 0.1).cast("int"))
    return _grids(spark, sf_dir).withColumn("region", grids.regions(flags, SIDE))


@query()
def connected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("vec_id", F.array_max("region").alias("n_regions"))


@query()
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the regions of three cells or more."""
    return grids.region_boxes(_regions(spark, sf_dir), "region", SIDE, ["vec_id"], 3)


def _marked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a score (the mirrored grid, scaled to 0..1) and the region they lie in."""
    r = _regions(spark, sf_dir).withColumn("scores", grids.rotate(F.col("values"), SIDE, 0, 1))
    px = r.select("vec_id", F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("category"), F.explode(F.arrays_zip("scores", "region")).alias("z"))
    return min_max(px.select("vec_id", "category", F.col("z.scores").alias("raw"), F.col("z.region").alias("region")), "raw", ["category"], "score")


@query()
def pro_curve_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.pro_curve(_marked_pixels(spark, sf_dir), "score", "region", "vec_id", "category")


@query()
def pro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.pro_auc(pro_curve_pixel(spark, sf_dir)).withColumn("pro_auc", F.round("pro_auc", 6))
