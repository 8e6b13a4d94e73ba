"""Images and files made from ``embeddings``: each vector is a picture of 8 x 8 cells."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import imaging
from orbweave.plans.registry import query
from orbweave.sources import npy, rasters
from orbweave.sources.store import materialise, shared_dir
from orbweave.sources.tables import load

SIDE = 8
#: A component as a byte.
BYTE = "floor(greatest(0, least(255, 128 + 400 * x::DOUBLE)))"


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * x.cast("double")))).cast("int"))
    return load(spark, sf_dir, "embeddings").where(F.size("embedding") == SIDE * SIDE).select("vec_id", v.alias("cells"))


def pictures(spark: SparkSession, sf_dir: str, scale: int = 1, margin: int = 0, least: int = 0) -> DataFrame:
    """Pictures of one channel: each cell ``scale`` pixels wide, 20 in the margin and for cells below ``least``."""
    side = SIDE * scale + 2 * margin

    def draw(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.uint8).reshape(-1, SIDE, SIDE)
            x = np.where(x >= least, x, 20).repeat(scale, 1).repeat(scale, 2)
            x = np.pad(x, ((0, 0), (margin, margin), (margin, margin)), constant_values=20).astype(np.uint8)
            sizes = [pa.array(np.full(len(x), n, np.int32)) for n in (side, side, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([p.tobytes() for p in x], pa.binary())], names=["vec_id", "height", "width", "channels", "pixels"])

    return _bytes(spark, sf_dir).mapInArrow(draw, f"vec_id long, {rasters.RASTER}")


@query()
def synthetic_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture with each kind of defect: how much of its object changed, and that nothing else did."""
    made = imaging.synthetic_defects(pictures(spark, sf_dir, 4, 6, 120), ["vec_id"])
    return made.select("vec_id", "kind", "area", "n_changed", "n_outside", F.sha2("pixels", 256).alias("pixels_sha256"))


@query()
def object_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each picture: how large it is, and its place."""
    masks = imaging.object_masks(pictures(spark, sf_dir, 4, 6, 120), ["vec_id"])
    return masks.select("vec_id", "area", F.sha2("pixels", 256).alias("mask_sha256"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: {BYTE}) AS v FROM embeddings),
    w AS (SELECT i, j, greatest(0, 1 - abs(j + 0.5::DOUBLE - 8 * (i + 0.5::DOUBLE) / 5) / 1.6::DOUBLE) AS w FROM range(0, 5) a(i), range(0, 8) b(j)),
    n AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w),
    r AS (SELECT vec_id, a.i * 5 + b.i AS p, sum(a.w * b.w * v[8 * a.j + b.j + 1]) AS x FROM e, n a, n b WHERE a.w > 0 AND b.w > 0 GROUP BY ALL)
    SELECT vec_id, (c * 25 + p)::INTEGER AS at, round((x / 255 - [0.485::DOUBLE, 0.456, 0.406][c + 1]) / [0.229::DOUBLE, 0.224, 0.225][c + 1], 6) AS x FROM r, range(0, 3) k(c)""")
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 x 8 resized to 5 x 5 and normalised in three channels."""
    made = imaging.normalised(pictures(spark, sf_dir), ["vec_id"], 5)
    return made.select("vec_id", F.posexplode("values").alias("at", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN {BYTE} >= 168 THEN 255 ELSE 0 END::INTEGER) AS v FROM embeddings)
    SELECT vec_id, array_to_string(list_sort(list_distinct(v)), ',') AS pixel_values, len(list_filter(v, lambda x: x > 0)) AS n_on, true AS plain FROM e""")
def png_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as PNG files, written to a table of contents, read again and decoded: their values."""
    bright = rasters.mapped(pictures(spark, sf_dir), lambda p, _: [(np.where(p >= 168, 255, 0), {})], ["vec_id"])
    files = materialise(rasters.encoded(bright), "png-files")
    found = rasters.mask_statistics(rasters.decoded(files), ["vec_id"])
    return found.withColumn("pixel_values", F.array_join("pixel_values", ","))


@query("SELECT label AS rank, count(*) AS n_rows, 64 AS width, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY 1")
def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 1,000 vectors at most, named by label, written as NumPy arrays and read again."""
    rows = load(spark, sf_dir, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    part = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / 5_000)))
    chunks = rows.groupBy("label", part.alias("part")).agg(F.collect_list("embedding").alias("m"))
    name = F.concat(F.lit("part"), F.col("part"), F.lit("_label"), F.col("label"))
    files = chunks.select(name.alias("name"), F.array(F.size("m"), F.size(F.get("m", F.lit(0)))).alias("shape"), F.flatten("m").cast("array<double>").alias("values"))
    npy.register(spark)
    path = f"{shared_dir(spark)}/orbweave/npy-{uuid.uuid4().hex}"
    files.write.format("npy").mode("append").save(path)
    back = npy.read_npy(spark, path).withColumn("rank", F.regexp_extract("path", r"_label(\d+)\.npy$", 1).cast("int"))
    return back.groupBy("rank").agg(
        F.sum(F.get("shape", F.lit(0)).cast("long")).alias("n_rows"), F.max(F.get("shape", F.lit(1))).alias("width"),
        F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)), 4).alias("total"),
    )
