"""Filters, sources and sinks that reports and runs need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import scalars
from orbweave.functions.vectors import standardise
from orbweave.operators import bank, metrics
from orbweave.plans.registry import query
from orbweave.sources import files
from orbweave.sources.store import shared_dir
from orbweave.sources.tables import load


@query("SELECT p_partkey, p_size FROM part WHERE p_size::VARCHAR IN ('8', '8-bit', '15')")
def type_tolerant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number that other tables hold as text."""
    return load(spark, sf_dir, "part").where(scalars.is_any_of(F.col("p_size"), 8, "8-bit", 15)).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity::DECIMAL(12, 2) / 8, 1)::DOUBLE AS eighth FROM lineitem")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eighth of a quantity, halves to the even digit."""
    exact = F.col("l_quantity").cast("decimal(12,2)") * F.lit("0.125").cast("decimal(4,3)")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_half_even(exact, 1).cast("double").alias("eighth"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS c FROM nation)
    SELECT r.place, n_name FROM range(0, 60) r(place) JOIN n ON r.place % c = i""")
def cap_with_recycling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty of twenty-five rows."""
    return metrics.first_recycled(load(spark, sf_dir, "nation"), "n_nationkey", 60).select("place", "n_name")


@query("""WITH f AS (SELECT 'scores/rank_' || (p_partkey % 50) || '_v' || (p_partkey % 3) || '.npy' AS path FROM part UNION ALL SELECT 'scores/other.npy')
    SELECT regexp_extract(path, 'rank_([0-9]+)_', 1)::INTEGER AS rank, max(path) AS path FROM f WHERE regexp_matches(path, 'rank_[0-9]+_') GROUP BY 1""")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last file of each rank."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("scores/rank_"), (key % 50).cast("string"), F.lit("_v"), (key % 3).cast("string"), F.lit(".npy"))
    paths = load(spark, sf_dir, "part").select(path.alias("path")).unionByName(spark.createDataFrame([("scores/other.npy",)], "path string"))
    return files.numbered_files(paths, "rank_([0-9]+)_")


@query("SELECT label, count(DISTINCT round(x, 1)) AS n_values, min(round(x, 1)) AS least, max(round(x, 1)) AS most FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1")
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different values the cells of each label's grids have."""
    cells = load(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", F.round(F.col("x").cast("double"), 1).alias("x"))
    return cells.groupBy("label").agg(F.count_distinct("x").alias("n_values"), F.min("x").alias("least"), F.max("x").alias("most"))


@query()
def gaussian_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label, its vectors with seeded normal noise added: the moments of what was added, and how many there are."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    noise = files.gaussian_vectors(spark, (e.agg(F.max("vec_id")).first()[0] or 0) + 1, 64, 7).withColumnRenamed("embedding", "noise")
    added = F.zip_with("embedding", "noise", lambda x, n: x.cast("double") + n)
    x = e.join(noise, "vec_id").select("label", F.explode(F.zip_with(added, "embedding", lambda a, b: a - b)).alias("x"))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("sd"))


@query("SELECT vec_id, (i - 1)::INTEGER AS p, round((embedding[(i - 1) // 4 * 2 * 8 + (i - 1) % 4 * 2 + 1]::DOUBLE / 255 - 0.485) / 0.229, 6) AS x FROM embeddings, range(1, 17) r(i)")
def resize_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids at half their side, as standardised pixels."""
    v = scalars.standard_pixels(scalars.resize_nearest(F.col("embedding").cast("array<double>"), 8, 4), 0.485, 0.229)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("p", "x")).withColumn("x", F.round("x", 6))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem")
def standardise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return standardise(rows, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT (i - 1)::INTEGER AS dim, round(avg(x), 6) AS mean, round(var_samp(x) + 1e-6, 5) AS variance FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def bank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector and covariance of all vectors; the covariance is read back from its inverse."""
    import numpy as np

    mean, inverse = bank.bank_statistics(load(spark, sf_dir, "embeddings"))
    variance = np.diag(np.linalg.inv(inverse))
    return spark.createDataFrame([(k, round(float(m), 6), round(float(v), 5)) for k, (m, v) in enumerate(zip(mean, variance, strict=True))], "dim int, mean double, variance double")


@query()
def spearman_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of size and price of the parts, with its p-value."""
    rows = load(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return metrics.spearman_test(rows, "x", "y").select(F.round("rho", 6).alias("rho"), "n", F.round("p_value", 6).alias("p_value"))


@query("""WITH x AS (SELECT vec_id, label, round(unnest(embedding::DOUBLE[]), 3) AS s, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
    g AS (SELECT *, CASE WHEN label >= 8 AND p // 8 < 4 AND p % 8 < 4 THEN 1 WHEN label >= 8 AND p // 8 >= 6 THEN 2 ELSE 0 END AS region FROM x),
    z AS (SELECT vec_id, region, count(*) AS size FROM g WHERE region > 0 GROUP BY 1, 2),
    b AS (SELECT s, count(*) FILTER (region = 0) AS fp, coalesce(sum(1.0::DOUBLE / size), 0) AS part FROM g LEFT JOIN z USING (vec_id, region) GROUP BY 1),
    c AS (SELECT *, sum(fp) OVER w / (SELECT sum(fp) FROM b) AS x1, sum(part) OVER w / (SELECT count(*) FROM z) AS y1, fp / (SELECT sum(fp) FROM b) AS dx, part / (SELECT count(*) FROM z) AS dy FROM b WINDOW w AS (ORDER BY s DESC))
    SELECT round(sum(dx * (y1 + y1 - dy) / 2) / greatest(max(x1), 0.3), 6) AS pro_auc FROM c WHERE x1 <= 0.3""")
def pro_auc_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap with two regions of each defective grid, every distinct score a threshold."""
    cells = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "s")).withColumn("s", F.round(F.col("s").cast("double"), 3))
    row, column = F.floor(F.col("p") / 8), F.col("p") % 8
    region = F.when((F.col("label") >= 8) & (row < 4) & (column < 4), 1).when((F.col("label") >= 8) & (row >= 6), 2).otherwise(0)
    return metrics.pro_area_over_scores(cells.withColumn("region", region), "s", "region", "vec_id").select(F.round("pro_auc", 6).alias("pro_auc"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS found FROM events""")
def nested_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wanted key at any depth of the events' properties, which stand at three depths, or are cut off."""
    depth = F.col("event_id") % 4
    json = F.when(depth == 0, F.col("props")).when(depth == 1, F.concat(F.lit('{"x": [1, '), "props", F.lit("]}")))
    json = json.when(depth == 2, F.concat(F.lit('[{"y": {"other": '), "props", F.lit("}}]"))).otherwise(F.concat(F.lit("{"), "props"))
    return load(spark, sf_dir, "events").select("event_id", scalars.first_key_anywhere(json, ["k", "score"]).alias("found"))


@query("SELECT event_type AS run, CASE WHEN max(value) > 400 THEN 'failed' ELSE 'done' END AS status, count(*) || ' events' AS detail FROM events GROUP BY 1 UNION ALL SELECT 'all', 'done', count(*) || ' events' FROM events")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a run for each type of event added to a log, and one for all."""
    path = f"{shared_dir(spark)}/orbweave/log-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events")
    for r in sorted(e.groupBy("event_type").agg(F.max("value").alias("top"), F.count("*").alias("n")).collect()):  # a row a type
        files.log_run(spark, path, r.event_type, "failed" if r.top > 400 else "done", f"{r.n} events")
    files.log_run(spark, path, "all", "done", f"{e.count()} events")
    return spark.read.parquet(path).select("run", "status", "detail")


@query("SELECT unnest(['mean: ' || printf('%.6f', round(avg(value), 6)), 'n: ' || printf('%.6f', count(value)::DOUBLE), 'top: ' || printf('%.6f', max(value))]) AS line FROM events")
def metric_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the events written as lines of text and read again."""
    path = f"{shared_dir(spark)}/orbweave/metric-{uuid.uuid4().hex}"
    r = load(spark, sf_dir, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"), F.max("value").alias("top")).first()
    files.write_metric(spark, path, mean=r["mean"], n=r["n"], top=r["top"])
    return spark.read.text(path).select(F.col("value").alias("line"))
