"""File sources: image trees, CSV and log files, masks; and the matching sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp")


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "[.]"), -1))


def stem(path: Column) -> Column:
    """File name without folders and without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    """Name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def image_tree(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Images below ``root/<category>/<split>/<defect>/``; label 0 for ``good``, else 1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).select(
        F.element_at(parts, -4).alias("category"),
        F.element_at(parts, -3).alias("split"),
        F.element_at(parts, -2).alias("defect"),
        "path",
        (F.element_at(parts, -2) != "good").cast("int").alias("label"),
        F.col("length").alias("n_bytes"),
        *(["content"] if with_content else []),
    )


def train_images(spark: SparkSession, root: str) -> DataFrame:
    """The good training images of ``image_tree``, in the order of their paths; ValueError if there is none."""
    found = image_tree(spark, root).where((F.col("split") == "train") & (F.col("defect") == "good"))
    if found.isEmpty():
        raise ValueError(f"no training images below {root}")
    return found.orderBy("path")


def test_images(spark: SparkSession, root: str) -> DataFrame:
    """The test images of ``image_tree``, in the order of defect and path; ValueError if there is none."""
    found = image_tree(spark, root).where(F.col("split") == "test")
    if found.isEmpty():
        raise ValueError(f"no test images below {root}")
    return found.orderBy("category", "defect", "path")


def first_images(paths: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """The first ``limit`` images by path, one for each path without regard to case."""
    kept = paths.where(extension(F.col(path)).isin(*IMAGE_EXTENSIONS))
    return dedupe_paths(kept, path).orderBy(path).limit(limit)


def dedupe_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row per path without regard to case: of each the last by its text."""
    return paths.groupBy(F.lower(path).alias("path_key")).agg(F.max(path).alias(path)).select(path)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with a given schema; fields that don't fit are null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("header", header).csv(paths)


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Those of ``paths`` that exist, in any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of ``pattern`` in a text, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def with_masks(images: DataFrame, masks: DataFrame, key: str, priority: str, mask: str) -> DataFrame:
    """Images with the mask of the lowest ``priority`` (then the least mask) for their key; null where there is none."""
    best = masks.groupBy(key).agg(F.min(F.struct(priority, mask)).alias("__best"))
    return images.join(best, key, "left").withColumn(mask, F.col(f"__best.{mask}")).drop("__best")


def write_csv(df: DataFrame, path: str, append: bool = False, single_file: bool = False) -> None:
    """CSV with a header; ``single_file`` is for small reports."""
    (df.coalesce(1) if single_file else df).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def unfinished(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a grid of experiments that have no result yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def numbered_files(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """``rank`` and path of the files whose name matches ``pattern`` (its first group is the number); others go.

    Of several files of a rank the last by path counts.
    """
    name = F.element_at(F.split(path, "/"), -1)
    rank = F.regexp_extract(name, pattern, 1).try_cast("int")
    return files.where(name.rlike(pattern)).select(rank.alias("rank"), path).where("rank is not null").groupBy("rank").agg(F.max(path).alias(path))


def exactly(paths: list[str], n: int) -> list[str]:
    """``paths`` if they are ``n`` different ones; ValueError otherwise."""
    if len(set(paths)) != n:
        raise ValueError(f"{n} input files are needed, not {len(set(paths))}")
    return paths


def split_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All split CSV files below ``root``, with the ``category`` that begins each image's path."""
    found = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    return found.withColumn("category", F.split_part("image", F.lit("/"), F.lit(1)))


def size_ratio(files: DataFrame, of: Column, to: Column, n_bytes: str = "n_bytes") -> DataFrame:
    """Megabytes of two kinds of files and the first's multiple of the second (null if that is nothing)."""
    mb = lambda kind: F.coalesce(F.sum(F.when(kind, F.col(n_bytes))), F.lit(0)) / 1e6
    return files.agg(mb(of).alias("mb"), mb(to).alias("mb_other")).select("*", (F.col("mb") / F.nullif(F.col("mb_other"), F.lit(0.0))).alias("ratio"))


def gaussian_vectors(spark: SparkSession, n: int, width: int, seed: int) -> DataFrame:
    """``n`` vectors of standard normal values (Box and Muller's) that depend on id, place and seed only.

    So they are the same however Spark deals out the rows.
    """
    share = lambda salt, i: (F.pmod(F.xxhash64(F.col("vec_id"), i, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 1) / float(1 << 40)
    value = lambda i: (F.sqrt(-2 * F.ln(share(0, i))) * F.cos(2 * F.pi() * share(1, i))).cast("float")
    return spark.range(n).withColumnRenamed("id", "vec_id").withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value))


def log_run(spark: SparkSession, path: str, run: str, status: str, detail: str | None = None) -> None:
    """Add a line on a run to the log at ``path``."""
    row = spark.createDataFrame([(run, status, detail)], "run string, status string, detail string").withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(path)


def write_metric(spark: SparkSession, path: str, **metrics: float) -> None:
    """Named figures as lines of text, over what is at ``path``."""
    lines = [(f"{k}: {v:.6f}",) for k, v in sorted(metrics.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
