"""Table loading with explicit schemas, and validation of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PATCHES = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("image_id", T.LongType()), T.StructField("patch", T.LongType()),
    T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])


class SchemaError(ValueError):
    """A table lacks required columns or has columns of another type."""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` if it has all ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` of ``df``, which must have its types."""
    require(df, schema.fieldNames())
    wrong = [f"{f.name}: {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}" for f in schema if df.schema[f.name].dataType != f.dataType]
    if wrong:
        raise SchemaError("; ".join(wrong))
    return df.select(*schema.fieldNames())


def vector_faults(vectors: DataFrame, width: int, embedding: str = "embedding") -> DataFrame:
    """Counts of null, wrongly wide and non-finite vectors, in one row."""
    v = F.col(embedding)
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return vectors.agg(
        F.count("*").alias("n_vectors"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(F.size(v) != width).alias("n_wrong_width"),
        F.count_if(F.coalesce(odd, F.lit(False))).alias("n_not_finite"),
    )


def union_vectors(parts: dict[str, DataFrame], embedding: str = "embedding") -> DataFrame:
    """The vectors of several tables as ``key`` and ``embedding``, the keys in the order of their names.

    Tables whose column is missing or holds no arrays of numbers are left out, and so are null vectors.
    ValueError if no table is left, if fewer than two vectors are, or if their widths differ.
    """
    numeric = lambda t: isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType)
    usable = {key: df for key, df in sorted(parts.items()) if embedding in df.columns and numeric(df.schema[embedding].dataType)}
    if not usable:
        raise ValueError("no table has vectors")
    one = [df.where(F.col(embedding).isNotNull()).select(F.lit(key).alias("key"), F.col(embedding).cast("array<double>").alias("embedding")) for key, df in usable.items()]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    widths = out.groupBy("key").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count("*").alias("n")).orderBy("key").collect()  # a row a table
    if sum(r.n for r in widths) < 2:
        raise ValueError("two vectors at least are needed")
    for r in widths:
        if not r.low == r.high == widths[0].low:
            raise ValueError(f"the vectors of {r.key} have widths {r.low} to {r.high}, not {widths[0].low}")
    return out


def patches(embeddings: DataFrame, per_image: int = 4, categories: int = 3, defect_from: int = 8) -> DataFrame:
    """Embedding rows as image patches: ``per_image`` consecutive vectors make an image.

    An image is defective (``image_label`` 1) if a patch has a label of at least ``defect_from``.
    """
    image = F.floor(F.col("vec_id") / per_image)
    rows = embeddings.select(
        F.concat(F.lit("c"), (image % categories).cast("string")).alias("category"),
        image.alias("image_id"),
        (F.col("vec_id") % per_image).alias("patch"),
        "vec_id",
        "label",
        "embedding",
    )
    defects = rows.groupBy("image_id").agg(F.max((F.col("label") >= defect_from).cast("int")).alias("image_label"))
    return rows.join(defects, "image_id")
