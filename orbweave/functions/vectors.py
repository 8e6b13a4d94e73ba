"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    # the norm is bound once, not computed for each element
    return F.element_at(
        F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))), 1
    )


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def is_finite(v: Column) -> Column:
    return F.forall(doubles(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def min_max(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``value`` scaled to 0..1 within its group; 0 where the group is flat."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(F.lit(0.0))
    return df.join(ends, by).withColumn(out, scaled).drop("__low", "__high")


def standardise(df: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """Columns at mean 0 and deviation 1 (constant ones at 0)."""
    sd = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", sd))]).first()
    lit = lambda k, c: F.lit(stats[f"{k}_{c}"]).cast("double")
    return df.withColumns({c: F.coalesce((F.col(c) - lit("m", c)) / F.nullif(lit("s", c), F.lit(0.0)), F.lit(0.0)) for c in columns})


def l2sq_to_mean(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Mean vector (``dim``, ``mean``), by dimension so that no vector is gathered."""
    return df.select(F.posexplode(doubles(F.col(embedding))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))
