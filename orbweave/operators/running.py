"""Running sums and ranks over a whole table without gathering it in one task.

Values are dealt to buckets by approximate quantiles; window functions run within a
bucket, and what lies in the buckets before is added from a table with a row per
bucket. Equal values always share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(df: DataFrame, by: str, n_buckets: int | None = None) -> Column:
    """Number of the bucket of ``by``, rising with it. Nulls are in the first."""
    n = n_buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(by, [k / n for k in range(1, n)], 1 / (4 * n))
    ends = sorted(set(cuts))
    if not ends:
        return F.lit(0)
    # binary search, so that the expression has only log2(n) levels
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(by) > ends[mid], search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(ends))


def running_sums(df: DataFrame, by: str, sums: dict[str, str], groups: tuple[str, ...] = (), n_buckets: int | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with sums over all rows of its group whose ``by`` is less; a null group is a group.

    ``sums`` maps new columns to the columns they add up. Rows with equal ``by`` get
    the same sum, so unique values give running totals without their own row.
    ``totals`` maps new columns to columns that are summed over the whole group.
    """
    totals = totals or {}
    rows = df.withColumn("__bucket", bucket_of(df, by, n_buckets))
    keys = [*groups, "__bucket"]
    per_bucket = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"__t_{new}") for new, c in (sums | totals).items()])
    whole = Window.partitionBy(*(groups or ("__one",)))
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("__one", F.lit(1)).select(
        *[F.col(c).alias(f"__k_{c}") for c in keys],
        *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in sums],
        *[F.sum(f"__t_{new}").over(whole).alias(new) for new in totals],
    )
    within = Window.partitionBy(*keys).orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*keys, by)
    local = rows.withColumns({f"__l_{new}": F.sum(c).over(within) - F.sum(c).over(equal) for new, c in sums.items()})
    same = F.col("__bucket") == F.col("__k___bucket")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    return local.join(offsets, same).withColumns({new: F.col(f"__l_{new}") + F.col(f"__o_{new}") for new in sums}).drop(
        "__bucket", *[f"__k_{c}" for c in keys], *[f"__{k}_{new}" for new in sums for k in "lo"]
    )


def quantiles(df: DataFrame, value: str, at: dict[str, float], groups: tuple[str, ...] = ()) -> DataFrame:
    """Per group: ``n``, the number of values that aren't null, and interpolated quantiles.

    ``at`` maps new columns to shares in 0..1. Distinct values are counted and ranked by
    running counts, so no task gathers a group. Groups without a value have no row; a
    NaN is above all numbers.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    ranked = running_sums(by_value, "__v", {"__before": "__c"}, groups, totals={"__n": "__c"})

    def value_at(k: Column) -> Column:
        return F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__c")), F.col("__v")))

    places = {name: F.lit(p) * (F.col("__n") - 1) for name, p in at.items()}
    ends = ranked.groupBy(*groups).agg(
        F.max("__n").alias("n"), *[value_at(round_(place)).alias(f"__{end}_{name}") for name, place in places.items() for end, round_ in (("low", F.floor), ("high", F.ceil))]
    )
    found = []
    for name, p in at.items():
        low, high, place = F.col(f"__low_{name}"), F.col(f"__high_{name}"), F.lit(p) * (F.col("n") - 1)
        found.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))).alias(name))
    out = ends.select(*groups, "n", *found)
    return out if groups else out.where("n is not null")


def average_ranks(df: DataFrame, by: str, out: str) -> DataFrame:
    """``df`` with ranks from 1; equal values share the mean of their ranks."""
    sizes = df.groupBy(F.col(by).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running_sums(sizes, "__v", {"__before": "__n"})
    ranks = ranked.select("__v", (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, df[by] == ranks["__v"]).drop("__v")
