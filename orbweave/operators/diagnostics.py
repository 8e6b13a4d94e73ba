"""Comparisons of embedding sets and of scores."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.knn import as_matrix
from orbweave.operators.running import quantiles


def cross_moments(pairs: DataFrame, x: str, y: str) -> tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Count, means and centred products of two vector columns, added up by the tasks."""

    def add(batches):
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                a, b = as_matrix(batch.column(0)), as_matrix(batch.column(1))
                own = [a.sum(0), b.sum(0), a.T @ a, b.T @ b, a.T @ b]
                n, sums = n + len(a), own if sums is None else [s + o for s, o in zip(sums, own, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())] + [pa.array([s.ravel().tolist()]) for s in sums], names=["n", "sa", "sb", "aa", "bb", "ab"])

    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    parts = rows.mapInArrow(add, "n long, sa array<double>, sb array<double>, aa array<double>, bb array<double>, ab array<double>")
    # one pass: each sum's elements are added by place
    stacked = parts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("sa", "sb", "aa", "bb", "ab")])).alias("e"))
    placed = stacked.select("n", "e.what", F.posexplode("e.v").alias("k", "v")).groupBy("what", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    table = placed.orderBy("what", "k").toPandas()  # width squared rows
    if table.empty:
        raise ValueError("no vectors")
    part = {w: g["v"].to_numpy() for w, g in table.groupby("what")}
    n = int(table["n"].iloc[0])
    ma, mb = part["sa"] / n, part["sb"] / n
    square = lambda w, p, q: part[w].reshape(len(p), len(q)) - n * np.outer(p, q)
    return n, ma, mb, {"aa": square("aa", ma, ma), "bb": square("bb", mb, mb), "ab": square("ab", ma, mb)}


def linear_cka(pairs: DataFrame, x: str, y: str) -> float:
    """Centred kernel alignment of two representations of the same rows."""
    _, _, _, m = cross_moments(pairs, x, y)
    return float((m["ab"] ** 2).sum() / np.sqrt((m["aa"] ** 2).sum() * (m["bb"] ** 2).sum()))


def procrustes(pairs: DataFrame, x: str, y: str) -> float:
    """Mean squared difference of x R and y for the best rotation R (not centred)."""
    n, ma, mb, m = cross_moments(pairs, x, y)
    raw = {"aa": m["aa"] + n * np.outer(ma, ma), "bb": m["bb"] + n * np.outer(mb, mb), "ab": m["ab"] + n * np.outer(ma, mb)}
    # |xR - y|^2 = |x|^2 + |y|^2 - 2 * (sum of singular values of x'y)
    least = np.trace(raw["aa"]) + np.trace(raw["bb"]) - 2 * np.linalg.svd(raw["ab"], compute_uv=False).sum()
    return float(least / (n * len(mb)))


def margin_pressure(df: DataFrame, exact: str, quantised: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Largest change by quantisation over the gap between the classes' scores.

    The gap is the 5th percentile of label 1 less the 95th of label 0; the ratio is
    infinite without a gap, and all are 0 where a class is missing.
    """
    error = F.max(F.abs(F.col(exact) - F.col(quantised)))
    ends = quantiles(df.where(F.col(label).isin(0, 1)), exact, {"low": 0.05, "high": 0.95}, (*groups, label))
    gaps = ends.groupBy(*groups).agg((F.max(F.when(F.col(label) == 1, F.col("low"))) - F.max(F.when(F.col(label) == 0, F.col("high")))).alias("gap"))
    errors = df.groupBy(*groups).agg(error.alias("error"))
    if groups:
        gaps = gaps.select(*[F.col(g).alias(f"__{g}") for g in groups], "gap")
        out = errors.join(gaps, reduce(and_, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]), "left")
    else:
        out = errors.withColumn("gap", F.lit(gaps.first()[0]).cast("double"))  # one number
    ratio = F.when(F.col("gap") > 0, F.col("error") / F.col("gap")).otherwise(F.lit(float("inf")))
    missing = F.col("gap").isNull()
    return out.select(
        *groups, F.when(missing, 0.0).otherwise(F.col("error")).alias("error"), F.when(missing, 0.0).otherwise(F.col("gap")).alias("gap"), F.when(missing, 0.0).otherwise(ratio).alias("pressure")
    )
