"""Reference banks: sampling, deduplication, coresets and statistics of vector sets."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions.vectors import doubles
from orbweave.operators.knn import as_matrix, assign_lists, kmeans, sample_matrix, squared_distances
from orbweave.operators.running import running_sums
from orbweave.sources.store import discard, materialise

#: Rows of a slice that one task reduces.
SLICE_ROWS = 4_096


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``place`` from 0 in the order of a unique column."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {"place": "__one"}).drop("__one")


def few_shot(images: DataFrame, order: str, n_shot: int, seed: int, rule: str = "numpy") -> DataFrame:
    """A seeded sample of ``n_shot`` images, as drawn from the list sorted by ``order``.

    ``numpy`` and ``stdlib`` reproduce RandomState(seed).choice and
    random.Random(seed).sample; ``first`` takes the first ones.
    """
    n = images.count()
    if n_shot > n:
        raise ValueError(f"{n_shot} of {n} images wanted")
    if rule == "numpy":
        picked = np.random.RandomState(seed).choice(n, n_shot, replace=False).tolist()
    elif rule == "stdlib":
        picked = random.Random(seed).sample(range(n), n_shot)
    elif rule == "first":
        picked = list(range(n_shot))
    else:
        raise ValueError(f"unknown rule: {rule}")
    return _numbered(images, order).where(F.col("place").isin(picked)).drop("place")


def evenly_spaced(df: DataFrame, order: str, least: int = 1, most: int = 64, share: float = 0.1) -> DataFrame:
    """max(least, min(most, int(share * n))) rows at even steps through the order."""
    n = df.count()
    k = max(least, min(most, int(share * n)))
    places = sorted({int(x) for x in np.linspace(0, n - 1, k)})
    return _numbered(df, order).where(F.col("place").isin(places)).drop("place")


def orbit_dedupe(df: DataFrame, groups: list[str], order: list[str], embedding: str = "embedding", limit: float = 0.98) -> DataFrame:
    """Rows whose cosine to the last kept row of their group is below ``limit``.

    What is kept depends on what was kept before, so a group is walked in order; its
    rows stream through one task in batches, with the last kept vector as the state.
    """
    at, keys = df.columns.index(embedding), [df.columns.index(g) for g in groups]

    def walk(batches):
        last_key, last = None, None
        for batch in batches:
            x = as_matrix(batch.column(at)) if len(batch) else np.zeros((0, 0))
            norms = np.linalg.norm(x, axis=1) if len(batch) else []
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if len(batch) else []
            kept = []
            for k, key in enumerate(own):
                unit = x[k] / (norms[k] or 1.0)
                if key != last_key or last is None or float(unit @ last) < limit:
                    kept.append(k)
                    last_key, last = key, unit
            yield batch.take(kept) if len(kept) < len(batch) else batch

    ordered = df.repartition(*groups).sortWithinPartitions(*groups, *order)
    return ordered.mapInArrow(walk, df.schema)


def k_centre(x: np.ndarray, k: int) -> list[int]:
    """Greedy farthest-first rows: the first is farthest from the mean, ties by row number."""
    at = int(((x - x.mean(0)) ** 2).sum(1).argmax())
    chosen, near = [at], np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        near = np.minimum(near, squared_distances(x, x[[at]])[:, 0])
        near[chosen] = -1
        at = int(near.argmax())
        chosen.append(at)
    return chosen


def k_centre_coreset(df: DataFrame, group: str, k: int | None = None, share: float | None = None, id_col: str = "vec_id", embedding: str = "embedding", rows: int = SLICE_ROWS) -> DataFrame:
    """Per group ``k`` rows, or max(1, int(share * n)) of its n, by greedy farthest-first.

    A group of at most ``rows`` rows is reduced at once. A larger one is cut into slices of
    about that size by a hash of the id. While a slice is at least four times what is wanted
    of the group, each is reduced to as many rows as are wanted and their union is reduced
    again: the usual composable coreset, within a constant factor of the one-round result.
    Where more is wanted, the slices share the number among them by their sizes. Null
    vectors take no part; a null group is one as well.
    """
    if (k is None) == (share is None):
        raise ValueError("either k or share is needed")
    left = df.where(F.col(embedding).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(embedding).alias("v"))
    kinds = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in left.columns)
    wanted = F.lit(k).cast("long") if share is None else F.greatest(F.lit(1).cast("long"), F.floor(F.lit(share) * F.col("n") + 1e-9))
    goals = materialise(left.groupBy("g").agg(F.count("*").alias("n")).select(F.col("g").alias("of"), wanted.alias("k")), "k-centre-goals")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def reduce_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        take = int(pdf["take"].iloc[0])
        return pdf.iloc[k_centre(np.stack(pdf["v"].to_numpy()).astype(float), take) if take else []][["g", "i", "v"]]

    def sliced(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with their slice, and a row a slice with its size and what is wanted of its group."""
        sizes = some.groupBy("g").agg(F.count("*").alias("m")).join(goals, same("g", "of")).select(F.col("g").alias("of"), "m", "k", F.ceil(F.col("m") / rows).alias("parts"))
        keyed = some.join(sizes, same("g", "of")).withColumn("slice", F.pmod(F.xxhash64("i"), F.col("parts"))).drop("of")
        return keyed, keyed.groupBy("g", "slice").agg(F.count("*").alias("c"), F.first("m").alias("m"), F.first("k").alias("k"))

    def reduced(keyed: DataFrame, takes: DataFrame) -> DataFrame:
        places = takes.select(F.col("g").alias("of"), F.col("slice").alias("part"), "take")
        met = keyed.select("g", "i", "v", "slice").join(places, same("g", "of") & same("slice", "part"))
        return met.select("g", "i", "v", "slice", "take").groupBy("g", "slice").applyInPandas(reduce_rows, kinds)

    before = None
    while True:
        sizes = left.groupBy("g").agg(F.count("*").alias("m")).join(goals, same("g", "of"))
        large = sizes.where((F.col("m") > rows) & (F.col("k") * 4 <= rows)).select(F.col("g").alias("of"))
        if large.isEmpty():
            break
        keyed, slices = sliced(left.join(large, same("g", "of"), "left_semi"))
        fewer = reduced(keyed, slices.withColumn("take", F.col("k")))
        left = materialise(fewer.unionByName(left.join(large, same("g", "of"), "left_anti")), "k-centre")
        if before is not None:
            discard(before)
        before = left
    keyed, slices = sliced(left)
    along = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # one row a slice
    upto = F.floor(F.least(F.col("k"), F.col("m")) * F.sum("c").over(along) / F.col("m") + 1e-9)
    down = F.floor(F.least(F.col("k"), F.col("m")) * (F.sum("c").over(along) - F.col("c")) / F.col("m") + 1e-9)
    found = reduced(keyed, slices.withColumn("take", upto - down))
    return found.select(F.col("g").alias(group), F.col("i").alias(id_col), F.col("v").alias(embedding))


def principal_axes(df: DataFrame, embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (rows) and variances (falling) of all vectors.

    Tasks add up counts, sums and products; only matrices of the vectors' width
    reach the driver.
    """

    def add(batches):
        n, s, p = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = as_matrix(batch.column(0))
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd_batch(n, s, p)

    def pd_batch(n, s, p):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], names=["n", "s", "p"])

    parts = df.where(F.col(embedding).isNotNull()).select(embedding).mapInArrow(add, "n long, s array<double>, p array<double>")
    total = lambda c: parts.select(F.posexplode(c).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toPandas()["x"].to_numpy()
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("no vectors")
    mean = total("s") / n
    covariance = total("p").reshape(len(mean), -1) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(covariance)
    return mean, vectors[:, ::-1].T, np.maximum(values[::-1], 0)


def project(df: DataFrame, mean: np.ndarray, axes: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """``df`` with its vectors centred and projected on ``axes``."""
    at, rest = df.columns.index(embedding), [c for c in df.columns if c != embedding]
    schema = df.select(*rest).schema.add(embedding, T.ArrayType(T.DoubleType()))

    def turn(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                y = (as_matrix(batch.column(at)) - mean) @ axes.T
                yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at] + [pa.array(list(y))], names=[*rest, embedding])

    return df.where(F.col(embedding).isNotNull()).mapInArrow(turn, schema)


def kmeans_coreset(df: DataFrame, share: float, dims: int = 50, id_col: str = "vec_id", embedding: str = "embedding", train_rows: int = 8_192, cells: int = 16, rows: int = SLICE_ROWS, seed: int = 42) -> DataFrame:
    """The actual rows nearest to about share * n centroids, in at most ``dims`` principal dimensions.

    ``cells`` centroids of a bounded sample part the rows coarsely; a cell is cut into
    slices of about ``rows`` rows by a hash of the id, and each slice has k-means of its own
    for its share of the centroids. So a task holds one slice, whatever the size.
    """
    mean, axes, _ = principal_axes(df, embedding)
    reduced = project(df.select(id_col, embedding), mean, axes[:dims], embedding)
    cells = max(1, min(cells, int(share * df.count()) // 4))
    centres = kmeans(sample_matrix(reduced, embedding, train_rows, seed), cells, seed=seed)
    own = assign_lists(reduced, centres, 1, embedding)
    slices = own.groupBy("list_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("__n"))
    # a row a cell: at most ``cells``
    keyed = own.join(F.broadcast(slices), "list_id").withColumn("__slice", F.pmod(F.xxhash64(id_col), F.col("__n")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        x = np.stack(pdf[embedding].to_numpy()).astype(float)
        found = kmeans(x, max(1, int(share * len(x))), seed=seed)
        return pdf.iloc[np.unique(squared_distances(x, found).argmin(0))][[id_col]]

    chosen = keyed.groupBy("list_id", "__slice").applyInPandas(choose, df.select(id_col).schema)
    return df.join(chosen.distinct(), id_col, "left_semi")


def bank_statistics(df: DataFrame, embedding: str = "embedding", ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and inverse of the covariance with a small ridge."""
    mean, axes, variances = principal_axes(df, embedding)
    n = df.where(F.col(embedding).isNotNull()).count()
    covariance = axes.T @ np.diag(variances * n / max(1, n - 1)) @ axes
    return mean, np.linalg.inv(covariance + ridge * np.eye(len(mean)))


def explained_variance(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``component`` (from 1), its ``share`` of the variance and the running ``cumulative`` share."""
    _, _, variances = principal_axes(df, embedding)
    share = variances / variances.sum()
    rows = [(k + 1, float(s), float(c)) for k, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def components_for(df: DataFrame, share: float, embedding: str = "embedding") -> int:
    """The fewest components that explain ``share`` of the variance."""
    _, _, variances = principal_axes(df, embedding)
    return int(np.searchsorted(np.cumsum(variances / variances.sum()), share) + 1)


def column_means(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Mean and population deviation of each dimension."""
    return df.select(F.posexplode(doubles(F.col(embedding))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that is last in ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
