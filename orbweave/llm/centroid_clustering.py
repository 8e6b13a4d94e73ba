"""Lloyd's clustering on distinct quantised vectors, each weighted by its multiplicity.

Components become integers, so equal vectors are found by grouping, and all sums and
distances are exact whatever the order in which tasks are added up. Each round reads
the distinct vectors only; a task returns one sum and one count for each centroid and
component. The assignments of the distinct vectors are joined back to the rows, where
a vector that very many rows share does not move them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import discard, materialise, meet

#: Components, their steps in a unit, centroids and rounds.
WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Largest sum of squares whose parts are all whole numbers in doubles.
EXACT = 1 << 53


def largest(width: int = WIDTH) -> int:
    """Components below this in magnitude, so that squared distances fit a long."""
    return min(isqrt((1 << 61) // width), (1 << 31) - 1)


def quantise(df: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """The id, ``q`` (array of int, floor(scale * x) of each component) and its hash ``h``.

    Kept are vectors of ``width`` components of which none is null or not finite. A
    component of ``largest(width)`` or more, whose distances no long could hold, counts
    as not finite. Repeated rows and null ids are kept.
    """
    v = F.col("__v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale >= largest(width)))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(embedding).alias("__v")).where(v.isNotNull() & (F.size(v) == width) & ~odd)
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.select("vec_id", q.alias("q")).select("vec_id", "q", F.xxhash64("q").alias("h"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and the squared distance, exact in longs."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if x.shape[1] * reach * reach < EXACT:  # all parts are whole numbers that doubles hold
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)
        own = d.argmin(1)
        return own, d[np.arange(len(x)), own].astype(np.int64)
    owns, least = [], []
    for at in range(0, len(x), 512):  # bounds the memory of the differences
        d = ((x[at : at + 512, None, :] - centroids[None]) ** 2).sum(2)
        owns.append(d.argmin(1))
        least.append(d.min(1))
    return np.concatenate(owns), np.concatenate(least)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed:id``; null ids come last, ties in the order of the vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r.q for r in rows.orderBy(order, "q").limit(k).select("q").collect()], np.int64)  # k rows


def _sums(distinct: DataFrame, centroids: np.ndarray, total: int) -> tuple[list[int], list[list[int]]]:
    """For each centroid the number of rows nearest to it and their exact componentwise sums."""
    k, width = centroids.shape
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)
    kind = np.int64 if total * largest(width) < 1 << 62 else object  # beyond longs Python's integers add up

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), kind), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                x, n = _matrix(batch.column(0), width), batch.column(1).to_numpy()
                own, _ = nearest(x, shared.value)
                order = own.argsort(kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
                there = own[order][starts]
                weighted = x.astype(kind) * n.astype(kind)[:, None]
                sums[there] += np.add.reduceat(weighted[order], starts, axis=0)
                counts[there] += np.add.reduceat(n[order], starts)
        there = np.flatnonzero(counts)
        whole = np.column_stack([counts[there].astype(object), sums[there].astype(object)]) if len(there) else np.zeros((0, width + 1), object)
        values = [pa.array([int(v) for v in whole.ravel()], pa.decimal128(38, 0))]
        places = pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(there)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, width + 1).astype(np.int32)), places, *values], names=["cluster", "place", "part"])

    parts = distinct.select("q", "n").mapInArrow(add, "cluster int, place int, part decimal(38,0)")
    counts, sums = [0] * k, [[0] * width for _ in range(k)]
    for r in parts.groupBy("cluster", "place").agg(F.sum("part").alias("whole")).collect():  # k * (width + 1) numbers
        if r.place:
            sums[r.cluster][r.place - 1] = int(r.whole)
        else:
            counts[r.cluster] = int(r.whole)
    return counts, sums


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own, d = nearest(_matrix(batch.column(0), centroids.shape[1]), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d)], names=["q", "h", "n", "cluster", "distance"])

    return distinct.select("q", "h", "n").mapInArrow(assign, "q array<int>, h long, n long, cluster int, distance long")


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of each kept vector; and of each
    centroid ``cluster``, its ``centroid`` (array of long), ``n`` and ``inertia``, the sum
    of its vectors' distances (null beyond a long).

    Kept are the rows of ``quantise``. The first centroids are those of ``first_centroids``;
    each of ``rounds`` rounds assigns all vectors and moves each centroid that has any to
    the floor of their mean. With fewer than ``k`` vectors there are as many centroids as
    vectors; without any both tables are empty. Further columns are left out.
    """
    spark = df.sparkSession
    rows = quantise(df, id_col, embedding, width, scale)
    centroids = first_centroids(rows, k, seed)
    about = "cluster int, centroid array<bigint>, n bigint, inertia bigint"
    if not len(centroids):
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), spark.createDataFrame([], about)
    distinct = materialise(rows.groupBy("q", "h").agg(F.count("*").alias("n")), "distinct-vectors")
    total = distinct.agg(F.sum("n")).first()[0]
    for _ in range(rounds):
        counts, sums = _sums(distinct, centroids, total)
        centroids = np.array([[s // n for s in part] if n else old.tolist() for n, part, old in zip(counts, sums, centroids, strict=True)], np.int64)
    assigned = materialise(_assigned(distinct, centroids), "assigned-vectors")
    discard(distinct)
    weighed = F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    sizes = {r.cluster: (r.n, int(r.inertia)) for r in assigned.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(weighed).alias("inertia")).collect()}  # k rows
    facts = [(c, centroids[c].tolist(), *sizes.get(c, (0, 0))) for c in range(len(centroids))]
    facts = [(c, v, n, inertia if inertia < 1 << 63 else None) for c, v, n, inertia in facts]
    found = meet(rows, assigned, ["h", "q"], "n", total)
    return found.select("vec_id", "cluster", "distance"), spark.createDataFrame(facts, about)


def digest(found: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row a vector, with its cluster's inertia, that of all, and the hash of its centroid."""
    all_inertia = centroids.agg(F.sum(F.col("inertia").cast("decimal(38,0)")).try_cast("bigint")).first()[0]
    named = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    few = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), named.alias("centroid_sha256"))
    # one row a centroid
    out = found.join(F.broadcast(few), "cluster").withColumn("inertia", F.lit(all_inertia).cast("long"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
