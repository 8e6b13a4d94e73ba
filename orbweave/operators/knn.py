"""Exact nearest neighbours, and the clustering and product codes that indexes are made of.

Exact search sends the queries, in blocks of a bounded size, to the base vectors;
each task keeps the best of its rows for each query, and the best of those are
merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that are sent to the executors at once.
BLOCK = 4_096
#: Partial results of a query are merged in so many groups first.
FAN = 64
#: Rows that are compared with a block at once.
SLICE = 1_024
#: Bytes of the vectors, as doubles, of a tile of a group that is searched for itself.
TILE_BYTES = 1 << 24


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls, all of one width, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between rows of ``a`` and of ``b``, not below 0."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def exact_knn(
    queries: DataFrame, base: DataFrame, k: int = 1, id_col: str = "vec_id", embedding: str = "embedding", group: str | None = None, exclude: str | None = None, block: int = BLOCK
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``neighbour_id`` and ``d2``; ties go to the smaller id.

    ``exclude``: ``"id"`` leaves out the query itself, ``"group"`` all rows of its
    ``group``. With a group column of queries and base given, ``exclude=None``
    searches within the group only. Null vectors take no part.
    """
    side = lambda df: df.where(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col(embedding).alias("v"))
    q, b = side(queries), side(base)
    n_blocks = max(1, -(-q.count() // block))
    parts = []
    for at in range(n_blocks):
        own = q if n_blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == at)
        rows = own.toArrow()  # about ``block`` rows
        if len(rows):
            parts.append(_block_knn(rows, b, k, bool(group), exclude))
    found = reduce(DataFrame.unionByName, parts) if parts else q.sparkSession.createDataFrame([], "query_id long, neighbour_id long, d2 double, part int")
    return merged(found, k)


def self_nearest(df: DataFrame, group: str, id_col: str = "vec_id", embedding: str = "embedding", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``group``, ``id_col`` and ``d2``, the least squared distance to another row of the group; rows without one are left out.

    A group is cut into tiles of ``tile_bytes`` of doubles by a hash of the id. Each
    unordered pair of tiles meets once, in a task of its own that serves both; so no group,
    however hot, is gathered. A vector is sent once for each tile of its group (32,768
    vectors of 64 components make one); the work grows with the square of a group, as an
    exact search must.
    """
    known = df.where(F.col(embedding).isNotNull() & F.col(group).isNotNull()).select(group, id_col, embedding)
    sizes = known.groupBy(group).agg(F.ceil(F.count("*") * F.max(F.size(embedding)) * 8 / tile_bytes).cast("int").alias("__n"))
    keyed = known.join(sizes, group).withColumn("__own", F.pmod(F.xxhash64(id_col), F.col("__n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__other")
    sides = keyed.select(group, "__own", other, id_col, embedding)
    placed = sides.select(group, F.least("__own", "__other").alias("__a"), F.greatest("__own", "__other").alias("__b"), (F.col("__own") > F.col("__other")).alias("__second"), id_col, embedding)

    def search(table: pa.Table) -> pa.Table:
        second = table["__second"].to_numpy()
        ids, x = table[id_col].to_numpy(), as_matrix(table[embedding])
        best = np.full(len(ids), np.inf)
        one = np.flatnonzero(~second)
        two = np.flatnonzero(second) if table["__a"][0] != table["__b"][0] else one
        for i in range(0, len(one), SLICE):
            rows = one[i : i + SLICE]
            for j in range(0 if two is not one else i, len(two), SLICE):  # a tile with itself: each pair once
                columns = two[j : j + SLICE]
                d = squared_distances(x[rows], x[columns])
                d[ids[rows][:, None] == ids[columns][None, :]] = np.inf
                best[rows] = np.minimum(best[rows], d.min(1))
                best[columns] = np.minimum(best[columns], d.min(0))
        there = pa.array(np.isfinite(best))
        return pa.table({group: table[group].filter(there), id_col: table[id_col].filter(there), "d2": pa.array(best).filter(there)})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (group, id_col))
    found = placed.groupBy(group, "__a", "__b").applyInArrow(search, f"{kinds}, d2 double")
    return found.groupBy(group, id_col).agg(F.min("d2").alias("d2"))


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of the tasks' results for each query, with their ``rank``."""
    best = lambda df, *keys: df.groupBy("query_id", *keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "neighbour_id"))), 1, k).alias("best"))
    some = best(found.withColumn("fan", F.col("part") % FAN), "fan").select("query_id", F.inline("best"))
    return best(some).select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.neighbour_id").alias("neighbour_id"), F.col("b.d2").alias("d2")
    )


class Best:
    """The ``k`` nearest rows of each query so far, by distance and then by id.

    Rows come in slices, of which only those that may still be among the best are sorted;
    so beside the matrix of a slice's distances it holds little more than its result.
    """

    def __init__(self, n: int, k: int):
        self.d, self.ids = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)

    def add(self, ids: np.ndarray, d: np.ndarray, rows: np.ndarray | None = None) -> None:
        """``d``: distances of the queries (those numbered ``rows``, or all) to the rows named ``ids``."""
        k, n = self.d.shape[1], len(d)
        rows = np.arange(len(self.d)) if rows is None else rows
        near = d <= self.d[rows, -1:]
        if near.sum() > 4 * k * n:  # as long as little is known
            near &= d <= np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, [min(k, d.shape[1]) - 1]]
        q, c = np.nonzero(near)
        finite = np.isfinite(d[q, c])
        q, c = q[finite], c[finite]
        if not len(q):
            return
        of = np.concatenate([np.repeat(np.arange(n), k), q])
        all_d, all_ids = np.concatenate([self.d[rows].ravel(), d[q, c]]), np.concatenate([self.ids[rows].ravel(), ids[c]])
        order = np.lexsort((all_ids, all_d, of))
        starts = np.searchsorted(of[order], np.arange(n))
        picked = order[starts[:, None] + np.arange(k)[None, :]]  # each query has at least the k it had
        self.d[rows], self.ids[rows] = all_d[picked], all_ids[picked]

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        there = np.isfinite(self.d)
        part = np.full(int(there.sum()), TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, there.sum(1))), pa.array(self.ids[there]), pa.array(self.d[there]), pa.array(part)], names=["query_id", "neighbour_id", "d2", "part"])


def _block_knn(rows: pa.Table, base: DataFrame, k: int, grouped: bool, exclude: str | None) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), np.array(rows["g"].to_pylist(), object), as_matrix(rows["v"])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, vectors = shared.value
        best = Best(len(ids), k)
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                own, d = batch.column(0).to_numpy(), squared_distances(vectors, as_matrix(batch.column(2)))
                if exclude == "id":
                    d[ids[:, None] == own[None, :]] = np.inf
                elif grouped:
                    same = groups[:, None] == np.array(batch.column(1).to_pylist(), object)[None, :]
                    d[same if exclude == "group" else ~same] = np.inf
                best.add(own, d)
        yield best.batch(ids)

    return base.mapInArrow(search, "query_id long, neighbour_id long, d2 double, part int")


def sample_matrix(df: DataFrame, embedding: str, rows: int, seed: int = 42) -> np.ndarray:
    """At most ``rows`` vectors, those with the least hashes: a bounded sample for training."""
    picked = df.where(F.col(embedding).isNotNull()).select(F.xxhash64(F.col(embedding), F.lit(seed)).alias("h"), F.col(embedding).alias("v")).orderBy("h", "v").limit(rows)
    return as_matrix(picked.select("v").toArrow()["v"])


def kmeans(x: np.ndarray, k: int, steps: int = 20, seed: int = 42) -> np.ndarray:
    """Centroids of a bounded sample, by Lloyd's steps from k-means++ seeds."""
    if not len(x):
        raise ValueError("no vectors to train on")
    k, rng = min(k, len(x)), np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    d = squared_distances(x, centres)[:, 0]
    while len(centres) < k:
        total = d.sum()
        at = rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[at]])
        d = np.minimum(d, squared_distances(x, x[[at]])[:, 0])
    for _ in range(steps):
        own = squared_distances(x, centres).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def assign_lists(df: DataFrame, centres: np.ndarray, n_lists: int = 1, embedding: str = "embedding") -> DataFrame:
    """``df``, each row once for each of its ``n_lists`` nearest centroids, with ``list_id``."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*df.schema.fields, T.StructField("list_id", T.IntegerType())])
    at = df.columns.index(embedding)
    n = min(n_lists, len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared_distances(as_matrix(batch.column(at)), shared.value) if len(batch) else np.zeros((0, len(shared.value)))
            lists = np.argsort(d, axis=1, kind="stable")[:, :n]
            row = pa.array(np.repeat(np.arange(len(batch)), n))
            yield pa.RecordBatch.from_arrays([*[c.take(row) for c in batch.columns], pa.array(lists.ravel().astype(np.int32))], names=schema.fieldNames())

    return df.where(F.col(embedding).isNotNull()).mapInArrow(assign, schema)


class ProductQuantiser:
    """Codebooks for ``m`` parts of a vector, ``2**bits`` codes each."""

    def __init__(self, sample: np.ndarray, m: int, bits: int, seed: int = 42):
        if sample.shape[1] % m:
            raise ValueError(f"width {sample.shape[1]} cannot be cut into {m} equal parts")
        if 2**bits > len(sample):
            raise ValueError(f"{2**bits} codes need as many training vectors, not {len(sample)}")
        self.m, self.bits = m, bits
        self.books = [kmeans(part, 2**bits, seed=seed) for part in np.split(sample, m, axis=1)]

    @classmethod
    def of(cls, books: list[np.ndarray], bits: int) -> ProductQuantiser:
        """The quantiser with these codebooks."""
        made = cls.__new__(cls)
        made.m, made.bits, made.books = len(books), bits, books
        return made

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([squared_distances(p, b).argmin(1) for p, b in zip(np.split(x, self.m, axis=1), self.books, strict=True)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([b[codes[:, k]] for k, b in enumerate(self.books)])


def reconstruct(df: DataFrame, quantiser: ProductQuantiser, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id_col``, ``codes`` and the vectors that the codes stand for (``decoded``), with their squared error."""
    shared = df.sparkSession.sparkContext.broadcast(quantiser)
    rows = df.where(F.col(embedding).isNotNull()).select(id_col, embedding)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = as_matrix(batch.column(1))
                codes = shared.value.encode(x)
                back = shared.value.decode(codes)
                error = ((x - back) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes.astype(np.int32))), pa.array(list(back)), pa.array(error)], names=[id_col, "codes", "decoded", "error2"])

    return rows.mapInArrow(code, f"{id_col} {df.schema[id_col].dataType.simpleString()}, codes array<int>, decoded array<double>, error2 double")
