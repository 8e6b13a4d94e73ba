"""Vector indexes that are kept: inverted lists of vectors (IVF) or of product codes (IVF-PQ).

An index is a folder: ``rows``, a Parquet table in a folder for each list, with the id, the
code of a vector's residual to its list's centroid (bytes; none without codes) and the
vector; ``centroids``; ``books`` of the codes; and ``facts``. It is built once. A search
reads the folders of the lists that its queries probe and no others; codes are compared by
tables of partial distances, one for each query, list and part, so nothing is decoded.
Vectors are read only for the lists and candidates that are ranked by them.

How many lists and candidates a query needs for the wanted recall is measured when the
index is built, and kept with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators.knn import BLOCK, SLICE, Best, ProductQuantiser, as_matrix, exact_knn, kmeans, merged, sample_matrix, squared_distances

#: Rows from which centroids and codes are learned: the vectors with the least hashes.
TRAIN_ROWS = 8_192
#: Recall at ``TUNED_K`` that an index must reach on ``TRIALS`` of its own vectors, each left out of its own result.
RECALL = 0.95
TRIALS = 256
TUNED_K = 5
#: Partial distances (query, list, part, code) that a task holds at once, and candidates of a block of queries.
TABLE_CELLS = 1 << 21
BLOCK_CANDIDATES = 1 << 18
#: Queries that are sent to the executors at once, and of those that are compared with a slice of rows at once.
MOST_QUERIES = 1 << 14


@dataclass(frozen=True)
class VectorIndex:
    """An index and what its searches need to know: small tables, whatever the number of rows."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    quantiser: ProductQuantiser | None
    n_rows: int
    n_probe: int
    width: int

    @property
    def rows(self) -> DataFrame:
        vector = "array<double>"
        return self.spark.read.schema(f"id long, code binary, v {vector}, list_id int").parquet(f"{self.path}/rows")


def build_index(
    base: DataFrame, path: str, n_lists: int = 16, m: int | None = None, bits: int = 4, n_probe: int = 1, recall: float | None = RECALL, id_col: str = "vec_id", embedding: str = "embedding", train_rows: int = TRAIN_ROWS, seed: int = 42
) -> VectorIndex:
    """Write an index of ``base`` below ``path`` and open it; with ``m`` parts of codes, else of vectors.

    ``n_probe`` lists are probed, or more if ``recall`` (None: not measured) needs them.
    One list makes a flat index of codes. Null vectors are left out; all others are indexed.
    """
    spark = base.sparkSession
    known = base.where(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    sample = sample_matrix(known, "v", train_rows, seed)
    centres = kmeans(sample, n_lists, seed=seed)
    quantiser = None
    if m is not None:
        if bits > 8:
            raise ValueError(f"a code of {bits} bits does not fit a byte")
        quantiser = ProductQuantiser(sample - centres[squared_distances(sample, centres).argmin(1)], m, bits, seed)
    shared = spark.sparkContext.broadcast((centres, quantiser))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("list_id", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                centres, quantiser = shared.value
                x = as_matrix(batch.column(1))
                own = squared_distances(x, centres).argmin(1)
                codes = pa.nulls(len(x), pa.binary()) if quantiser is None else _as_binary(quantiser.encode(x - centres[own]).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column(0), codes, batch.column(1), pa.array(own.astype(np.int32))], names=schema.names)

    # a list's rows meet, in files of a bounded size: a large list gets several
    placed = known.mapInArrow(place, schema).hint("rebalance", "list_id")
    placed.write.partitionBy("list_id").mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    rows = [(k, c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    books = [(k, c, v.tolist()) for k, book in enumerate(quantiser.books) for c, v in enumerate(book)] if quantiser else []
    spark.createDataFrame(books, "part int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    made = VectorIndex(spark, path, centres, quantiser, 0, min(n_probe, len(centres)), TUNED_K)
    n = made.rows.count()
    made = VectorIndex(spark, path, centres, quantiser, n, *(_effort(made, recall) if recall and n else (made.n_probe, made.width)))
    facts = [(made.n_rows, made.n_probe, made.width, m, bits if m else None)]
    spark.createDataFrame(facts, "n_rows long, n_probe int, width int, m int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return made


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` wrote whole; its facts come last, so they are there only then."""
    facts = spark.read.parquet(f"{path}/facts").first()
    centres = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()])
    quantiser = None
    if facts.m is not None:
        books: list[list] = [[] for _ in range(facts.m)]
        for r in spark.read.parquet(f"{path}/books").orderBy("part", "code").collect():
            books[r.part].append(r.centroid)
        quantiser = ProductQuantiser.of([np.array(b) for b in books], facts.bits)
    return VectorIndex(spark, path, centres, quantiser, facts.n_rows, facts.n_probe, facts.width)


def _as_binary(codes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())


def _codes(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, m)


def partial_distances(vectors: np.ndarray, centre: np.ndarray, quantiser: ProductQuantiser) -> np.ndarray:
    """For each part, code and query the squared distance of the query's residual to the code's centroid."""
    return np.stack([squared_distances(book, q) for q, book in zip(np.split(vectors - centre, quantiser.m, axis=1), quantiser.books, strict=True)]).astype(np.float32)


def coded_distances(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of coded rows to queries: for each part a row of its table."""
    out = tables[0][codes[:, 0]]
    one = np.empty_like(out)
    for k in range(1, codes.shape[1]):
        np.take(tables[k], codes[:, k], axis=0, out=one, mode="clip")
        out += one
    return out


def _nearest_lists(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Which lists each query probes, as flags."""
    probed = np.zeros((len(vectors), len(centres)), bool)
    np.put_along_axis(probed, squared_distances(vectors, centres).argsort(1, kind="stable")[:, :n], True, 1)
    return probed


def _scan(index: VectorIndex, ids: np.ndarray, vectors: np.ndarray, probed: np.ndarray, width: int) -> DataFrame:
    """The best ``width`` rows for each query in each task, of the lists it probes: by codes if the index has them."""
    shared = index.spark.sparkContext.broadcast((ids, vectors, probed, index.centres, index.quantiser))
    lists = np.flatnonzero(probed.any(0)).tolist()
    coded = index.quantiser is not None
    rows = index.rows.where(F.col("list_id").isin(lists)).select("id", "list_id", "code" if coded else "v")  # folders of other lists are not read

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, probed, centres, quantiser = shared.value
        best = Best(len(ids), width)
        known: tuple[int, list] = (-1, [])  # the tables of the list that was met last: a file has one list
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                names, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for one in np.unique(own).tolist():
                    there, asking = np.flatnonzero(own == one), np.flatnonzero(probed[:, one])
                    if not len(asking):
                        continue
                    if quantiser is None:
                        x = as_matrix(batch.column(2).take(pa.array(there)))
                        for k in range(0, len(asking), BLOCK):
                            best.add(names[there], squared_distances(vectors[asking[k : k + BLOCK]], x), asking[k : k + BLOCK])
                        continue
                    codes = _codes(batch.column(2).take(pa.array(there)), quantiser.m)
                    some = max(1, TABLE_CELLS // (quantiser.m * len(quantiser.books[0])))
                    if known[0] != one:
                        known = (one, [partial_distances(vectors[asking], centres[one], quantiser)] if len(asking) <= some else [])
                    for k in range(0, len(asking), some):
                        tables = known[1][0] if known[1] else partial_distances(vectors[asking[k : k + some]], centres[one], quantiser)
                        best.add(names[there], coded_distances(tables, codes).T, asking[k : k + some])
        yield best.batch(ids)

    return rows.mapInArrow(search, "query_id long, neighbour_id long, d2 double, part int")


def search_index(queries: DataFrame, index: VectorIndex, k: int = 1, n_probe: int | None = None, width: int | None = None, id_col: str = "vec_id", embedding: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``neighbour_id`` and ``d2`` of the best ``k`` rows in the lists nearest to each query.

    Lists and candidates are those that the index was tuned to, or as stated. Candidates by
    codes are ranked by their vectors; ties go to the smaller id. Queries go to the rows in
    blocks that hold at most ``BLOCK_CANDIDATES`` candidates. Null vectors ask nothing.
    """
    extra = int(exclude_self)
    n_probe = min(n_probe or index.n_probe, len(index.centres))
    wide = k + extra if index.quantiser is None else max(k + extra, (width or index.width) * -(-k // TUNED_K))
    q = queries.where(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    block = max(1, min(MOST_QUERIES, BLOCK_CANDIDATES // wide))
    n_blocks = max(1, -(-q.count() // block))
    parts = []
    for at in range(n_blocks):
        asked = (q if n_blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == at)).toArrow()  # about ``block`` rows
        if len(asked):
            ids, vectors = asked["id"].to_numpy(), as_matrix(asked["v"])
            probed = _nearest_lists(vectors, index.centres, n_probe)
            found = _scan(index, ids, vectors, probed, wide)
            parts.append(found if index.quantiser is None else _ranked_by_vectors(index, found, asked, probed, wide))
    empty = "query_id long, neighbour_id long, d2 double, part int"
    found = reduce(DataFrame.unionByName, parts) if parts else index.spark.createDataFrame([], empty)
    if exclude_self:
        found = found.where("query_id <> neighbour_id")
    return merged(found, k)


def _ranked_by_vectors(index: VectorIndex, found: DataFrame, asked: pa.Table, probed: np.ndarray, width: int) -> DataFrame:
    """The candidates with their true distances."""
    candidates = merged(found, width).select("query_id", F.col("neighbour_id").alias("id"))
    lists = np.flatnonzero(probed.any(0)).tolist()
    # at most BLOCK_CANDIDATES pairs of numbers, and the queries of the block
    there = index.rows.where(F.col("list_id").isin(lists)).select("id", "v").join(F.broadcast(candidates), "id")
    shared = index.spark.sparkContext.broadcast((asked["id"].to_numpy(), as_matrix(asked["v"])))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        order = ids.argsort()
        for batch in batches:
            if len(batch):
                q = vectors[order[np.searchsorted(ids[order], batch.column(0).to_numpy())]]
                d = ((q - as_matrix(batch.column(2))) ** 2).sum(1)
                part = np.full(len(d), TaskContext.get().partitionId(), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d), pa.array(part)], names=["query_id", "neighbour_id", "d2", "part"])

    return there.select("query_id", "id", "v").mapInArrow(rank, "query_id long, neighbour_id long, d2 double, part int")


def _least(ranks: np.ndarray, share: float) -> int:
    """The least rank that at least ``share`` of the ranks do not exceed."""
    return int(np.sort(ranks)[int(np.ceil(share * len(ranks))) - 1])


def _effort(index: VectorIndex, recall: float) -> tuple[int, int]:
    """The lists and candidates with which the true neighbours of ``TRIALS`` of the index's vectors are found.

    A neighbour is missed if its list is not probed, or if too many rows of the probed
    lists are nearer by their codes; with codes each may miss half.
    """
    trials = index.rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(TRIALS)
    rows = trials.toArrow()
    asked = index.spark.createDataFrame(rows)
    true = exact_knn(asked, index.rows, TUNED_K, "id", "v", exclude="id").select("query_id", F.col("neighbour_id").alias("id"))
    met = index.rows.join(F.broadcast(true), "id").select("query_id", "id", "list_id", "code").toArrow()  # TRIALS * TUNED_K rows
    if not len(met):
        return index.n_probe, index.width
    place = {i: n for n, i in enumerate(rows["id"].to_pylist())}
    vectors, ids = as_matrix(rows["v"]), rows["id"].to_numpy()
    at, own = np.array([place[i] for i in met["query_id"].to_pylist()]), met["list_id"].to_numpy()
    ranks = squared_distances(vectors, index.centres).argsort(1, kind="stable").argsort(1)
    share = recall if index.quantiser is None else (1 + recall) / 2
    n_probe = max(index.n_probe, _least(ranks[at, own] + 1, share))
    if index.quantiser is None:
        return n_probe, index.width
    codes = _codes(met["code"].combine_chunks(), index.quantiser.m)
    far = np.array([coded_distances(partial_distances(vectors[[a]], index.centres[o], index.quantiser), codes[[n]])[0, 0] for n, (a, o) in enumerate(zip(at, own, strict=True))])
    probed = _nearest_lists(vectors, index.centres, n_probe)
    shared = index.spark.sparkContext.broadcast((ids, vectors, probed, at, far, index.centres, index.quantiser))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, probed, at, far, centres, quantiser = shared.value
        before = np.zeros(len(at), np.int64)
        for whole in batches:
            for k in range(0, len(whole), SLICE):
                batch = whole.slice(k, SLICE)
                mine = batch.column(1).to_numpy()
                for one in np.unique(mine).tolist():
                    there = np.flatnonzero(mine == one)
                    asking = np.flatnonzero(probed[:, one])
                    if len(asking):
                        d = coded_distances(partial_distances(vectors[asking], centres[one], quantiser), _codes(batch.column(2).take(pa.array(there)), quantiser.m)).T
                        spot = np.full(len(ids), -1)
                        spot[asking] = np.arange(len(asking))
                        some = np.flatnonzero(spot[at] >= 0)
                        before[some] += (d[spot[at[some]]] <= far[some][:, None] * (1 + 1e-6)).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(before)], names=["n", "before"])

    lists = np.flatnonzero(probed.any(0)).tolist()
    scanned = index.rows.where(F.col("list_id").isin(lists)).select("id", "list_id", "code")
    needed = scanned.mapInArrow(count, "n long, before long").groupBy("n").agg(F.sum("before").alias("rank")).toArrow()["rank"].to_numpy()
    return n_probe, max(TUNED_K, _least(needed, share))
