"""Exact ranking metrics of pixels, whose number is that of the images times their size.

A task turns its images into scores and labels of pixels, counts those with equal scores, and
sends on packed arrays cut by ranges of the score: no row stands for a pixel. A range is
sorted by one task; what lies below it is added from a table with a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators.grids import blur_matrix, upsample_matrix

#: Cells of the score between its least and largest value in which pixels are counted first, and pixels of a range.
CELLS = 4_096
RANGE_PIXELS = 1 << 21
#: Pixels that a task gathers before it sends them on.
GATHERED = 1 << 20

#: From the columns of a batch (values of maps, labels of cells) to scores and labels of pixels, a row an image.
ToPixels = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def upsampled(side: int, size: int, sigma: float | None = None, radius: int = 16, digits: int = 9) -> ToPixels:
    """Square maps of ``side`` resampled to ``size`` (bicubic) and blurred; labels of cells become those of the pixels they cover."""
    matrix = upsample_matrix(side, size)
    if sigma is not None:
        matrix = blur_matrix(size, sigma, radius) @ matrix
    cell = np.arange(size) * side // size

    def pixels(values: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maps, flags = values.reshape(-1, side, side), labels.reshape(-1, side, side)
        return np.round(matrix @ maps @ matrix.T, digits).reshape(len(maps), -1), flags[:, cell][:, :, cell].reshape(len(maps), -1)

    return pixels


def _counted(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores with their positives and negatives."""
    values, at = np.unique(scores, return_inverse=True)
    pos = np.bincount(at, labels, len(values))
    return values, pos.astype(np.int64), np.bincount(at, minlength=len(values)).astype(np.int64) - pos.astype(np.int64)


def pixel_auroc(maps: DataFrame, groups: tuple[str, ...], values: str, labels: str, to_pixels: ToPixels, range_pixels: int = RANGE_PIXELS) -> DataFrame:
    """Per group: ``n_pos``, ``n_neg`` and ``pixel_auroc`` over all pixels of all maps, ties counting half; null with one class only.

    ``values`` and ``labels`` are arrays of one size a map, labels 0 or 1. Maps in which either is null take
    no part, nor do pixels whose score is not finite.
    """
    keys = [f"__g{k}" for k in range(len(groups))]
    known = maps.where(F.col(values).isNotNull() & F.col(labels).isNotNull())
    rows = known.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(values).cast("array<double>").alias("v"), F.col(labels).cast("array<double>").alias("y"))
    kinds = [rows.schema[k] for k in keys]
    n = len(keys)

    def pixels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """A group's pixels of some maps."""
        for batch in batches:
            of = list(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True)) if n else [()] * len(batch)
            x = [batch.column(n + k).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for k in (0, 1)] if len(batch) else None
            for key in dict.fromkeys(of):
                mine = [k for k, other in enumerate(of) if other == key]
                for at in range(0, len(mine), 64):
                    scores, flags = (a.ravel() for a in to_pixels(x[0][mine[at : at + 64]], x[1][mine[at : at + 64]]))
                    fine = np.isfinite(scores)
                    yield key, scores[fine], flags[fine]

    ends_type = T.StructType([*kinds, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[float, float]] = {}
        for key, scores, _ in pixels_of(batches):
            if len(scores):
                low, high = found.get(key, (np.inf, -np.inf))
                found[key] = (min(low, float(scores.min())), max(high, float(scores.max())))
        yield _batch(ends_type, [(*k, *v) for k, v in found.items()])

    low, high = rows.mapInArrow(ends, ends_type).agg(F.min("low"), F.max("high")).first()
    if low is None:
        return maps.limit(0).select(*groups, F.lit(0).cast("long").alias("n_pos"), F.lit(0).cast("long").alias("n_neg"), F.lit(0.0).alias("pixel_auroc"))
    width = (high - low) / CELLS or 1.0
    cell_of = lambda scores: np.minimum(((scores - low) / width).astype(np.int64), CELLS - 1)
    cell_type = T.StructType([*kinds, T.StructField("cell", T.LongType()), T.StructField("c", T.LongType())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for key, scores, _ in pixels_of(batches):
            found[key] = found.get(key, 0) + np.bincount(cell_of(scores), minlength=CELLS)
        for key, counts in found.items():
            there = np.flatnonzero(counts)
            yield _batch(cell_type, [(*key, int(k), int(counts[k])) for k in there])

    # how the ranges lie is one table for all groups: a number for each cell
    counts = np.zeros(CELLS, np.int64)
    for r in rows.mapInArrow(cells, cell_type).groupBy("cell").agg(F.sum("c").alias("c")).collect():
        counts[r.cell] = r.c
    range_of = (np.cumsum(counts) - counts) // range_pixels
    part_type = T.StructType([*kinds, T.StructField("range", T.LongType()), *[T.StructField(k, T.BinaryType()) for k in ("scores", "pos", "neg")]])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent(key: tuple) -> pa.RecordBatch:
            scores, pos, neg = _counted(np.concatenate([s for s, _ in held[key]]), np.concatenate([y for _, y in held[key]]))
            held[key] = []
            where = range_of[cell_of(scores)]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            out = [(*key, int(where[a]), scores[a:b].tobytes(), pos[a:b].tobytes(), neg[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(scores)], strict=True)]
            return _batch(part_type, out)

        for key, scores, flags in pixels_of(batches):
            held.setdefault(key, []).append((scores, flags))
            if sum(len(s) for s, _ in held[key]) >= GATHERED:
                yield sent(key)
        for key in held:
            if held[key] and sum(len(s) for s, _ in held[key]):
                yield sent(key)

    sums_type = T.StructType([*kinds, *[T.StructField(k, T.LongType()) for k in ("range", "pos", "neg", "wins2")]])

    def ranked(table: pa.Table) -> pa.Table:
        scores, pos, neg = (np.frombuffer(b"".join(table[k].to_pylist()), t) for k, t in (("scores", np.float64), ("pos", np.int64), ("neg", np.int64)))
        _, at = np.unique(scores, return_inverse=True)
        p, q = (np.bincount(at, w).astype(np.int64) for w in (pos, neg))
        below = np.cumsum(q) - q
        wins2 = int((p * (2 * below + q)).sum())
        return _table(sums_type, [(*[table[k][0].as_py() for k in keys], table["range"][0].as_py(), int(p.sum()), int(q.sum()), wins2)])

    sums = rows.mapInArrow(packed, part_type).groupBy(*keys, "range").applyInArrow(ranked, sums_type)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    whole = sums.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    wins = F.sum(F.col("pos").cast("double") * F.col("below") + F.col("wins2") / 2.0)
    out = whole.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins"))
    area = F.col("wins") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], "n_pos", "n_neg", area.alias("pixel_auroc"))


def _table(types: T.StructType, rows: list[tuple]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(types)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _batch(types: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    table = _table(types, rows)
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], schema=table.schema)
