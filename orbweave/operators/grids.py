"""Grids of patches or pixels: symmetries, smoothing, regions and region overlap.

A grid is one row with an array of ``height * width`` values in row order. Symmetries
are index arithmetic in Spark; resampling, blurring and labelling are NumPy helpers
that run on batches of grids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orbweave.operators.metrics import trapezoid

#: The eight symmetries of a square, as rotations (quarter turns) after a mirroring.
P4M = tuple((turns, mirrored) for mirrored in (0, 1) for turns in range(4))
BICUBIC_A = -0.75


def rotate(values: Column, side: int, turns: int, mirrored: int = 0) -> Column:
    """A square grid mirrored left to right (or not), then turned anticlockwise by quarter turns."""

    def source(k: Column) -> Column:
        row, col = F.floor(k / side), k % side
        for _ in range(turns % 4):  # a quarter turn takes (row, col) from (col, side - 1 - row)
            row, col = col, side - 1 - row
        return row * side + ((side - 1 - col) if mirrored else col)

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.get(values, source(k).cast("int")))


def orbit(df: DataFrame, values: str, side: int) -> DataFrame:
    """Each grid in its eight views: ``view`` 0 to 7 and the turned ``values``."""
    views = F.array(*[F.struct(F.lit(n).alias("view"), rotate(F.col(values), side, t, m).alias("values")) for n, (t, m) in enumerate(P4M)])
    rest = [c for c in df.columns if c != values]
    return df.select(*rest, F.inline(views)).withColumnRenamed("values", values)


def upsample_matrix(n: int, size: int) -> np.ndarray:
    """Weights of a bicubic resampling from n to ``size`` points, half-pixel centres, edges repeated."""
    a, out = BICUBIC_A, np.zeros((size, n))
    for k in range(size):
        x = (k + 0.5) * n / size - 0.5
        base = int(np.floor(x))
        for j in range(base - 1, base + 3):
            d = abs(x - j)
            w = (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * (d**3 - 5 * d**2 + 8 * d - 4)
            out[k, min(max(j, 0), n - 1)] += w
    return out


def blur_matrix(n: int, sigma: float, radius: int) -> np.ndarray:
    """Weights of a Gaussian blur, mirrored at the edges."""
    offsets = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (offsets / sigma) ** 2)
    w /= w.sum()
    out = np.zeros((n, n))
    for k in range(n):
        for o, x in zip(offsets, w, strict=True):
            j = (k + o) % (2 * n)
            out[k, j if j < n else 2 * n - 1 - j] += x
    return out


def _separable(matrix: np.ndarray, side: int):
    @pandas_udf("array<double>")
    def apply(values: pd.Series) -> pd.Series:
        grids = np.stack(values.to_numpy()).astype(float).reshape(-1, side, side)
        return pd.Series(list((matrix @ grids @ matrix.T).reshape(len(grids), -1)))

    return apply


def upsample(values: Column, side: int, size: int) -> Column:
    return _separable(upsample_matrix(side, size), side)(values)


def blur(values: Column, side: int, sigma: float = 4.0, radius: int = 16) -> Column:
    return _separable(blur_matrix(side, sigma, radius), side)(values)


def label_regions(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the 4-connected regions of a mask, in order of their first cell; 0 elsewhere."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:  # each cell takes the least number around it until nothing changes
        padded = np.pad(np.where(labels, labels, big), 1, constant_values=big)
        least = np.minimum.reduce([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        new = np.where(mask, least, 0)
        if (new == labels).all():
            break
        labels = new
    return np.searchsorted(np.unique(labels[labels > 0]), labels) * mask + mask if mask.any() else labels


def regions(values: Column, side: int) -> Column:
    """Region numbers of a grid of flags."""

    @pandas_udf("array<int>")
    def label(flags: pd.Series) -> pd.Series:
        return pd.Series([label_regions(np.asarray(f, bool).reshape(side, -1)).ravel().astype(np.int32) for f in flags])

    return label(values)


def threshold_sweep(pixels: DataFrame, score: str, n_thresholds: int, groups: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each of ``n_thresholds`` even steps over 0..1: sums over rows with ``score`` at or above it.

    A row counts for all thresholds up to its score, so rows are counted once at the
    highest one, and the counts are added up from the top.
    """
    steps = np.linspace(0, 1, n_thresholds)
    cell = F.least(F.floor(F.col(score) * (n_thresholds - 1)), F.lit(n_thresholds - 1))
    edges = F.array(*[F.lit(float(t)) for t in steps])
    # the floor may be off by one where doubles round: compare with the thresholds themselves
    step = F.when(F.col(score) < F.get(edges, cell.cast("int")), cell - 1).when(
        (cell < n_thresholds - 1) & (F.col(score) >= F.get(edges, (cell + 1).cast("int"))), cell + 1
    ).otherwise(cell)
    counted = pixels.select("*", step.cast("int").alias("step")).groupBy(*groups, "step").agg(*[c.alias(k) for k, c in sums.items()])
    all_steps = counted.select(*groups).distinct().select(*groups, F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1))).alias("step"))
    down = Window.partitionBy(*groups).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    joined = all_steps.join(counted, [*groups, "step"], "left")
    return joined.select(*groups, "step", F.get(edges, F.col("step")).alias("threshold"), *[F.sum(F.coalesce(F.col(k), F.lit(0))).over(down).alias(k) for k in sums])


def pro_curve(pixels: DataFrame, score: str, region: str, image: str, category: str, n_thresholds: int = 300) -> DataFrame:
    """Per category and threshold: false positive rate and mean overlap of the regions."""
    keyed = pixels.select(F.col(category).alias("category"), F.col(image).alias("image"), F.col(region).alias("region"), F.col(score).alias("s"))
    clean = keyed.where("region = 0")
    false = threshold_sweep(clean, "s", n_thresholds, ["category"], {"fp": F.count("*")})
    n_clean = clean.groupBy("category").agg(F.count("*").alias("n_clean"))
    marked = keyed.where("region > 0")
    sizes = marked.groupBy("category", "image", "region").agg(F.count("*").alias("size"))
    shares = marked.join(sizes, ["category", "image", "region"])
    overlap = threshold_sweep(shares, "s", n_thresholds, ["category"], {"covered": F.sum(1 / F.col("size"))})
    n_regions = sizes.groupBy("category").agg(F.count("*").alias("n_regions"))
    return (
        false.join(overlap.drop("threshold"), ["category", "step"])
        .join(n_clean, "category")
        .join(n_regions, "category")
        .select("category", "step", "threshold", (F.col("fp") / F.col("n_clean")).alias("fpr"), (F.col("covered") / F.col("n_regions")).alias("pro"))
    )


def pro_auc(curve: DataFrame, cap: float = 0.3) -> DataFrame:
    """Area under the overlap curve up to a false positive rate of ``cap``, scaled to 0..1."""
    points = curve.where(F.col("fpr") <= cap).withColumn("x", F.col("fpr") / cap)
    return trapezoid(points, "x", "pro", ("category",), "pro_auc")


def pool_matrix(n: int, size: int) -> np.ndarray:
    """Weights of adaptive average pooling from n to ``size`` bins, which may overlap by a cell."""
    out = np.zeros((size, n))
    for k in range(size):
        first, last = k * n // size, -(-(k + 1) * n // size)
        out[k, first:last] = 1 / (last - first)
    return out


def adaptive_pool(values: Column, side: int, size: int) -> Column:
    return _separable(pool_matrix(side, size), side)(values)


def square_pad(values: Column, height: int, width: int, fill: float = 0.0) -> Column:
    """A grid centred in a square of its longer side; of an odd margin the larger part comes last."""
    side = max(height, width)
    top, left = (side - height) // 2, (side - width) // 2

    def cell(k: Column) -> Column:
        row, col = F.floor(k / side) - top, k % side - left
        inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
        return F.when(inside, F.get(values, (row * width + col).cast("int"))).otherwise(F.lit(fill))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), cell)


def high_frequency_energy(values: Column, side: int, radius: float) -> Column:
    """Sum of the magnitudes of a grid's Fourier coefficients further than ``radius`` from frequency zero."""
    at = np.fft.fftfreq(side, 1 / side)
    outside = np.hypot(*np.meshgrid(at, at)) > radius

    @pandas_udf("double")
    def energy(grids: pd.Series) -> pd.Series:
        stacked = np.stack(grids.to_numpy()).astype(float).reshape(-1, side, side)
        return pd.Series((np.abs(np.fft.fft2(stacked)) * outside).sum((1, 2)))

    return energy(values)


def region_boxes(df: DataFrame, region: str, side: int, keys: list[str], least_area: int = 1) -> DataFrame:
    """Area and bounding box of each region of at least ``least_area`` cells; ``region`` holds region numbers."""
    cells = df.select(*keys, F.posexplode(region).alias("p", "region")).where("region > 0")
    row, col = F.floor(F.col("p") / side).cast("int"), F.col("p") % side
    boxes = cells.groupBy(*keys, "region").agg(
        F.count("*").alias("area"), F.min(row).alias("top"), F.min(col).alias("left"), F.max(row).alias("bottom"), F.max(col).alias("right")
    )
    return boxes.where(F.col("area") >= least_area)
