"""Exact AUROC over pixels, for ranges of several sizes, against a plain count of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import grids, pixels


def plain_auroc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg)))


@pytest.mark.parametrize("range_pixels", [40, 1 << 21])
@pytest.mark.parametrize("size", [3, 9])
def test_pixel_auroc_equals_pairs(spark, range_pixels, size):
    rng = np.random.default_rng(size)
    rows = []
    for k in range(40):
        values, labels = rng.integers(0, 4, 9) / 3.0, (rng.random(9) < 0.3).astype(int)
        rows.append(("a" if k % 3 else None, values.tolist(), ([0] * 9 if k % 3 == 0 else labels.tolist())))
    rows += [("b", None, [1] * 9), ("b", [float("nan")] * 9, [1] * 9), ("a", [1.0] * 9, None)]
    df = spark.createDataFrame(rows, "g string, v array<double>, y array<int>").repartition(4)
    to_pixels = pixels.upsampled(3, size, 1.0, 2)
    got = {r.g: r for r in pixels.pixel_auroc(df, ("g",), "v", "y", to_pixels, range_pixels).collect()}
    for g in ("a", None):
        mine = [(v, y) for name, v, y in rows if name == g and v and y]
        scores, labels = (x.ravel() for x in to_pixels(np.array([v for v, _ in mine]), np.array([y for _, y in mine])))
        expected = plain_auroc(scores, labels)
        assert (got[g].n_pos, got[g].n_neg) == (labels.sum(), (1 - labels).sum())
        assert got[g].pixel_auroc == (None if expected is None else pytest.approx(expected))
    assert set(got) == {"a", None}
    assert pixels.pixel_auroc(df.limit(0), ("g",), "v", "y", to_pixels).count() == 0
    assert pixels.pixel_auroc(df.where("g = 'a'"), (), "v", "y", to_pixels, range_pixels).count() == 1


def test_pixels_are_those_of_the_grid_operators(spark):
    x = np.random.default_rng(2).normal(size=(3, 16))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    plain = sorted(r[0] for r in df.select(grids.blur(grids.upsample(F.col("v"), 4, 12), 12, 2.0, 5)).collect())
    got, labels = pixels.upsampled(4, 12, 2.0, 5)(x, np.tile(np.arange(16) % 2, (3, 1)))
    assert sorted(got.tolist()) == [pytest.approx(p, abs=1e-8) for p in plain]
    assert labels.reshape(3, 12, 12)[0, 0].tolist() == [0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 1]
