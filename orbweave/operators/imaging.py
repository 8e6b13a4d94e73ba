"""Resampling, object masks and synthetic defects of images; each row is changed where it is."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from orbweave.operators.grids import blur_matrix
from orbweave.sources.rasters import mapped

#: Means and deviations of the channels that images are normalised to.
CHANNEL_MEANS = (0.485, 0.456, 0.406)
CHANNEL_SDS = (0.229, 0.224, 0.225)
#: The ellipse of 5 x 5 cells, the least difference to the background, and the share of a side that a corner has.
ELLIPSE = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], bool)
LEAST_DIFFERENCE = 15.0
CORNER = 20
#: From linear red, green and blue to the white point's X, Y and Z.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def resize_matrix(n: int, size: int) -> np.ndarray:
    """Weights of a bilinear resampling from n to ``size`` points; where points get fewer, each takes part in the mean."""
    scale = n / size
    reach = max(1.0, scale)
    centre = (np.arange(size) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image of doubles with other sides."""
    rows, columns = resize_matrix(pixels.shape[0], height), resize_matrix(pixels.shape[1], width)
    return np.einsum("ai,ijc,bj->abc", rows, pixels.astype(float), columns, optimize=True)


def normalised(rasters: DataFrame, keys: list[str], size: int, means: tuple[float, ...] = CHANNEL_MEANS, sds: tuple[float, ...] = CHANNEL_SDS) -> DataFrame:
    """``keys`` and ``values``: images resized to ``size`` x ``size``, each channel scaled to 0..1 and normalised; channel after channel.

    Images of one channel are taken to have as many equal ones as there are means.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from orbweave.sources.rasters import pixels_of

    types = T.StructType([*(rasters.schema[k] for k in keys), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True):
                x = resized(pixels_of(row), size, size) / 255
                x = np.repeat(x, len(means), 2) if x.shape[2] == 1 else x[..., : len(means)]
                out.append(((x - np.array(means)) / np.array(sds)).transpose(2, 0, 1).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], names=types.names)

    return rasters.where("pixels is not null").select(*keys, "height", "width", "channels", "pixels").mapInArrow(run, types)


def lab(pixels: np.ndarray) -> np.ndarray:
    """Lightness and two colour axes, each from 0 to 255, of red, green and blue bytes."""
    x = pixels[..., :3].astype(float) / 255
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    t = linear @ TO_XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    return np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)


def spread(mask: np.ndarray, shape: np.ndarray = ELLIPSE) -> np.ndarray:
    """Cells that ``shape``, centred on a cell of the mask, covers; beyond the edges there is nothing."""
    r, c = shape.shape[0] // 2, shape.shape[1] // 2
    padded = np.pad(mask, ((r, r), (c, c)))
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(shape), strict=True):
        out |= padded[y : y + mask.shape[0], x : x + mask.shape[1]]
    return out


def closed_and_opened(mask: np.ndarray) -> np.ndarray:
    """Small gaps filled, then small specks removed; the shape is symmetric, and edges count as what would change nothing."""
    shrunk = lambda m: ~spread(~m)
    return spread(shrunk(shrunk(spread(mask))))


def largest_region(mask: np.ndarray) -> np.ndarray:
    """The 8-connected region with the most cells, of equally large ones the first in row order."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    parents = np.arange(mask.size + 1)
    pairs = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = labels[: mask.shape[0] - dy, max(0, -dx) : mask.shape[1] - max(0, dx)]
        b = labels[dy:, max(0, dx) : mask.shape[1] - max(0, -dx)]
        both = (a > 0) & (b > 0)
        pairs.append(np.stack([a[both], b[both]]))
    links = np.concatenate(pairs, 1)
    while True:  # hang each root below the least root it is linked to, then shorten the paths
        low, high = np.sort(parents[links], axis=0)
        if (low == high).all():
            break
        np.minimum.at(parents, high, low)
        while (parents != parents[parents]).any():
            parents = parents[parents]
    roots = parents[labels]
    sizes = np.bincount(roots[mask], minlength=mask.size + 1) if mask.any() else np.zeros(1, int)
    return mask & (roots == sizes.argmax()) if mask.any() else mask


def object_mask(pixels: np.ndarray, least: float = LEAST_DIFFERENCE) -> np.ndarray:
    """Where an image differs from the mean of its four corners: closed, opened, and its largest region."""
    h, w = pixels.shape[:2]
    up, side = max(5, h // CORNER), max(5, w // CORNER)
    corners = [pixels[:up, :side], pixels[:up, -side:], pixels[-up:, :side], pixels[-up:, -side:]]
    ground = np.mean([c.reshape(-1, c.shape[2]) for c in corners], axis=0).mean(0).astype(np.uint8)
    both = (lab(pixels), lab(ground[None, None])) if pixels.shape[2] >= 3 else (pixels[..., :1].astype(float), ground[None, None, :1].astype(float))
    return largest_region(closed_and_opened(np.sqrt(((both[0] - both[1]) ** 2).sum(-1)) > least))


def object_masks(rasters: DataFrame, keys: list[str], least: float = LEAST_DIFFERENCE) -> DataFrame:
    """``keys`` and the mask of each image as a raster of 0 and 255, with ``area``, the number of its cells."""

    def change(pixels: np.ndarray, _: dict) -> list:
        mask = object_mask(pixels, least)
        return [((mask * np.uint8(255))[..., None], {"area": int(mask.sum())})]

    return mapped(rasters, change, keys, "area long")


class Brush:
    """Shapes on an image's cells, and places drawn within a mask."""

    def __init__(self, mask: np.ndarray, rng: np.random.Generator):
        self.mask, self.rng = mask, rng
        self.y, self.x = np.mgrid[: mask.shape[0], : mask.shape[1]]
        self.cells = np.argwhere(mask)

    def point(self) -> np.ndarray:
        """A cell (row, column) of the mask; the middle if it has none."""
        return self.cells[self.rng.integers(len(self.cells))] if len(self.cells) else np.array(self.mask.shape) // 2

    def line(self, a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
        """Cells within half of ``width`` of the straight line between two cells."""
        d, reach = (b - a).astype(float), int(width / 2) + 1
        low, high = np.maximum(np.minimum(a, b) - reach, 0), np.maximum(a, b) + reach + 1
        near = np.s_[low[0] : high[0], low[1] : high[1]]  # no cell beyond is so close
        y, x = self.y[near] - a[0], self.x[near] - a[1]
        t = np.clip((y * d[0] + x * d[1]) / max(1e-9, d @ d), 0, 1)
        out = np.zeros(self.mask.shape, bool)
        out[near] = np.hypot(y - t * d[0], x - t * d[1]) <= width / 2
        return out

    def disc(self, at: np.ndarray, radius: float) -> np.ndarray:
        return np.hypot(self.y - at[0], self.x - at[1]) <= radius

    def box(self, least: float, most: float) -> np.ndarray:
        """A rectangle about a cell of the mask, each side a share of the image's."""
        at, size = self.point(), np.maximum(1, self.rng.uniform(least, most, 2) * self.mask.shape)
        return (np.abs(self.y - at[0]) <= size[0] / 2) & (np.abs(self.x - at[1]) <= size[1] / 2)


#: Weights of the last blurs: images of one size share them.
_blur_weights = lru_cache(maxsize=16)(blur_matrix)


def _blurred(pixels: np.ndarray, sigma: float) -> np.ndarray:
    rows, columns = (_blur_weights(n, sigma, min(n - 1, int(4 * sigma))) if n > 1 else np.ones((1, 1)) for n in pixels.shape[:2])
    return np.einsum("ai,ijc,bj->abc", rows, pixels.astype(float), columns, optimize=True)


def _scratch(x: np.ndarray, brush: Brush) -> np.ndarray:
    for _ in range(12):
        x[brush.line(brush.point(), brush.point(), brush.rng.uniform(0.01, 0.03) * max(x.shape[:2]) + 1)] = 0
    return x


def _crack(x: np.ndarray, brush: Brush) -> np.ndarray:
    points = [brush.point() for _ in range(12)]
    for a, b in zip(points, points[1:], strict=False):
        x[brush.line(a, b, 0.02 * max(x.shape[:2]) + 1)] = 0
    return x


def _dent(x: np.ndarray, brush: Brush) -> np.ndarray:
    at, radius = brush.point(), brush.rng.uniform(0.1, 0.2) * min(x.shape[:2])
    inside = brush.disc(at, radius)
    x[inside] = _blurred(x, 0.1 * min(x.shape[:2]) + 0.5)[inside]
    x[inside & ~brush.disc(at, radius - 0.02 * max(x.shape[:2]) - 0.5)] = 0
    return x


def _missing_label(x: np.ndarray, brush: Brush) -> np.ndarray:
    x[brush.box(1 / 8, 1 / 3)] = 0
    return x


def _stain(x: np.ndarray, brush: Brush) -> np.ndarray:
    """Overlapping discs that darken what they cover, with noise."""
    for _ in range(5):
        at = brush.disc(brush.point(), brush.rng.uniform(0.03, 0.1) * min(x.shape[:2]) + 0.5)
        x[at] = x[at] * 0.6 + brush.rng.normal(0, 8, x[at].shape)
    return x


def _blur(x: np.ndarray, brush: Brush) -> np.ndarray:
    return _blurred(x, float(brush.rng.choice([2.9, 3.2, 3.5])))


def _colour_shift(x: np.ndarray, brush: Brush) -> np.ndarray:
    n = x.shape[2]
    x = np.clip(x * brush.rng.uniform(0.7, 1.4, n) + brush.rng.uniform(-55, 55, n), 0, 255)
    return x * 0.6 + np.resize([30.0, 0.0, 120.0], n) * 0.4


def _asymmetry(x: np.ndarray, brush: Brush) -> np.ndarray:
    """The left half mirrored onto the right one, with a disc and a box that break it."""
    half = x.shape[1] // 2
    x[:, x.shape[1] - half :] = x[:, :half][:, ::-1]
    x[brush.disc(brush.point(), 0.06 * max(x.shape[:2]) + 0.5)] = 0
    x[brush.box(1 / 6, 1 / 3)] = 0
    return x


DEFECTS: dict[str, Callable[[np.ndarray, Brush], np.ndarray]] = {
    "scratch": _scratch, "crack": _crack, "dent": _dent, "missing_label": _missing_label, "stain": _stain, "blur": _blur, "color_shift": _colour_shift, "asymmetric": _asymmetry,
}


def defective(pixels: np.ndarray, kind: str, seed: str, mask: np.ndarray | None = None) -> np.ndarray:
    """An image with a defect of a kind; what ``seed`` is, and nothing else, says where. Only cells of the mask change."""
    mask = object_mask(pixels) if mask is None else mask
    digest = hashlib.sha256(f"{seed}:{kind}".encode()).digest()
    rng = np.random.default_rng(np.frombuffer(digest, np.uint32))
    made = np.clip(np.rint(DEFECTS[kind](pixels.astype(float), Brush(mask, rng))), 0, 255).astype(np.uint8)
    return np.where(mask[..., None], made, pixels)


def synthetic_defects(rasters: DataFrame, keys: list[str], kinds: tuple[str, ...] = tuple(DEFECTS), seed: int = 42, least: float = LEAST_DIFFERENCE) -> DataFrame:
    """Each image once for each of ``kinds``: ``keys``, ``kind``, the changed image as a raster, and its ``area`` (cells of the
    object's mask), ``n_changed`` and ``n_outside`` (changed cells outside the mask, always 0).

    The draws depend on seed, keys and kind, so the same rows give the same images however they are dealt out.
    Raises ValueError for an unknown kind.
    """
    unknown = [k for k in kinds if k not in DEFECTS]
    if unknown:
        raise ValueError(f"unknown defects: {', '.join(unknown)}; there are {', '.join(DEFECTS)}")

    def change(pixels: np.ndarray, own: dict) -> list:
        mask, out = object_mask(pixels, least), []
        for kind in kinds:
            made = defective(pixels, kind, f"{seed}:{'|'.join(map(str, own.values()))}", mask)
            other = (made != pixels).any(-1)
            out.append((made, {"kind": kind, "area": int(mask.sum()), "n_changed": int(other.sum()), "n_outside": int((other & ~mask).sum())}))
        return out

    return mapped(rasters, change, keys, "kind string, area long, n_changed long, n_outside long")
