"""Images as rows: PNG files decoded and encoded with NumPy, and masks found for images.

A raster is the columns ``height``, ``width``, ``channels`` and ``pixels`` (bytes in row
order). Files are read by Spark's ``binaryFile`` source, so from any store that Spark
reads; each is decoded where it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.sources.files import extension, parent, stem

#: Fixed values of the format: its signature, and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The first row and column and the steps of each of the seven passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
RASTER = "height int, width int, channels int, pixels binary"
#: Pixels of an image that is decoded at most; a larger one gives an error, not a dead worker.
MOST_PIXELS = 1 << 28
#: Bytes of pixels from which changed images leave a task together.
BATCH_PIXELS = 1 << 20


def _unfiltered(data: np.ndarray, rows: int, line: int, step: int) -> np.ndarray:
    """Lines of bytes as they were before each was predicted from its left and upper neighbours."""
    lines = data[: rows * (line + 1)].reshape(rows, line + 1)
    out = np.zeros((rows, line), np.uint8)
    above = np.zeros(line, np.uint8)
    for k in range(rows):
        kind, raw = int(lines[k, 0]), lines[k, 1:]
        if kind == 0:
            row = raw
        elif kind == 1:  # the left one: running sums for each byte of a pixel
            row = np.zeros(line, np.uint8)
            for c in range(step):
                row[c::step] = np.cumsum(raw[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            row = raw + above
        elif kind in (3, 4):
            row = _by_pixels(raw.tolist(), above.tolist(), step, kind)
        else:
            raise ValueError(f"unknown filter {kind}")
        out[k] = above = row
    return out


def _by_pixels(raw: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    """The filters whose prediction depends on the pixel just decoded."""
    row = [0] * len(raw)
    for i, x in enumerate(raw):
        left, up = row[i - step] if i >= step else 0, above[i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = above[i - step] if i >= step else 0
            by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner
        row[i] = (x + guess) & 255
    return np.array(row, np.uint8)


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Values of lines of bytes; of 16 bits the higher eight."""
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2)[..., 0]
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]


def decode_png(content: bytes) -> np.ndarray:
    """The pixels of a PNG image, height x width x channels, eight bits each; palettes are looked up, lower depths scaled up."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if width * height > MOST_PIXELS:
        raise ValueError(f"{width} x {height} pixels are too many")
    channels = CHANNELS[colour]
    data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    out = np.zeros((height, width, channels), np.uint8)
    step = max(1, channels * depth // 8)
    for row, column, down, across in PASSES if interlaced else ((0, 0, 1, 1),):
        h, w = -(-(height - row) // down), -(-(width - column) // across)
        if h > 0 and w > 0:
            line = -(-w * channels * depth // 8)
            out[row::down, column::across] = _samples(_unfiltered(data, h, line, step), w, channels, depth)
            data = data[h * (line + 1) :]
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        return palette[out[..., 0]]
    return out * np.uint8(255 // (2**depth - 1)) if depth < 8 else out


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG image of height x width x channels (1 to 4) bytes."""
    height, width, channels = pixels.shape
    colour = {n: c for c, n in CHANNELS.items() if c != 3}[channels]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels).reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pixels_of(row: tuple) -> np.ndarray:
    """A raster's (height, width, channels, pixels) as an array."""
    height, width, channels, pixels = row
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def mapped(rasters: DataFrame, change: Callable[[np.ndarray, dict], list[tuple[np.ndarray, dict]]], keys: list[str], added: str = "") -> DataFrame:
    """``keys`` of ``rasters`` with the rasters that ``change`` makes of each, and the further columns ``added`` that it gives them.

    ``change`` gets the pixels and the keys of a row; rows are changed where they are.
    """
    types = T.StructType([*(rasters.schema[k] for k in keys), *T._parse_datatype_string(f"{RASTER}{', ' + added if added else ''}").fields])
    arrow = rasters.select(*keys, "height", "width", "channels", "pixels")
    extra = [f.name for f in types.fields[len(keys) + 4 :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, out, size = to_arrow_schema(types), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["pixels"] is None:
                    continue
                own = {k: row[k] for k in keys}
                made = change(pixels_of((row["height"], row["width"], row["channels"], row["pixels"])), own)
                out += [{**own, "height": p.shape[0], "width": p.shape[1], "channels": p.shape[2], "pixels": np.ascontiguousarray(p, np.uint8).tobytes(), **{k: more[k] for k in extra}} for p, more in made]
                size += sum(p.size for p, _ in made)
                if size >= BATCH_PIXELS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return arrow.mapInArrow(run, types)


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without ``content``, as rasters; ``error`` says why a file has none (null pixels)."""
    rest = [c for c in files.columns if c != content]
    types = T.StructType([*(files.schema[c] for c in rest), *T._parse_datatype_string(f"{RASTER}, error string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(types)
        for batch in batches:
            for k, body in enumerate(batch.column(batch.schema.get_field_index(content)).to_pylist()):
                own = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in rest}
                try:
                    pixels = decode_png(body or b"")
                    made = dict(zip(("height", "width", "channels"), pixels.shape, strict=True)) | {"pixels": pixels.tobytes(), "error": None}
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    made = {"height": None, "width": None, "channels": None, "pixels": None, "error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([own | made], schema=schema)

    return files.select(*rest, content).mapInArrow(run, types)


def encoded(rasters: DataFrame, out: str = "content") -> DataFrame:
    """``rasters`` with PNG files in place of their pixels."""

    @F.udf("binary", useArrow=True)
    def encode(height: int, width: int, channels: int, pixels: bytes) -> bytes | None:
        return None if pixels is None else encode_png(pixels_of((height, width, channels, pixels)))

    rest = [c for c in rasters.columns if c not in ("height", "width", "channels", "pixels", out)]
    return rasters.select(*rest, encode("height", "width", "channels", "pixels").alias(out))


def read_png(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and raster of all PNG files below ``root``, whatever the case of their extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return decoded(files.where(extension(F.col("path")) == "png").select("path", "content"))


def mask_statistics(masks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the distinct values of a mask's pixels, how many of its pixels are not 0, and whether it is a plain mask: of 0 and one other value at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.unique(np.frombuffer(p, np.uint8)), int(np.count_nonzero(np.frombuffer(p, np.uint8)))) for p in batch.column(len(keys)).to_pylist()]
            values = pa.array([v.astype(np.int32) for v, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], values, pa.array([n for _, n in found], pa.int64())], names=[*keys, "pixel_values", "n_on"])

    types = T.StructType([*(masks.schema[k] for k in keys), *T._parse_datatype_string("pixel_values array<int>, n_on long").fields])
    found = masks.where(F.col("pixels").isNotNull()).select(*keys, "pixels").mapInArrow(count, types)
    return found.withColumn("plain", F.size(F.array_except("pixel_values", F.array(F.lit(0)))) <= 1)


def masks_for(images: DataFrame, masks: DataFrame, path: str = "path") -> DataFrame:
    """``images`` with the ``mask_path`` of each, and ``found_by``: ``strict``, ``suffix``, ``recursive``, or null.

    Strict is a file of the image's defect folder named as the image with ``_mask`` added;
    then one there with the image's own name; then one anywhere with either name. Of
    several the first path counts. Images of the folder ``good`` have no mask.
    """
    named = masks.select(F.col(path).alias("mask_path"), parent(F.col(path)).alias("m_folder"), stem(F.col(path)).alias("m_name"))
    own = named.withColumn("name", F.regexp_replace("m_name", "_mask$", "")).withColumn("marked", F.col("m_name").endswith("_mask"))
    first = F.min(F.struct((~F.col("marked")).alias("late"), "mask_path")).alias("best")
    in_folder = own.groupBy(F.col("m_folder").alias("__folder"), F.col("name").alias("__name")).agg(first)
    anywhere = own.groupBy(F.col("name").alias("__name")).agg(first.alias("any"))
    keyed = images.withColumns({"__folder": parent(F.col(path)), "__name": stem(F.col(path))})
    met = keyed.join(in_folder, ["__folder", "__name"], "left").join(anywhere, "__name", "left")
    good = F.col("__folder") == "good"
    found: Column = F.when(good, F.lit(None)).when(F.col("best").isNotNull(), F.when(F.col("best.late"), "suffix").otherwise("strict")).when(F.col("any").isNotNull(), "recursive")
    chosen = F.when(~good, F.coalesce("best.mask_path", "any.mask_path"))
    return met.select(*images.columns, chosen.alias("mask_path"), found.alias("found_by"))
