"""PNG files, masks, resampling, synthetic defects and NumPy files, against plain loops and round trips."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import imaging, reports
from orbweave.sources import files, npy, rasters


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered_png(pixels, depth=8, colour=None, palette=None):
    """A PNG file whose lines use all five filters in turn, by the format's own definition."""
    h, w, c = pixels.shape
    colour = {1: 0, 3: 2, 2: 4, 4: 6}[c] if colour is None else colour
    bits = (pixels.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1 if depth < 8 else None
    lines = np.packbits(bits.reshape(h, -1), axis=1) if depth < 8 else pixels.reshape(h, -1).astype(">u2").view(np.uint8) if depth == 16 else pixels.reshape(h, -1).astype(np.uint8)
    step = max(1, c * depth // 8)
    out, above = b"", np.zeros(lines.shape[1], int)
    for k, line in enumerate(lines.astype(int)):
        left = np.r_[np.zeros(step, int), line[:-step]] if len(line) > step else np.zeros(len(line), int)
        corner = np.r_[np.zeros(step, int), above[:-step]] if len(line) > step else np.zeros(len(line), int)
        guess = left + above - corner
        near = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        paeth = np.choose(near.argmin(0), [left, above, corner])
        wanted = [0 * line, left, above, (left + above) // 2, paeth][k % 5]
        out += bytes([k % 5]) + ((line - wanted) % 256).astype(np.uint8).tobytes()
        above = line
    packed = zlib.compress(out)
    data = chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:])
    return rasters.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + data + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_filters_and_round_trip(channels):
    x = np.random.default_rng(channels).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    assert (rasters.decode_png(filtered_png(x)) == x).all()
    assert (rasters.decode_png(rasters.encode_png(x)) == x).all()
    deep = x.astype(np.uint16) * 257
    assert (rasters.decode_png(filtered_png(deep, 16)) == x).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_png_of_few_bits_and_palettes(depth):
    x = np.random.default_rng(depth).integers(0, 2**depth, (9, 13, 1)).astype(np.uint8)
    assert (rasters.decode_png(filtered_png(x, depth)) == x * (255 // (2**depth - 1))).all()
    palette = np.random.default_rng(9).integers(0, 256, (2**depth, 3)).astype(np.uint8)
    assert (rasters.decode_png(filtered_png(x, depth, 3, palette)) == palette[x[..., 0]]).all()


def test_interlaced_png():
    x = np.random.default_rng(5).integers(0, 256, (13, 10, 3)).astype(np.uint8)
    lines = b""
    for row, column, down, across in rasters.PASSES:
        for line in x[row::down, column::across]:
            lines += b"\0" + line.tobytes() if line.size else b""
    body = rasters.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 10, 13, 8, 2, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (rasters.decode_png(body) == x).all()


def test_masks_are_found_and_counted(spark, tmp_path):
    root = tmp_path / "bottle"
    on = np.zeros((6, 5, 1), np.uint8)
    on[2:4, 1:3] = 255
    grey = on // 2 + on // 4
    grey[0, 0] = 7
    for name, mask in (("ground_truth/crack/000_mask.png", on), ("ground_truth/crack/001.PNG", on), ("other/place/002_mask.png", grey), ("ground_truth/crack/000.png", grey)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(rasters.encode_png(mask))
    (root / "ground_truth/crack/bad.png").write_bytes(b"no image")
    masks = rasters.read_png(spark, f"file://{root}")
    assert {r.error is None for r in masks.where("path like '%bad%'").collect()} == {False} and masks.where("error is null").count() == 4
    images = spark.createDataFrame([(f"/x/bottle/test/{p}.png",) for p in ("crack/000", "crack/001", "crack/002", "crack/003", "good/000")], "path string")
    got = {r.path.split("test/")[1]: (r.mask_path and r.mask_path.split("bottle/")[1], r.found_by) for r in rasters.masks_for(images, masks).collect()}
    assert got == {
        "crack/000.png": ("ground_truth/crack/000_mask.png", "strict"), "crack/001.png": ("ground_truth/crack/001.PNG", "suffix"),
        "crack/002.png": ("other/place/002_mask.png", "recursive"), "crack/003.png": (None, None), "good/000.png": (None, None),
    }
    found = {r.path.split("bottle/")[1]: (r.pixel_values, r.n_on, r.plain) for r in rasters.mask_statistics(masks, ["path"]).collect()}
    assert found["ground_truth/crack/001.PNG"] == ([0, 255], 4, True) and found["other/place/002_mask.png"] == ([0, 7, 190], 5, False)


@pytest.mark.parametrize("size", [(3, 4), (9, 14), (20, 5)])
def test_resampling_equals_a_plain_loop(size):
    x = np.random.default_rng(1).integers(0, 256, (9, 7, 2)).astype(np.uint8)

    def weights(n, m, i):
        scale = n / m
        w = [max(0.0, 1 - abs((j + 0.5) - (i + 0.5) * scale) / max(1.0, scale)) for j in range(n)]
        return [v / sum(w) for v in w]

    got = imaging.resized(x, *size)
    for a in range(size[0]):
        for b in range(size[1]):
            wa, wb = weights(9, size[0], a), weights(7, size[1], b)
            for c in range(2):
                assert got[a, b, c] == pytest.approx(sum(wa[i] * wb[j] * int(x[i, j, c]) for i in range(9) for j in range(7)))


def plain_regions(mask):
    """Regions of 8-connected cells by flooding."""
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        front = [min(left)]
        left.discard(front[0])
        region = set(front)
        while front:
            y, x = front.pop()
            for p in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if p in left:
                    left.discard(p)
                    region.add(p)
                    front.append(p)
        out.append(region)
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.7, 1.0])
def test_largest_region_and_closing(share):
    mask = np.random.default_rng(int(share * 100)).random((17, 23)) < share
    regions = plain_regions(mask)
    got = {tuple(p) for p in np.argwhere(imaging.largest_region(mask)).tolist()}
    assert len(got) == max(map(len, regions), default=0) and (not regions or got in regions)

    def move(m, every):
        out = np.zeros_like(m)
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                near = [m[y + dy, x + dx] for dy in range(-2, 3) for dx in range(-2, 3) if imaging.ELLIPSE[dy + 2, dx + 2] and 0 <= y + dy < m.shape[0] and 0 <= x + dx < m.shape[1]]
                out[y, x] = all(near) if every else any(near)
        return out

    assert (imaging.closed_and_opened(mask) == move(move(move(move(mask, False), True), True), False)).all()


def test_object_of_a_coloured_picture():
    x = np.full((60, 80, 3), (30, 60, 200), np.uint8)
    x[20:45, 30:60] = (200, 40, 30)
    x[5:9, 40:44] = (200, 40, 30)
    mask = imaging.object_mask(x)
    assert mask[22:43, 32:58].all() and not mask[:18].any() and 0.9 < mask.sum() / (25 * 30) <= 1.0
    assert not imaging.object_mask(np.full((30, 30, 3), 90, np.uint8)).any()


def test_defects_stay_in_the_object_and_come_again(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(6):
        x = np.full((48, 40, 3), 15, np.uint8)
        x[8:40, 6:34] = rng.integers(120, 250, (32, 28, 3))
        rows.append((k, 48, 40, 3, bytearray(x.tobytes())))
    rows.append((9, 1, 1, 1, bytearray(b"\x05")))
    df = spark.createDataFrame([*rows, (10, None, None, None, None)], f"id long, {rasters.RASTER}")
    made = imaging.synthetic_defects(df, ["id"])
    found = made.collect()
    assert len(found) == 7 * len(imaging.DEFECTS) and all(r.n_outside == 0 for r in found)
    assert all(r.n_changed > 0 for r in found if r.id < 9)
    assert sorted(map(str, found)) == sorted(map(str, imaging.synthetic_defects(df.repartition(5), ["id"]).collect()))
    assert sorted(map(str, found)) != sorted(map(str, imaging.synthetic_defects(df, ["id"], seed=43).collect()))
    with pytest.raises(ValueError, match="unknown defects: hole"):
        imaging.synthetic_defects(df, ["id"], ("hole",))


def test_weights_of_a_blur_are_made_once(monkeypatch):
    made = []
    real = imaging.blur_matrix
    monkeypatch.setattr(imaging, "_blur_weights", imaging.lru_cache(lambda *how: (made.append(how), real(*how))[1]))
    x = np.full((44, 44, 1), 20, np.uint8)
    x[8:36, 8:36] = 200
    for k in range(12):
        for kind in ("blur", "dent"):
            imaging.defective(x, kind, f"42:{k}")
    assert 2 <= len(made) <= 4  # one for the dents, three for the blurs


def test_lines_look_at_no_more_than_they_may_cover():
    rng = np.random.default_rng(5)
    brush = imaging.Brush(np.ones((31, 44), bool), rng)
    for _ in range(60):
        a, b, width = rng.integers(0, (31, 44)), rng.integers(0, (31, 44)), rng.uniform(0.3, 9)
        d = (b - a).astype(float)
        t = np.clip(((brush.y - a[0]) * d[0] + (brush.x - a[1]) * d[1]) / max(1e-9, d @ d), 0, 1)
        whole = np.hypot(brush.y - a[0] - t * d[0], brush.x - a[1] - t * d[1]) <= width / 2
        assert (brush.line(a, b, width) == whole).all()


def test_numpy_files(spark, tmp_path):
    npy.register(spark)
    path = f"{tmp_path}/maps"
    rows = [(f"c_heatmap_rank{k}", [k, 2], [float(v) for v in range(2 * k)]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").repartition(3)
    df.write.format("npy").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "maps").iterdir()) == [f"c_heatmap_rank{k}.npy" for k in range(1, 6)]
    assert (np.load(f"{path}/c_heatmap_rank3.npy") == np.arange(6.0).reshape(3, 2)).all()
    np.save(f"{path}/z_heatmap_rank3.npy", np.ones((1, 4), np.float32))
    (tmp_path / "maps" / "broken_rank9.npy").write_bytes(b"nothing")
    by_rank = {r.rank: (r.shape, r["values"]) for r in npy.ranked_npy(spark, f"file://{path}").collect()}
    assert by_rank == {**{k: ([k, 2], [float(v) for v in range(2 * k)]) for k in (1, 2, 4, 5)}, 3: ([1, 4], [1.0] * 4)}
    (tmp_path / "maps" / "broken_rank9.npy").unlink()
    whole = spark.read.format("npy").load(path)
    assert whole.rdd.getNumPartitions() == 6 and {tuple(r.shape) for r in whole.collect()} == {(1, 2), (2, 2), (3, 2), (4, 2), (5, 2), (1, 4)}
    twice = df.limit(1).union(df.limit(1)).withColumn("name", F.lit("same"))
    with pytest.raises(Exception, match="two rows have one name"):
        twice.write.format("npy").mode("append").save(path)
    assert not (tmp_path / "maps" / npy.UNDER_WAY).exists() and not (tmp_path / "maps" / "same.npy").exists()
    df.limit(1).write.format("npy").mode("overwrite").save(path)
    assert len(list((tmp_path / "maps").iterdir())) == 1


def test_ordered_scans(spark, tmp_path):
    for name in ("b/train/good/2.png", "b/train/good/1.PNG", "b/test/good/3.jpg", "b/test/crack/9.png", "b/test/crack/1.png", "b/test/crack/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    tail = lambda df: [r.path.split("/b/")[1] for r in df.collect()]
    root = f"file://{tmp_path}"
    assert tail(files.train_images(spark, root)) == ["train/good/1.PNG", "train/good/2.png"]
    assert tail(files.test_images(spark, root)) == ["test/crack/1.png", "test/crack/9.png", "test/good/3.jpg"]
    with pytest.raises(ValueError, match="no training images"):
        files.train_images(spark, f"{root}/b/test")
    paths = spark.createDataFrame([("a/X.png",), ("a/x.PNG",), ("a/b.jpg",), ("a/c.txt",), ("a/d.bmp",)], "path string")
    assert [r.path for r in files.first_images(paths, 2).collect()] == ["a/b.jpg", "a/d.bmp"]


def test_box_of_figures():
    box = reports.ascii_table({"Image AUROC": 0.91234, "False negatives": 12})
    lines = box.split("\n")
    assert len({len(x) for x in lines}) == 1 and lines[3].endswith("0.9123 │") and lines[4].endswith(" 12 │") and lines[0][0] == "┌"
