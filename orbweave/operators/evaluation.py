"""Banks of reference vectors: building, keeping, searching, and evaluating them over grids of settings."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.vectors import is_finite, l2sq, normalise
from orbweave.operators.bank import evenly_spaced, k_centre_coreset, kmeans_coreset, orbit_dedupe
from orbweave.operators.evt import gpd_thresholds
from orbweave.operators.grids import orbit, rotate
from orbweave.operators.knn import ProductQuantiser, as_matrix, sample_matrix, squared_distances
from orbweave.operators.metrics import auroc, rates_at
from orbweave.operators.pixels import pixel_auroc, upsampled
from orbweave.sources.store import discard, materialise

CORESETS = ("all", "linspace", "kcentre", "kmeans")
SEARCHES = ("exact", "pq")
#: Parts of a product code that are tried, in this order.
PARTS = (64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1)
#: Rows of a bank from which its codes are learned.
TRAIN_ROWS = 4_096
#: Rows, and vectors of a bank, that meet at once: their distances fit a core's cache.
SLICE, BLOCK = 256, 512
#: Bytes of a bank's vectors, as doubles, that go to the tasks at once.
PART_BYTES = 1 << 26


def build_bank(support: DataFrame, coreset: str = "all", share: float = 0.1, dedupe: float | None = None, group: str = "category", order: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The bank of ``support``: valid vectors, deduplicated, reduced by ``coreset``, with unit norm.

    Null, empty, non-finite and zero vectors are left out. ``dedupe`` is the cosine from
    which a vector repeats the last one kept of its group. Raises ValueError for an
    unknown coreset.
    """
    if coreset not in CORESETS:
        raise ValueError(f"unknown coreset: {coreset}; one of {', '.join(CORESETS)} is needed")
    v = F.col(embedding)
    bank = support.where(v.isNotNull() & (F.size(v) > 0) & is_finite(v) & F.exists(v, lambda x: x != 0))
    if dedupe is not None:
        bank = orbit_dedupe(bank, [group], [order], embedding, dedupe)
    if coreset == "linspace":
        bank = evenly_spaced(bank, order, share=share)
    elif coreset == "kcentre":
        # as many of each group as it has rows times the share
        picked = k_centre_coreset(bank, group, share=share, id_col=order, embedding=embedding).select(order)
        bank = bank.join(picked, order, "left_semi")
    elif coreset == "kmeans":
        bank = kmeans_coreset(bank, share, id_col=order, embedding=embedding)
    return bank.withColumn(embedding, normalise(v))


def bank_facts(bank: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: the bank's size and width, and the lists and code parts that an index of it takes."""
    parts = F.coalesce(*[F.when(F.col("width") % p == 0, F.lit(p)) for p in PARTS])
    sizes = bank.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(embedding)), F.lit(0)).alias("width"))
    return sizes.select("n", "width", F.greatest(F.lit(1), F.least(F.lit(100), F.floor(F.col("n") / 10))).cast("long").alias("n_lists"), parts.alias("m"))


def save_bank(bank: DataFrame, path: str) -> None:
    """Write a bank and its facts below ``path``, over what is there."""
    bank.write.mode("overwrite").parquet(f"{path}/vectors")
    bank_facts(bank).write.mode("overwrite").json(f"{path}/facts")


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank that ``save_bank`` wrote; ValueError if it isn't whole."""
    bank = spark.read.parquet(f"{path}/vectors")
    said, found = spark.read.json(f"{path}/facts").first(), bank_facts(bank).first()
    if said is None or said.n != found.n or said.width != found.width:
        raise ValueError(f"the bank at {path} has {found.n} vectors, not {said.n if said else 'any'}")
    return bank


def coded_bank(bank: DataFrame, search: str, m: int = 16, bits: int = 4, embedding: str = "embedding") -> DataFrame:
    """The bank as its search sees it: itself (``exact``), or what product codes give back (``pq``)."""
    if search not in SEARCHES:
        raise ValueError(f"unknown search: {search}; one of {', '.join(SEARCHES)} is needed")
    if search == "exact":
        return bank
    quantiser = bank.sparkSession.sparkContext.broadcast(ProductQuantiser(sample_matrix(bank, embedding, TRAIN_ROWS), m, bits))
    at = bank.columns.index(embedding)
    schema = bank.withColumn(embedding, F.col(embedding).cast("array<double>")).schema

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                back = quantiser.value.decode(quantiser.value.encode(as_matrix(batch.column(at))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(list(back)), *batch.columns[at + 1 :]], names=batch.schema.names)

    return bank.mapInArrow(code, schema)


def _keys(columns: list, rows: int) -> list[tuple]:
    """The rows' keys; without key columns all rows share one."""
    return list(zip(*(c.to_pylist() for c in columns), strict=True)) if columns else [()] * rows


def bank_distances(
    rows: DataFrame, bank: DataFrame, keys: list[str], own: str | None = None, id_col: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``rows`` with ``d2``, the least squared distance to a bank vector with the same ``keys``; null if there is none.

    The bank, the smaller side, goes to the tasks in parts of about ``part_bytes`` of doubles; the
    rows pass each part with the best distance so far, so they are neither shuffled nor gathered,
    and ``SLICE`` of them meet ``block`` vectors at once. Between parts the rows are written, so a
    task has one Python worker and one part whatever the bank's size; only a stream, which
    can't be written between, passes all parts in the one worker. Bank vectors with the row's
    value of ``own`` are left out.
    """
    known = bank.where(F.col(embedding).isNotNull())
    n_bytes = known.agg(F.coalesce(F.count("*") * F.max(F.size(embedding)) * 8, F.lit(0)).alias("b")).first().b
    n_parts = max(1, -(-n_bytes // part_bytes))

    def part(n: int) -> Broadcast:
        mine = known if n_parts == 1 else known.where(F.pmod(F.xxhash64(*keys, id_col), F.lit(n_parts)) == n)
        table = mine.select(*keys, F.col(own).alias("__own") if own else F.lit(None).cast("string").alias("__own"), F.col(embedding).alias("__v")).toArrow()  # about ``part_bytes``
        vectors, members = as_matrix(table["__v"]), defaultdict(list)
        for k, key in enumerate(_keys([table[c] for c in keys], len(table))):
            members[key].append(k)
        of = np.array(table["__own"].to_pylist(), object)
        return rows.sparkSession.sparkContext.broadcast({key: (vectors[ids], of[ids] if own else None) for key, ids in members.items()})

    out = rows.where(F.col(embedding).isNotNull()).drop("d2").withColumn("d2", F.lit(None).cast("double"))
    if rows.isStreaming:
        return _passed(out, [part(n) for n in range(n_parts)], keys, own, embedding, block)
    before = None
    for n in range(n_parts):
        out = _passed(out, [part(n)], keys, own, embedding, block)
        if n < n_parts - 1:
            out = materialise(out, "bank-part")
            if before is not None:
                discard(before)
            before = out
    return out


def _passed(rows: DataFrame, parts: list[Broadcast], keys: list[str], own: str | None, embedding: str, block: int) -> DataFrame:
    """``rows``, whose last column is ``d2``, with the lesser of it and the least distance to the vectors of ``parts``."""
    at, places, own_at = rows.columns.index(embedding), [rows.columns.index(k) for k in keys], rows.columns.index(own) if own else 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, groups = as_matrix(batch.column(at)), defaultdict(list)
            for k, key in enumerate(_keys([batch.column(p) for p in places], len(batch))):
                groups[key].append(k)
            best = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)
            best[np.isnan(best)] = np.inf
            mine = np.array(batch.column(own_at).to_pylist(), object) if own else None
            for shared in parts:
                for key, ids in groups.items():
                    if key not in shared.value:
                        continue
                    vectors, of = shared.value[key]
                    for i in range(0, len(ids), SLICE):
                        some = ids[i : i + SLICE]
                        for j in range(0, len(vectors), block):
                            d = squared_distances(x[some], vectors[j : j + block])
                            if own:
                                d[mine[some][:, None] == of[None, j : j + block]] = np.inf
                            best[some] = np.minimum(best[some], d.min(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.where(np.isfinite(best), best, 0.0), mask=~np.isfinite(best))], names=batch.schema.names)

    return rows.mapInArrow(search, rows.schema)


def draw_support(images: DataFrame, seeds: tuple[int, ...], n_shot: int, group: str = "category", image: str = "image_id") -> DataFrame:
    """``seed`` and the images of its support: of each group the ``n_shot`` with the least hashes of seed and image."""
    order = Window.partitionBy("seed", group).orderBy(F.md5(F.concat_ws(":", "seed", image)), image)
    drawn = images.select(F.explode(F.array(*map(F.lit, seeds))).alias("seed"), group, image)
    return drawn.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n_shot).drop("__n")


def patch_scores(
    patches: DataFrame, seeds: tuple[int, ...], n_shot: int, search: str = "exact", m: int = 16, bits: int = 4, orbit_side: int | None = None, turns: int = 0, turned_side: int = 8
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The patches of all images outside the support with ``seed`` and ``d2``; the nearest distances of the support
    patches to those of other support images; and the bank of each seed and category.

    ``patches`` has category, image_id, image_label, vec_id and embedding. The bank is written once.
    Which seeds an image supports is a small table (a row for each drawn image) that goes to the
    patches, so these are neither shuffled nor joined by their vectors. With ``orbit_side`` the bank
    holds each vector in its eight views as a square grid of that side; ``turns`` quarter turns are
    made of the grids (of ``turned_side``) of the tested patches.
    """
    normal = patches.where("image_label = 0").select("category", "image_id").distinct()
    support = draw_support(normal, seeds, n_shot)
    keys = ["seed", "category"]
    # seeds * categories * n_shot images, far fewer than the patches
    own = materialise(support.groupBy("category", "image_id").agg(F.collect_set("seed").alias("__own")), "support")
    bank = patches.join(own, ["category", "image_id"]).withColumn("seed", F.explode("__own")).drop("__own")
    if orbit_side is not None:
        bank = orbit(bank, "embedding", orbit_side).select(*bank.columns)
    bank = materialise(bank, "bank")
    known = coded_bank(bank, search, m, bits)
    every = F.array(*map(F.lit, seeds))
    left = F.when(F.col("__own").isNull(), every).otherwise(F.array_except(every, F.col("__own")))
    tests = patches.join(own, ["category", "image_id"], "left").withColumn("seed", F.explode(left)).drop("__own")
    if turns:
        tests = tests.withColumn("embedding", rotate(F.col("embedding"), turned_side, turns))
    found = bank_distances(tests, known, keys).where("d2 is not null").withColumn("d2", F.round("d2", 9))
    inner = bank_distances(bank, known, keys, own="image_id").where("d2 is not null").select(*keys, "vec_id", F.round("d2", 9).alias("d2"))
    return found, inner, bank


def evaluate(patches: DataFrame, seeds: tuple[int, ...], n_shot: int, search: str = "exact", m: int = 16, bits: int = 4, **views) -> tuple[DataFrame, DataFrame]:
    """Image scores of all images outside the support (``seed``, ``category``, ``image_id``,
    ``image_label``, ``score``), and the nearest distances of the support patches to those of
    other support images. ``views`` are those of ``patch_scores``.
    """
    found, inner, _ = patch_scores(patches, seeds, n_shot, search, m, bits, **views)
    return found.groupBy("seed", "category", "image_id", "image_label").agg(F.max("d2").alias("score")), inner


def patch_maps(found: DataFrame, side: int, patch: str = "patch", patch_label: str = "patch_label") -> DataFrame:
    """Each image's map of distances (``values``) and of labels (``labels``), row by row; images that lack a patch are left out.

    An image has ``side * side`` patches, numbered from 0.
    """
    cells = found.groupBy("seed", "category", "image_id").agg(F.sort_array(F.collect_list(F.struct(patch, "d2", patch_label))).alias("cells"))
    return cells.where(F.size("cells") == side * side).select("seed", "category", "image_id", F.col("cells.d2").alias("values"), F.col(f"cells.{patch_label}").alias("labels"))


def evaluate_whole(
    patches: DataFrame, seeds: tuple[int, ...], n_shot: int, side: int, size: int, search: str = "exact", m: int = 16, bits: int = 4, sigma: float | None = 4.0, tail: float = 0.1, alpha: float = 0.01
) -> DataFrame:
    """Per seed and category all that an evaluation reports: n_pos, n_neg, auroc, the extreme-value threshold ``tau`` of the
    support's distances (with shape and scale), fpr and fnr there, the code's error ``r_max`` and ``r_avg``, and pixel_auroc.

    ``patches`` also has ``patch`` (its place in the image) and ``patch_label``. Maps are resampled to ``size`` and
    blurred by ``sigma``.
    """
    keys = ("seed", "category")
    found, inner, bank = patch_scores(patches, seeds, n_shot, search, m, bits)
    found = materialise(found, "patch-scores")
    scores = found.groupBy(*keys, "image_id", "image_label").agg(F.max("d2").alias("score"))
    fits = gpd_thresholds(materialise(inner, "support-distances"), "d2", keys, tail, alpha).select(*keys, "shape", "scale", "tau")
    rates = rates_at(scores.join(fits, list(keys)), "score", "image_label", F.col("tau"), keys).drop("n")
    areas = pixel_auroc(patch_maps(found, side), keys, "values", "labels", upsampled(side, size, sigma)).select(*keys, "pixel_auroc")
    coded = coded_bank(bank, search, m, bits).select(*keys, "vec_id", F.col("embedding").alias("__coded"))
    error = F.sqrt(l2sq(F.col("embedding"), F.col("__coded")))
    errors = bank.join(coded, [*keys, "vec_id"]).groupBy(*keys).agg(F.max(error).alias("r_max"), F.avg(error).alias("r_avg"))
    out = auroc(scores, "score", "image_label", keys)
    for more in (fits, rates, errors, areas):  # a row for each seed and category
        out = out.join(more, list(keys), "left")
    return out


def evaluated(scores: DataFrame, inner: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Per seed and category: AUROC, the threshold at a quantile of the support's distances, FPR and FNR there."""
    keys = ("seed", "category")
    tau = inner.groupBy(*keys).agg(F.percentile("d2", quantile).alias("tau"))
    rates = rates_at(scores.join(tau, list(keys)), "score", "image_label", F.col("tau"), keys).drop("n")
    return auroc(scores, "score", "image_label", keys).join(tau, list(keys), "left").join(rates, list(keys), "left")


def distance_statistics(features: DataFrame, bank: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: how many features there are, and the mean and population deviation of their squared distances to the nearest vector of the bank."""
    found = bank_distances(features, bank, keys or []).where("d2 is not null")
    return found.agg(F.count("*").alias("n"), F.avg("d2").alias("distance_mean"), F.stddev_pop("d2").alias("distance_sd"))
