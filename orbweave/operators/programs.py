"""Whole reports of evaluations: thresholds side by side, ranges of scores, heat maps, fits by bits, trade-offs and timings.

Rows whose key is null take no part in reports that join by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.scalars import is_any_of
from orbweave.operators.evaluation import bank_distances
from orbweave.operators.evt import gpd_thresholds
from orbweave.operators.grids import upsample
from orbweave.operators.metrics import auroc, curve
from orbweave.operators.reports import against_reference, latency
from orbweave.operators.running import quantiles, running_sums
from orbweave.sources.files import with_fallback
from orbweave.sources.store import materialise


def nominal_scores(train: DataFrame, bank: DataFrame, keys: tuple[str, ...], image: str = "image_id") -> DataFrame:
    """``score`` of each training image: the largest of its patches' least distances to bank vectors of other images."""
    found = bank_distances(train, bank, list(keys), own=image).where("d2 is not null")
    return found.groupBy(*keys, image).agg(F.max("d2").alias("score"))


def threshold_comparison(nominal: DataFrame, tests: DataFrame, keys: tuple[str, ...], label: str = "image_label", score: str = "score", tail: float = 0.1, alpha: float = 0.01, quantile: float = 0.95) -> DataFrame:
    """Per key the extreme-value threshold and a quantile of the nominal scores, and the error rates of both.

    Columns: ``n_nominal``, ``n_test``, and tau, fpr and fnr of ``evt`` and of ``pct``. Defective
    is strictly above; a rate is 0 where its class is absent. Keys without nominal or test scores have no row.
    """
    fits = gpd_thresholds(nominal, score, keys, tail, alpha).select(*keys, F.col("n").alias("n_nominal"), F.col("tau").alias("evt_tau"))
    taus = fits.join(quantiles(nominal, score, {"pct_tau": quantile}, keys).drop("n"), list(keys))
    y = F.col(label)
    rates = []
    for kind in ("evt", "pct"):
        above = (F.col(score) > F.col(f"{kind}_tau")).cast("double")
        rates += [F.max(f"{kind}_tau").alias(f"{kind}_tau"), F.coalesce(F.avg(F.when(y == 0, above)), F.lit(0.0)).alias(f"{kind}_fpr"), F.coalesce(F.avg(F.when(y == 1, 1 - above)), F.lit(0.0)).alias(f"{kind}_fnr")]
    return tests.where(F.col(score).isNotNull() & y.isNotNull()).join(taus, list(keys)).groupBy(*keys).agg(F.max("n_nominal").alias("n_nominal"), F.count("*").alias("n_test"), *rates)


def score_ranges(scores: DataFrame, keys: tuple[str, ...], label: str = "image_label", score: str = "score") -> DataFrame:
    """Per key the least and largest score of both classes (null where a class is absent) and ``span``, from the least normal to the largest defective."""
    of = lambda y: F.when(F.col(label) == y, F.col(score))
    found = scores.groupBy(*keys).agg(F.min(of(0)).alias("normal_min"), F.max(of(0)).alias("normal_max"), F.min(of(1)).alias("defect_min"), F.max(of(1)).alias("defect_max"))
    return found.withColumn("span", F.col("defect_max") - F.col("normal_min"))


def error_share(ranges: DataFrame, errors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``ranges`` with the codes' errors and ``r_max_percent``, the largest error in percent of the span; null unless the span is above 0."""
    share = F.when(F.col("span") > 0, F.col("r_max") / F.col("span") * 100)
    return ranges.join(errors, list(keys)).withColumn("r_max_percent", share)


def sweep_report(scores: DataFrame, taus: DataFrame, pixel_areas: DataFrame, keys: tuple[str, ...], label: str = "image_label", score: str = "score") -> DataFrame:
    """Per key: image_auroc, pixel_auroc, missed defects at ``tau``, and the numbers of images."""
    missed = scores.join(taus.select(*keys, "tau"), list(keys)).groupBy(*keys).agg(F.count_if((F.col(label) == 1) & (F.col(score) <= F.col("tau"))).alias("false_negatives"))
    areas = auroc(scores, score, label, keys).select(*keys, F.col("auroc").alias("image_auroc"), F.col("n_pos").alias("total_defective"), F.col("n_neg").alias("total_good"))
    both = areas.withColumn("total_images", F.col("total_defective") + F.col("total_good"))
    return both.join(missed, list(keys), "left").join(pixel_areas.select(*keys, "pixel_auroc"), list(keys), "left")


def top_heat_maps(maps: DataFrame, keys: tuple[str, ...], side: int, size: int, k: int = 3, image: str = "image_id", values: str = "values") -> DataFrame:
    """The ``k`` images of each key with the highest score (ties by id): ``rank``, ``score``, and ``heat``, the map resampled to ``size`` and scaled to 0..1.

    A score is the map's largest value. A map of one value is 0 everywhere. Maps that are null are left out.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), image)
    scored = maps.where(F.col(values).isNotNull()).withColumn("score", F.round(F.array_max(values), 9))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    large = best.withColumn("__m", upsample(F.col(values), side, size))
    low, high = F.array_min("__m"), F.array_max("__m")
    scaled = F.transform("__m", lambda x: F.when(high - low > 1e-12, (x - low) / (high - low)).otherwise(F.lit(0.0)))
    return large.select(*keys, "rank", image, "score", scaled.alias("heat"))


def fits_by_bits(first: DataFrame, second: DataFrame, order: str, low: int = 4, high: int = 8) -> DataFrame:
    """Per category and bits: mean and population deviation of shape and scale over the seeds, ``n_seeds``, and
    ``sign_flip``, whether the mean shape is above 0 at ``low`` bits and below 0 at ``high``.

    ``first`` and ``second`` have category, seed, bits, shape and scale; seeds that a category lacks in
    ``first`` come from ``second``. Bits may be a number or a text like ``4-bit``. Of several rows of a setting the first
    by ``order`` counts; fits without shape or scale count nowhere. The flip is null unless both have a fit.
    """
    depth = F.coalesce(*[F.when(is_any_of(F.col("bits"), b, f"{b}-bit"), F.lit(b)) for b in (low, high)])
    rows = with_fallback(first, second, ["category", "seed"]).withColumn("bit_depth", depth).where("bit_depth is not null")
    one = rows.groupBy("category", "seed", "bit_depth").agg(F.min_by(F.struct("shape", "scale"), order).alias("fit")).select("category", "bit_depth", "fit.*")
    stats = [f(c).alias(f"{c}_{name}") for c in ("shape", "scale") for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    table = one.where("shape is not null and scale is not null").groupBy("category", "bit_depth").agg(*stats, F.count("*").alias("n_seeds"))
    at = lambda b: F.max(F.when(F.col("bit_depth") == b, F.col("shape_mean")))
    flips = table.groupBy(F.col("category").alias("__c")).agg(((at(low) > 0) & (at(high) < 0)).alias("sign_flip"))
    return table.join(flips, F.col("category").eqNullSafe(F.col("__c"))).drop("__c")


def trade_off(quality: DataFrame, cost: DataFrame, group: str, setting: str, reference: object) -> DataFrame:
    """Settings of each group with ``quality`` and ``cost``, and against the reference setting: the change of quality
    (absolute and in percent) and the reduction of cost (likewise). Percentages of nothing are null.

    ValueError if the two tables share no setting.
    """
    both = quality.join(cost, [group, setting])
    if both.isEmpty():
        raise ValueError(f"no {setting} has both quality and cost")
    base = F.col(setting) == reference
    better = against_reference(both, [group], base, "quality").select(group, setting, "quality", "cost", F.col("delta").alias("quality_change"), (-F.col("drop_percent")).alias("quality_percent"))
    return against_reference(better, [group], base, "cost").select(*better.columns, (-F.col("delta")).alias("cost_reduction"), F.col("drop_percent").alias("cost_percent"))


def breakdown(timings: DataFrame, run: str, item: str, stage: str, ms: str, warm_up: int = 1, total: str = "total") -> DataFrame:
    """Latency of each stage and of whole items (``total``) without the first ``warm_up`` items of each run.

    Items are numbered from 0 in their run. ``share_percent`` is the stage's part of the mean total, ``per_second``
    how many there are in a second. Timings that are null count nowhere.
    """
    warm = timings.where((F.col(item) >= warm_up) & F.col(ms).isNotNull()).select(run, item, F.col(stage).cast("string").alias(stage), F.col(ms).cast("double").alias(ms))
    whole = warm.groupBy(run, item).agg(F.sum(ms).alias(ms)).withColumn(stage, F.lit(total))
    by_stage = latency(warm.unionByName(whole), stage, ms)
    return against_reference(by_stage, [], F.col(stage) == total, "mean_ms").select(*by_stage.columns, (F.col("mean_ms") / F.nullif("reference", F.lit(0.0)) * 100).alias("share_percent"), (1_000 / F.nullif("mean_ms", F.lit(0.0))).alias("per_second"))


def concurrency(runs: DataFrame, tier: str, stream: str, began_us: str, ended_us: str) -> DataFrame:
    """Per tier of concurrent streams: their number, images, wall seconds from the first begin to the last end, images a
    second, milliseconds an image, and the 95th percentile over the streams of their own milliseconds an image.

    ``runs`` has a row for each image with its begin and end in microseconds. Rows that lack either are left out.
    """
    known = runs.where(F.col(began_us).isNotNull() & F.col(ended_us).isNotNull())
    streams = known.groupBy(tier, stream).agg(F.count("*").alias("n"), F.min(began_us).alias("b"), F.max(ended_us).alias("e")).withColumn("own_ms", (F.col("e") - F.col("b")) / 1_000 / F.col("n"))
    wall = (F.max("e") - F.min("b")) / 1_000_000
    tiers = streams.groupBy(tier).agg(F.count("*").alias("n_streams"), F.sum("n").alias("n_images"), wall.alias("wall_seconds"))
    at = quantiles(streams, "own_ms", {"p95_ms": 0.95}, (tier,)).select(F.col(tier).alias("__t"), "p95_ms")
    seconds = F.nullif("wall_seconds", F.lit(0.0))
    out = tiers.withColumns({"per_second": F.col("n_images") / seconds, "mean_ms": F.col("wall_seconds") * 1_000 / F.col("n_images")})
    return out.join(at, F.col(tier).eqNullSafe(F.col("__t")), "left").drop("__t")


def compare_by_position(a: DataFrame, b: DataFrame, keys: list[str], position: str, value: str, first: int = 3) -> DataFrame:
    """Per key whether two sequences are equal: ``n_first``, ``n_second``, ``n_different`` places, ``equal``, and ``differing``, the first such places.

    A place that only one of them has differs; nulls are equal to each other. ``position`` is unique within a key on either side.
    """
    left = a.select(*keys, position, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*keys, position, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = left.join(right, [*keys, position], "full")
    differs = F.col("__in_a").isNull() | F.col("__in_b").isNull() | ~F.col("__a").eqNullSafe(F.col("__b"))
    by_key = both.withColumn("__d", differs).groupBy(*keys).agg(F.count("__in_a").alias("n_first"), F.count("__in_b").alias("n_second"), F.count_if("__d").alias("n_different"))
    order = Window.partitionBy(*keys).orderBy(position)
    places = both.where(differs).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= first).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(position)), ",").alias("differing"))
    return by_key.join(places, keys, "left").withColumns({"equal": F.col("n_different") == 0, "differing": F.coalesce("differing", F.lit(""))})


def next_names(existing: DataFrame, items: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """``items`` with ``new_name``: its group and a number that goes on after the highest one that an existing name ``<group>_<number>`` ends with.

    Items of a group are numbered by ``order``, a unique number; a group without such names begins at 1. Numbers are running
    counts, so no task gathers a group.
    """
    number = F.regexp_extract(name, r"_(\d+)$", 1).try_cast("long")
    highest = existing.where(number.isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.max(number).alias("__high"))
    counted = running_sums(items.withColumn("__one", F.lit(1).cast("long")), order, {"__before": "__one"}, (group,))
    out = counted.join(highest, F.col(group).eqNullSafe(F.col("__g")), "left")
    new = F.coalesce("__high", F.lit(0).cast("long")) + F.col("__before") + 1
    return out.withColumn("new_name", F.concat(F.col(group), F.lit("_"), new.cast("string"))).drop("__g", "__high", "__one", "__before")


def metrics_of(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = (), over: float = 0.5) -> DataFrame:
    """All figures of a ranking, per group: auroc, average_precision, the best f1 with its threshold, precision and recall, and
    detection_rate and false_positive_rate, the shares of all rows with a score above ``over`` (and label 0).

    Of several thresholds with the best F1 the highest counts. Rows that lack score or label are left out.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = materialise(curve(known, score, label, groups), "curve")
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif("n_pos", F.lit(0))
    f1 = F.round(F.coalesce(2 * p * r / (p + r + 1e-8), F.lit(0.0)), 9)
    # a positive loses to the negatives above it, and half to those with its score
    lost = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    out = points.groupBy(*groups).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        (1 - lost / F.nullif(F.max("n_pos") * F.max("n_neg"), F.lit(0))).alias("auroc"),
        F.sum(F.col("pos") / F.nullif("n_pos", F.lit(0)) * p).alias("average_precision"),
        F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"))).alias("__b"),
    )
    above = F.col(score) > over
    rates = known.groupBy(*groups).agg(F.avg(above.cast("double")).alias("detection_rate"), F.avg((above & (F.col(label) == 0)).cast("double")).alias("false_positive_rate"))
    out = out.join(rates, list(groups)) if groups else out.crossJoin(F.broadcast(rates))  # a row for each group
    return out.select(*groups, "n_pos", "n_neg", "auroc", "average_precision", "__b.f1", "__b.threshold", "__b.precision", "__b.recall", "detection_rate", "false_positive_rate")
