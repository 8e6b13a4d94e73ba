"""Ranking and detection metrics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.running import running_sums


def _by_score(df: DataFrame, score: str, label: str, groups: tuple[str, ...]) -> DataFrame:
    """Positives and negatives of each distinct score; counted before anything is ranked."""
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )


def auroc(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counting half; null with one class only."""
    ranked = running_sums(_by_score(df, score, label, groups), "score", {"neg_below": "neg"}, groups)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ranked.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), (wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc")
    )


def curve(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score as threshold: tp, fp (scores at or above it), and the totals."""
    by_score = _by_score(df, score, label, groups).withColumn("falling", -F.col("score"))
    above = running_sums(by_score, "falling", {"tp_above": "pos", "fp_above": "neg"}, groups)
    totals = by_score.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if groups:
        out = above.join(totals, list(groups))
    else:
        row = totals.first()
        out = above.withColumns({c: F.lit(row[c]).cast("long") for c in ("n_pos", "n_neg")})
    return out.select(
        *groups, "score", (F.col("tp_above") + F.col("pos")).alias("tp"), (F.col("fp_above") + F.col("neg")).alias("fp"), "pos", "neg", "n_pos", "n_neg"
    )


def average_precision(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Sum over distinct scores of (rise of recall) * precision."""
    return curve(df, score, label, groups).groupBy(*groups).agg(
        F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision")
    )


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    return curve(df, score, label).select("score", (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the best F1 (of several the highest)."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n_pos")
    points = curve(df, score, label).select("score", (2 * p * r / (p + r + 1e-8)).alias("f1"), p.alias("precision"), r.alias("recall"))
    best = F.max(F.struct(F.round("f1", 9).alias("f1"), "score", "precision", "recall")).alias("b")
    return points.agg(best).select(F.col("b.score").alias("threshold"), "b.f1", "b.precision", "b.recall")


def rates_at(df: DataFrame, score: str, label: str, threshold: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    """False positive and negative rates; defective is strictly above the threshold."""
    above = (F.col(score) > threshold).cast("double")
    return df.groupBy(*groups).agg(
        F.avg(F.when(F.col(label) == 0, above)).alias("fpr"), F.avg(F.when(F.col(label) == 1, 1 - above)).alias("fnr"), F.count("*").alias("n")
    )


def overlap(df: DataFrame, predicted: Column, truth: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    """IoU and Dice of two flags; 0 where their union (or intersection) is empty."""
    both, either = F.count_if(predicted & truth), F.count_if(predicted | truth)
    sizes = F.count_if(predicted) + F.count_if(truth)
    return df.groupBy(*groups).agg(
        F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(0.0)).alias("iou"), F.coalesce(2 * both / F.nullif(sizes, F.lit(0)), F.lit(0.0)).alias("dice")
    )


def confusion(df: DataFrame, score: str, label: str, threshold: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the four outcomes with accuracy, precision, recall and F1 (null where nothing divides them)."""
    above, bad = F.col(score) > threshold, F.col(label) == 1
    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*groups).agg(
        F.count_if(above & bad).alias("tp"), F.count_if(above & ~bad).alias("fp"), F.count_if(~above & bad).alias("fn"), F.count_if(~above & ~bad).alias("tn")
    )
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def tpr_at_fpr(df: DataFrame, score: str, label: str, group: str, tie: str, cap: float = 0.3) -> DataFrame:
    """Per group: share of positives met, by falling score (then rising ``tie``), before the FPR exceeds ``cap``.

    Negatives above a score are running sums over the distinct scores; only rows of one score are walked together.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(group).alias("__g"), (-F.col(score).cast("double")).alias("__falling"))
    by_score = counts.agg(F.count_if(F.col(label) == 0).alias("__neg"), F.count_if(F.col(label) == 1).alias("__pos"))
    above = running_sums(by_score, "__falling", {"__above": "__neg"}, ("__g",), totals={"n_neg": "__neg", "n_pos": "__pos"}).select("__g", "__falling", "__above", "n_neg", "n_pos")
    rows = df.select(F.col(group).alias("g"), (-F.col(score).cast("double")).alias("f"), F.col(tie).alias("t"), F.col(label).alias("y"))
    met = rows.join(above, F.col("g").eqNullSafe(F.col("__g")) & F.col("f").eqNullSafe(F.col("__falling")))
    equal = Window.partitionBy("g", "f").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    fp = F.col("__above") + F.count_if(F.col("y") == 0).over(equal)
    walked = met.where("n_pos > 0").select("g", "y", "n_pos", (F.coalesce(fp / F.nullif(F.col("n_neg"), F.lit(0)), F.lit(0.0)) <= cap).alias("within"))
    return walked.groupBy(F.col("g").alias(group)).agg((F.count_if((F.col("y") == 1) & F.col("within")) / F.max("n_pos")).alias("tpr"))


def trapezoid(points: DataFrame, x: str, y: str, groups: tuple[str, ...], out: str = "area") -> DataFrame:
    """Area under points (a bounded number of them per group) by the trapezoid rule."""
    order = Window.partitionBy(*groups).orderBy(x, y)
    strip = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return points.select(*groups, strip.alias("__strip")).groupBy(*groups).agg(F.coalesce(F.sum("__strip"), F.lit(0.0)).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    from orbweave.operators.running import average_ranks

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1 - (a + b) * x / (a + 1), key=abs)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (max(tiny, 1 + step * d, key=abs))
            c = max(tiny, 1 + step / c, key=abs)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def correlation_p_value(rho: float, n: int) -> float | None:
    """The two-sided p-value of a rank correlation over ``n`` pairs, by Student's distribution; None below three pairs."""
    if n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    a, x = (n - 2) / 2, 1 - rho * rho
    front = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5) + a * math.log(x) + 0.5 * math.log1p(-x))
    if x < (a + 1) / (a + 2.5):
        return front * _beta_fraction(a, 0.5, x) / a
    return 1 - front * _beta_fraction(0.5, a, 1 - x) / 0.5


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """``rho``, ``n`` and ``p_value`` of a rank correlation, in one row."""
    row = spearman(df, x, y).first()
    p = None if row.rho is None else correlation_p_value(row.rho, row.n)
    return df.sparkSession.createDataFrame([(row.rho, row.n, p)], "rho double, n long, p_value double")


def first_recycled(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows in ``order`` (a unique column), with their ``place``; a table with fewer is gone through again."""
    rows = df.count()
    if not rows or n <= 0:
        return df.withColumn("place", F.lit(0).cast("long")).limit(0)
    first = df.orderBy(order).limit(n)  # n rows at most are numbered in one task
    numbered = first.withColumn("__n", F.row_number().over(Window.orderBy(order)) - 1)
    places = F.sequence(F.col("__n").cast("long"), F.lit(n - 1).cast("long"), F.lit(rows).cast("long"))
    return numbered.withColumn("place", F.explode(places)).drop("__n")


def pro_area_over_scores(pixels: DataFrame, score: str, region: str, image: str, cap: float = 0.3) -> DataFrame:
    """One row: the area under the regions' mean overlap with every distinct score as a threshold.

    The false positive rate goes up to ``cap``; the area is divided by the highest rate
    reached or by ``cap``, whichever is more. ``region`` is 0 outside regions. Null
    without regions or without pixels outside them.
    """
    sizes = pixels.where(F.col(region) > 0).groupBy(image, region).agg(F.count("*").alias("__size"))
    marked = pixels.where(F.col(region) > 0).join(sizes, [image, region]).select(F.col(score).cast("double").alias("s"), F.lit(0).cast("long").alias("fp"), (1 / F.col("__size")).alias("part"))
    clean = pixels.where(F.col(region) == 0).select(F.col(score).cast("double").alias("s"), F.lit(1).cast("long").alias("fp"), F.lit(0.0).alias("part"))
    by_score = marked.unionByName(clean).groupBy("s").agg(F.sum("fp").alias("fp"), F.sum("part").alias("part")).withColumn("falling", -F.col("s"))
    n_clean, n_regions = by_score.agg(F.sum("fp")).first()[0] or 0, sizes.count()
    if not n_clean or not n_regions:
        return pixels.sparkSession.createDataFrame([(None,)], "pro_auc double")
    above = running_sums(by_score, "falling", {"fp_above": "fp", "part_above": "part"})
    # each threshold adds the strip between the point before it and its own
    x0, x1 = F.col("fp_above") / n_clean, (F.col("fp_above") + F.col("fp")) / n_clean
    y0, y1 = F.col("part_above") / n_regions, (F.col("part_above") + F.col("part")) / n_regions
    inside = above.where(x1 <= cap)
    area = inside.agg(F.sum((x1 - x0) * (y0 + y1) / 2).alias("a"), F.max(x1).alias("last"))
    return area.select((F.col("a") / F.greatest(F.col("last"), F.lit(cap))).alias("pro_auc"))
