"""Ranking metrics with the documents' length or the score of an image as the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import metrics as M
from orbweave.operators.running import quantiles
from orbweave.plans.registry import query
from orbweave.sources.tables import load

JOINED = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"
CURVE = f"""WITH j AS ({JOINED}), s AS (SELECT n_chars::DOUBLE AS score, sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg FROM j GROUP BY 1),
    c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM s)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table is the smaller side of the join."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id")


def _auc_sql(groups: str) -> str:
    part = f"PARTITION BY {groups}" if groups else ""
    same = f"PARTITION BY {groups}, n_chars" if groups else "PARTITION BY n_chars"
    return f"""WITH j AS ({JOINED}), r AS (SELECT *, rank() OVER ({part} ORDER BY n_chars) + (count(*) OVER ({same}) - 1) / 2.0 AS r FROM j)
    SELECT {groups + ',' if groups else ''} sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg,
    round((sum(quality * r) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)), 6) AS auroc FROM r {'GROUP BY ' + groups if groups else ''}"""


@query(_auc_sql(""))
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(labelled(spark, sf_dir), "n_chars", "quality").withColumn("auroc", F.round("auroc", 6))


@query(_auc_sql("lang"))
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(labelled(spark, sf_dir), "n_chars", "quality", ("lang",)).withColumn("auroc", F.round("auroc", 6))


@query(CURVE + " SELECT round(sum(pos / n_pos * (tp / (tp + fp))), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(labelled(spark, sf_dir), "n_chars", "quality").withColumn("average_precision", F.round("average_precision", 6))


@query(CURVE + """, f AS (SELECT score AS threshold, round(2 * (tp / (tp + fp)) * (tp / n_pos) / (tp / (tp + fp) + tp / n_pos + 1e-8), 9) AS f1, tp / (tp + fp) AS p, tp / n_pos AS r FROM c)
    SELECT threshold, round(f1, 6) AS f1, round(p, 6) AS precision, round(r, 6) AS recall FROM f ORDER BY f.f1 DESC, threshold DESC LIMIT 1""")
def pr_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_f1(labelled(spark, sf_dir), "n_chars", "quality").select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


@query(CURVE + " SELECT score, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_points(labelled(spark, sf_dir), "n_chars", "quality").select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"""WITH j AS ({JOINED}) SELECT source, round(coalesce(count(*) FILTER (n_chars > 1500 AND quality = 1) / nullif(count(*) FILTER (n_chars > 1500 OR quality = 1), 0), 0), 6) AS iou,
    round(coalesce(2.0 * count(*) FILTER (n_chars > 1500 AND quality = 1) / nullif(count(*) FILTER (n_chars > 1500) + count(*) FILTER (quality = 1), 0), 0), 6) AS dice FROM j GROUP BY 1""")
def iou_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.overlap(labelled(spark, sf_dir), F.col("n_chars") > 1500, F.col("quality") == 1, ("source",))
    return out.select("source", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query(f"""WITH j AS ({JOINED}), c AS (SELECT source, count(*) FILTER (n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1500 AND quality = 0) AS fp,
    count(*) FILTER (n_chars <= 1500 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 1500 AND quality = 0) AS tn FROM j GROUP BY 1)
    SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
    round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.confusion(labelled(spark, sf_dir), "n_chars", "quality", F.lit(1500), ("source",))
    return out.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""WITH j AS ({JOINED}), t AS (SELECT quantile_cont(n_chars, 0.95) AS tau FROM j WHERE quality = 0)
    SELECT round(avg((n_chars > tau)::INTEGER) FILTER (quality = 0), 6) AS fpr, round(avg((n_chars <= tau)::INTEGER) FILTER (quality = 1), 6) AS fnr, count(*) AS n FROM j, t""")
def fpr_fnr_at_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at the 95th percentile of the nominal scores."""
    rows = labelled(spark, sf_dir)
    tau = quantiles(rows.where("quality = 0"), "n_chars", {"tau": 0.95}).first().tau
    return M.rates_at(rows, "n_chars", "quality", F.lit(tau)).select(F.round("fpr", 6).alias("fpr"), F.round("fnr", 6).alias("fnr"), "n")


@query(f"""WITH j AS ({JOINED}), s AS (SELECT *, n_chars / (SELECT max(n_chars) FROM documents JOIN labels USING (doc_id)) AS v FROM j)
    SELECT round(avg((v > 0.5)::INTEGER), 6) AS detection_rate, round(avg((v > 0.5 AND toxic = 0)::INTEGER), 6) AS false_positive_rate, count(*) AS n FROM s""")
def metrics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and false detections as shares of all rows, at half of the highest score."""
    rows = labelled(spark, sf_dir)
    top = rows.agg(F.max("n_chars")).first()[0]
    over = F.col("n_chars") / F.lit(top) > 0.5
    return rows.agg(
        F.round(F.avg(over.cast("double")), 6).alias("detection_rate"), F.round(F.avg((over & (F.col("toxic") == 0)).cast("double")), 6).alias("false_positive_rate"), F.count("*").alias("n")
    )


@query(f"""WITH j AS ({JOINED}), w AS (SELECT source, toxic, sum(1 - toxic) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS fp,
    sum(1 - toxic) OVER (PARTITION BY source) AS nn, sum(toxic) OVER (PARTITION BY source) AS np FROM j)
    SELECT source, round(count(*) FILTER (toxic = 1 AND fp / nn <= 0.3) / max(np), 6) AS tpr FROM w WHERE np > 0 GROUP BY 1""")
def tpr_at_fpr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tpr_at_fpr(labelled(spark, sf_dir), "n_chars", "toxic", "source", "doc_id").withColumn("tpr", F.round("tpr", 6))


@query(f"""WITH j AS ({JOINED}), r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY doc_id) AS b FROM j)
    SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spearman(labelled(spark, sf_dir), "n_chars", "doc_id").withColumn("rho", F.round("rho", 6))


@query(f"""WITH j AS ({JOINED}), g AS (SELECT i, i * 100.0 AS t FROM range(0, 60) r(i))
    SELECT i::INTEGER AS step, count(*) FILTER (n_chars >= t AND quality = 1) AS tp, count(*) FILTER (n_chars >= t AND quality = 0) AS fp FROM g, j GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at 60 thresholds: each row is counted once, at the highest it reaches."""
    from orbweave.operators.grids import threshold_sweep as sweep

    rows = labelled(spark, sf_dir).withColumn("s", F.least(F.col("n_chars") / 5900, F.lit(1.0))).withColumn("one", F.lit(1))
    # steps of 100 characters are even steps over 0..1 of the scaled score, compared as whole numbers
    step = F.least(F.floor(F.col("n_chars") / 100), F.lit(59)) / 59
    out = sweep(rows.withColumn("s", step), "s", 60, ["one"], {"tp": F.count_if(F.col("quality") == 1), "fp": F.count_if(F.col("quality") == 0)})
    return out.select("step", "tp", "fp")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.operators.reports import latency

    out = latency(load(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("SELECT l_shipmode_like AS tier, count(*) AS n, round(count(*) / sum(l_quantity), 6) AS throughput, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM (SELECT *, l_linenumber AS l_shipmode_like FROM lineitem) GROUP BY 1")
def throughput_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    rates = rows.groupBy(F.col("l_linenumber").alias("tier")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum("l_quantity"), 6).alias("throughput"))
    at = quantiles(rows.withColumnRenamed("l_linenumber", "tier"), "l_extendedprice", {"p95": 0.95}, ("tier",))
    return rates.join(at.select("tier", F.round("p95", 4).alias("p95")), "tier")


@query("SELECT event_type, round(sum(value) / (SELECT sum(value) FROM events) * 100, 6) AS share_percent FROM events GROUP BY 1")
def stage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    total = by_type.agg(F.sum("v")).first()[0]
    return by_type.select("event_type", F.round(F.col("v") / F.lit(total) * 100, 6).alias("share_percent"))


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT least(floor((value - lo) / (hi - lo) * 50), 49)::INTEGER AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    low, high = rows.agg(F.min("value"), F.max("value")).first()
    cell = F.least(F.floor((F.col("value") - low) / (high - low) * 50), F.lit(49)).cast("int")
    return rows.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT round(quantile_cont(value, 0.005), 6) AS p005, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p975 FROM events")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"p005": 0.005, "p05": 0.05, "p50": 0.5, "p975": 0.975}
    return quantiles(load(spark, sf_dir, "events"), "value", at).select(*[F.round(k, 6).alias(k) for k in at])
