"""Extreme-value thresholds over events and patch distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import evt
from orbweave.operators.running import quantiles
from orbweave.plans.registry import query
from orbweave.plans.vector_queries import kept_scores
from orbweave.sources.tables import load


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_type", "value")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n, value AS u FROM r WHERE i = floor(n * (1 - 0.1))""")
def evt_tail_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evt.tail_start(_events(spark, sf_dir), "value", 0.1, ("event_type",))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n, value AS u FROM r WHERE i = greatest(0, least(floor(n * (1 - 0.001)), n - 10))""")
def evt_tail_index_min10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evt.tail_start(_events(spark, sf_dir), "value", 0.001, ("event_type",), "index_min10")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS u FROM events GROUP BY 1")
def evt_tail_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evt.tail_start(_events(spark, sf_dir), "value", 0.05, ("event_type",), "percentile").withColumn("u", F.round("u", 6))


@query()
def gpd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, scale and threshold of each event type's tail."""
    return evt.gpd_thresholds(_events(spark, sf_dir), "value", ("event_type",), 0.1, 0.01)


#: A fit for each user, from the user's events: a shape of 0 for some, and none for others.
FITS = """(SELECT user_id, max(value)::DOUBLE AS u, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (count(*) % 5 - 2) / 5.0::DOUBLE END AS shape,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE avg(value) END AS scale FROM events WHERE value IS NOT NULL GROUP BY user_id) f"""


@query(f"""SELECT user_id, round(CASE WHEN shape IS NULL THEN 1.05 * u WHEN abs(shape) < 1e-5 THEN u - scale * ln(0.1) ELSE u + scale / shape * (pow(0.1, -shape) - 1) END, 6) AS tau,
    round(CASE WHEN shape IS NULL THEN 1.05 * u WHEN abs(shape) < 1e-5 THEN u - scale * ln(0.01) ELSE u + scale / shape * (pow(0.01, -shape) - 1) END, 6) AS tau_unconditional FROM {FITS}""")
def evt_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of the threshold, for a fit of each user."""
    known = F.col("user_id") % 7 != 0
    users = load(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.max("value").alias("u"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    f = users.select("user_id", "u", F.when(known, (F.col("n") % 5 - 2) / 5.0).alias("shape"), F.when(known, F.col("mean")).alias("scale"))
    args = (F.col("u"), F.col("shape"), F.col("scale"), 0.01, 0.1)
    return f.select("user_id", F.round(evt.threshold(*args), 6).alias("tau"), F.round(evt.threshold(*args, conditional=False), 6).alias("tau_unconditional"))


@query()
def bootstrap_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positive rate at each category's 95th percentile of nominal scores, with an interval."""
    scores = kept_scores(spark, sf_dir)
    tau = quantiles(scores.where("image_label = 0"), "score", {"tau": 0.95}, ("category",)).drop("n")
    counts = scores.where("image_label = 0").join(tau, "category").groupBy("category").agg(F.count_if(F.col("score") > F.col("tau")).alias("hits"), F.count("*").alias("n"))
    return evt.bootstrap_rate(counts, ("category",), "hits", "n")


@query()
def bootstrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at which an event type's values exceed their 95th percentile, by resampling its rows."""
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "event_type", "value")
    tau = quantiles(rows, "value", {"tau": 0.95}, ("event_type",)).drop("n")
    hits = rows.join(tau, "event_type").withColumn("hit", (F.col("value") > F.col("tau")).cast("int"))
    found = evt.bootstrap_rows(hits, ("event_type",), "hit", "event_id", 500)
    return found.select("event_type", "n", *[F.round(c, 9).alias(c) for c in found.columns[2:]])


#: Fixed values of theta at which the likelihood of a tail is compared.
THETAS = (-0.01, 0.05, 0.3, 1.0, 4.0)


@query(f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    u AS (SELECT event_type, value AS u, n - floor(n * 0.9)::BIGINT AS n_tail FROM r WHERE i = floor(n * 0.9)), t AS (SELECT event_type, n_tail, value - u AS x FROM r JOIN u USING (event_type) WHERE i >= floor(n * 0.9)),
    m AS (SELECT event_type, n_tail, avg(x) AS mean FROM t GROUP BY ALL), s AS (SELECT event_type, n_tail, theta, avg(ln(1 + theta * x / mean)) AS shape FROM t JOIN m USING (event_type, n_tail), (VALUES {', '.join(f'({t}::DOUBLE)' for t in THETAS)}) h(theta) GROUP BY ALL)
    SELECT event_type, n_tail, theta, round(shape, 6) AS shape, round(CASE WHEN shape / theta > 0 THEN -ln(shape / theta) - shape - 1 END, 6) AS likelihood FROM s""")
def gpd_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile likelihood of each event type's tail, whole, as its fit adds it up task by task."""
    excess, facts = evt.tail_excesses(_events(spark, sf_dir), "value", ("event_type",), 0.1)
    known = {(r.event_type,): r for r in facts.collect()}
    theta = np.array(THETAS)
    sums = evt.profile_sums(excess, {key: (r["mean"], theta) for key, r in known.items()}, ("event_type",))
    out = []
    for key, s in sums.items():
        shape = s / known[key].n_tail
        out += [(key[0], known[key].n_tail, float(t), round(float(a), 6), round(float(-np.log(a / t) - a - 1), 6)) for t, a in zip(theta, shape, strict=True)]
    return spark.createDataFrame(out, "event_type string, n_tail long, theta double, shape double, likelihood double")


@query()
def evt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: the threshold for 1 % and the share of values that exceed it."""
    rows = _events(spark, sf_dir)
    fits = evt.gpd_thresholds(rows, "value", ("event_type",), 0.1, 0.01)
    seen = rows.join(fits.select("event_type", "tau"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") > F.col("tau")).cast("double")).alias("empirical"), F.first("tau").alias("tau"))
    return seen.withColumn("error", F.abs(F.col("empirical") - 0.01))
