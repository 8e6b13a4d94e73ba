"""Structured Streaming over ``events``: what is there is drained into a table and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.plans.registry import query
from orbweave.plans.vector_queries import L2SQ
from orbweave.sources.store import materialise, shared_dir
from orbweave.sources.tables import load
from orbweave.streaming import events as E
from orbweave.streaming import state


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    at = f"{shared_dir(spark)}/orbweave/{name}-{uuid.uuid4().hex}"
    return E.drain(stream, f"{at}/rows", f"{at}/checkpoint")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.read_events(spark, sf_dir)


#: Windows are given out once the watermark (last time less ten minutes) has passed their end.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _windows(df: DataFrame) -> DataFrame:
    return df.select(F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "event_type", "n", F.round("total", 4).alias("total"), "top")


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY 1, 2)
    SELECT epoch(s)::BIGINT AS start_s, epoch(s)::BIGINT + 3600 AS end_s, event_type, n, total, top FROM w WHERE s + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_drained(spark, E.tumbling(_events(spark, sf_dir)), "tumbling"))


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS s, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events, range(0, 2) r(k) GROUP BY 1, 2)
    SELECT epoch(s)::BIGINT AS start_s, epoch(s)::BIGINT + 3600 AS end_s, event_type, n, total, top FROM w WHERE s + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_drained(spark, E.sliding(_events(spark, sf_dir)), "sliding"))


@query(f"""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o),
    s AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k)
    SELECT floor(epoch(s))::BIGINT AS start_s, floor(epoch(e))::BIGINT AS end_s, user_id, n, total FROM s WHERE e <= {CLOSED}""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(spark, E.sessions(_events(spark, sf_dir)), "session")
    return out.select(F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "user_id", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT event_id, event_type, user_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, E.deduplicated(_events(spark, sf_dir)), "dedupe").select("event_id", "event_type", "user_id")


@query("SELECT event_id, event_type, value FROM events WHERE value > 100")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, E.alarms(_events(spark, sf_dir), 100.0), "score").select("event_id", "event_type", "value")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT *, coalesce(max(i) FILTER (value <= 50) OVER (PARTITION BY event_type ORDER BY i), 0) AS reset FROM o)
    SELECT event_type, event_id FROM g WHERE value > 50 AND (i - reset) % 3 = 0""")
def stream_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three values above 50 per event type, with state kept between batches."""
    at = f"{shared_dir(spark)}/orbweave/streaks-{uuid.uuid4().hex}"
    return E.drain_streaks(_events(spark, sf_dir), at, f"{at}/checkpoint", 50.0)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY user_id) AS seen FROM events)
    SELECT user_id, any_value(seen) AS seen, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS event_ids FROM o WHERE i <= 5 GROUP BY 1""")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user, kept as state."""
    out = _drained(spark, E.recent(_events(spark, sf_dir), "user_id"), "recent")
    now = out.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max_by("event_ids", "seen").alias("event_ids"))
    return now.withColumn("event_ids", F.array_join(F.col("event_ids").cast("array<string>"), ","))


@query(f"""WITH p AS (SELECT vec_id, 'c' || (vec_id % 3) AS category, embedding::DOUBLE[] AS v, vec_id % 20 = 0 AS known FROM embeddings)
    SELECT a.vec_id, a.category, round(min({L2SQ.format(a="a.v", b="b.v")}), 6) AS score FROM p a JOIN p b USING (category) WHERE b.known AND NOT a.known GROUP BY 1, 2""")
def stream_bank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a stream against a bank of those whose id is divisible by 20, by category."""
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    category = F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("category")
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/embedding[s].parquet").where("vec_id % 20 <> 0")
    bank = load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    at = f"{shared_dir(spark)}/orbweave/bank-scores-{uuid.uuid4().hex}"
    out = E.drain_scored(arriving.select("vec_id", category, "embedding"), bank.select("vec_id", category, "embedding"), ["category"], f"{at}/rows", f"{at}/checkpoint")
    return out.select("vec_id", "category", F.round("score", 6).alias("score"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg((value > 100)::INTEGER) * 100, 6) AS alarm_percent FROM events GROUP BY 1, 2")
def hourly_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the dashboard: counts and share of alarms by hour."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("value") > 100).cast("double")) * 100, 6).alias("alarm_percent")
    )


@query()
def stream_recent_until_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user since the user was last idle for a day, in state that goes with it."""
    out = _drained(spark, state.recent_until_idle(_events(spark, sf_dir), "user_id", idle_minutes=1_440), "until-idle")
    now = out.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max_by("event_ids", "seen").alias("event_ids"))
    return now.withColumn("event_ids", F.array_join(F.col("event_ids").cast("array<string>"), ","))


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, state.sketched(_events(spark, sf_dir), "event_type", "12 hours"), "sketches")


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING s + INTERVAL 12 HOUR <= {CLOSED})
    SELECT epoch(s)::BIGINT AS start_s, event_type, n, n AS sketched FROM w""")
def stream_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a stream with a sketch of their values: how many it has taken in."""
    w = _sketches(spark, sf_dir)
    return w.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.kll_sketch_get_n_double("sketch").alias("sketched"))


@query()
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose values differ from those of the window before, and the threshold that the last ten give."""
    w = materialise(_sketches(spark, sf_dir), "windows")
    limits = state.adaptive_thresholds(w, "event_type", back=10).drop("n")
    return state.drift(w, "event_type").join(limits, ["start", "event_type"]).select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", "drifted", (F.col("threshold").isNotNull()).alias("has_threshold"))
