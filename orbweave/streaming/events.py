"""Event-time monitoring with Structured Streaming.

Each function takes a streaming (or batch) DataFrame of events with a timestamp and
returns one; the caller chooses the sink. State is bounded by the watermark, but that of
``recent``, which is bounded by the keys (``state.recent_until_idle`` lets idle ones go).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbweave.operators.evaluation import bank_distances
from orbweave.operators.running import bucket_of
from orbweave.sources.store import scratch

WATERMARK = "10 minutes"


def read_events(spark: SparkSession, sf_dir: str, streaming: bool = True) -> DataFrame:
    """The table ``events`` with ``ts`` as a zoned timestamp (UTC session)."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream if streaming else spark.read
    folder = path if not streaming else f"{sf_dir}/event[s].parquet"  # a file source wants a folder or a pattern
    rows = reader.schema(schema).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _summary() -> list:
    return [F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")]


def tumbling(events: DataFrame, length: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    return _flat(events.withWatermark("ts", watermark).groupBy(F.window("ts", length), "event_type").agg(*_summary()))


def sliding(events: DataFrame, length: str = "1 hour", step: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return _flat(events.withWatermark("ts", watermark).groupBy(F.window("ts", length, step), "event_type").agg(*_summary()))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Runs of a user's events with pauses below ``gap``."""
    grouped = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(*_summary())
    return _flat(grouped)


def deduplicated(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The first row of each event id (within the watermark when streaming)."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def alarms(events: DataFrame, limit: float) -> DataFrame:
    """Events whose value is above a threshold: stateless scoring."""
    return events.where(F.col("value") > limit).select("event_id", "ts", "event_type", "value")


def scored(vectors: DataFrame, bank: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """A stream of vectors with ``score``, the least squared distance to a vector of ``bank`` with the same keys.

    The bank is a table; all of it goes to each task, and rows pass as they come (``drain_scored`` holds one part at a time).
    Rows without a vector, or whose keys the bank lacks, have no score and are left out.
    """
    return bank_distances(vectors, bank, keys, embedding=embedding).where("d2 is not null").withColumnRenamed("d2", "score")


def drain_scored(stream: DataFrame, bank: DataFrame, keys: list[str], path: str, checkpoint: str, embedding: str = "embedding") -> DataFrame:
    """Run ``scored`` over what is there now into a Parquet table without the vectors, and read that.

    Each batch of the stream is a table, so its rows are written between the parts of the bank and a
    task holds one part, however large the bank; the bank is read for each batch. A batch that
    is run again writes the same, as it writes under its own number.
    """
    spark = stream.sparkSession
    schema = T.StructType([f for f in stream.schema if f.name not in (embedding, "d2")]).add("score", "double")

    def one(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            scored(batch, bank, keys, embedding).drop(embedding).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    none = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    none.write.mode("ignore").parquet(f"{path}/none")  # a stream without rows has no batch
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def recent(events: DataFrame, key: str, size: int = 5) -> DataFrame:
    """Per key and trigger: how many events were seen, and the ids of the last ``size`` by time.

    The state of a key is ``size`` pairs of time and id, so batches are read one at a time
    and in any order. Events without a time or an id only count. The row of a key with the
    largest ``seen`` is what holds now.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, times, ids = state.get if state.exists else (0, [], [])
        last = list(zip(times, ids, strict=True))
        for rows in batches:
            seen += len(rows)
            known = rows.dropna()
            new = zip(known["us"].astype("int64"), known["event_id"].astype("int64"), strict=True)
            last = heapq.nlargest(size, [*last, *((int(t), int(e)) for t, e in new)])
        state.update((seen, [t for t, _ in last], [e for _, e in last]))
        yield pd.DataFrame({key: [group[0]], "seen": [seen], "event_ids": [[e for _, e in last]]})

    rows = events.select(key, F.unix_micros("ts").alias("us"), "event_id")
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, seen long, event_ids array<long>", "seen long, times array<long>, ids array<long>", "append", GroupStateTimeout.NoTimeout)


def streaks(events: DataFrame, limit: float, least: int = 3, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Where an event type has ``least`` values above ``limit`` in a row (by time, id and value), in a batch.

    Returns a row of ``event_type`` and ``event_id`` for each, and the runs that are still
    open at the end (``event_type``, ``run``). ``runs`` has those that the batch begins with. A
    run ends at a null value; events without a time come first. Time is cut into buckets, so that
    no task walks an event type: windows count within a bucket, and what lies before it is added
    from a table with a row per bucket.
    """
    over = F.coalesce(F.col("value") > limit, F.lit(False))
    rows = events.select("event_type", "event_id", "value", F.unix_micros("ts").alias("us"), over.cast("long").alias("over"))
    rows = rows.withColumn("bucket", bucket_of(rows, "us"))
    so_far = Window.partitionBy("event_type", "bucket").orderBy("us", "event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("overs", F.sum("over").over(so_far))
    base = F.when(F.col("over") == 0, F.col("overs"))  # how many were over the limit when the last run ended
    counted = counted.withColumn("base", F.max(base).over(so_far))
    ends = counted.groupBy("event_type", "bucket").agg(F.sum("over").alias("overs"), F.max("base").alias("base"))
    before = Window.partitionBy("event_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("overs_before", F.coalesce(F.sum("overs").over(before), F.lit(0)))
    offsets = offsets.withColumn("base_before", F.max(F.col("overs_before") + F.col("base")).over(before))
    begun = runs or events.sparkSession.createDataFrame([], "event_type string, run long")
    offsets = offsets.join(begun.select(F.col("event_type").alias("type"), "run"), F.col("event_type").eqNullSafe(F.col("type")), "left").drop("type")
    start = F.coalesce(F.col("base_before"), -F.coalesce("run", F.lit(0)))
    places = offsets.select(F.col("event_type").alias("type"), F.col("bucket").alias("at"), "overs_before", start.alias("start"))
    placed = counted.join(places, F.col("event_type").eqNullSafe(F.col("type")) & (F.col("bucket") == F.col("at")))
    length = F.col("overs_before") + F.col("overs") - F.coalesce(F.col("overs_before") + F.col("base"), F.col("start"))
    found = placed.where((F.col("over") == 1) & (length % least == 0)).select("event_type", "event_id")
    last = offsets.groupBy("event_type").agg(F.max(F.col("overs_before") + F.col("overs")).alias("n"), F.max(F.col("overs_before") + F.col("base")).alias("base"), F.first("run").alias("run"))
    now = last.select("event_type", ((F.col("n") - F.coalesce(F.col("base"), -F.coalesce("run", F.lit(0)))) % least).alias("run"))
    idle = begun.join(last.select(F.col("event_type").alias("type")), F.col("event_type").eqNullSafe(F.col("type")), "left_anti")
    return found, now.unionByName(idle)


def drain_streaks(stream: DataFrame, path: str, checkpoint: str, limit: float, least: int = 3, delay_s: int | None = None) -> DataFrame:
    """Run ``streaks`` over what is there now, batch by batch, into a Parquet table, and read that.

    Each batch writes its rows and the runs that are open after it under its own number, so
    a batch that is run again writes the same. With ``delay_s`` events wait until they are
    that many seconds behind the latest one, so late events take their place by time; events behind
    what was already given out are left out, and the last ``delay_s`` seconds wait for the next run.
    Without it each batch is taken as later than those before.
    """
    spark, kind = stream.sparkSession, "event_type string, event_id long, batch long"

    def at(table: str, number: int) -> str:
        return f"{path}/{table}/batch={number}"

    def one(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        ready = batch
        if delay_s is not None:
            held = spark.read.schema(batch.schema).parquet(at("held", number - 1)) if number else batch.limit(0)
            before = spark.read.schema("until long").parquet(at("until", number - 1)).first().until if number else None
            latest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
            until = max([t for t in (before, None if latest is None else latest - delay_s * 1_000_000) if t is not None], default=None)
            on_time = batch if before is None else batch.where(F.col("ts").isNull() | (F.unix_micros("ts") > before))
            waiting = held.unionByName(on_time)
            behind = F.col("ts").isNull() | (F.unix_micros("ts") <= F.lit(until).cast("long"))
            ready = waiting.where(behind)
            waiting.where(~F.coalesce(behind, F.lit(False))).write.mode("overwrite").parquet(at("held", number))
            spark.createDataFrame([(until,)], "until long").coalesce(1).write.mode("overwrite").parquet(at("until", number))
        runs = spark.read.schema("event_type string, run long").parquet(at("runs", number - 1)) if number else None
        found, now = streaks(ready, limit, least, runs)
        found.write.mode("overwrite").parquet(at("rows", number))
        now.write.mode("overwrite").parquet(at("runs", number))
        batch.unpersist()

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).parquet(f"{path}/rows").drop("batch")


def _flat(windows: DataFrame) -> DataFrame:
    return windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in windows.columns if c != "window"])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table, and read that."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
