"""State that ends: the last events of a key until it is idle, and sketches of windows for drift.

``recent_until_idle`` keeps its state with ``transformWithState``, which needs the RocksDB
state store; ``use_rocksdb`` sets it for the session.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

#: A sketch of K items misses a rank by at most this share, with 99 % of confidence.
K = 200
RANK_ERROR = 0.0165
#: Quantiles of a window that stand for its distribution when two are compared.
STEPS = 200
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class RecentEvents(StatefulProcessor):
    """A key's last ``size`` events by time and id, until the watermark is ``idle_ms`` past the last of them."""

    def __init__(self, key: str, kind: DataType, size: int, idle_ms: int):
        self.key, self.kind, self.size, self.idle_ms = key, kind, size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recent", "seen long, times array<long>, ids array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, times, ids = self.state.get() if self.state.exists() else (0, [], [])
        last = list(zip(times, ids, strict=True))
        for batch in rows:
            seen += len(batch)
            known = batch.dropna()
            new = zip(known["us"].astype("int64"), known["event_id"].astype("int64"), strict=True)
            last = heapq.nlargest(self.size, [*last, *((int(t), int(e)) for t, e in new)])
        self.state.update((seen, [t for t, _ in last], [e for _, e in last]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a key without any time is kept from the watermark on
        begin = last[0][0] // 1000 if last else max(0, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(begin + self.idle_ms)
        yield pd.DataFrame({self.key: [key[0]], "seen": [seen], "event_ids": [[e for _, e in last]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def recent_until_idle(events: DataFrame, key: str, size: int = 5, idle_minutes: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """Per key and trigger: how many events were ``seen`` since the key was last idle, and the ids of the last ``size`` by time.

    Late events within the watermark take their place by time; those behind it are left out.
    The state of a key goes once the watermark is ``idle_minutes`` past its last event.
    """
    use_rocksdb(events.sparkSession)
    field = events.schema[key]
    # the watermark holds on the time itself, which the state does not read
    rows = events.withWatermark("ts", watermark).select(key, "ts", F.unix_micros("ts").alias("us"), "event_id")
    processor = RecentEvents(key, field.dataType, size, idle_minutes * 60_000)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {field.dataType.simpleString()}, seen long, event_ids array<long>", "Append", "EventTime")


def sketched(events: DataFrame, group: str, length: str = "1 hour", value: str = "value", watermark: str = "10 minutes") -> DataFrame:
    """Per window and group: ``start``, ``n`` and ``sketch`` (quantiles of the values); its state is a sketch, however many rows there are."""
    known = events.where(F.col(value).isNotNull() & ~F.isnan(value))
    per = known.withWatermark("ts", watermark).groupBy(F.window("ts", length), group)
    return per.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("sketch")).select(F.col("window.start").alias("start"), group, "n", "sketch")


def drift(windows: DataFrame, group: str, alpha: float = 0.01) -> DataFrame:
    """Each window of ``sketched`` (a table) against the one before of its group: ``distance``, ``critical`` and ``drifted``.

    The distance is the largest difference of the two distribution functions at the quantiles of
    either; beyond the critical value of Kolmogorov and Smirnov's test at ``alpha``, with the
    error of both sketches added, the values have changed. Null for the first window.
    """
    order = Window.partitionBy(group).orderBy("start")  # a row a window
    pairs = windows.withColumns({"b_n": F.lag("n").over(order), "b": F.lag("sketch").over(order)})
    points = F.array(*[F.lit((k + 0.5) / STEPS) for k in range(STEPS)])
    there = pairs.withColumns({"own": F.kll_sketch_get_quantile_double("sketch", points), "other": F.kll_sketch_get_quantile_double("b", points)})
    upto = lambda values, x: F.size(F.filter(values, lambda v: v <= x)) / F.lit(float(STEPS))
    gap = lambda x: F.abs(upto(F.col("own"), x) - upto(F.col("other"), x))
    gaps = F.transform(F.array_union("own", "other"), gap)
    scale = math.sqrt(-0.5 * math.log(alpha / 2))
    critical = F.lit(scale) * F.sqrt((F.col("n") + F.col("b_n")) / (F.col("n").cast("double") * F.col("b_n"))) + 2 * (RANK_ERROR + 1 / STEPS)
    made = there.withColumn("distance", F.when(F.col("b").isNotNull(), F.array_max(gaps))).withColumn("critical", F.when(F.col("b").isNotNull(), critical))
    return made.select("start", group, "n", "distance", "critical", (F.col("distance") > F.col("critical")).alias("drifted"))


def adaptive_thresholds(windows: DataFrame, group: str, share: float = 0.99, back: int = 24) -> DataFrame:
    """Per window and group the value that a ``share`` of those of the ``back`` windows before it did not exceed; null for the first."""
    numbered = windows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("start")))  # a row a window
    used = numbered.select(group, "sketch", F.explode(F.sequence(F.col("k") + 1, F.col("k") + back)).alias("k"))
    merged = used.groupBy(group, "k").agg(F.kll_merge_agg_double("sketch", K).alias("merged"))
    met = numbered.join(merged, [group, "k"], "left")
    return met.select("start", group, "n", F.kll_sketch_get_quantile_double("merged", F.lit(share)).alias("threshold"))
