import random
from datetime import datetime

from pyspark.sql import functions as F

from orbweave.streaming import events as E

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def write(spark, path, rows):
    made = [(i, datetime.fromisoformat(t), u, k, v) for i, t, u, k, v in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_and_repeated_ids(spark, tmp_path):
    """A row behind the watermark is left out, a repeated id counts once."""
    path = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    out = lambda name, s: E.drain(s, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint")
    batches = [
        [(1, "2024-01-01 00:05:00", 1, "a", 1.0), (1, "2024-01-01 00:05:00", 1, "a", 1.0)],
        [(2, "2024-01-01 02:00:00", 1, "a", 2.0)],
        [(3, "2024-01-01 00:10:00", 1, "a", 9.0), (4, "2024-01-01 04:00:00", 1, "a", 4.0)],
    ]
    for b in batches:
        write(spark, path, b)
        windows = out("tumbling", E.tumbling(stream()))
        once = out("dedupe", E.deduplicated(stream()))
    assert [(r.n, r.total) for r in windows.orderBy("start").collect()] == [(2, 2.0), (1, 2.0)]
    assert once.where("event_id = 1").count() == 1


def test_streaks_keep_state_between_batches(spark, tmp_path):
    path = f"{tmp_path}/in"
    for k, values in enumerate([(60.0, 60.0), (60.0, 10.0)]):
        write(spark, path, [(2 * k + j, f"2024-01-01 00:0{2 * k + j}:00", 1, "a", v) for j, v in enumerate(values)])
        got = E.drain_streaks(spark.readStream.schema(SCHEMA).parquet(path), f"{tmp_path}/out", f"{tmp_path}/c", 50.0)
    assert [tuple(r) for r in got.collect()] == [("a", 2)]


def walked(rows, limit, least, runs):
    """The same by a plain walk."""
    found, now = [], dict(runs)
    for event_id, _, _, kind, value in sorted(rows, key=lambda r: (r[1], r[0])):
        now[kind] = now.get(kind, 0) + 1 if value is not None and value > limit else 0
        if now[kind] and now[kind] % least == 0:
            found.append((kind, event_id))
    return sorted(found, key=str), {k: v % least for k, v in now.items()}


def test_streaks_equal_a_plain_walk(spark, tmp_path):
    """Over three batches with runs across them, types that come and go, null types and values."""
    rng, runs, all_found, got = random.Random(5), {}, [], None
    path = f"{tmp_path}/in"
    for k, kinds in enumerate((["a", "b", None], ["a"], ["a", "b", None])):
        rows = [(1000 * k + j, f"2024-01-0{k + 1} {rng.randrange(24):02}:00:00", 1, rng.choice(kinds), rng.choice([10.0, 60.0, 70.0, 80.0, None])) for j in range(300)]
        rows += [(1000 * k + 500 + j, f"2024-01-0{k + 1} 23:30:00", 1, "a", 90.0) for j in range(4)]
        write(spark, path, rows)
        got = E.drain_streaks(spark.readStream.schema(SCHEMA).parquet(path), f"{tmp_path}/out", f"{tmp_path}/c", 50.0)
        found, runs = walked(rows, 50.0, 3, runs)
        all_found += found
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(all_found, key=str) and len(all_found) > 50


def test_recent_keeps_the_last_events_over_batches(spark, tmp_path):
    path = f"{tmp_path}/in"
    for batch in ([(1, "2024-01-01 00:05:00", 1, "a", 1.0), (2, "2024-01-01 00:01:00", 1, "a", 1.0)], [(3, "2024-01-01 00:03:00", 1, "a", 1.0), (4, "2024-01-01 00:03:00", 2, "a", 1.0)]):
        write(spark, path, batch)
        got = E.drain(E.recent(spark.readStream.schema(SCHEMA).parquet(path), "user_id", 2), f"{tmp_path}/out", f"{tmp_path}/c")
    rows = sorted((r.user_id, r.seen, list(r.event_ids)) for r in got.collect())
    assert rows == [(1, 2, [1, 2]), (1, 3, [1, 3]), (2, 1, [4])]


def test_stream_equals_batch(spark, sf, tmp_path):
    got = E.drain(E.alarms(E.read_events(spark, sf), 100.0), f"{tmp_path}/o", f"{tmp_path}/c")
    batch = E.alarms(E.read_events(spark, sf, streaming=False), 100.0)
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0 and got.where(F.col("value") <= 100).count() == 0
