"""State over several triggers: late events, idle keys, sketches and drift."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from orbweave.streaming import events as E
from orbweave.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
BEGIN = datetime(2024, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame([(i, BEGIN + timedelta(minutes=m), u, k, v) for i, m, u, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_idle_keys_go_and_late_events_take_their_place(spark, tmp_path):
    path, seen = f"{tmp_path}/in", []
    batches = [
        [(1, 0, 1, "a", 1.0), (2, 4, 1, "a", 1.0), (3, 0, 2, "a", 1.0)],
        [(4, 2, 1, "a", 1.0), (5, 8, 2, "a", 1.0)],  # 4 is late, but within the watermark
        [(6, 200, 2, "a", 1.0)],  # the watermark passes 4 + 60 minutes after this batch
        [(7, 201, 1, "a", 1.0), (8, 3, 2, "a", 1.0)],  # user 1 was idle; 8 is behind the watermark
    ]
    for b in batches:
        write(spark, path, b)
        out = E.drain(state.recent_until_idle(spark.readStream.schema(SCHEMA).parquet(path), "user_id", 3, 60), f"{tmp_path}/out", f"{tmp_path}/c")
        seen.append({(r.user_id, r.seen, tuple(r.event_ids)) for r in out.collect()})
    assert seen[0] == {(1, 2, (2, 1)), (2, 1, (3,))}
    assert seen[1] - seen[0] == {(1, 3, (2, 4, 1)), (2, 2, (5, 3))}
    last = seen[3] - seen[2]
    assert (1, 1, (7,)) in last  # its state had gone
    assert not any(8 in ids for _, _, ids in last)


def test_streaks_wait_for_late_events(spark, tmp_path):
    rng, path = random.Random(3), f"{tmp_path}/in"
    rows = [(k, k, 1, rng.choice(["a", "b"]), rng.choice([10.0, 60.0, 70.0, 80.0])) for k in range(120)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))  # up to eight minutes late
    parts = [shuffled[k : k + 30] for k in range(0, 120, 30)] + [[(999, 400, 1, "a", 10.0)], [(1000, 5, 1, "a", 99.0), (1001, 5, 1, "a", 99.0), (1002, 5, 1, "a", 99.0)]]
    for part in parts:
        write(spark, path, part)
        got = E.drain_streaks(spark.readStream.schema(SCHEMA).parquet(path), f"{tmp_path}/out", f"{tmp_path}/c", 50.0, delay_s=600)
    run, expected = {}, []
    for i, _, _, kind, value in rows:
        run[kind] = run.get(kind, 0) + 1 if value > 50 else 0
        if run[kind] and run[kind] % 3 == 0:
            expected.append((kind, i))
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 10


def test_sketches_keep_their_error_and_merge(spark, tmp_path):
    rng = np.random.default_rng(2)
    hours = {h: rng.normal(50 if h < 3 else 65, 10, 4_000) for h in range(5)}
    rows = [(h * 10_000 + k, h * 60 + k % 60, 1, "a", float(v)) for h, x in hours.items() for k, v in enumerate(x)]
    rows += [(900_000, 10, 1, "a", None), (900_001, 1_000, 1, "b", 1.0)]
    path = f"{tmp_path}/in"
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        write(spark, path, part)
        windows = E.drain(state.sketched(spark.readStream.schema(SCHEMA).parquet(path), "event_type"), f"{tmp_path}/out", f"{tmp_path}/c")
    found = {int((r.start - BEGIN).total_seconds() // 3600): r for r in windows.select("start", "n", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in (0.05, 0.5, 0.95)])).alias("q")).collect()}
    assert sorted(found) == list(range(5)) and all(r.n == 4_000 for r in found.values())
    for h, x in hours.items():
        assert np.allclose([(x <= v).mean() for v in found[h].q], [0.05, 0.5, 0.95], atol=state.RANK_ERROR)
    changed = {int((r.start - BEGIN).total_seconds() // 3600): r.drifted for r in state.drift(windows, "event_type").collect()}
    assert changed == {0: None, 1: False, 2: False, 3: True, 4: False}
    limits = {int((r.start - BEGIN).total_seconds() // 3600): r.threshold for r in state.adaptive_thresholds(windows, "event_type", 0.9, 2).collect()}
    assert limits[0] is None
    for h in (1, 2, 3, 4):
        past = np.concatenate([hours[k] for k in range(max(0, h - 2), h)])
        assert abs((past <= limits[h]).mean() - 0.9) <= 2 * state.RANK_ERROR
