"""Fits, resamples and grids of experiments at several sizes, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import evt
from orbweave.operators.experiments import ProgressTable


def test_fits_by_tasks_equal_the_fit_of_the_whole_tail(spark):
    u, groups, exact = (np.arange(20_000) + 0.5) / 20_000, [], {}
    for name, shape, far in (("light", 0.24, None), ("heavy", 0.8, None), ("one", 1.0, None), ("outlier", 0.24, 1e7)):
        x = ((1 - u) ** -shape - 1) / shape
        x = x if far is None else np.append(x, far)
        groups += [(name, float(v)) for v in x]
        low = np.sort(x)[0]
        exact[name] = evt.fit_gpd(x - low)
    found = {r.g: (r["shape"], r["scale"]) for r in evt.gpd_thresholds(spark.createDataFrame(groups, "g string, s double"), "s", ("g",), fraction=1.0).collect()}
    for name, fit in exact.items():
        assert found[name] == pytest.approx(fit, rel=1e-6), name


@pytest.mark.parametrize("rule", ["index", "index_min10", "percentile"])
def test_tails_with_ties_are_those_of_the_sorted_scores(spark, rule):
    rng = np.random.default_rng(3)
    rows = {"ties": np.round(rng.exponential(size=400), 1), "at": np.r_[np.zeros(300), np.full(60, 2.0), 2 + rng.exponential(size=40)], "flat": np.ones(50)}
    df = spark.createDataFrame([(g, float(v)) for g, x in rows.items() for v in x], "g string, s double")
    got = {r.g: r for r in evt.gpd_thresholds(df, "s", ("g",), 0.2, 0.01, rule).collect()}
    for g, x in rows.items():
        x = np.sort(x)
        at = int(len(x) * (1 - 0.2))
        u = np.quantile(x, 0.8) if rule == "percentile" else x[at]
        tail = x[x > u] - u if rule == "percentile" else x[at:] - u
        fit = evt.fit_gpd(tail)
        assert (got[g].n, got[g].u, got[g].n_tail) == (len(x), pytest.approx(u), len(tail))
        assert (got[g]["shape"], got[g]["scale"]) == ((None, None) if fit is None else (pytest.approx(fit[0], rel=1e-6), pytest.approx(fit[1], rel=1e-6)))
        if fit is None:
            assert got[g].tau == pytest.approx(1.05 * u)
    assert evt.gpd_thresholds(df.limit(0), "s", ("g",)).count() == 0
    whole = evt.gpd_thresholds(df, "s", ()).first()
    assert whole.n == sum(map(len, rows.values()))


def test_bootstrap_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(g, k, float(rng.random() < 0.1 * (1 + n))) for n, g in enumerate(("a", "b", None)) for k in range(70 + 30 * n)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "g string, id long, hit double").repartition(5)
    got = {r.g: r for r in evt.bootstrap_rows(df, ("g",), "hit", "id", 200).collect()}
    for g in ("a", "b", None):
        x = np.array([h for k, i, h in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: r[1])])
        source = np.random.RandomState(42)
        means = [x[source.choice(len(x), size=len(x), replace=True)].mean() for _ in range(200)]
        wanted = [np.percentile(means, q) for q in (2.5, 97.5, 0.5, 99.5)] + [np.mean(means), np.std(means)]
        assert (got[g].n, got[g]["mean"]) == (len(x), pytest.approx(x.mean()))
        assert [got[g][c] for c in ("ci_low", "ci_high", "ci_low_99", "ci_high_99", "replicate_mean", "replicate_sd")] == pytest.approx(wanted)
    assert evt.bootstrap_rows(df.limit(0), ("g",), "hit", "id", 9).count() == 0


def test_bootstrap_over_many_buckets_draws_as_many_rows_as_there_are(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), F.lit(1.0).alias("one"), (F.rand(5) * 10).alias("x")).cache()
    every = evt.bootstrap_rows(df, ("g",), "one", "id", 50, bucket_rows=64).collect()
    assert all((r.ci_low_99, r.ci_high_99, r.replicate_sd) == (1.0, 1.0, 0.0) for r in every)  # neither more nor fewer than n
    for r in evt.bootstrap_rows(df, ("g",), "x", "id", 800, bucket_rows=64).collect():
        x = np.array([v.x for v in df.where(F.col("g") == r.g).collect()])
        assert r.replicate_sd == pytest.approx(x.std() / np.sqrt(len(x)), rel=0.12) and r.replicate_mean == pytest.approx(x.mean(), abs=4 * x.std() / np.sqrt(len(x) * 800))
    again = evt.bootstrap_rows(df.repartition(7), ("g",), "x", "id", 800, bucket_rows=64)
    assert sorted(map(str, again.select("g", F.round("ci_low", 9)).collect())) == sorted(map(str, evt.bootstrap_rows(df, ("g",), "x", "id", 800, bucket_rows=64).select("g", F.round("ci_low", 9)).collect()))


def test_a_grid_that_stopped_is_gone_on_with(spark, tmp_path):
    settings = spark.createDataFrame([("exact", b) for b in range(5)], "search string, bits int")
    computed = []

    def one(setting, fail_at=None):
        if setting.bits == fail_at:
            raise RuntimeError("killed")
        computed.append(setting.bits)
        return spark.createDataFrame([(setting.bits * 10,)], "tau int")

    table = ProgressTable(spark, f"file://{tmp_path}/grid", ["search", "bits"])
    with pytest.raises(ValueError, match="no setting"):
        table.results(settings)
    with pytest.raises(RuntimeError):
        table.run(settings, lambda s: one(s, 3))
    assert computed == [0, 1, 2] and table.results(settings).count() == 3
    half = settings.where("bits = 2").first()
    (tmp_path / "grid" / table.folder(half).split("/")[-1] / "_SUCCESS").unlink()  # as if the task had been killed while it wrote
    assert ProgressTable(spark, f"file://{tmp_path}/grid", ["search", "bits"]).run(settings, one) == 3 and computed == [0, 1, 2, 2, 3, 4]
    assert sorted(map(tuple, table.results(settings).select("search", "bits", "tau").collect())) == [("exact", b, b * 10) for b in range(5)]
    assert table.run(settings, one) == 0
