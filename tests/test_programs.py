"""Whole reports against plain loops, and their edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import evt, programs
from orbweave.sources.tables import union_vectors


def test_thresholds_side_by_side_equal_a_plain_loop(spark):
    rng = random.Random(1)
    nominal = [(k, rng.expovariate(1.0)) for k in ("a", "b") for _ in range(80)]
    tests = [(k, int(rng.random() < 0.4), rng.expovariate(0.6)) for k in ("a", "b") for _ in range(60)]
    got = programs.threshold_comparison(spark.createDataFrame(nominal, "k string, score double"), spark.createDataFrame(tests, "k string, image_label int, score double"), ("k",), tail=0.2, alpha=0.02)
    rows = {r.k: r for r in got.collect()}
    for k in ("a", "b"):
        own = np.sort([s for n, s in nominal if n == k])
        u = own[int(80 * 0.8)]
        x = own[int(80 * 0.8) :] - u
        shape, scale = evt.fit_gpd(x)  # the tail begins with an excess of 0
        assert rows[k].pct_tau == pytest.approx(np.percentile(own, 95))
        assert rows[k].evt_tau == pytest.approx(u + scale / shape * ((0.02 / 0.2) ** -shape - 1), rel=1e-3)
        for kind in ("evt", "pct"):
            tau = rows[k][f"{kind}_tau"]
            good, bad = ([s for n, y, s in tests if n == k and y == v] for v in (0, 1))
            assert rows[k][f"{kind}_fpr"] == pytest.approx(sum(s > tau for s in good) / len(good))
            assert rows[k][f"{kind}_fnr"] == pytest.approx(sum(s <= tau for s in bad) / len(bad))
        assert (rows[k].n_nominal, rows[k].n_test) == (80, 60)


def test_an_absent_class_has_rate_nought_and_a_key_without_nominal_no_row(spark):
    nominal = spark.createDataFrame([("a", float(i)) for i in range(30)], "k string, score double")
    tests = spark.createDataFrame([("a", 0, 100.0), ("a", 0, 1.0), ("b", 1, 3.0), (None, 1, 3.0), ("a", None, 2.0), ("a", 0, None)], "k string, image_label int, score double")
    rows = programs.threshold_comparison(nominal, tests, ("k",), tail=0.3).collect()
    assert [(r.k, r.n_test, r.pct_fpr, r.pct_fnr) for r in rows] == [("a", 2, 0.5, 0.0)]
    assert programs.threshold_comparison(nominal, tests.limit(0), ("k",), tail=0.3).count() == 0


def test_nominal_scores_leave_the_own_image_out(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(24, 5))
    rows = spark.createDataFrame([("c", i // 4, i, v[i].tolist()) for i in range(24)], "category string, image_id long, vec_id long, embedding array<double>")
    got = {r.image_id: r.score for r in programs.nominal_scores(rows, rows, ("category",)).collect()}
    for image in range(6):
        other = np.array([v[j] for j in range(24) if j // 4 != image])
        assert got[image] == pytest.approx(max(min(((v[i] - o) ** 2).sum() for o in other) for i in range(4 * image, 4 * image + 4)))


def test_ranges_and_error_share(spark):
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 2.0), ("a", 1, 6.0), ("b", 0, 2.0), ("c", 0, 5.0), ("c", 1, 4.0)], "k string, image_label int, score double")
    ranges = programs.score_ranges(scores, ("k",))
    assert sorted((r.k, r.normal_min, r.normal_max, r.defect_min, r.defect_max, r.span) for r in ranges.collect()) == [("a", 1, 3, 2, 6, 5), ("b", 2, 2, None, None, None), ("c", 5, 5, 4, 4, -1)]
    errors = spark.createDataFrame([("a", 0.5, 0.2), ("b", 1.0, 0.2), ("c", 1.0, 0.2)], "k string, r_max double, r_avg double")
    assert {r.k: r.r_max_percent for r in programs.error_share(ranges, errors, ("k",)).collect()} == {"a": pytest.approx(10.0), "b": None, "c": None}


def test_heat_maps_of_ties_and_of_one_value(spark):
    maps = [("a", 3, [1.0, 1.0, 1.0, 1.0]), ("a", 1, [0.0, 0.0, 0.0, 2.0]), ("a", 2, [2.0, 0.0, 0.0, 0.0]), ("a", 4, [0.5] * 4), ("a", 5, None), ("b", 9, [0.0, 1.0, 2.0, 3.0])]
    got = programs.top_heat_maps(spark.createDataFrame(maps, "k string, image_id long, values array<double>"), ("k",), 2, 4, k=3).collect()
    assert sorted((r.k, r["rank"], r.image_id) for r in got) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 9)]
    for r in got:
        assert len(r.heat) == 16
        assert (min(r.heat), max(r.heat)) == ((0.0, 0.0) if r.image_id == 3 else (0.0, 1.0))


def test_fits_by_bits_takes_the_first_row_and_the_second_source_for_missing_seeds(spark):
    schema = "category string, seed int, bits string, shape double, scale double, at int"
    first = spark.createDataFrame([("a", 1, "4", 0.4, 1.0, 2), ("a", 1, "4-bit", 0.2, 2.0, 1), ("a", 1, "8", -0.1, 1.0, 1), ("a", 1, "6-bit", 9.0, 9.0, 1), ("b", 1, "4", None, 1.0, 1), ("b", 1, "8", -0.5, 1.0, 1)], schema)
    second = spark.createDataFrame([("a", 1, "4", 7.0, 7.0, 0), ("a", 2, "4-bit", 0.6, 4.0, 1), ("a", 2, "8-bit", -0.3, 1.0, 1)], schema)
    rows = {(r.category, r.bit_depth): r for r in programs.fits_by_bits(first, second, "at").collect()}
    assert set(rows) == {("a", 4), ("a", 8), ("b", 8)}
    a = rows["a", 4]
    assert (a.shape_mean, a.shape_sd, a.scale_mean, a.scale_sd, a.n_seeds, a.sign_flip) == (pytest.approx(0.4), pytest.approx(0.2), 3.0, 1.0, 2, True)
    assert rows["b", 8].sign_flip is None


def test_trade_off_against_a_reference_and_without_common_settings(spark):
    quality = spark.createDataFrame([("a", 16, 0.5), ("a", 64, 0.6), ("a", 99, 1.0), ("b", 16, 0.0), ("b", 64, 1.0)], "g string, m int, quality double")
    cost = spark.createDataFrame([("a", 16, 10.0), ("a", 64, 8.0), ("b", 16, 4.0), ("b", 64, 5.0)], "g string, m int, cost double")
    rows = {(r.g, r.m): r for r in programs.trade_off(quality, cost, "g", "m", 16).collect()}
    assert len(rows) == 4
    r = rows["a", 64]
    assert (r.quality_change, r.quality_percent, r.cost_reduction, r.cost_percent) == (pytest.approx(0.1), pytest.approx(20.0), pytest.approx(2.0), pytest.approx(20.0))
    assert rows["b", 64].quality_percent is None and rows["b", 64].cost_percent == pytest.approx(-25.0)
    with pytest.raises(ValueError, match="no m has both"):
        programs.trade_off(quality, cost.where("m = 1"), "g", "m", 16)


def test_breakdown_leaves_warm_up_out(spark):
    rows = [(run, item, s, float(ms)) for run in (1, 2) for item in range(3) for s, ms in (("load", 1 + item), ("search", 10 * item))] + [(1, 2, "load", None)]
    got = {r.stage: r for r in programs.breakdown(spark.createDataFrame(rows, "run int, item int, stage string, ms double"), "run", "item", "stage", "ms").collect()}
    assert (got["load"].n, got["load"].mean_ms, got["search"].mean_ms, got["total"].n, got["total"].mean_ms) == (4, 2.5, 15.0, 4, 17.5)
    assert got["search"].share_percent == pytest.approx(15 / 17.5 * 100) and got["total"].per_second == pytest.approx(1000 / 17.5)


def test_concurrency_by_hand(spark):
    second = 1_000_000
    rows = [(2, "x", 0, second), (2, "x", second, 2 * second), (2, "y", 0, 4 * second), (2, "z", None, second), (1, "x", 5, 5)]
    got = {r.tier: r for r in programs.concurrency(spark.createDataFrame(rows, "tier int, stream string, b long, e long"), "tier", "stream", "b", "e").collect()}
    assert (got[2].n_streams, got[2].n_images, got[2].wall_seconds, got[2].per_second) == (2, 3, 4.0, 0.75)
    assert got[2].p95_ms == pytest.approx(np.percentile([1000, 4000], 95))
    assert got[1].per_second is None


def test_parity_of_sequences(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, None), ("q", 1, "x"), ("q", 2, "y"), ("q", 3, "z"), ("q", 4, "w"), ("r", 1, "x")], "k string, place int, v string")
    b = spark.createDataFrame([("p", 1, "x"), ("p", 2, None), ("q", 1, "y"), ("q", 2, "x"), ("q", 3, None), ("s", 1, "x")], "k string, place int, v string")
    got = {r.k: (r.n_first, r.n_second, r.n_different, r.equal, r.differing) for r in programs.compare_by_position(a, b, ["k"], "place", "v").collect()}
    assert got == {"p": (2, 2, 0, True, ""), "q": (4, 3, 4, False, "1,2,3"), "r": (1, 0, 1, False, "1"), "s": (0, 1, 1, False, "1")}


def test_next_names_go_on_after_the_highest(spark):
    old = spark.createDataFrame([("dent", "dent_7"), ("dent", "dent_12"), ("dent", "dent_x"), ("spot", None)], "kind string, name string")
    new = spark.createDataFrame([("dent", 5), ("dent", 3), ("spot", 9), ("new", 1)], "kind string, i int")
    assert sorted((r.i, r.new_name) for r in programs.next_names(old, new, "kind", "name", "i").collect()) == [(1, "new_1"), (3, "dent_13"), (5, "dent_14"), (9, "spot_1")]


def test_metrics_of_all_rows_and_of_one_class(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 9) / 10, int(rng.random() < 0.5)) for g in "ab" for _ in range(50)] + [("c", 0.9, 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r for r in programs.metrics_of(df, "s", "y", ("g",)).collect()}
    for g in "ab":
        own = [(s, y) for k, s, y in rows if k == g]
        pos, neg = ([s for s, y in own if y == v] for v in (1, 0))
        assert got[g].auroc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
        best = []
        for t in {s for s, _ in own}:
            tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
            p, r = tp / (tp + fp), tp / len(pos)
            best.append((round(2 * p * r / (p + r + 1e-8), 9), t))
        assert (got[g].f1, got[g].threshold) == pytest.approx(max(best))
        assert got[g].detection_rate == pytest.approx(sum(s > 0.5 for s, _ in own) / 50)
        assert got[g].false_positive_rate == pytest.approx(sum(s > 0.5 and not y for s, y in own) / 50)
    assert got["c"].auroc is None and got["c"].n_neg == 1
    whole = programs.metrics_of(df, "s", "y").collect()
    assert len(whole) == 1 and whole[0].n_pos + whole[0].n_neg == 101


def test_union_vectors_checks_widths(spark):
    a = spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<double>")
    b = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    texts = spark.createDataFrame([(["x"],)], "embedding array<string>")
    got = union_vectors({"z": a, "b": b, "t": texts, "n": a.select(F.lit(1).alias("other"))})
    assert sorted((r.key, r.embedding) for r in got.collect()) == [("b", [1.0, 2.0]), ("z", [1.0, 2.0])]
    with pytest.raises(ValueError, match="widths 3 to 3, not 2"):
        union_vectors({"a": a, "c": spark.createDataFrame([([1.0, 2.0, 3.0],)], "embedding array<double>")})
    with pytest.raises(ValueError, match="no table"):
        union_vectors({"t": texts})
    with pytest.raises(ValueError, match="two vectors"):
        union_vectors({"a": a})
