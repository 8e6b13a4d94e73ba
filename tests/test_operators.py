"""Operators against NumPy, by hand-made cases and by properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions import scalars, vectors
from orbweave.operators import bank, diagnostics, evt, grids, knn, metrics, reports, running
from orbweave.sources import files, tables


def vecs(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


TINY = [[1, 0, 0, 0], [0, 2, 0, 0], [0, 0, 0, 0], [1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 3, 4]]


def test_normalise_keeps_zero(spark):
    got = [r[0] for r in vecs(spark, TINY).orderBy("vec_id").select(vectors.normalise(F.col("embedding"))).collect()]
    assert got[2] == [0.0] * 4 and got[5] == pytest.approx([0, 0, 0.6, 0.8])


def test_finite(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0, 2.0],)], "v array<double>")
    assert sorted(r[0] for r in df.select(vectors.is_finite(F.col("v"))).collect()) == [False, False, True]


def test_standardise_and_min_max(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 2.0, 5.0)], "g string, x double, y double")
    got = vectors.standardise(df, ["x", "y"]).orderBy("x").collect()
    assert [r.y for r in got] == [0, 0, 0] and got[0].x == pytest.approx(-1.224744871)
    assert sorted(r.s for r in vectors.min_max(df, "x", ["g"], "s").collect()) == [0, 0, 1]


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_knn(spark, block):
    x = np.random.default_rng(0).normal(size=(40, 5))
    x[7] = x[3]
    df = vecs(spark, x.astype(np.float32))
    x = x.astype(np.float32).astype(float)
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.d2) for r in knn.exact_knn(df, df, 4, block=block).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(40):
        order = np.lexsort((np.arange(40), np.round(d[i], 9)))[:4]
        assert [got[i, k + 1][0] for k in range(4)] == order.tolist()


def test_exact_knn_without_rows(spark):
    df = vecs(spark, TINY)
    assert knn.exact_knn(df.where("vec_id < 0"), df, 2).count() == 0
    assert knn.exact_knn(df, df.where("vec_id < 0"), 2).count() == 0


def test_quantiser_error_falls_and_refuses(spark):
    x = np.random.default_rng(2).normal(size=(200, 8))
    errors = [((x - (q := knn.ProductQuantiser(x, 4, b)).decode(q.encode(x))) ** 2).sum() for b in (1, 3, 5)]
    assert errors[0] > errors[1] > errors[2]
    with pytest.raises(ValueError):
        knn.ProductQuantiser(x[:10], 4, 5)
    with pytest.raises(ValueError):
        knn.ProductQuantiser(x, 3, 2)


def test_auroc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 1), (1.0, 0), (1.0, 1), (2.0, 1)], "s double, y int")
    assert metrics.auroc(df, "s", "y").first().auroc == pytest.approx(4 / 6)
    assert metrics.auroc(df.where("y = 1"), "s", "y").first().auroc is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 1)), min_size=2, max_size=30).filter(lambda r: len({y for _, y in r}) == 2))
def test_auroc_properties(spark, pairs):
    df = spark.createDataFrame([(float(s), y) for s, y in pairs], "s double, y int")
    a = metrics.auroc(df, "s", "y").first().auroc
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert a == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    assert metrics.auroc(df.withColumn("s", -F.col("s")), "s", "y").first().auroc == pytest.approx(1 - a)


def test_average_precision_and_f1(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert metrics.best_f1(df, "s", "y").first().threshold == 0.7


def test_running_sums_in_groups(spark):
    rng = random.Random(0)
    rows = [(rng.choice("ab"), float(rng.randrange(20)), rng.randrange(5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    for r in running.running_sums(df, "x", {"below": "n"}, ("g",), 7).collect():
        assert r.below == sum(n for g, x, n in rows if g == r.g and x < r.x)


def test_spearman(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 4.0], [2.0, 1.0, 4.0, 3.0, 5.0]
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double")
    rx, ry = np.array([1, 2, 3, 4.5, 4.5]), np.array([2, 1, 4, 3, 5])
    assert metrics.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(rx, ry)[0, 1])


@pytest.mark.parametrize("shape", [-0.4, -0.067, 0.008, 0.2357])
def test_gpd_recovers_shape(shape):
    u = np.random.default_rng(4).random(20_000)
    found = evt.fit_gpd(2.0 / shape * ((1 - u) ** -shape - 1))
    assert found[0] == pytest.approx(shape, abs=0.03) and found[1] == pytest.approx(2.0, rel=0.05)


def test_gpd_of_constant_tail(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("b", float(i)) for i in range(100)], "g string, s double")
    got = {r.g: r for r in evt.gpd_thresholds(df, "s", ("g",)).collect()}
    assert got["a"].shape is None and got["a"].tau == pytest.approx(1.05)
    assert got["b"].tau > got["b"].u


def test_tail_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "s double")
    assert evt.tail_start(df, "s", 0.1).first().u == 90
    assert evt.tail_start(df, "s", 0.01, rule="index_min10").first().u == 90
    assert evt.tail_start(df, "s", 0.5, rule="percentile").first().u == 49.5
    with pytest.raises(ValueError):
        evt.tail_start(df, "s", 0.5, rule="other")


def test_threshold_rises_as_alpha_falls(spark):
    df = spark.createDataFrame([(1.0, 0.1, 2.0)], "u double, a double, b double")
    taus = [df.select(evt.threshold(F.col("u"), F.col("a"), F.col("b"), p, 0.1)).first()[0] for p in (0.05, 0.01, 0.001)]
    assert taus == sorted(taus)


def test_bootstrap_interval_holds_the_rate(spark):
    df = spark.createDataFrame([("a", 5, 100), ("b", 0, 10)], "g string, hits long, n long")
    got = {r.g: r for r in evt.bootstrap_rate(df, ("g",), "hits", "n").collect()}
    assert got["a"].ci_low <= 0.05 <= got["a"].ci_high and got["b"].ci_high == 0


def test_few_shot_draws(spark):
    df = spark.createDataFrame([(f"p{i:03d}",) for i in range(209)], "path string")
    picked = sorted(np.random.RandomState(111).choice(209, 10, replace=False))
    assert sorted(r.path for r in bank.few_shot(df.orderBy(F.rand(1)).withColumn("k", F.col("path").substr(2, 3).cast("int")), "k", 10, 111).collect()) == [f"p{i:03d}" for i in picked]
    with pytest.raises(ValueError):
        bank.few_shot(df.withColumn("k", F.lit(1)), "k", 500, 1)


def test_orbit_dedupe_is_a_sequential_fold(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    df = vecs(spark, x).withColumn("g", (F.col("vec_id") % 2).cast("string"))
    got = {g: [] for g in "01"}
    for r in bank.orbit_dedupe(df, ["g"], ["vec_id"], limit=0.5).orderBy("vec_id").collect():
        got[r.g].append(r.vec_id)
    for g in (0, 1):
        last, expected = None, []
        for i in range(g, 60, 2):
            v = np.float32(x[i]).astype(float)
            v /= np.linalg.norm(v)
            if last is None or v @ last < 0.5:
                expected.append(i)
                last = v
        assert got[str(g)] == expected


def test_k_centre(spark):
    x = np.array([[0.0], [1], [2], [10]])
    assert bank.k_centre(x, 3)[0] == 3 and len(set(bank.k_centre(x, 3))) == 3
    df = vecs(spark, x).withColumn("g", F.lit("a"))
    assert {r.vec_id for r in bank.k_centre_coreset(df, "g", 2).collect()} == {3, 0}
    with pytest.raises(ValueError, match="either k or share"):
        bank.k_centre_coreset(df, "g")


def test_principal_axes_and_projection(spark):
    x = np.random.default_rng(6).normal(size=(100, 4)) * [5, 2, 1, 0.1]
    df = vecs(spark, x)
    x = x.astype(np.float32).astype(float)
    mean, axes, variances = bank.principal_axes(df)
    assert variances == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    low = np.array([r.embedding for r in bank.project(df, mean, axes[:2]).orderBy("vec_id").collect()])
    assert np.abs(low) == pytest.approx(np.abs((x - x.mean(0)) @ axes[:2].T))
    share = variances / variances.sum()
    assert bank.components_for(df, 0.9) == int(np.searchsorted(np.cumsum(share), 0.9) + 1)


def test_kmeans_coreset_takes_actual_rows(spark):
    df = vecs(spark, np.random.default_rng(7).normal(size=(80, 4)))
    got = bank.kmeans_coreset(df, 0.1)
    assert 1 <= got.count() <= 8 and got.join(df, "vec_id", "left_anti").count() == 0


def test_cka_and_procrustes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 3)).astype(np.float32)
    r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x.astype(float), x.astype(float) @ r, strict=True)], "a array<double>, b array<double>")
    assert diagnostics.linear_cka(df, "a", "b") == pytest.approx(1)
    assert diagnostics.procrustes(df, "a", "b") == pytest.approx(0, abs=1e-9)


def test_margin_pressure_cases(spark):
    df = spark.createDataFrame([(1.0, 1.1, 0), (2.0, 2.0, 0), (8.0, 8.0, 1), (1.0, 1.0, 1)], "e double, q double, y int")
    assert diagnostics.margin_pressure(df, "e", "q", "y").first().pressure == float("inf")
    assert diagnostics.margin_pressure(df.where("y = 0"), "e", "q", "y").first().pressure == 0


def test_orbit_has_eight_views_closed_under_rotation(spark):
    g = [float(v) for v in range(9)]
    df = spark.createDataFrame([(g,)], "v array<double>")
    views = [np.array(r.v).reshape(3, 3) for r in grids.orbit(df, "v", 3).orderBy("view").collect()]
    a = np.arange(9.0).reshape(3, 3)
    expected = [np.rot90(m, k) for m in (a, a[:, ::-1]) for k in range(4)]
    assert all((v == e).all() for v, e in zip(views, expected, strict=True))
    assert len({v.tobytes() for v in views}) == 8


def test_resampling_and_blur_keep_constants(spark):
    df = spark.createDataFrame([([2.0] * 16,)], "v array<double>")
    up = df.select(grids.upsample(F.col("v"), 4, 9)).first()[0]
    soft = df.select(grids.blur(F.col("v"), 4, 1.0, 3)).first()[0]
    assert len(up) == 81 and up == pytest.approx([2.0] * 81) and soft == pytest.approx([2.0] * 16)


def test_regions_are_four_connected():
    m = np.zeros((8, 8), bool)
    m[1:3, 1:3] = m[3:5, 3:5] = True
    assert grids.label_regions(m).max() == 2
    snake = np.array([[1, 1, 1], [0, 0, 1], [1, 1, 1]], bool)
    assert grids.label_regions(snake).max() == 1 and grids.label_regions(np.zeros((2, 2), bool)).max() == 0


def test_pro_auc_by_hand(spark):
    # a perfect map: both regions score 1, all else 0
    px = [("c", 1, 1, 1.0)] * 4 + [("c", 1, 2, 1.0)] * 4 + [("c", 1, 0, 0.0)] * 56
    df = spark.createDataFrame(px, "category string, image int, region int, score double")
    curve = grids.pro_curve(df, "score", "region", "image", "category", 11)
    assert curve.where("threshold > 0 and (pro <> 1 or fpr <> 0)").count() == 0
    brute = np.random.default_rng(9).random(200)
    df = spark.createDataFrame([("c", 1, int(k % 10 == 0), float(s)) for k, s in enumerate(brute)], "category string, image int, region int, score double")
    for r in grids.pro_curve(df, "score", "region", "image", "category", 50).collect():
        bad = brute[[k for k in range(200) if k % 10]]
        assert r.fpr == pytest.approx((bad >= r.threshold).mean())


def test_tables_and_errors(spark, sf):
    df = tables.load(spark, sf, "labels")
    with pytest.raises(tables.SchemaError):
        tables.require(df, ["doc_id", "other"])
    with pytest.raises(tables.SchemaError):
        tables.validate(df, T.StructType([T.StructField("doc_id", T.StringType())]))


def test_dirty_texts(spark):
    df = spark.createDataFrame([("",), ("ERROR",), ("12.0",), ("  7 ",), (None,)], "t string")
    got = [tuple(r) for r in df.select(scalars.safe_int(F.col("t")), scalars.safe_double(F.col("t"))).collect()]
    assert got == [(None, None), (None, None), (12, 12.0), (7, 7.0), (None, None)]


def test_image_tree_and_csv(spark, tmp_path):
    for d in ("good", "scratch"):
        (tmp_path / "tree/screw/test" / d).mkdir(parents=True)
        (tmp_path / "tree/screw/test" / d / "a.PNG").write_bytes(b"x" * 10)
        (tmp_path / "tree/screw/test" / d / "note.txt").write_bytes(b"x")
    got = sorted((r.category, r.split, r.defect, r.label) for r in files.image_tree(spark, f"{tmp_path}/tree").collect())
    assert got == [("screw", "test", "good", 0), ("screw", "test", "scratch", 1)]
    (tmp_path / "a.csv").write_text("x.png,0\ny.png,1\nz.png,bad\n")
    schema = T.StructType([T.StructField("filename", T.StringType()), T.StructField("label", T.IntegerType())])
    assert [r.label for r in files.read_csv(spark, f"{tmp_path}/a.csv", schema, header=False).orderBy("filename").collect()] == [0, 1, None]
    assert files.existing(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]) == [f"{tmp_path}/a.csv"]
    log = spark.createDataFrame([("Image AUROC: 0.5\nImage AUROC: 0.75\n",), ("none",)], "t string")
    assert sorted(str(r[0]) for r in log.select(files.last_match(F.col("t"), r"Image AUROC: ([0-9.]+)")).collect()) == ["0.75", "None"]
    files.write_csv(log, f"{tmp_path}/out", single_file=True)
    files.write_csv(log, f"{tmp_path}/out", append=True)
    assert files.read_csv(spark, f"{tmp_path}/out", log.schema).count() >= 4


def test_report_of_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    t = reports.formatted(reports.mean_sd_table(df, "g", ["v"], overall="ALL"), "g", ["v"])
    assert reports.markdown(t, "g").splitlines()[2:] == ["| ALL | 1.0000 ± 0.0000 |", "| a | 1.0000 ± 0.0000 |"]


def test_pooling_padding_energy_and_boxes(spark):
    df = spark.createDataFrame([(1, [float(k) for k in range(25)])], "id long, v array<double>")
    pooled = df.select(grids.adaptive_pool(F.col("v"), 5, 2)).first()[0]
    g = np.arange(25.0).reshape(5, 5)
    assert np.allclose(pooled, [g[:3, :3].mean(), g[:3, 2:].mean(), g[2:, :3].mean(), g[2:, 2:].mean()])
    wide = df.select(F.slice("v", 1, 6).alias("v")).select(grids.square_pad(F.col("v"), 2, 3, -1.0)).first()[0]
    assert wide == [0, 1, 2, 3, 4, 5, -1, -1, -1]
    tall = df.select(F.slice("v", 1, 3).alias("v")).select(grids.square_pad(F.col("v"), 3, 1)).first()[0]
    assert tall == [0, 0, 0, 0, 1, 0, 0, 2, 0]
    flat = spark.createDataFrame([(1, [2.0] * 16)], "id long, v array<double>")
    assert flat.select(grids.high_frequency_energy(F.col("v"), 4, 0.5)).first()[0] < 1e-9
    assert math.isclose(flat.select(grids.high_frequency_energy(F.col("v"), 4, -1)).first()[0], 32)
    marked = spark.createDataFrame([(1, [1, 1, 0, 0, 0, 0, 2, 0, 0]), (2, [0] * 9)], "id long, region array<int>")
    assert [tuple(r) for r in grids.region_boxes(marked, "region", 3, ["id"]).orderBy("region").collect()] == [(1, 1, 2, 0, 0, 0, 1), (1, 2, 1, 2, 0, 2, 0)]
    assert grids.region_boxes(marked, "region", 3, ["id"], 2).count() == 1


def test_confusion_counts(spark):
    df = spark.createDataFrame([(2.0, 1), (2.0, 0), (1.0, 1), (0.5, 0), (None, 1), (2.0, None)], "s double, y int")
    r = metrics.confusion(df, "s", "y", F.lit(1.0)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    none = metrics.confusion(df.limit(0), "s", "y", F.lit(1.0)).first()
    assert (none.tp, none.accuracy) == (0, None)
