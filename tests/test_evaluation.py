"""Banks, searches and evaluations against brute force, and the sources and figures beside them."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators import bank, evaluation, knn, metrics
from orbweave.plans import evt_queries, stream_queries, vector_queries
from orbweave.sources import files
from orbweave.streaming import events


def vectors(spark, n, seed=1, width=6):
    rng = np.random.default_rng(seed)
    rows = [(k, f"g{k % 3 if k % 7 else 0}", k // 4, rng.normal(size=width).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (n, "g0", 0, None)], "vec_id long, g string, image long, embedding array<double>")


def brute(rows, base, same, other):
    out = {}
    for r in rows:
        d = [sum((a - b) ** 2 for a, b in zip(r.embedding, x.embedding, strict=True)) for x in base if same(r, x) and other(r, x)]
        if d:
            out[r.vec_id] = min(d)
    return out


@pytest.mark.parametrize("block", [5, 1000])
def test_bank_distances(spark, block):
    df, known = vectors(spark, 80), vectors(spark, 37, seed=2)
    rows, base = ([r for r in x.collect() if r.embedding] for x in (df, known))
    for keys, own in ((["g"], None), ([], None), (["g"], "image")):
        got = {r.vec_id: r.d2 for r in evaluation.bank_distances(df, known, keys, own, block=block).collect()}
        expected = brute(rows, base, lambda r, x: not keys or r.g == x.g, lambda r, x: own is None or r.image != x.image)
        assert set(got) == {r.vec_id for r in rows}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx(expected)
    assert all(r.d2 is None for r in evaluation.bank_distances(df, known.limit(0), ["g"]).collect())
    assert evaluation.bank_distances(df.limit(0), known, ["g"]).count() == 0


def workers(df):
    """Python workers that a task of ``df`` has at once: one for each function over its rows."""
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize("how", [{"block": 5}, {"part_bytes": 400}])
def test_a_large_bank_takes_one_worker_a_task(spark, how):
    df, known = vectors(spark, 80), vectors(spark, 37, seed=2)
    got, whole = evaluation.bank_distances(df, known, ["g"], "image", **how), evaluation.bank_distances(df, known, ["g"], "image")
    assert workers(got) == 1
    assert {r.vec_id: r.d2 for r in got.collect()} == pytest.approx({r.vec_id: r.d2 for r in whole.collect()})


def test_a_stream_passes_all_parts_in_one_worker(spark, tmp_path):
    df, known = vectors(spark, 80), vectors(spark, 37, seed=2)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = evaluation.bank_distances(stream, known, ["g"], part_bytes=400)
    assert out._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    got = {r.vec_id: r.d2 for r in events.drain(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()}
    assert got == pytest.approx({r.vec_id: r.d2 for r in evaluation.bank_distances(df, known, ["g"]).collect()})


def test_a_drained_stream_holds_one_part_of_its_bank(spark, sf, monkeypatch):
    whole, passed = {r.vec_id: (r.category, r.score) for r in stream_queries.stream_bank_scores(spark, sf).collect()}, []
    one = lambda rows, parts, *how, go=evaluation._passed: passed.append(len(parts)) or go(rows, parts, *how)
    monkeypatch.setattr(evaluation, "_passed", one)
    monkeypatch.setattr(events, "bank_distances", functools.partial(evaluation.bank_distances, part_bytes=2_000))
    got = stream_queries.stream_bank_scores(spark, sf)
    assert len(passed) > 3 and set(passed) == {1}
    assert {r.vec_id: (r.category, r.score) for r in got.collect()} == whole


def test_a_stream_is_scored_batch_by_batch_and_goes_on(spark, tmp_path):
    df, known = vectors(spark, 80), vectors(spark, 37, seed=2)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    take = lambda: sorted(map(tuple, events.drain_scored(stream, known, ["g"], f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()))
    score = lambda x: sorted(map(tuple, events.scored(x, known, ["g"]).drop("embedding").collect()))
    assert take() == []
    df.where("vec_id < 50").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    assert take() == score(df.where("vec_id < 50"))
    df.where("vec_id >= 50").write.mode("append").parquet(f"{tmp_path}/in")
    assert take() == take() == score(df)


@pytest.mark.parametrize("query", [vector_queries.golden_slice, vector_queries.golden_slice_by_category, vector_queries.margin_pressure, evt_queries.bootstrap_fpr])
def test_scores_are_searched_once(spark, sf, query):
    """Quantiles and ranks of scores read a table of them; they don't search again."""
    assert workers(query(spark, sf)) == 0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 26,000 embeddings, over 4,096 of them support, and the score of each tested image by brute force."""
    rng, n = np.random.default_rng(3), 26_000
    x, image = rng.normal(size=(n, 2)).astype(np.float32), np.arange(n) // 4
    label = np.where((image % 7 == 0) & (np.arange(n) % 4 == 1), 9, 2)
    at = str(tmp_path_factory.mktemp("many"))
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(k, v, y) for k, (v, y) in enumerate(zip(x.tolist(), label.tolist(), strict=True))], schema).write.parquet(f"{at}/embeddings.parquet")
    support = (image % 5 == 0) & (image % 7 != 0)
    assert support.sum() > 4_096
    base, tested, scores = x[support].astype(float), np.flatnonzero(~support), {}
    for ids in np.array_split(tested, 50):
        d = sum((x[ids, c].astype(float)[:, None] - base[None, :, c]) ** 2 for c in range(2)).min(1)
        for i, v in zip(image[ids].tolist(), d.tolist(), strict=True):
            scores[i] = max(v, scores.get(i, 0.0))
    return at, scores


def test_image_scores_of_a_large_bank_take_one_worker_a_task(spark, many):
    at, scores = many
    made = vector_queries.image_score_max(spark, at)
    assert workers(made) == 1
    got = {r.image_id: (r.category, r.image_label, r.score) for r in made.collect()}
    assert {i: (c, y) for i, (c, y, _) in got.items()} == {i: (f"c{i % 3}", int(i % 7 == 0)) for i in scores}
    assert {i: s for i, (_, _, s) in got.items()} == pytest.approx(scores, abs=1e-6)


def test_golden_slice_of_a_large_bank_reads_its_scores(spark, many):
    at, scores = many
    made = vector_queries.golden_slice(spark, at)
    assert workers(made) == 0
    ids = np.array(sorted(scores))
    s, y = np.round([scores[i] for i in ids], 9), ids % 7 == 0
    pairs = (s[y][:, None] > s[~y][None, :]).sum() + (s[y][:, None] == s[~y][None, :]).sum() / 2
    row = made.first()
    assert (row.n_pos, row.n_neg) == (y.sum(), (~y).sum())
    assert row.auroc == pytest.approx(pairs / (y.sum() * (~y).sum()), abs=1e-6)


@pytest.mark.parametrize("tile", [48 * 7, 48 * 1000])
def test_self_nearest(spark, tile):
    df = vectors(spark, 90)
    known = [r for r in df.collect() if r.embedding]
    got = {r.vec_id: r.d2 for r in knn.self_nearest(df, "g", tile_bytes=tile).collect()}
    assert got == pytest.approx(brute(known, known, lambda r, x: r.g == x.g, lambda r, x: r.vec_id != x.vec_id))
    assert knn.self_nearest(df.limit(0), "g").count() == 0


def test_coresets_hold_one_slice_a_task(spark):
    df = vectors(spark, 400)
    picked = bank.k_centre_coreset(df.where("embedding is not null"), "g", 5, rows=20)
    assert {r.g: r["count"] for r in picked.groupBy("g").count().collect()} == {"g0": 5, "g1": 5, "g2": 5}
    # more than a quarter of a slice: the slices share what is wanted
    many = bank.k_centre_coreset(df, "g", 50, rows=60)
    assert {r.g: r["count"] for r in many.groupBy("g").count().collect()} == {"g0": 50, "g1": 50, "g2": 50}
    chosen = bank.kmeans_coreset(df.where("embedding is not null"), 0.1, rows=30, cells=4)
    assert 25 <= chosen.count() <= 55 and chosen.join(df, "vec_id", "left_anti").count() == 0


def greedy(x, k):
    """Farthest-first, row by row."""
    at = max(range(len(x)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(x[i], np.mean(x, 0), strict=True)), -i))
    chosen = [at]
    while len(chosen) < k:
        left = [i for i in range(len(x)) if i not in chosen]
        chosen.append(max(left, key=lambda i: (min(sum((a - b) ** 2 for a, b in zip(x[i], x[c], strict=True)) for c in chosen), -i)))
    return chosen


def test_k_centre_bank_takes_the_share_of_each_category(spark):
    df = vectors(spark, 90).withColumnRenamed("g", "category")
    expected = set()
    for g in ("g0", "g1", "g2"):
        own = sorted((r.vec_id, r.embedding) for r in df.where(F.col("category") == g).collect() if r.embedding)
        expected |= {own[i][0] for i in greedy([v for _, v in own], max(1, int(0.1 * len(own))))}
    assert {r.vec_id for r in evaluation.build_bank(df, "kcentre", 0.1).collect()} == expected


def test_k_centre_bank_of_a_hundred_thousand_rows(spark):
    rows = spark.range(100_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 10)).alias("category"), F.array(*[F.rand(k) - 0.5 for k in range(3)]).alias("embedding"))
    sizes = {r.category: r["count"] for r in rows.groupBy("category").count().collect()}
    for share in (0.001, 0.02):
        made = evaluation.build_bank(rows, "kcentre", share)
        assert {r.category: r["count"] for r in made.groupBy("category").count().collect()} == {g: max(1, int(n * share)) for g, n in sizes.items()}


def test_bank_build_and_round_trip(spark, tmp_path):
    df = vectors(spark, 60).withColumnRenamed("g", "category")
    odd = spark.createDataFrame([(900, "g0", 1, [0.0] * 6), (901, "g0", 1, [float("nan")] * 6), (902, "g0", 1, [])], df.schema)
    for coreset in evaluation.CORESETS:
        made = evaluation.build_bank(df.unionByName(odd), coreset, 0.2)
        norms = [math.sqrt(sum(x * x for x in r.embedding)) for r in made.collect()]
        assert norms == pytest.approx([1.0] * len(norms)) and (len(norms) == 60 if coreset == "all" else 3 <= len(norms) <= 40)
    assert evaluation.build_bank(df, dedupe=-1.0).count() == 3  # one of each group
    with pytest.raises(ValueError, match="unknown coreset"):
        evaluation.build_bank(df, "other")
    with pytest.raises(ValueError, match="unknown search"):
        evaluation.coded_bank(df, "other")
    path = f"file://{tmp_path}/bank"
    evaluation.save_bank(made, path)
    assert evaluation.load_bank(spark, path).count() == made.count()
    assert tuple(evaluation.bank_facts(evaluation.build_bank(df)).first()) == (60, 6, 6, 6)
    made.limit(1).write.mode("overwrite").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="has 1 vectors"):
        evaluation.load_bank(spark, path)


def test_p_values(spark):
    def by_steps(rho, n):
        """Twice the tail of Student's density, by Simpson's rule over an angle."""
        df, t = n - 2, abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
        a, steps = math.atan(t / math.sqrt(df)), 4000
        h = (math.pi / 2 - a) / steps
        total = sum((1 if k in (0, steps) else 4 if k % 2 else 2) * max(0.0, math.cos(a + k * h)) ** (df - 1) for k in range(steps + 1))
        return 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * total * h / 3

    for rho, n in ((0.5, 15), (-0.9, 15), (0.01, 200), (0.3, 5), (0.99, 30)):
        assert metrics.correlation_p_value(rho, n) == pytest.approx(by_steps(rho, n), rel=1e-6)
    assert metrics.correlation_p_value(1.0, 9) == 0 and metrics.correlation_p_value(0.2, 2) is None
    df = spark.createDataFrame([(float(k), float((k * 7) % 15)) for k in range(15)], "x double, y double")
    row = metrics.spearman_test(df, "x", "y").first()
    assert row.n == 15 and row.p_value == pytest.approx(by_steps(row.rho, 15), rel=1e-6)


def test_rows_are_gone_through_again(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "name string, at int")
    take = lambda x, n: [r.name for r in metrics.first_recycled(x, "at", n).orderBy("place").collect()]
    assert take(df, 2) == ["a", "b"] and take(df, 7) == list("abcabca") and take(df, 0) == [] and take(df.limit(0), 4) == []


def test_pro_area_over_scores_on_odd_tables(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (1, 0, 0.2), (1, 1, 0.8)], "image int, region int, score double")
    area = lambda x: metrics.pro_area_over_scores(x, "score", "region", "image").first()[0]
    assert area(df) == 0  # no rate of up to 0.3 but 0
    assert area(df.where("region = 0")) is None and area(df.where("region = 1")) is None and area(df.limit(0)) is None


def test_vectors_do_not_depend_on_how_rows_are_dealt(spark):
    a = files.gaussian_vectors(spark, 50, 4, 3)
    assert sorted(map(str, a.collect())) == sorted(map(str, a.repartition(7).collect()))
    assert sorted(map(str, a.collect())) != sorted(map(str, files.gaussian_vectors(spark, 50, 4, 4).collect()))


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="5 input files"):
        files.exactly(["a", "b", "b"], 5)
    assert files.exactly(["a", "b"], 2) == ["a", "b"]
    (tmp_path / "s" / "one").mkdir(parents=True)
    (tmp_path / "s" / "one" / "split.csv").write_text("image,label\ncandle/1.png,0\n")
    (tmp_path / "s" / "two.csv").write_text("image,label\npcb/x/2.png,1\n")
    schema = T.StructType([T.StructField("image", T.StringType()), T.StructField("label", T.IntegerType())])
    assert sorted(map(tuple, files.split_table(spark, f"{tmp_path}/s", schema).collect())) == [("candle/1.png", 0, "candle"), ("pcb/x/2.png", 1, "pcb")]
    sizes = spark.createDataFrame([("a.bin", 4_000_000), ("b.pt", 1_000_000), ("c.txt", 5)], "path string, n_bytes long")
    assert tuple(files.size_ratio(sizes, F.col("path").endswith("bin"), F.col("path").endswith("pt")).first()) == (4.0, 1.0, 4.0)
    assert files.size_ratio(sizes, F.col("path").endswith("bin"), F.lit(False)).first().ratio is None
