"""Whole reports of evaluations over patches, and the same reports over tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.vectors import l2sq, norm
from orbweave.operators import evaluation, pixels, programs
from orbweave.operators.metrics import auroc
from orbweave.operators.running import quantiles
from orbweave.plans.evaluation_queries import PIXEL_SQL, SEEDS, WEIGHTS, evaluation_sql
from orbweave.plans.metric_queries import JOINED, labelled
from orbweave.plans.registry import query
from orbweave.plans.vector_queries import embeddings
from orbweave.sources.store import materialise
from orbweave.sources.tables import load, patches, union_vectors

KEYS = ("seed", "category")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _scores(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEYS, "image_id", "image_label").agg(F.max("d2").alias("score"))


@query()
def threshold_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extreme-value threshold against the 95th percentile of the training images' scores: both and their error rates."""
    found, _, bank = evaluation.patch_scores(patches(embeddings(spark, sf_dir)), SEEDS, 12)
    nominal = materialise(programs.nominal_scores(bank, bank, KEYS), "nominal")
    out = programs.threshold_comparison(nominal, materialise(_scores(found), "scores"), KEYS, tail=0.3)
    return _rounded(out, 6, *[f"{kind}_{c}" for kind in ("evt", "pct") for c in ("tau", "fpr", "fnr")])


@query(evaluation_sql((4,)) + """ SELECT seed, category, round(min(score) FILTER (y = 0), 6) AS normal_min, round(max(score) FILTER (y = 0), 6) AS normal_max, round(min(score) FILTER (y = 1), 6) AS defect_min,
    round(max(score) FILTER (y = 1), 6) AS defect_max, round(max(score) FILTER (y = 1) - min(score) FILTER (y = 0), 6) AS span FROM m GROUP BY ALL""")
def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the scores of both classes reach, by seed and category."""
    scores, _ = evaluation.evaluate(patches(embeddings(spark, sf_dir)), SEEDS, 4)
    return _rounded(programs.score_ranges(scores, KEYS), 6, "normal_min", "normal_max", "defect_min", "defect_max", "span")


@query()
def code_error_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest error of the bank's codes in percent of the span of the scores that they give."""
    found, _, bank = evaluation.patch_scores(patches(embeddings(spark, sf_dir)), SEEDS[:1], 4, "pq", bits=4)
    coded = evaluation.coded_bank(bank, "pq", bits=4).select(*KEYS, "vec_id", F.col("embedding").alias("coded"))
    error = F.sqrt(l2sq(F.col("embedding"), F.col("coded")))
    errors = bank.join(coded, [*KEYS, "vec_id"]).groupBy(*KEYS).agg(F.max(error).alias("r_max"), F.avg(error).alias("r_avg"))
    out = programs.error_share(programs.score_ranges(_scores(found), KEYS), errors, KEYS)
    return _rounded(out, 6, *[c for c in out.columns if c not in KEYS])


@query(evaluation_sql((4,)) + f""", {PIXEL_SQL}, fn AS (SELECT seed, category, count(*) FILTER (y = 1 AND score <= tau) AS false_negatives FROM k JOIN q USING (seed, category) GROUP BY ALL)
    SELECT r.seed, r.category, round(r.auroc, 6) AS image_auroc, r.n_pos AS total_defective, r.n_neg AS total_good, r.n_pos + r.n_neg AS total_images, false_negatives, pixel_auroc
    FROM res r LEFT JOIN fn USING (seed, category) LEFT JOIN px_area USING (seed, category)""")
def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and pixels of an evaluation in one table, with the defects that the 95th percentile misses."""
    rows = patches(embeddings(spark, sf_dir)).withColumn("patch_label", (F.col("label") >= 8).cast("int"))
    found, inner, _ = evaluation.patch_scores(rows, SEEDS, 4)
    found = materialise(found, "patch-scores")
    areas = pixels.pixel_auroc(evaluation.patch_maps(found, 2), KEYS, "values", "labels", pixels.upsampled(2, 8, 1.0, 1))
    taus = quantiles(materialise(inner, "support-distances"), "d2", {"tau": 0.95}, KEYS)
    out = programs.sweep_report(_scores(found), taus, areas, KEYS)
    return _rounded(_rounded(out, 6, "image_auroc"), 5, "pixel_auroc")


@query(evaluation_sql((4,)) + f""", {WEIGHTS},
    f4 AS (SELECT seed, category, image_id, max(d2) AS score FROM d GROUP BY ALL HAVING count(*) = 4),
    b3 AS (SELECT *, row_number() OVER (PARTITION BY seed, category ORDER BY score DESC, image_id) AS rank FROM f4 QUALIFY rank <= 3),
    px AS (SELECT seed, category, rank, b3.image_id, b3.score, u.i AS r, w.i AS c, sum(u.w * w.w * d2) AS s FROM b3 JOIN d USING (seed, category, image_id), up u, up w WHERE u.j = (vec_id % 4) // 2 AND w.j = vec_id % 2 GROUP BY ALL),
    sc AS (SELECT *, min(s) OVER (PARTITION BY seed, category, rank) AS low, max(s) OVER (PARTITION BY seed, category, rank) AS high FROM px)
    SELECT seed, category, rank::INTEGER AS rank, image_id, round(score, 6) AS score, (8 * r + c)::INTEGER AS pixel, round(CASE WHEN high - low > 1e-12 THEN (s - low) / (high - low) ELSE 0 END, 5) AS heat FROM sc""")
def heat_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three highest scored images of each seed and category with their maps, resampled to 8 x 8 and scaled to 0..1."""
    rows = patches(embeddings(spark, sf_dir)).withColumn("patch_label", F.lit(0))
    found, _, _ = evaluation.patch_scores(rows, SEEDS, 4)
    best = programs.top_heat_maps(evaluation.patch_maps(found, 2), KEYS, 2, 8)
    return best.select(*KEYS, "rank", "image_id", F.round("score", 6).alias("score"), F.posexplode("heat").alias("pixel", "heat")).withColumn("heat", F.round("heat", 5))


@query("""WITH f AS (SELECT event_type AS category, user_id % 5 AS seed, CASE event_id % 3 WHEN 0 THEN '4-bit' WHEN 1 THEN '8' ELSE '12-bit' END AS bits, user_id, nullif(round((avg(value) - 10) / 10, 6), 0.1) AS shape, max(value) AS scale FROM events WHERE value IS NOT NULL AND user_id % 5 < 4 GROUP BY ALL),
    g AS (SELECT event_type AS category, user_id % 5 AS seed, CASE event_id % 2 WHEN 0 THEN '4' ELSE '8-bit' END AS bits, user_id, nullif(round((avg(value) - 10) / 10, 6), 0.1) AS shape, max(value) AS scale FROM events WHERE value IS NOT NULL GROUP BY ALL),
    a AS (SELECT * FROM f UNION ALL SELECT * FROM g WHERE NOT EXISTS (FROM f WHERE f.category = g.category AND f.seed = g.seed)),
    n AS (SELECT *, CASE WHEN bits IN ('4', '4-bit') THEN 4 WHEN bits IN ('8', '8-bit') THEN 8 END AS bit_depth FROM a),
    o AS (SELECT * FROM n WHERE bit_depth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category, seed, bit_depth ORDER BY user_id) = 1),
    t AS (SELECT category, bit_depth, avg(shape) AS sm, stddev_pop(shape) AS ss, avg(scale) AS cm, stddev_pop(scale) AS cs, count(*) AS n_seeds FROM o WHERE shape IS NOT NULL AND scale IS NOT NULL GROUP BY ALL)
    SELECT category, bit_depth, round(sm, 5) AS shape_mean, round(ss, 5) AS shape_sd, round(cm, 5) AS scale_mean, round(cs, 5) AS scale_sd, n_seeds,
    (max(sm) FILTER (bit_depth = 4) OVER (PARTITION BY category) > 0 AND max(sm) FILTER (bit_depth = 8) OVER (PARTITION BY category) < 0) AS sign_flip FROM t""")
def fits_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of two bit depths over seeds, where some seeds are in the second source only and bits are written in several ways."""
    e = load(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("category"), (F.col("user_id") % 5).alias("seed"), "user_id", "event_id", "value")

    def fits(rows: DataFrame, bits: F.Column) -> DataFrame:
        by_user = rows.withColumn("bits", bits).groupBy("category", "seed", "bits", "user_id")
        return by_user.agg(F.nullif(F.round((F.avg("value") - 10) / 10, 6), F.lit(0.1)).alias("shape"), F.max("value").alias("scale"))

    third, half = F.col("event_id") % 3, F.col("event_id") % 2
    first = fits(e.where("seed < 4"), F.when(third == 0, "4-bit").when(third == 1, "8").otherwise("12-bit"))
    second = fits(e, F.when(half == 0, "4").otherwise("8-bit"))
    return _rounded(programs.fits_by_bits(first, second, "user_id"), 5, "shape_mean", "shape_sd", "scale_mean", "scale_sd")


@query("""WITH q AS (SELECT left(p_brand, 7) AS brand, p_size % 3 AS setting, avg(p_retailprice) AS quality FROM part GROUP BY ALL),
    c AS (SELECT left(p_brand, 7) AS brand, p_size % 3 AS setting, avg(l_quantity) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), b AS (SELECT * FROM q JOIN c USING (brand, setting))
    SELECT b.brand, b.setting, round(b.quality, 4) AS quality, round(b.cost, 4) AS cost, round(b.quality - r.quality, 4) AS quality_change, round((b.quality - r.quality) / r.quality * 100, 4) AS quality_percent,
    round(r.cost - b.cost, 4) AS cost_reduction, round((r.cost - b.cost) / r.cost * 100, 4) AS cost_percent FROM b JOIN b r ON b.brand = r.brand AND r.setting = 0""")
def trade_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with what they gain and save against setting 0 of their group, from two tables of results."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("brand"), (F.col("p_size") % 3).alias("setting"), "p_retailprice")
    quality = part.groupBy("brand", "setting").agg(F.avg("p_retailprice").alias("quality"))
    sold = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    cost = sold.join(part, "p_partkey").groupBy("brand", "setting").agg(F.avg("l_quantity").alias("cost"))
    out = programs.trade_off(quality, cost, "brand", "setting", 0)
    return _rounded(out, 4, *[c for c in out.columns if c not in ("brand", "setting")])


@query()
def code_parts_trade_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC and bytes a vector by the parts of its code, per category, against 8 parts."""
    rows, quality = patches(embeddings(spark, sf_dir)), None
    for m in (8, 16, 32):
        scores, _ = evaluation.evaluate(rows, SEEDS[:1], 4, "pq", m=m, bits=4)
        one = auroc(materialise(scores, "scores"), "score", "image_label", ("category",)).select("category", F.lit(m).alias("m"), F.col("auroc").alias("quality"))
        quality = one if quality is None else quality.unionByName(one)
    cost = quality.select("category", "m", (F.col("m") * 4 / 8).alias("cost"))
    out = programs.trade_off(quality, cost, "category", "m", 8)
    return _rounded(out, 6, *[c for c in out.columns if c not in ("category", "m")])


@query("""WITH i AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS item FROM events), w AS (SELECT * FROM i WHERE item >= 1 AND value IS NOT NULL),
    a AS (SELECT event_type AS stage, value FROM w UNION ALL SELECT 'total', sum(value) FROM w GROUP BY user_id, item),
    s AS (SELECT stage, count(*) AS n, avg(value) AS m, stddev_pop(value) AS d, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM a GROUP BY 1)
    SELECT stage, n, round(m, 6) AS mean_ms, round(d, 6) AS std_ms, round(p50, 6) AS p50_ms, round(p95, 6) AS p95_ms, round(p99, 6) AS p99_ms, round(m / (SELECT m FROM s WHERE stage = 'total') * 100, 6) AS share_percent, round(1000 / m, 6) AS per_second FROM s""")
def latency_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of stages and of whole items without the first of each run; an event's value is its duration, a user a run."""
    place = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    timings = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("ms"), (F.row_number().over(place) - 1).alias("item"))
    out = programs.breakdown(timings, "user_id", "item", "stage", "ms")
    return _rounded(out, 6, *[c for c in out.columns if c not in ("stage", "n")])


@query("""WITH s AS (SELECT event_type, user_id, count(*) AS n, min(epoch_us(ts)) AS b, max(epoch_us(ts) + round(value * 1000)::BIGINT) AS e FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    t AS (SELECT event_type AS tier, count(*) AS n_streams, sum(n)::BIGINT AS n_images, (max(e) - min(b)) / 1e6 AS wall, quantile_cont((e - b) / 1000 / n, 0.95) AS p95 FROM s GROUP BY 1)
    SELECT tier, n_streams, n_images, round(wall, 6) AS wall_seconds, round(n_images / wall, 9) AS per_second, round(wall * 1000 / n_images, 4) AS mean_ms, round(p95, 4) AS p95_ms FROM t""")
def stream_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput of concurrent streams: a kind of event is a tier, a user a stream."""
    began = F.unix_micros(F.col("ts").cast("timestamp"))
    runs = load(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), "user_id", began.alias("began"), (began + F.round(F.col("value") * 1_000).cast("long")).alias("ended"))
    out = programs.concurrency(runs, "tier", "user_id", "began", "ended")
    return _rounded(_rounded(_rounded(out, 6, "wall_seconds"), 9, "per_second"), 4, "mean_ms", "p95_ms")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P'),
    j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.place, b.place) AS place, a.o_orderkey AS x, b.o_orderkey AS y FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.place = b.place),
    d AS (SELECT *, x IS DISTINCT FROM y AS differs, row_number() OVER (PARTITION BY o_custkey, x IS DISTINCT FROM y ORDER BY place) AS n FROM j)
    SELECT o_custkey, count(x) AS n_first, count(y) AS n_second, count(*) FILTER (differs) AS n_different, count(*) FILTER (differs) = 0 AS equal, coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (differs AND n <= 3), '') AS differing FROM d GROUP BY 1""")
def position_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's orders come in the same order by date and by key, where the second leaves pending ones out."""
    o = load(spark, sf_dir, "orders")
    placed = lambda rows, *by: rows.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by)).alias("place"))
    return programs.compare_by_position(placed(o, "o_orderdate", "o_orderkey"), placed(o.where("o_orderstatus <> 'P'"), "o_orderkey"), ["o_custkey"], "place", "o_orderkey")


@query("""WITH h AS (SELECT p_brand, max(p_partkey % 100) AS high FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1)
    SELECT p_partkey, p_brand || '_' || (coalesce(high, 0) + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::BIGINT AS new_name FROM part LEFT JOIN h USING (p_brand) WHERE p_partkey % 3 = 0""")
def next_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for new rows that go on after the numbers of their brand."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    existing = p.where("p_partkey % 3 <> 0").select("p_brand", F.concat_ws("_", "p_brand", F.col("p_partkey") % 100).alias("name"))
    return programs.next_names(existing, p.where("p_partkey % 3 = 0"), "p_brand", "name", "p_partkey").select("p_partkey", "new_name")


@query(f"""WITH j AS (SELECT * FROM ({JOINED}) WHERE lang IS NOT NULL), s AS (SELECT lang, n_chars::DOUBLE AS score, sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg FROM j GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS np, sum(neg) OVER (PARTITION BY lang) AS nn FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
    f AS (SELECT *, tp / (tp + fp) AS p, tp / np AS r FROM c), g AS (SELECT *, round(2 * p * r / (p + r + 1e-8), 9) AS f1 FROM f),
    b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score DESC) = 1),
    t AS (SELECT lang, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, 1 - sum(pos * (fp - neg / 2.0)) / (max(np) * max(nn)) AS auroc, sum(pos / np * p) AS ap FROM g GROUP BY 1),
    d AS (SELECT lang, avg((n_chars > 1500)::INTEGER) AS dr, avg((n_chars > 1500 AND quality = 0)::INTEGER) AS fr FROM j GROUP BY 1)
    SELECT lang, n_pos, n_neg, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision, round(f1, 6) AS f1, score AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(dr, 6) AS detection_rate, round(fr, 6) AS false_positive_rate
    FROM t JOIN b USING (lang) JOIN d USING (lang)""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the ranking of labelled documents by their length, a language."""
    out = programs.metrics_of(labelled(spark, sf_dir).where("lang is not null"), "n_chars", "quality", ("lang",), 1_500)
    return _rounded(out, 6, *[c for c in out.columns if c not in ("lang", "n_pos", "n_neg", "threshold")])


@query("SELECT 'label-' || label AS key, count(*) AS n, 64 AS width, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS norm_mean FROM embeddings WHERE label IN (0, 3, 7) GROUP BY label")
def multi_key_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of several tables as one, after a check of their widths; a table without vectors is passed over."""
    e = embeddings(spark, sf_dir)
    parts = {f"label-{k}": e.where(F.col("label") == k) for k in (0, 3, 7)} | {"names": load(spark, sf_dir, "nation")}
    return union_vectors(parts).groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.round(F.avg(norm(F.col("embedding"))), 6).alias("norm_mean"))
