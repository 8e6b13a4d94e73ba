"""Evaluations over seeds, shots, searches and reductions, and the banks behind them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.vectors import norm
from orbweave.operators import bank, evaluation, evt, knn, pixels, reports, vector_index
from orbweave.operators.experiments import ProgressTable
from orbweave.operators.metrics import auroc
from orbweave.plans.registry import query
from orbweave.plans.vector_queries import L2SQ, embeddings
from orbweave.sources.store import materialise, shared_dir
from orbweave.sources.tables import patches

SEEDS = (111, 333, 999)


def _views(orbit: bool, turns: int) -> tuple[str, str]:
    """In SQL: the views of a bank's grids as a table, and the tested grids turned; places by NumPy's own turns."""
    grid = np.arange(64).reshape(8, 8)
    at = [np.rot90(np.fliplr(grid) if m else grid, t).ravel().tolist() for m in (0, 1) for t in range(4)] if orbit else [grid.ravel().tolist()]
    turned = "v" if not turns else f"list_transform({np.rot90(grid, turns).ravel().tolist()}, lambda i: v[i + 1])"
    return ", ".join(f"({a})" for a in at), turned


def evaluation_sql(shots: tuple[int, ...], orbit: bool = False, turns: int = 0) -> str:
    """Common table expressions up to ``res``: AUROC, tau, FPR and FNR per shots, seed and category."""
    views, turned = _views(orbit, turns)
    seeds, sizes = ", ".join(f"({s})" for s in SEEDS), ", ".join(f"({s})" for s in shots)
    return f"""
    WITH p AS (SELECT vec_id, vec_id // 4 AS image_id, 'c' || ((vec_id // 4) % 3) AS category, label, embedding::DOUBLE[] AS v FROM embeddings),
    i AS (SELECT image_id, category, max((label >= 8)::INTEGER) AS y FROM p GROUP BY 1, 2),
    r AS (SELECT seed, i.*, row_number() OVER (PARTITION BY seed, category ORDER BY md5(seed || ':' || image_id), image_id) AS n FROM i, (VALUES {seeds}) s(seed) WHERE y = 0),
    s AS (SELECT n_shot, seed, category, image_id FROM r, (VALUES {sizes}) z(n_shot) WHERE n <= n_shot),
    b AS (SELECT s.*, vec_id, list_transform(places, lambda i: v[i + 1]) AS v FROM s JOIN p USING (category, image_id), (VALUES {views}) views(places)),
    t AS (SELECT n_shot, seed, p.* REPLACE ({turned} AS v), y FROM p JOIN i USING (image_id), (VALUES {seeds}) s(seed), (VALUES {sizes}) z(n_shot)),
    d AS (SELECT t.n_shot, t.seed, t.category, t.image_id, y, t.vec_id, round(min({L2SQ.format(a='t.v', b='b.v')}), 9) AS d2
          FROM t JOIN b ON t.n_shot = b.n_shot AND t.seed = b.seed AND t.category = b.category
          WHERE NOT EXISTS (FROM s WHERE s.n_shot = t.n_shot AND s.seed = t.seed AND s.image_id = t.image_id) GROUP BY ALL),
    m AS (SELECT n_shot, seed, category, image_id, y, max(d2) AS score FROM d GROUP BY ALL),
    k AS (SELECT *, rank() OVER (PARTITION BY n_shot, seed, category ORDER BY score) + (count(*) OVER (PARTITION BY n_shot, seed, category, score) - 1) / 2.0 AS rk FROM m),
    e AS (SELECT a.n_shot, a.seed, a.category, a.vec_id, round(min({L2SQ.format(a='a.v', b='b.v')}), 9) AS d2
          FROM b a JOIN b ON a.n_shot = b.n_shot AND a.seed = b.seed AND a.category = b.category AND a.image_id <> b.image_id GROUP BY ALL),
    q AS (SELECT n_shot, seed, category, quantile_cont(d2, 0.95) AS tau FROM e GROUP BY ALL),
    res AS (SELECT n_shot, seed, category, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
          (sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auroc, any_value(tau) AS tau,
          avg((score > tau)::INTEGER) FILTER (y = 0) AS fpr, avg((score <= tau)::INTEGER) FILTER (y = 1) AS fnr
          FROM k LEFT JOIN q USING (n_shot, seed, category) GROUP BY ALL)"""


def _result(spark: SparkSession, sf_dir: str, shots: int, **search) -> DataFrame:
    return evaluation.evaluated(*evaluation.evaluate(patches(embeddings(spark, sf_dir)), SEEDS, shots, **search))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(evaluation_sql((4,)) + " SELECT seed, category, n_pos, n_neg, round(auroc, 6) AS auroc, round(tau, 6) AS tau, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM res")
def seeded_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank of four images a category and seed: AUROC, and the error rates at the 95th percentile of its own distances."""
    return _rounded(_result(spark, sf_dir, 4), "auroc", "tau", "fpr", "fnr")


@query(evaluation_sql((4,)) + """, g AS (SELECT category, avg(auroc) AS m, coalesce(stddev_samp(auroc), 0) AS s FROM res GROUP BY 1)
    SELECT category, round(m, 6) AS auroc_mean, round(s, 6) AS auroc_sd FROM g UNION ALL SELECT 'overall', round(avg(m), 6), round(coalesce(stddev_samp(m), 0), 6) FROM g""")
def seeded_evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the seeds, with an overall row."""
    return _rounded(reports.mean_sd_table(_result(spark, sf_dir, 4), "category", ["auroc"], overall="overall"), "auroc_mean", "auroc_sd")


@query(evaluation_sql((1, 2, 8)) + " SELECT n_shot, round(avg(auroc), 6) AS auroc, count(auroc) AS n FROM res GROUP BY 1")
def shots_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AUROC by the size of the support."""
    made = [_result(spark, sf_dir, s).agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.count("auroc").alias("n")).withColumn("n_shot", F.lit(s)) for s in (1, 2, 8)]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with a label of their own; an image is 2 x 2 of them."""
    return patches(embeddings(spark, sf_dir)).withColumn("patch_label", (F.col("label") >= 8).cast("int"))


#: Bicubic weights from 2 to 8 points and a blur of one point either way, by their formulas.
WEIGHTS = """
    wo AS (SELECT i, floor((i + 0.5) / 4 - 0.5)::INTEGER AS b, (i + 0.5) / 4 - 0.5 AS x FROM (SELECT i::DOUBLE AS i FROM range(0, 8) r(i))),
    wc AS (SELECT i, least(1, greatest(0, j)) AS j, abs(x - j) AS d FROM wo, LATERAL (SELECT unnest(range(b - 1, b + 3)) AS j)),
    up AS (SELECT i, j, sum(CASE WHEN d <= 1 THEN 1.25 * d * d * d - 2.25 * d * d + 1 ELSE -0.75 * (d * d * d - 5 * d * d + 8 * d - 4) END) AS w FROM wc GROUP BY ALL),
    wg AS (SELECT k, exp(-0.5 * k * k)::DOUBLE / (1 + 2 * exp(-0.5::DOUBLE)) AS w FROM range(-1, 2) r(k)),
    ws AS (SELECT i, CASE WHEN i + k < 0 THEN -1 - i - k WHEN i + k > 7 THEN 15 - i - k ELSE i + k END AS n, w FROM range(0, 8) r(i), wg),
    wt AS (SELECT ws.i, up.j, sum(ws.w * up.w) AS w FROM ws JOIN up ON up.i = ws.n GROUP BY ALL)"""


#: Common table expressions up to ``px_area``: the AUROC of pixels by seed and category.
PIXEL_SQL = f"""{WEIGHTS},
    m4 AS (SELECT d.seed, d.category, d.image_id, d.vec_id % 4 AS p, d2, (label >= 8)::INTEGER AS y FROM d JOIN embeddings USING (vec_id)),
    full4 AS (SELECT * FROM m4 JOIN (SELECT seed, image_id FROM m4 GROUP BY ALL HAVING count(*) = 4) USING (seed, image_id)),
    px AS (SELECT seed, category, image_id, a.i AS r, b.i AS c, round(sum(a.w * b.w * d2), 9) AS s, max(y) FILTER (p = 2 * (a.i // 4) + b.i // 4) AS y FROM full4, wt a, wt b WHERE a.j = p // 2 AND b.j = p % 2 GROUP BY ALL),
    px_s AS (SELECT seed, category, s, sum(y) AS pos, sum(1 - y) AS neg FROM px GROUP BY ALL),
    px_w AS (SELECT *, sum(neg) OVER (PARTITION BY seed, category ORDER BY s) - neg AS below FROM px_s),
    px_area AS (SELECT seed, category, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 5) AS pixel_auroc FROM px_w GROUP BY ALL)"""


@query(evaluation_sql((4,)) + f", {PIXEL_SQL} SELECT * FROM px_area")
def pixel_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC over all pixels of the maps of distances, resampled from 2 x 2 to 8 x 8 and blurred, by seed and category."""
    found, _, _ = evaluation.patch_scores(_patches(spark, sf_dir), SEEDS, 4)
    maps = evaluation.patch_maps(materialise(found, "patch-scores"), 2)
    made = pixels.pixel_auroc(maps, ("seed", "category"), "values", "labels", pixels.upsampled(2, 8, 1.0, 1))
    return made.withColumn("pixel_auroc", F.round("pixel_auroc", 5))


@query()
def whole_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of an evaluation by codes: AUROC of images and pixels, extreme-value threshold, error rates, error of the codes."""
    made = evaluation.evaluate_whole(_patches(spark, sf_dir), SEEDS, 4, 2, 16, "pq", bits=2, sigma=2.0, tail=0.2, alpha=0.05)
    return _rounded(made, *[c for c in made.columns if c not in ("seed", "category", "n_pos", "n_neg")])


def _grid(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query()
def bits_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AUROC by the bits of the codes; no bits for the exact search."""
    runs = [(None, {}), (2, {"search": "pq", "bits": 2}), (4, {"search": "pq", "bits": 4})]
    return _grid([_result(spark, sf_dir, 4, **how).agg(F.round(F.avg("auroc"), 6).alias("auroc")).withColumn("bits", F.lit(bits).cast("int")) for bits, how in runs])


@query()
def ablation_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC with and without unit norms, by exact search and by codes."""
    plain = patches(embeddings(spark, sf_dir))
    unit = evaluation.build_bank(plain)
    out = []
    for name, rows in (("raw", plain), ("unit", unit)):
        for search in evaluation.SEARCHES:
            scores, _ = evaluation.evaluate(rows, SEEDS, 4, search)
            out.append(auroc(scores, "score", "image_label", ("seed", "category")).agg(F.round(F.avg("auroc"), 6).alias("auroc")).select(F.lit(name).alias("vectors"), F.lit(search).alias("search"), "auroc"))
    return _grid(out)


def _means(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    scores, _ = evaluation.evaluate(patches(embeddings(spark, sf_dir)), SEEDS[:2], 4, **how)
    return auroc(materialise(scores, "scores"), "score", "image_label", ("seed", "category")).groupBy("category").agg(F.avg("auroc").alias("auroc"))


_P4M_SQL = " UNION ALL ".join(f"SELECT category, {str(o).lower()} AS p4m, round(avg(auroc), 6) AS auroc FROM ({evaluation_sql((4,), o)} SELECT * FROM res WHERE seed IN (111, 333)) GROUP BY category" for o in (False, True))


@query(_P4M_SQL)
def p4m_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC by exact search with a bank of all eight views of its grids, and of one."""
    return _grid([_rounded(_means(spark, sf_dir, orbit_side=8 if o else None), "auroc").select("category", F.lit(o).alias("p4m"), "auroc") for o in (False, True)])


@query()
def p4m_ablation_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean AUROC with all views or one, by exact search and by codes."""
    out = []
    for o in (False, True):
        for search in evaluation.SEARCHES:
            mean = _means(spark, sf_dir, search=search, orbit_side=8 if o else None).agg(F.round(F.avg("auroc"), 6).alias("auroc"))
            out.append(mean.select(F.lit(o).alias("p4m"), F.lit(search).alias("search"), "auroc"))
    return _grid(out)


_TURNS_SQL = " UNION ALL ".join(f"SELECT category, {str(o).lower()} AS p4m, {90 * k} AS degrees, avg(auroc) AS auroc FROM ({evaluation_sql((4,), o, k)} SELECT * FROM res WHERE seed IN (111, 333)) GROUP BY category" for o in (False, True) for k in range(4))


@query(f"""WITH a AS ({_TURNS_SQL}), b AS (SELECT a.*, 100 * (r.auroc - a.auroc) AS dropped FROM a JOIN a r ON a.category = r.category AND a.p4m = r.p4m AND r.degrees = 0)
    SELECT category, p4m, degrees, round(auroc, 6) AS auroc, round(dropped, 4) AS drop_points, abs(dropped) <= 2 AS within_2 FROM b""")
def rotation_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC when the tested grids are turned, with and without all views in the bank; the drop against those not turned."""
    parts = [_means(spark, sf_dir, orbit_side=8 if o else None, turns=k).select("category", F.lit(o).alias("p4m"), F.lit(90 * k).alias("degrees"), "auroc") for o in (False, True) for k in range(4)]
    rows = materialise(_grid(parts), "turned")
    drops = reports.against_reference(rows, ["category", "p4m"], F.col("degrees") == 0, "auroc")
    dropped = 100 * (F.col("reference") - F.col("auroc"))
    return drops.select("category", "p4m", "degrees", F.round("auroc", 6).alias("auroc"), F.round(dropped, 4).alias("drop_points"), (F.abs(dropped) <= 2).alias("within_2"))


@query()
def index_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail's fit and threshold on distances that an exact search, inverted lists and two codes give, against the exact one."""
    e = embeddings(spark, sf_dir).where("label < 8")
    asked = e.where("vec_id % 20 = 0")
    at = lambda name: f"{shared_dir(spark)}/orbweave/stability-{name}-{uuid.uuid4().hex}"
    exact = knn.exact_knn(asked, e, 1, exclude="id").select(F.lit("exact").alias("search"), "d2")
    parts = [exact]
    for name, how in (("ivf", {}), ("ivfpq-4", {"m": 16, "bits": 4}), ("ivfpq-8", {"m": 16, "bits": 8})):
        index = vector_index.build_index(e, at(name), 8, recall=None, n_probe=2, **how)
        parts.append(vector_index.search_index(asked, index, 1, exclude_self=True).select(F.lit(name).alias("search"), "d2"))
    rows = materialise(_grid(parts), "stability")
    fits = evt.gpd_thresholds(rows, "d2", ("search",), 0.3, 0.05)
    return reports.against_reference(fits, [], F.col("search") == "exact", "tau").select("search", "n_tail", *[F.round(c, 6).alias(c) for c in ("u", "shape", "scale", "tau", "delta")])


@query(f"""WITH n AS (SELECT count(*) AS n, greatest(1, least(64, floor(count(*) * 0.1)))::INTEGER AS k FROM embeddings), l AS (SELECT DISTINCT floor(i * ((n - 1) / (k - 1)::DOUBLE))::BIGINT AS place FROM n, range(0, 64) r(i) WHERE i < k - 1 UNION SELECT n - 1 FROM n),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), d AS (SELECT e.vec_id, min({L2SQ.format(a='e.v', b='b.v')}) AS d2 FROM e, e b JOIN l ON b.place = l.place GROUP BY 1)
    SELECT count(*) AS n, round(avg(d2), 6) AS distance_mean, round(stddev_pop(d2), 6) AS distance_sd FROM d""")
def bank_distance_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of all vectors' distances to a bank of evenly spaced ones."""
    e = embeddings(spark, sf_dir)
    return _rounded(evaluation.distance_statistics(e, materialise(bank.evenly_spaced(e, "vec_id"), "bank")), "distance_mean", "distance_sd")


@query()
def quantised_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tail's fit and threshold move with the index; each setting's result is kept as soon as it is there."""
    settings = spark.createDataFrame([("exact", 0), ("pq", 2), ("pq", 4)], "search string, bits int")
    rows = patches(embeddings(spark, sf_dir))

    def one(setting: Row) -> DataFrame:
        scores, _ = evaluation.evaluate(rows, SEEDS, 4, setting.search, bits=setting.bits or 4)
        fits = evt.gpd_thresholds(materialise(scores.where("image_label = 0"), "scores"), "score", ("category",), 0.2, 0.01)
        return fits.select("category", "n_tail", *[F.round(c, 4).alias(c) for c in ("u", "shape", "scale", "tau")])

    kept = ProgressTable(spark, f"{shared_dir(spark)}/orbweave/grid-{uuid.uuid4().hex}", ["search", "bits"])
    kept.run(settings, one)
    return kept.results(settings)


@query()
def pca_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC in 16 principal dimensions that are fitted on the support only."""
    rows = patches(embeddings(spark, sf_dir))
    normal = rows.where("image_label = 0").select("category", "image_id").distinct()
    support = rows.join(evaluation.draw_support(normal, SEEDS[:1], 8), ["category", "image_id"], "left_semi")
    mean, axes, _ = bank.principal_axes(support)
    scores, _ = evaluation.evaluate(bank.project(rows, mean, axes[:16]), SEEDS[:1], 8)
    return _rounded(auroc(scores, "score", "image_label", ("category",)), "auroc")


@query("""WITH n AS (SELECT count(*) AS n, greatest(1, least(64, floor(count(*) * 0.1)))::BIGINT AS k FROM embeddings)
    SELECT k AS n, 64 AS width, greatest(1, least(100, k // 10))::BIGINT AS n_lists, 64 AS m, 1.0::DOUBLE AS least_norm FROM n""")
def bank_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank of evenly spaced vectors with unit norm, and what its index takes."""
    rows = patches(embeddings(spark, sf_dir))
    made = materialise(evaluation.build_bank(rows, "linspace"), "bank")
    least = made.agg(F.round(F.min(norm(F.col("embedding"))), 6)).first()[0]
    return evaluation.bank_facts(made).withColumn("least_norm", F.lit(least))


@query("SELECT category, count(*) AS n FROM (SELECT 'c' || ((vec_id // 4) % 3) AS category FROM embeddings) GROUP BY 1")
def bank_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank that is written, read again and checked."""
    path = f"{shared_dir(spark)}/orbweave/bank-{uuid.uuid4().hex}"
    evaluation.save_bank(evaluation.build_bank(patches(embeddings(spark, sf_dir))), path)
    return evaluation.load_bank(spark, path).groupBy("category").agg(F.count("*").alias("n"))
