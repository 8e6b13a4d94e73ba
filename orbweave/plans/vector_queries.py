"""Vector functions and nearest-neighbour search over ``embeddings``.

Searches take as queries every vector whose id is divisible by 20, against all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import vectors as V
from orbweave.operators import diagnostics, knn, vector_index
from orbweave.operators.evaluation import bank_distances
from orbweave.operators.metrics import auroc
from orbweave.operators.vector_index import VectorIndex
from orbweave.plans.registry import query
from orbweave.sources.store import Kept, materialise
from orbweave.sources.tables import load, patches, vector_faults

QUERY_STEP = 20
#: Indexes that searches share.
KEPT = Kept("index")

#: Squared distance of two double arrays in SQL.
L2SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


def is_query() -> F.Column:
    return F.col("vec_id") % QUERY_STEP == 0


def knn_sql(k: int, keep: str = "true") -> str:
    d = L2SQ.format(a="q.v", b="b.v")
    return f"""
    WITH e AS (SELECT vec_id, vec_id // 4 AS image_id, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, {d} AS d2
          FROM e q JOIN e b ON {keep} WHERE q.vec_id % {QUERY_STEP} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), neighbour_id) AS rank FROM d)
    SELECT query_id, rank::INTEGER AS rank, neighbour_id, round(d2, 6) AS d2 FROM r WHERE rank <= {k}"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("d2", F.round("d2", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first_unit FROM embeddings")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    v = F.col("embedding")
    return e.select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.get(V.normalise(v), F.lit(0)), 6).alias("first_unit"))


@query(f"""SELECT a.vec_id, round({L2SQ.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, 6) AS d2,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance and cosine of each vector to the next."""
    e = embeddings(spark, sf_dir)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    v, w = F.col("embedding"), F.col("other")
    return e.join(after, "vec_id").select("vec_id", F.round(V.l2sq(v, w), 6).alias("d2"), F.round(V.cosine(v, w), 6).alias("cosine"))


@query("SELECT count(*) AS n_vectors, count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (len(embedding) <> 64) AS n_wrong_width, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS n_not_finite FROM embeddings")
def vec_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_faults(embeddings(spark, sf_dir), 64)


@query("SELECT (i - 1)::INTEGER AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def vec_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.operators.bank import column_means

    stats = column_means(embeddings(spark, sf_dir))
    return stats.select("dim", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("SELECT vec_id, len(list_concat(embedding, embedding))::INTEGER AS width, round(list_sum(list_concat(embedding, embedding)::DOUBLE[]), 5) AS total FROM embeddings")
def vec_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("both", V.doubles(F.concat("embedding", "embedding")))
    return e.select("vec_id", F.size("both").alias("width"), F.round(F.aggregate("both", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(knn_sql(1))
def knn_exact_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _rounded(knn.exact_knn(e.where(is_query()), e, 1))


@query(knn_sql(5))
def knn_exact_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _rounded(knn.exact_knn(e.where(is_query()), e, 5))


@query(knn_sql(9, "q.vec_id <> b.vec_id"))
def knn_self_exclude_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _rounded(knn.exact_knn(e.where(is_query()), e, 9, exclude="id"))


@query(knn_sql(1, "q.image_id <> b.image_id"))
def knn_self_exclude_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("image_id", F.floor(F.col("vec_id") / 4))
    return _rounded(knn.exact_knn(e.where(is_query()), e, 1, group="image_id", exclude="group"))


@query(f"""WITH t AS ({knn_sql(2)}) SELECT a.query_id, CASE WHEN a.neighbour_id // 4 = a.query_id // 4 THEN b.d2 ELSE a.d2 END AS d2
    FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2""")
def knn_second_if_own_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest distance, or the second if the nearest is of the same image (one alternative only)."""
    e = embeddings(spark, sf_dir)
    found = _rounded(knn.exact_knn(e.where(is_query()), e, 2))
    own = F.floor(F.col("neighbour_id") / 4) == F.floor(F.col("query_id") / 4)
    per = found.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, own)).alias("own"), F.max(F.when(F.col("rank") == 1, F.col("d2"))).alias("d_1"), F.max(F.when(F.col("rank") == 2, F.col("d2"))).alias("d_2"))
    return per.select("query_id", F.when(F.col("own"), F.col("d_2")).otherwise(F.col("d_1")).alias("d2"))


#: Images are four vectors; nominal ones with an id divisible by 5 support, the others are tested.
SLICE_SQL = f"""
    WITH p AS (SELECT vec_id, vec_id // 4 AS image_id, 'c' || ((vec_id // 4) % 3) AS category, label, embedding::DOUBLE[] AS v FROM embeddings),
    i AS (SELECT image_id, max((label >= 8)::INTEGER) AS y FROM p GROUP BY 1),
    s AS (SELECT p.* FROM p JOIN i USING (image_id) WHERE y = 0 AND image_id % 5 = 0),
    t AS (SELECT p.*, y FROM p JOIN i USING (image_id) WHERE NOT (y = 0 AND image_id % 5 = 0)),
    d AS (SELECT t.image_id, t.category, t.y, t.vec_id, min({L2SQ.format(a='t.v', b='s.v')}) AS d2 FROM t JOIN s ON true GROUP BY 1, 2, 3, 4),
    m AS (SELECT image_id, category, y, max(d2) AS score FROM d GROUP BY 1, 2, 3)"""


def slice_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Support patches and test patches."""
    p = patches(embeddings(spark, sf_dir))
    supports = (F.col("image_label") == 0) & (F.col("image_id") % 5 == 0)
    return p.where(supports), p.where(~supports)


def patch_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test patches with the squared distance to the nearest support patch.

    The support patches, the smaller side, go to the test patches in blocks.
    """
    support, test = slice_parts(spark, sf_dir)
    return bank_distances(test, support, []).where("d2 is not null")


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_distances(spark, sf_dir).groupBy("category", "image_id", "image_label").agg(F.max("d2").alias("score"))


def kept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image scores, written once: what ranks them reads them in several jobs, each of which would search anew."""
    return materialise(image_scores(spark, sf_dir), "image-scores")


@query(SLICE_SQL + " SELECT category, image_id, y AS image_label, round(score, 6) AS score FROM m")
def image_score_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


AUC_OF_M = """SELECT {g} sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
    round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc
    FROM (SELECT *, rank() OVER ({p} ORDER BY s) + (count(*) OVER ({p2} s) - 1) / 2.0 AS r FROM (SELECT *, round(score, 9) AS s FROM m)) {h}"""


@query(SLICE_SQL + AUC_OF_M.format(g="", p="", p2="PARTITION BY", h=""))
def golden_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, exact search, image score, AUROC: the flagship query."""
    scores = kept_scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return auroc(scores, "score", "image_label").withColumn("auroc", F.round("auroc", 6))


@query(SLICE_SQL + AUC_OF_M.format(g="category,", p="PARTITION BY category", p2="PARTITION BY category,", h="GROUP BY category"))
def golden_slice_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = kept_scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return auroc(scores, "score", "image_label", ("category",)).withColumn("auroc", F.round("auroc", 6))


@query(f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT a.vec_id, a.label, min({L2SQ.format(a='a.v', b='b.v')}) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.label = b.label GROUP BY 1, 2)
    SELECT label, count(*) AS n, round(var_pop(sqrt(d2)), 6) AS nndv FROM d GROUP BY 1""")
def nndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of nearest-neighbour distances within each label, the vector itself left out."""
    e = embeddings(spark, sf_dir).where(F.col("label").isNotNull())
    return knn.self_nearest(e, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.var_pop(F.sqrt("d2")), 6).alias("nndv"))


def kept_index(spark: SparkSession, sf_dir: str, **how) -> VectorIndex:
    """An index of ``embeddings`` in the shared folder: built by the first search that asks for it, then opened."""
    return KEPT.get(f"{sf_dir}-{sorted(how.items())}", spark, lambda path: vector_index.build_index(embeddings(spark, sf_dir), path, **how), lambda path: vector_index.open_index(spark, path))


@query()
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _rounded(vector_index.search_index(e.where(is_query()), kept_index(spark, sf_dir, n_lists=16, n_probe=4), 5))


@query(knn_sql(5))
def knn_ivf_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all lists probed, inverted lists give the exact result."""
    e = embeddings(spark, sf_dir)
    return _rounded(vector_index.search_index(e.where(is_query()), kept_index(spark, sf_dir, n_lists=8, recall=None), 5, n_probe=8))


@query()
def knn_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _rounded(vector_index.search_index(e.where(is_query()), kept_index(spark, sf_dir, n_lists=16, n_probe=4, m=32, bits=8), 5))


@query()
def knn_pq_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes without lists: every code is compared, the candidates are ranked by their vectors."""
    e = embeddings(spark, sf_dir)
    return _rounded(vector_index.search_index(e.where(is_query()), kept_index(spark, sf_dir, n_lists=1, m=16, bits=8), 5))


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, 32 AS code_bytes, 0 AS n_uncoded FROM embeddings")
def index_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That an index of codes holds every row once, with a code of one byte a part."""
    rows = kept_index(spark, sf_dir, n_lists=16, n_probe=4, m=32, bits=8).rows
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.max(F.length("code")).alias("code_bytes"), F.count_if(F.col("code").isNull()).cast("int").alias("n_uncoded"))


def _errors(e: DataFrame, m: int, bits: int) -> DataFrame:
    quantiser = knn.ProductQuantiser(knn.sample_matrix(e, "embedding", 4_096), m, bits)
    return knn.reconstruct(e, quantiser).agg(F.round(F.max(F.sqrt("error2")), 6).alias("r_max"), F.round(F.avg(F.sqrt("error2")), 6).alias("r_avg"))


@query()
def pq_recon_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(embeddings(spark, sf_dir), 16, 6)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def bits_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction error by bits a code."""
    e = embeddings(spark, sf_dir)
    return _union([_errors(e, 16, b).withColumn("bits", F.lit(b)) for b in (2, 4, 6)])


@query()
def m_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction error by the number of parts."""
    e = embeddings(spark, sf_dir)
    return _union([_errors(e, m, 4).withColumn("m", F.lit(m)) for m in (8, 16, 32)])


@query()
def margin_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the classes' margin quantisation may eat up, per category."""
    support, test = slice_parts(spark, sf_dir)
    quantiser = knn.ProductQuantiser(knn.sample_matrix(support, "embedding", 4_096), 16, 4)
    coded = knn.reconstruct(support, quantiser).select("vec_id", F.col("decoded").alias("embedding"))
    # the support, the smaller side, goes to the test patches in parts; both banks are searched in one pass
    banks = _union([b.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(name).alias("bank")) for name, b in (("exact", support), ("quantised", coded))])
    both = bank_distances(test.withColumn("bank", F.explode(F.array(F.lit("exact"), F.lit("quantised")))), banks, ["bank"])
    worst = lambda name: F.max(F.when(F.col("bank") == name, F.col("d2"))).alias(name)
    # a row an image, written once: errors and gaps are taken from it by several jobs
    images = materialise(both.groupBy("category", "image_id", "image_label").agg(worst("exact"), worst("quantised")), "image-margins")
    out = diagnostics.margin_pressure(images, "exact", "quantised", "image_label", ("category",))
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("error", "gap", "pressure")])
