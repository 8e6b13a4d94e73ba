"""Toxicity by a classifier chain of logistic regressions.

The categories are label columns in a given order. The model of each category sees
the words of a text and the probabilities of the categories before it. In training
those probabilities are out-of-fold: each comes from a model that has not seen the
document. The threshold of the last category is chosen on its out-of-fold
probabilities, with the classes weighted as they are in all labels.

The models are fitted on a bounded sample of labelled documents (``POSITIVE`` with
and ``NEGATIVE`` without the last category, by hash of the id); all documents are
scored, whole. Features are counted and chosen by Spark; of each document of the sample
the driver gets the numbers of the chosen ones only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import fresh, materialise, small_batches

#: Bounds of the sample for fitting, in documents.
POSITIVE, NEGATIVE = 1_500, 3_000
FOLDS = 3
#: Features that a model may use; a feature is in at least LEAST_DOCUMENTS of the sample.
FEATURES, LEAST_DOCUMENTS = 600, 3
#: Log-likelihood ratio that a feature needs: a base far above chance, and a part that grows with the
#: sample, lest many weak features add up in long texts.
LEAST_RATIO = (8.0, 0.005)
#: Besides whole words, their beginnings of these lengths are features, and such beginnings of two different words.
BEGINNINGS = (4, 5)
PENALTY, STEPS = 1e-3, 200
PUNCTUATION = b".,;:!?\"'()[]|*#$%&<>-"


def features_of(text: bytes) -> set[bytes]:
    """The words of a text (lower case, without punctuation at their ends) and their beginnings.

    A beginning is marked by ``^``, so it is never taken for a word; one that at least two different
    words share is there a second time, marked by ``^^``, as the forms of one stem are.
    """
    words = {w.strip(PUNCTUATION) for w in set(text.lower().split())}
    words.discard(b"")
    out = set(words)
    for n in BEGINNINGS:
        begins = Counter(w[:n] for w in words if len(w) > n)
        out |= {b"^" + b for b in begins} | {b"^^" + b for b, k in begins.items() if k > 1}
    return out


def choose_features(rows: DataFrame, n_categories: int) -> dict[tuple[int, int | None], list[bytes]]:
    """By category and left-out fold (None: all rows): the features whose presence differs most between the classes.

    ``rows`` has the array ``features``, ``fold``, and labels ``y0``, ``y1``... The difference
    is the log-likelihood ratio; at most ``FEATURES`` names of each are collected.
    """
    cells = [(j, v, k) for j in range(n_categories) for v in (0, 1) for k in range(FOLDS)]
    counts = [F.count_if((F.col(f"y{j}") == v) & (F.col("fold") == k)).alias(f"n_{j}_{v}_{k}") for j, v, k in cells]
    sizes = rows.agg(*counts).first()
    by_feature = rows.select(F.explode("features").alias("feature"), "fold", *[f"y{j}" for j in range(n_categories)]).groupBy("feature").agg(F.count("*").alias("n"), *counts)
    by_feature = materialise(by_feature.where(F.col("n") >= LEAST_DOCUMENTS), "toxicity-features")

    def gain(x: Column, n: int, share: Column) -> Column:
        p = F.least(F.greatest(x / n, F.lit(1e-9)), F.lit(1 - 1e-9))
        return x * F.ln(p / share) + (n - x) * F.ln((1 - p) / (1 - share))

    out = {}
    for j in range(n_categories):
        for left_out in (None, *range(FOLDS)):
            own = [k for k in range(FOLDS) if k != left_out]
            n1, n0 = (sum(sizes[f"n_{j}_{v}_{k}"] for k in own) for v in (1, 0))
            names: list[bytes] = []
            if n1 and n0:
                a, b = (sum((F.col(f"n_{j}_{v}_{k}") for k in own), F.lit(0)) for v in (1, 0))
                share = F.least(F.greatest((a + b) / (n1 + n0), F.lit(1e-9)), F.lit(1 - 1e-9))
                ratio = F.when(a + b >= LEAST_DOCUMENTS, gain(a, n1, share) + gain(b, n0, share))
                best = by_feature.select("feature", ratio.alias("ratio")).where(F.col("ratio") > LEAST_RATIO[0] + LEAST_RATIO[1] * (n1 + n0))
                names = [bytes(x.feature) for x in best.orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect()]
            out[j, left_out] = names
    return out


def matrix(rows: list[list[int]], columns: list[int]) -> np.ndarray:
    """Which of ``columns`` each row has."""
    place = {f: k for k, f in enumerate(columns)}
    x = np.zeros((len(rows), len(columns)), np.float32)
    for row, own in enumerate(rows):
        x[row, [place[f] for f in own if f in place]] = 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the intercept) by accelerated gradient descent with an L2 penalty."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    ahead, momentum = w, 1.0
    # the largest eigenvalue of x'x bounds the curvature
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (0.25 * np.linalg.norm(x @ v) ** 2 / len(x) + PENALTY)
    for _ in range(STEPS):
        gradient = x.T @ (sigmoid(x @ ahead) - y) / len(x) + PENALTY * np.r_[ahead[:-1], 0]
        new = ahead - rate * gradient
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Link:
    """One category's model: weights of features, of earlier categories, and the intercept."""

    category: str
    weights: dict[bytes, float]
    earlier: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]
    threshold: float

    def probabilities(self, text: bytes) -> list[float]:
        return self.score(features_of(text))

    def score(self, features: set[bytes]) -> list[float]:
        out: list[float] = []
        for link in self.links:
            z = link.intercept + sum(w * p for w, p in zip(link.earlier, out, strict=True))
            z += sum(link.weights[f] for f in features & link.weights.keys())
            out.append(float(sigmoid(np.float64(z))))
        return out


def fit_chain(rows: list[list[int]], labels: np.ndarray, categories: list[str], fold: np.ndarray, names: list[bytes], chosen: dict[tuple[int, int | None], list[int]], shares: tuple[float, float] = (1.0, 1.0)) -> Chain:
    """A chain for the columns of ``labels``.

    ``rows`` are the numbers of each document's features among ``names``, ``chosen`` those of
    a category's model (or of that without a fold); ``fold`` numbers each document's fold.
    ``shares`` are the weights of documents without and with the last category.
    """
    links, before = [], np.zeros((len(rows), 0), np.float32)
    held = np.zeros(len(rows))
    for j, category in enumerate(categories):
        y, own = labels[:, j].astype(float), chosen[j, None]
        w = fit_logistic(np.hstack([matrix(rows, own), before]), y)
        links.append(Link(category, {names[f]: float(x) for f, x in zip(own, w, strict=False)}, tuple(map(float, w[len(own) : -1])), float(w[-1])))
        held = np.zeros(len(rows))
        for k in range(FOLDS):
            out, rest = fold == k, fold != k
            if rest.any():
                xk = np.hstack([matrix(rows, chosen[j, k]), before])
                held[out] = sigmoid(np.hstack([xk[out], np.ones((out.sum(), 1))]) @ fit_logistic(xk[rest], y[rest]))
        before = np.hstack([before, held[:, None].astype(np.float32)])
    return Chain(tuple(links), best_threshold(held, labels[:, -1], np.array(shares)[labels[:, -1]]))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The threshold with the best F1 of the weighted documents, in the middle of the gap below it; 0.5 if there is no class to find."""
    if not y.any():
        return 0.5
    w = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((w * y)[order])
    f1 = 2 * hits / (np.cumsum(w[order]) + (w * y).sum())
    ends = np.r_[p[order][1:] < p[order][:-1], True]  # only between different values
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def agreed_labels(labels: DataFrame, id_col: str, categories: list[str]) -> DataFrame:
    """``__id`` and labels ``y0``, ``y1``...; ids with null or conflicting labels are left out."""
    rows = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"y{j}") for j, c in enumerate(categories)])
    names = [f"y{j}" for j in range(len(categories))]
    same = rows.groupBy("__id").agg(*[F.min(c).alias(c) for c in names], *[F.max(c).alias(f"max_{c}") for c in names])
    for c in names:
        same = same.where((F.col(c) == F.col(f"max_{c}")) & F.col(c).isin(0, 1))
    return same.select("__id", *[F.col(c).cast("int").alias(c) for c in names])


def sample_ids(known: DataFrame, last: str) -> DataFrame:
    """The rows of the sample: those with the least hashes of each class of ``last``."""
    by_hash = (F.xxhash64("__id"), F.col("__id"))
    return known.where(F.col(last) == 1).orderBy(*by_hash).limit(POSITIVE).unionByName(known.where(F.col(last) == 0).orderBy(*by_hash).limit(NEGATIVE))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain, fitted on the sample. Without labelled documents all probabilities are 0.5 and none is above the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = [f"y{j}" for j in range(len(categories))]
    known = agreed_labels(labels, id_col, categories)
    totals = {r[0]: r[1] for r in known.groupBy(marks[-1]).agg(F.count("*")).collect()}  # a row a class
    # at most POSITIVE + NEGATIVE ids, so the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text")).join(F.broadcast(sample_ids(known, marks[-1])), "__id")
    # of rows that share an id the one with the least hash
    one = rows.groupBy("__id", *marks).agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    one = one.select(F.xxhash64("__id").alias("h"), F.col("__id").cast("string").alias("name"), F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), *marks, "__text")
    listed = T.StructType([*one.schema.fields[:-1], T.StructField("features", T.ArrayType(T.BinaryType()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [sorted(features_of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(features, pa.list_(pa.binary()))], names=listed.names)

    sample = materialise(one.mapInArrow(extract, listed), "toxicity-sample")
    found = choose_features(sample, len(categories))
    names = sorted({f for own in found.values() for f in own})
    number = {f: k for k, f in enumerate(names)}
    shared = spark.sparkContext.broadcast(number)
    coded = T.StructType([*listed.fields[:-1], T.StructField("own", T.ArrayType(T.IntegerType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[shared.value[f] for f in row if f in shared.value] for row in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.list_(pa.int32()))], names=coded.names)

    gathered = sample.mapInArrow(code, coded).toArrow().sort_by([("h", "ascending"), ("name", "ascending")])  # the sample's rows, the chosen features only
    if not len(gathered):
        return Chain(tuple(Link(c, {}, (0.0,) * j, 0.0) for j, c in enumerate(categories)), 1.0)
    y = np.stack([gathered[c].to_numpy() for c in marks], 1).astype(int)
    ones = int(y[:, -1].sum())
    shares = (totals.get(0, 0) / max(1, len(y) - ones), totals.get(1, 0) / max(1, ones))
    chosen = {key: [number[f] for f in own] for key, own in found.items()}
    return fit_chain(gathered["own"].to_pylist(), y, categories, gathered["fold"].to_numpy(), names, chosen, shares)


def score_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``p_<category>`` for each category and ``flagged``.

    A null or empty text has no features and is never flagged. Null ids and repeated
    rows are kept; an empty table gives no rows; further columns pass through.
    """
    small_batches(docs.sparkSession)
    names = [f"p_{link.category}" for link in chain.links]
    rest = [c for c in docs.columns if c not in (text_col, "flagged", *names)]
    rows = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(fresh(docs, "__text")))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("flagged", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            p = [model.probabilities(t) for t in texts]
            flagged = [bool(t.strip()) and x[-1] > model.threshold for t, x in zip(texts, p, strict=True)]
            columns = [pa.array([x[j] for x in p], pa.float64()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *columns, pa.array(flagged, pa.bool_())], names=schema.names)

    return rows.mapInArrow(score, schema)
