"""The toxicity chain: features by plain counts, out-of-fold inputs, and recall on labels that were not learned from."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orbweave.llm import toxicity


def plain_features(texts, labels):
    """The log-likelihood ratios by plain counting, best first."""
    n1, n0 = sum(labels), len(labels) - sum(labels)
    ones, zeros = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        (ones if y else zeros).update(t)
    out = []
    for f in set(ones) | set(zeros):
        a, b = ones[f], zeros[f]
        if a + b >= toxicity.LEAST_DOCUMENTS:
            clip = lambda x: min(max(x, 1e-9), 1 - 1e-9)
            share = clip((a + b) / (n1 + n0))
            ratio = sum(x * math.log(clip(x / n) / share) + (n - x) * math.log((1 - clip(x / n)) / (1 - share)) for x, n in ((a, n1), (b, n0)))
            if ratio > toxicity.LEAST_RATIO[0] + toxicity.LEAST_RATIO[1] * (n1 + n0):
                out.append((-ratio, f))
    return [f for _, f in sorted(out)][: toxicity.FEATURES]


def test_features_are_those_of_plain_counts(spark):
    rng = random.Random(3)
    words = [f"w{k}".encode() for k in range(40)]
    rows = []
    for i in range(240):
        y0, y1 = int(rng.random() < 0.4), int(rng.random() < 0.3)
        own = {w for k, w in enumerate(words) if rng.random() < (0.8 if (k % 5 == 0 and y0) or (k % 7 == 0 and y1) else 0.2)}
        rows.append((sorted(own), i % toxicity.FOLDS, y0, y1))
    df = spark.createDataFrame([([bytearray(f) for f in fs], k, a, b) for fs, k, a, b in rows], "features array<binary>, fold int, y0 int, y1 int")
    found = toxicity.choose_features(df, 2)
    assert set(found) == {(j, k) for j in (0, 1) for k in (None, 0, 1, 2)}
    for (j, left_out), names in found.items():
        own = [r for r in rows if r[1] != left_out]
        expected = plain_features([r[0] for r in own], [r[2 + j] for r in own])
        assert set(names) == set(expected) and names


def test_chain_equals_a_plain_chain():
    """Each link sees the earlier categories' out-of-fold probabilities, made without the document itself."""
    rng = np.random.default_rng(4)
    rows = [sorted(set(rng.integers(0, 12, 5).tolist())) for _ in range(150)]
    y = np.stack([[int(0 in r) for r in rows], [int(0 in r or 3 in r) for r in rows]], 1)
    fold = np.arange(150) % toxicity.FOLDS
    names = [f"f{k}".encode() for k in range(12)]
    chosen = {(j, k): list(range(12)) for j in (0, 1) for k in (None, 0, 1, 2)}
    chain = toxicity.fit_chain(rows, y, ["a", "b"], fold, names, chosen)
    x = np.zeros((150, 12))
    for k, r in enumerate(rows):
        x[k, r] = 1
    add = lambda m: np.hstack([m, np.ones((len(m), 1))])
    earlier = np.zeros(150)
    for k in range(toxicity.FOLDS):
        w = toxicity.fit_logistic(x[fold != k], y[fold != k, 0].astype(float))
        earlier[fold == k] = toxicity.sigmoid(add(x[fold == k]) @ w)
    second = toxicity.fit_logistic(np.hstack([x, earlier[:, None]]), y[:, 1].astype(float))
    assert np.allclose(chain.links[1].earlier, second[12], atol=1e-5) and np.isclose(chain.links[1].intercept, second[-1], atol=1e-5)
    first = toxicity.fit_logistic(x, y[:, 0].astype(float))
    p0 = toxicity.sigmoid(add(x) @ first)
    p1 = toxicity.sigmoid(add(np.hstack([x, p0[:, None]])) @ second)
    got = np.array([chain.score({names[f] for f in r}) for r in rows])
    assert np.allclose(got, np.stack([p0, p1], 1), atol=1e-4)


def test_a_beginning_that_two_words_share_is_marked_twice():
    found = toxicity.features_of("Trashy trashily, trash trashy! grim".encode())
    assert {b"trashy", b"trashily", b"trash", b"grim", b"^tras", b"^^tras", b"^trash", b"^^trash"} == found
    assert toxicity.features_of(b"") == toxicity.features_of(b" ... ") == set()
    assert not any(f.startswith(b"^^") for f in toxicity.features_of(b"trashy trashy trash. TRASHY"[:13]))


def test_threshold_weighs_the_classes():
    p, y = np.array([0.9, 0.8, 0.7, 0.6, 0.1]), np.array([1, 0, 1, 1, 0])
    assert toxicity.best_threshold(p, y) < 0.6
    assert toxicity.best_threshold(p, y, np.where(y == 1, 1.0, 100.0)) > 0.8


def test_held_out_labels(spark):
    """Documents of a fifth of the ids are not learned from; most toxic ones among them are flagged, others are not."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chain = toxicity.train(docs, labels.where(~held).select("doc_id", (1 - F.col("quality")).alias("low"), "toxic"), ["low", "toxic"])
    truth = {r.doc_id: r.toxic for r in labels.where(held).where("toxic is not null").collect()}
    got = {r.doc_id: r.flagged for r in toxicity.score_toxicity(docs.join(labels.where(held).select("doc_id").distinct(), "doc_id", "left_semi"), chain).collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in truth)
    hit = [got[i] for i, y in truth.items() if y == 1 and i in got]
    wrong = [got[i] for i, y in truth.items() if y == 0 and i in got]
    print("held out:", sum(hit), "of", len(hit), "toxic;", sum(wrong), "of", len(wrong), "others")
    assert np.mean(hit) >= 0.9 and np.mean(wrong) <= 0.02
