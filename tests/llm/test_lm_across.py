"""Language-model scores against a plain trie over whole documents."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute_ppm import BrutePpm, line_of
from fixtures import documents
from pyspark.sql import functions as F

from orbweave.llm import lm_score, queries


def check(df, order, **hot):
    rows = [(str(r.doc_id), r.train, r.text) for r in df.select("doc_id", "train", "text").collect()]
    model = BrutePpm([line_of(t) for _, train, t in rows if train], order)
    counts = Counter(w for _, train, t in rows if train for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, train, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        expected.append((i, train, len(words), sum(counts[w] > 0 for w in words), n, base, model.text(line_of(t))))
    got = [(str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score_documents(df, order=order, **hot).collect()]
    for a, b in zip(sorted(got), sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize(("order", "hot"), [(0, 3), (2, 5), (5, 1 << 17), (6, 40)])
def test_scores(spark, order, hot):
    check(documents(spark).withColumn("train", F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))), order, hot_words=hot, hot_grams=hot)


def test_a_long_word_is_scored(spark):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh+/=0123456789") for _ in range(1_000_000))
    df = spark.createDataFrame([(1, word, True), (2, word[:999] + "!" + word[999:], False), (3, "a short text", True)], "doc_id long, text string, train boolean")
    check(df, 5, hot_words=0, hot_grams=0)


def test_long_lines_are_cut_without_a_seam():
    rng = random.Random(2)
    lines = [bytes(rng.randrange(97, 100) for _ in range(n)) for n in (0, 1, 7, 50, 3, 64, 129)]
    for most in (8, 16, 1000):
        found = [(o, s, g) for owners, sizes, grams in lm_score.pieces(enumerate(lines), 5, most) for o, s, g in zip(owners, sizes, np.split(grams, np.cumsum(sizes)[:-1]), strict=True)]
        for k, line in enumerate(lines):
            own = [x for o, _, g in found if o == k for x in g.tolist()]
            padded = bytes(5) + line
            assert own == [int.from_bytes(padded[j : j + 6], "big") for j in range(len(line))]


def test_query_tells_shuffled_words_from_prose(spark, tmp_path):
    prose = "the cat sat on the mat and the dog lay by the door of the house"
    texts = [(i * 5, prose) for i in range(40)]
    held = next(i for i in range(1, 999) if i % 5 and zlib.crc32(str(i).encode()) % 5 == 1)
    shuffled = " ".join(sorted(prose.split()))
    spark.createDataFrame([*texts, (held, shuffled)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op3_lm_score(spark, str(tmp_path)).collect()}
    assert got[held] < min(s for i, s in got.items() if i != held)


def test_probabilities_sum_to_one():
    model = BrutePpm([b"abc\n", b"abc\n", b"abd\n"], 3)
    for ctx in (b"\0\0a", b"\0ab", b"zzz", b"\0\0\0"):
        assert sum(10 ** model.symbol(ctx, s) for s in range(256)) == pytest.approx(1)
