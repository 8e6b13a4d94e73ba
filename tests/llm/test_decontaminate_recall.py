"""Decontamination against a plain alignment of every document with every item."""

import random
import time

import pytest

from orbweave.llm import decontaminate


def plain_alignment(item, words):
    """Score, start and end of the best local alignment, cell by cell."""
    best, row = (0.0, 0, 0), [(0.0, j) for j in range(len(words) + 1)]
    for x in item:
        new = [(0.0, 0)]
        for j, y in enumerate(words, 1):
            diagonal = (row[j - 1][0] + (1.0 if x == y else -0.5), row[j - 1][1])
            up, left = (row[j][0] - 0.5, row[j][1]), (new[-1][0] - 0.5, new[-1][1])
            cell = max(diagonal, up, left, key=lambda c: c[0])
            new.append(cell if cell[0] > 0 else (0.0, j))
            if new[-1][0] > best[0]:
                best = (new[-1][0], new[-1][1], j)
        row = new
    return best


def edit(rng, words, share, vocabulary):
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        else:
            kind = rng.randrange(3)
            out += [[rng.choice(vocabulary)], [], [w, rng.choice(vocabulary)]][kind]
    return out


def test_recall_against_plain_alignment(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 45))] for _ in range(12)]
    docs = []
    for k in range(120):
        copy = edit(rng, items[k % 12], (0.0, 0.1, 0.15, 0.2, 0.25, 0.3)[k % 6], vocabulary)
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(60))] + copy + [rng.choice(vocabulary) for _ in range(rng.randrange(60))])
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.start, r.end) for r in decontaminate.find_contamination(df, table).collect()}
    expected = {}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            score, start, end = plain_alignment(item, words)
            if score / len(item) >= decontaminate.LEAST_SCORE:
                expected[d, i] = (score / len(item), start, end)
    assert set(found) <= set(expected) and len(found) >= 0.97 * len(expected) and len(expected) > 80
    for key, (score, start, end) in found.items():
        assert score == pytest.approx(expected[key][0])
        own = plain_alignment(items[key[1]], docs[key[0]][start:end])
        assert own[0] / len(items[key[1]]) == pytest.approx(score)  # the passage alone has the whole score
    exact = sum(found[k][1:] == expected[k][1:] for k in found)
    assert exact >= 0.9 * len(found)  # alignments that tie may begin elsewhere


def test_items_of_one_and_two_words(spark):
    table = spark.createDataFrame([(1, "purple elephants"), (2, "Xylophone"), (3, "three little words here")], "item_id long, text string")
    rows = [(1, "we saw purple elephants, today"), (2, "a xylophone!"), (3, "purple elephants"), (4, "elephants purple"), (5, "three little words here and there")]
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.end) for r in found) == [(1, 1, 2, 4), (2, 2, 1, 2), (3, 1, 0, 2), (5, 3, 0, 4)]


def test_a_text_that_repeats_a_seed_very_often(spark):
    item = "again and again and again the same words come up in a row of fifteen words"
    text = "again and " * 100_000 + item
    began = time.perf_counter()
    items = decontaminate.Items([(1, item.encode())])
    seeds = decontaminate.choose_seeds(items, dict.fromkeys(items.places, 1))
    ((k, score, start, end),) = decontaminate.align_document(decontaminate.split_words(text.encode()), items, seeds, 0.6)
    assert (k, score) == (0, 1.0) and (start, end) == (200_000, 200_016) and time.perf_counter() - began < 60
