"""Large alphabets, long labelled texts, long words and long runs stay within bounds and change no result."""

import random
import time

import numpy as np

from orbweave.llm import language_id, lm_score


def brute_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference and text[at : at + size] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_rare_symbols_parse_like_frequent_ones():
    rng = random.Random(4)
    signs = [chr(0x4E00 + k) for k in range(300)]
    refs = (("zh", "".join(rng.choice(signs[:40] if rng.random() < 0.7 else signs) for _ in range(3_000))), ("xx", "".join(rng.choice("abc ") for _ in range(500))))
    texts = ["".join(rng.choice(signs[:50] + list("ab")) for _ in range(n)) for n in (1, 7, 300, 1_500)] + [refs[0][1][100:900] * 2]
    for cells in (1, 20_000, language_id.MOST_CELLS):
        model = language_id.Model(refs, cells)
        got = model.phrases([model.codes(t) for t in texts])
        for k, t in enumerate(texts):
            assert got[k].tolist() == [brute_phrases(t, r) for _, r in refs]


def test_large_alphabet_is_bounded():
    rng = np.random.default_rng(1)
    text = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3_000, 60_000))
    model = language_id.Model((("zh", text), ("en", "some plain words " * 3_000)))
    assert all(m.table.nbytes + m.keys.nbytes + m.targets.nbytes < 50_000_000 for m in model.moves)
    assert model.phrases([model.codes(text)])[0, 0] == 1
    assert model.predict([text[:500], "plain words", None, "123"])[0] == ["zh", "en", "und", "und"]


def test_long_runs_take_time_in_proportion():
    model = language_id.Model((("xx", "a" * 900 + "b"), ("yy", "abc " * 200)))
    began = time.perf_counter()
    got = model.phrases([model.codes("a" * 1_000_000)])
    assert time.perf_counter() - began < 20
    assert got[0].tolist() == [-(-1_000_000 // 900), 1_000_000]


def test_long_labelled_texts_are_not_gathered(spark):
    long = "wort " * 100_000
    df = spark.createDataFrame([(k, long, "de") for k in range(3)] + [(9, "some words", "en")] + [(20 + k, "kurz " * 20_000, "fr") for k in range(9)], "doc_id long, text string, lang string")
    known = dict(language_id.references(df))
    assert "de" not in known and known["en"] == "some words" and 90_000 < len(known["fr"]) <= language_id.MOST_CHARS


def test_long_words_are_joined_and_score_alike(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 5, 64, 65, 4_000, 200_000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(4)), k % 5 != 1) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got, few = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm_score.score_documents(df, **how).collect()} for how in ({}, {"hot_words": 1, "hot_grams": 10}))
    assert got == few
