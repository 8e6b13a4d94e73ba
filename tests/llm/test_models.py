"""Packing, LM scores, SimHash, languages, decontamination and toxicity against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA, documents, same, with_clashes
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, language_id, lm_score, packing, queries, simhash_dedup, toxicity


# packing


def check_packing(rows, ids, window=1024):
    """``ids``: a list of documents' ids (with the end) for each id; returns the padding."""
    sequences, seen = defaultdict(list), defaultdict(Counter)
    for r in rows:
        piece = [zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) for d in ids[r.doc_id] if len(d) == r.doc_tokens]
        assert r.length > 0 and r.ids_crc32 in piece
        seen[r.doc_id][r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, docs in ids.items():
        assert seen[k] == sum((Counter({len(d): len(d)}) for d in docs), Counter())
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at
    return padding


def token_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = defaultdict(list)
    for i, text in rows:
        ids[i].append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    return ids


def test_packing_query(spark, sf):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert check_packing(queries.op2_packing(spark, sf).collect(), token_ids(texts)) < 1024


def test_packing_on_odd_tables(spark):
    df = documents(spark)
    pack = lambda x: packing.pack_documents(x, queries.tokenizer_path())
    out = pack(df)
    assert check_packing(out.collect(), token_ids([(r.doc_id, r.text) for r in df.collect()])) < 1024
    assert all(len(r.ids) == 4 * r.length for r in out.collect())
    assert pack(df.limit(0)).count() == 0
    assert same(out.drop("ids"), pack(with_clashes(df)).drop("ids"))


def test_words_sum_up_to_texts():
    encode = packing.Encoder(queries.tokenizer_path())
    assert encode.first is not None
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Bc", " ", " ", "\n", "é", "'s", "12", "!?", " ", "\t", "<|", "😀"]) for _ in range(rng.randrange(30)))
        whole = encode.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == whole, text


def test_plan_uses_all_pieces_once():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    histogram[40] += 3000  # a hot length without enough partners
    plan = packing.make_plan(histogram, 64)
    used = np.zeros((len(histogram) and int((histogram * np.arange(65)).sum() // 64) + 2, 64), int)
    for size in range(1, 65):
        at = plan.length == size
        first, base, offset = plan.first[at], plan.base[at], plan.offset[at]
        for n in range(histogram[size]):
            k = np.searchsorted(first, n, side="right") - 1
            if offset[k] < 0:
                start = base[k] + (n - first[k]) * size
                for p in range(start, start + size):
                    used[p // 64, p % 64] += 1
            else:
                used[base[k] + n - first[k], offset[k] : offset[k] + size] += 1
    assert used.max() == 1 and used.sum() == (histogram * np.arange(65)).sum() and (used.sum(1) < 64).sum() <= 2
    assert (plan.offset >= 0).sum() > 40  # most goes into combinations that fill a window


# language model


def test_lm_on_odd_tables(spark):
    df = documents(spark)
    none = lm_score.score_documents(df.withColumn("train", F.lit(None).cast("boolean")))
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in none.collect())
    assert lm_score.score_documents(df.withColumn("train", F.lit(True)).limit(0)).count() == 0
    clash = with_clashes(df).withColumn("train", F.lit(True))
    assert same(lm_score.score_documents(df.withColumn("train", F.lit(True))).select("doc_id", "n_tokens", "n_known"), lm_score.score_documents(clash).select("doc_id", "n_tokens", "n_known"))


# SimHash


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints):
    """The least of each print's component."""
    left, root = set(prints), {}
    while left:
        front = [left.pop()]
        group = set(front)
        while front:
            a = front.pop()
            near = {b for b in left if (a ^ b).bit_count() <= 3}
            left -= near
            group |= near
            front += near
        for g in group:
            root[g] = min(group)
    return root


def test_simhash_components(spark):
    df = documents(spark)
    rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
    root = brute_roots({p for _, p in rows})
    least = {g: min((i for i, p in rows if root[p] == g and i is not None), default=None) for g in set(root.values())}
    got = [(r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash_dedup.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, p, least[root[p]])) for i, p in rows)
    kept = simhash_dedup.keep_one(with_clashes(df))
    assert kept.columns == with_clashes(df).columns and kept.count() == len(least)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, least.values()))
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0 and simhash_dedup.keep_one(df.limit(0)).count() == 0
    assert same(simhash_dedup.near_duplicates(df), simhash_dedup.near_duplicates(with_clashes(df)))


@pytest.mark.parametrize("most", [20_000, 8])
def test_links_lose_nothing(spark, most):
    """Random prints, chains of single bits and a dense group; also when groups are cut into chunks."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for start in list(prints)[:10]:
        for _ in range(12):  # a chain: each three bits from the last
            for b in rng.sample(range(64), 3):
                start ^= 1 << b
            prints.add(start)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash_dedup.link_fingerprints(df, most).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = brute_roots(prints)
    reached = {(r.node & (2**64 - 1)): r.root for r in simhash_dedup.components(simhash_dedup.link_fingerprints(df, most)).collect()}
    groups = Counter(root.values())
    assert set(reached) == {p for p in prints if groups[root[p]] > 1}
    for p in reached:
        assert reached[p] == min(signed(q) for q in prints if root[q] == root[p])


def test_anchors_cover():
    """Each half has an anchor within one bit, and halves one bit apart share it."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**32, 500, dtype=np.uint64)
    for bit in (0, 7, 30, 31):
        y = x ^ np.uint64(1 << bit)
        (rx, ax), (ry, ay) = simhash_dedup.anchors(x), simhash_dedup.anchors(y)
        for k in range(0, 500, 25):
            assert set(ax[rx == k].tolist()) & set(ay[ry == k].tolist())
    distance = np.bitwise_count((x[rx] & np.uint64(0x7FFFFFFF)) ^ ax.astype(np.uint64))
    assert distance.max() <= 2


# languages


def test_automaton_knows_all_substrings():
    text = "abcabxabcd"
    a = language_id.SuffixAutomaton(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            state = 0
            for c in text[i:j]:
                state = a.next[state][c]
    assert "y" not in a.next[0]


def brute_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference and text[at : at + size] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_equal_cross_parsing():
    rng = random.Random(6)
    refs = tuple((lang, "".join(rng.choice(letters) for _ in range(400))) for lang, letters in (("aa", "abc "), ("bb", "bcd ")))
    model = language_id.Model(refs)
    texts = ["".join(rng.choice("abcde") for _ in range(n)) for n in (1, 5, 60, language_id.WINDOW, language_id.WINDOW + 1, 5 * language_id.WINDOW, 3001)]
    got = model.phrases([model.codes(t) for t in texts])
    for k, t in enumerate(texts):
        assert got[k].tolist() == [brute_phrases(t, r) for _, r in refs]


def test_languages_held_out(spark, sf):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = [r for r in queries.op5_language_id(spark, sf).collect()]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_languages_on_odd_tables(spark):
    df = documents(spark).select("doc_id", "text", "lang")
    known = language_id.references(df)
    out = language_id.identify(df, known)
    assert out.count() == df.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in df.select("text").join(language_id.identify(df.withColumn("copy", F.col("text")), known).withColumnRenamed("copy", "text"), "text").collect())
    assert {r.lang_pred for r in language_id.identify(df, ()).collect()} == {"und"}
    assert language_id.identify(df.limit(0), known).count() == 0 and language_id.references(df.limit(0)) == ()
    assert same(out.select("doc_id", "lang_pred"), language_id.identify(with_clashes(df), known).select("doc_id", "lang_pred"))


# decontamination


def benchmark(spark, extra=()):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 50))) for _ in range(12)]
    return rng, vocabulary, items, spark.createDataFrame([*enumerate(items), *extra], "item_id long, text string")


def edited(rng, text, share):
    out = []
    for w in text.split():
        x = rng.random()
        if x < share:
            out += rng.choice([["other"], [], [w, "put"]])
        else:
            out.append(w)
    return " ".join(out)


def test_copies_and_edited_copies_are_found(spark):
    rng, vocabulary, items, table = benchmark(spark, [(50, None), (51, ""), (52, "...")])
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, expected = [], set()
    for k, item in enumerate(items):
        for j, text in enumerate((item, item.upper(), edited(rng, item, 0.12))):
            rows.append((100 * k + j, f"{noise(80)} {text} {noise(200)}"))
            expected.add((100 * k + j, k))
        rows.append((100 * k + 50, noise(400)))
    rows += [(5000 + i, f"{noise(5)} {items[0]} {noise(5)}") for i in range(300)]  # a passage in most documents
    expected |= {(5000 + i, 0) for i in range(300)}
    rows += [(None, items[3]), (9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 700):
        found = decontaminate.find_contamination(df, table, block_chars=block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == expected | {(None, 3)}
        clean = decontaminate.decontaminate(df, table, block_chars=block)
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in {d for d, _ in expected} and i is not None)
    assert decontaminate.find_contamination(df.limit(0), table).count() == 0
    assert decontaminate.find_contamination(df, table.limit(0)).count() == 0 and decontaminate.decontaminate(df, table.limit(0)).count() == len(rows)
    assert same(found.select("doc_id", "item_id"), decontaminate.find_contamination(with_clashes(df), table).select("doc_id", "item_id"))


@pytest.mark.parametrize("with_exact", [False, True])
def test_an_edited_copy_is_found_whatever_else_leaked(spark, with_exact):
    words = [f"word{k}" for k in range(40)]
    cut = " ".join("other" if k % 4 == 0 else w for k, w in enumerate(words))
    rows = [(1, f"before it {cut} after it"), (2, "nothing of this kind at all " * 9)] + [(k, " ".join(words)) for k in (3, 4) if with_exact]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_contamination(docs, table).collect()) == [1, *[k for k in (3, 4) if with_exact]]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, table).collect()] == [2]


def test_upper_case_copies_with_accents_are_found(spark):
    item = "éal ñandú über straße cœur garçon élève théâtre año señor größer naïf forêt île où là"
    rows = [(1, f"before it {item.upper().replace('STRASSE', 'STRAßE')} and after"), (2, item), (3, "quite another text " * 9)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_contamination(docs, table).collect()) == [1, 2]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, table).collect()] == [3]


def brute_align(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (1.0 if x == y else -0.5), row[j] - 0.5, new[-1] - 0.5))
        row = new
        best = max(best, *row)
    return best


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(9)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        assert decontaminate.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_planted_passages(spark, sf):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    exact = {(i, k) for i, t in texts for k, x in items if x in t}
    found = {(r.doc_id, r.item_id): r.score for r in queries.op9_decontaminate(spark, sf).collect()}
    assert exact <= set(found) and all(found[p] >= 0.9 for p in exact)
    for i, k in set(found) - exact:  # what else is found is alike by the plain alignment of the whole text
        item, doc = (decontaminate.split_words(dict(x)[n].encode()) for x, n in ((items, k), (texts, i)))
        assert brute_align(item, doc) / len(item) >= decontaminate.LEAST_SCORE


# toxicity


def toxic_rows(n=400):
    rng = random.Random(10)
    plain, bad = [f"w{k}" for k in range(60)], ["scumbag", "idiotic", "loserish"]
    rows = []
    for i in range(n):
        toxic, low = int(i % 5 == 0), int(i % 7 == 0)
        w = [rng.choice(plain) for _ in range(40)] + [rng.choice(bad) for _ in range(3 * toxic)] + ["!!junk!!"] * low
        rng.shuffle(w)
        rows.append((i, " ".join(w), toxic, low))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in rows[:300]] + [(0, 0, 0), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, low int")
    chain = toxicity.train(docs, labels, ["low", "toxic"])
    assert [x.category for x in chain.links] == ["low", "toxic"] and len(chain.links[1].earlier) == 1
    got = {r.doc_id: r.flagged for r in toxicity.score_toxicity(docs, chain).collect()}
    assert all(got[i] == bool(x) for i, _, x, _ in rows[300:])


def test_toxicity_on_odd_tables(spark):
    df, labels = documents(spark), spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(df, labels, ["toxic"])
    out = toxicity.score_toxicity(df, chain)
    assert out.count() == df.count() and out.where("flagged").count() == 0 and toxicity.score_toxicity(df.limit(0), chain).count() == 0
    assert same(out.select("doc_id", "p_toxic"), toxicity.score_toxicity(with_clashes(df), chain).select("doc_id", "p_toxic"))


def test_toxicity_query(spark, sf):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.op10_toxicity(spark, sf).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    clean = [r.toxic for r in rows if truth.get(r.doc_id) == 0]
    assert np.mean(clean) <= 0.02


def test_logistic_regression_separates():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 2, (300, 5)).astype(np.float32)
    y = x[:, 0].astype(float)
    p = toxicity.sigmoid(np.hstack([x, np.ones((300, 1))]) @ toxicity.fit_logistic(x, y))
    assert ((p > 0.5) == (y == 1)).all()


def test_schema_of_fixture():
    assert SCHEMA.startswith("doc_id long")


def test_learned_texts_are_whole_and_windows_leave_no_mark(spark):
    """References hold whole texts; a text whose phrases are longer than a window needs as few as one parse finds."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcd ") for _ in range(1500))
    df = spark.createDataFrame([(1, long, "xx"), (2, "short words", "yy")], "doc_id long, text string, lang string")
    known = language_id.references(df)
    assert dict(known) == {"xx": language_id.letters(long), "yy": "short words"}
    model = language_id.Model(known)
    assert model.phrases([model.codes(dict(known)["xx"])])[0, 0] == 1
