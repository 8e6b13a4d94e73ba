"""Centroid clustering, embedding near-dedup and fill-in-middle against SQL, brute force and round trips."""

import hashlib
import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from fixtures import documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm import centroid_clustering, embedding_dedup, fill_middle, oracles, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def cells(rows, columns):
    return sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


def sql_rows(spark, sf, sql, **tables):
    duck = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        if p.stem not in tables:
            duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, df in tables.items():
        duck.register(name, df.toArrow())
    found = duck.sql(sql)
    return cells(found.fetchall(), list(found.columns))


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_embedding_dedup", "op13_fill_middle"])
def test_query_equals_sql(spark, sf, name):
    made = queries.queries()[name](spark, sf)
    assert cells(made.collect(), made.columns) == sql_rows(spark, sf, queries.oracle_sql()[name])


def vectors(seed=3, n=300):
    """Clusters of near copies, exact copies (one vector makes a third), odd vectors, ties, null ids and labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(size=64) * rng.choice([0.05, 0.3, 1.0])).astype(np.float32).tolist(), i % 3) for i in range(n)]
    rows += [(10_000 + i, rows[5][1], 2) for i in range(n // 2)] + [(5, rows[5][1], 2), (5, rows[6][1], 0), (None, rows[5][1], 2), (None, rows[7][1], None)]
    bad = [None, [], [0.0] * 64, [None] * 64, [1.0] * 63, [1.0] * 65, [float("nan")] + [1.0] * 63, [1.0] * 63 + [float("inf")], [1.0] * 63 + [None]]
    rows += [(20_000 + i, v, 1) for i, v in enumerate(bad + bad)] + [(-3, [-x for x in rows[5][1]], 2), (30_000, [1e-30] * 64, 1), (30_001, [1e30] * 64, 1), (30_002, [2e30] * 64, 1)]
    return rows


def test_clustering_on_odd_tables(spark, sf):
    rows = [r for r in vectors() if r[0] not in (30_001, 30_002)]
    df = with_clashes(spark.createDataFrame(rows, VECTORS))
    made = centroid_clustering.digest(*centroid_clustering.cluster_vectors(df))
    assert cells(made.collect(), made.columns) == sql_rows(spark, sf, oracles.clustering_sql(), embeddings=df.select("vec_id", "embedding", "label"))
    few = spark.createDataFrame(rows[:3], VECTORS)
    found, centroids = centroid_clustering.cluster_vectors(few)
    assert found.count() == 3 and centroids.count() == 3
    empty, none = centroid_clustering.cluster_vectors(df.limit(0))
    assert empty.count() == none.count() == 0 and centroid_clustering.digest(empty, none).count() == 0


def test_clustering_of_large_components_is_exact(spark):
    """Beyond what doubles hold whole, against Python's integers."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(64)], 0) for i in range(60)] + [(100 + i, [3e6] * 64, 0) for i in range(3)]
    found, centroids = centroid_clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), k=4)
    kept = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i < 100}  # no long holds the distances of the others
    start = sorted(kept, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:4]
    at = [kept[i] for i in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(at))
    for _ in range(3):
        own = {i: near(q)[1] for i, q in kept.items()}
        members = [[kept[i] for i in kept if own[i] == k] for k in range(4)]
        at = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, at, strict=True)]
    assert {r.vec_id: (r.distance, r.cluster) for r in found.collect()} == {i: near(q) for i, q in kept.items()}
    assert [r.centroid for r in centroids.orderBy("cluster").collect()] == at


def brute_links(rows, threshold=0.93):
    """Number of links and least reachable id of each row."""
    ok = [v is not None and g is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, g in rows]
    unit = [np.array(v, float) / np.abs(v).max() if good else None for good, (_, v, _) in zip(ok, rows, strict=True)]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    linked = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, front = {i}, [i]
        while front:
            new = [j for j in linked[front.pop()] if j not in seen]
            seen.update(new)
            front += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), least, rows[i][0] == least))
    return sorted(map(str, out))


@pytest.mark.parametrize("tiles", [{}, {"tile_bytes": 64 * 8 * 40}, {"tile_bytes": 64 * 8 * 17, "spread_rows": 8}])
def test_embedding_dedup_against_brute_force(spark, tiles):
    rows = vectors()
    df = with_clashes(spark.createDataFrame(rows, VECTORS))
    made = embedding_dedup.near_duplicates(df, **tiles).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(str(tuple(r)) for r in made) == brute_links(rows)


def test_embedding_dedup_of_nothing(spark):
    for rows in ([], [(1, None, 3), (2, [0.0] * 4, 1), (3, [1.0, 2.0], None)]):
        made = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
        assert sorted(tuple(r) for r in made) == [(r[0], 0, r[0], True) for r in rows]


@pytest.mark.parametrize("spread", [0.001, 0.04, 0.2, 0.4])
def test_tiles_find_what_plain_products_find(spread):
    """Dense and sparse blocks, also between two tiles and at the threshold itself."""
    rng = np.random.default_rng(int(spread * 1000))
    x = rng.normal(size=(9, 40))[rng.integers(9, size=2_600)] + rng.normal(size=(2_600, 40)) * spread
    x[7], x[8] = np.eye(40)[0], np.r_[0.93, math.sqrt(1 - 0.93**2), np.zeros(38)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1].T
    n = rng.integers(1, 4, len(x))
    plain = np.where(np.eye(len(x), dtype=bool), 0, unit @ unit.T) >= 0.93
    plain[7, 8] = plain[8, 7] = embedding_dedup.cosines(x[[7]], x[[8]])[0] >= 0.93
    counts, sets = embedding_dedup.compare(x, None, n, None, axes)
    assert (counts == plain @ n).all()
    assert all(len(set(sets[np.flatnonzero(row)]) | {sets[k]}) == 1 for k, row in enumerate(plain))
    links = int((sets != np.arange(len(x))).sum())
    assert links == len(x) - len({*sets.tolist()})
    half = len(x) // 3
    counts, sets = embedding_dedup.compare(x[:half], x[half:], n[:half], n[half:], axes)
    assert (counts == np.r_[plain[:half, half:] @ n[half:], plain[half:, :half] @ n[:half]]).all()
    assert all(sets[i] == sets[half + j] for i, j in zip(*np.nonzero(plain[:half, half:]), strict=True))


# fill in middle


def plain_format(doc_id, text):
    """The contract, by lists of units."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_on_odd_tables(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(i, t) for i in range(100, 140) for t in (" a  b\n", "  ", "<P> marked", "<P <S <M>", "x<", "é𝄞 ü b", "wordword" * 3_000)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    made = fill_middle.format_documents(df)
    assert made.columns == [*df.columns, "fim"] and fill_middle.format_documents(df.limit(0)).count() == 0
    want = sorted(str((i, plain_format(i, t or ""), t or "")) for i, t in rows)
    assert sorted(str((r.doc_id, tuple(r.fim)[:5], r.fim.restored)) for r in made.collect()) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM> \n\té𝄞", max_size=60), st.integers(0, 99))
def test_fill_middle_round_trip(text, doc_id):
    got = fill_middle.fill_middle(text, fill_middle.draw(doc_id), rate=100)
    assert fill_middle.restore(got.output, got.form) == text
    assert fill_middle.fill_middle(text, fill_middle.draw(doc_id)) == plain_format(doc_id, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(1, 9), st.data())
def test_ropes_split_at_any_rank(text, leaf, data):
    tree, units = fill_middle.rope(text, leaf), re.findall(fill_middle.UNIT, text)
    assert (fill_middle.flat(tree), tree.units, tree.chars) == (text, len(units), len(text))
    rank, at = data.draw(st.integers(0, len(units))), data.draw(st.integers(0, len(text)))
    left, right = fill_middle.split_units(tree, rank)
    assert (fill_middle.flat(left), fill_middle.flat(right), left.units, right.units) == ("".join(units[:rank]), "".join(units[rank:]), rank, len(units) - rank)
    left, right = fill_middle.split_chars(tree, at)
    assert (fill_middle.flat(left), fill_middle.flat(right), left.chars) == (text[:at], text[at:], at)
    assert fill_middle.flat(fill_middle.joined(left, right)) == text


def test_very_long_texts_take_little_time():
    text = "word " * 200_000 + " " * 500_000 + "x" * 500_000
    got = fill_middle.fill_middle(text, fill_middle.Draw(77, 150_000, 0, 0))
    assert got.n == 200_001 and fill_middle.restore(got.output, got.form) == text
