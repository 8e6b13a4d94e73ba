"""Kept indexes: exactness with all lists, recall of codes, which folders a search reads, and odd tables."""

import numpy as np
import pytest

from orbweave.operators import knn
from orbweave.operators import vector_index as vi


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def clustered(n, width=16, centres=12, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, width))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def found(df):
    return {(r.query_id, r["rank"]): (r.neighbour_id, r.d2) for r in df.collect()}


def test_all_lists_are_exact_and_few_never_nearer(spark, tmp_path):
    df = table(spark, np.random.default_rng(1).normal(size=(120, 6)))
    q = df.where("vec_id < 10")
    index = vi.build_index(df, f"file://{tmp_path}/i", 6, n_probe=2, recall=None)
    exact, every, few = found(knn.exact_knn(q, df, 3)), found(vi.search_index(q, index, 3, n_probe=6)), found(vi.search_index(q, index, 3))
    assert every.keys() == exact.keys() and all(every[k][1] == pytest.approx(exact[k][1], abs=1e-9) for k in exact)
    assert all(few[k][1] >= exact[k][1] - 1e-9 for k in few)


def test_partial_distances_equal_decoding(spark):
    x = clustered(300)
    quantiser = knn.ProductQuantiser(x - x.mean(0), 4, 5)
    codes = quantiser.encode(x - x.mean(0))
    plain = knn.squared_distances(x[:9], x.mean(0) + quantiser.decode(codes))
    assert np.allclose(vi.coded_distances(vi.partial_distances(x[:9], x.mean(0), quantiser), codes).T, plain, atol=1e-4)


@pytest.mark.parametrize("n_lists", [1, 12])
def test_recall_of_codes_at_no_more_than_half_the_lists(spark, tmp_path, n_lists):
    df = table(spark, clustered(4_000))
    q = df.where("vec_id % 20 = 0")
    path = f"file://{tmp_path}/i"
    vi.build_index(df, path, n_lists, m=8, bits=6)
    index = vi.open_index(spark, path)
    assert index.n_rows == 4_000 and (n_lists == 1 or index.n_probe <= n_lists // 2)
    exact, got = found(knn.exact_knn(q, df, 5)), found(vi.search_index(q, index, 5))
    pairs = lambda f: {(k[0], v[0]) for k, v in f.items()}
    assert len(got) == len(exact) and len(pairs(exact) & pairs(got)) / len(exact) >= 0.9
    shared = pairs(exact) & pairs(got)
    by_pair = lambda f: {(k[0], v[0]): v[1] for k, v in f.items() if (k[0], v[0]) in shared}
    assert by_pair(got) == pytest.approx(by_pair(exact), abs=1e-9)  # by the vectors, not by the codes


def test_a_search_reads_the_probed_folders_only(spark, tmp_path):
    df = table(spark, clustered(2_000))
    index = vi.build_index(df, f"file://{tmp_path}/i", 10, recall=None)
    assert len(list((tmp_path / "i" / "rows").glob("list_id=*"))) == 10
    one = df.limit(1).toArrow()
    vectors = knn.as_matrix(one["embedding"])
    scan = vi._scan(index, one["vec_id"].to_numpy(), vectors, vi._nearest_lists(vectors, index.centres, 2), 5)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan.replace("`", "") or "list_id" in plan.split("PartitionFilters: ")[1][:60]
    lists = {r.list_id for r in index.rows.where("list_id in (1, 2)").select("list_id").distinct().collect()}
    assert lists == {1, 2}


def test_candidates_of_slices_with_ties():
    rng = np.random.default_rng(0)
    d, ids = rng.integers(0, 6, (7, 900)).astype(float), rng.permutation(900)
    d[2] = np.inf
    best = vi.Best(7, 5)
    for at in range(0, 900, 100):
        best.add(ids[at : at + 100], d[:, at : at + 100])
    for k in range(7):
        order = np.lexsort((ids, d[k]))[:5]
        assert (best.d[k] == d[k][order]).all() and (k == 2 or (best.ids[k] == ids[order]).all())


def test_odd_tables(spark, tmp_path):
    df = table(spark, clustered(60)).unionByName(spark.createDataFrame([(900, None)], "vec_id long, embedding array<float>"))
    index = vi.build_index(df, f"file://{tmp_path}/i", 4, m=4, bits=3)
    assert index.rows.count() == 60 and vi.search_index(df.where("vec_id = 900"), index, 3).count() == 0
    got = vi.search_index(df.where("vec_id < 5"), index, 2, exclude_self=True).collect()
    assert len(got) == 10 and all(r.query_id != r.neighbour_id for r in got)
    with pytest.raises(ValueError, match="no vectors"):
        vi.build_index(df.limit(0), f"file://{tmp_path}/e", 4)
    with pytest.raises(ValueError, match="does not fit a byte"):
        vi.build_index(df, f"file://{tmp_path}/b", 4, m=4, bits=9)
