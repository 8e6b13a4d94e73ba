"""Recall of the registered searches by inverted lists against the exact one."""

import pytest

from orbweave import plans


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_searches_find_the_neighbours(spark, size):
    queries, at = plans.queries(), f"/root/testdata/{size}"
    found = {n: {(r.query_id, r.neighbour_id) for r in queries[n](spark, at).collect()} for n in ("knn_exact_k5", "knn_ivf", "knn_ivfpq")}
    exact = found["knn_exact_k5"]
    shares = {n: len(exact & found[n]) / len(exact) for n in ("knn_ivf", "knn_ivfpq")}
    print(size, shares)
    assert all(len(f) == len(exact) for f in found.values())
    assert min(shares.values()) >= 0.9
