"""The exact way, what many chunks score, and how many files are opened."""

import numpy as np
import pandas as pd
from brute import nearest as brute_nearest

from veritab.llm import permindex


def test_exact_finds_all(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((700, 24))
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "id long, v array<double>")
    got = permindex.nearest(v, lambda i: i % 50 == 0, exact=True, chunk=64, block=4).toPandas()
    want = brute_nearest(list(range(700)), vectors.tolist(), lambda i: i % 50 == 0)
    found = {q: x.sort_values("rank")["vec_id"].tolist() for q, x in got.groupby("query_id")}
    assert found == {q: [i for i, _ in w] for q, w in want.items()}


def test_chunks_share_a_files_number():
    rng = np.random.default_rng(3)
    pivots = rng.standard_normal((40, 16))
    x = rng.standard_normal((6000, 16))
    order = permindex.orders(x, pivots, 40)
    query = pd.DataFrame({"id": [9999], "row": [9999], "v": [x[0].tobytes()], "o": [order[0].tobytes()]})
    scored = {}
    for chunks in (1, 10, 40):
        search = permindex._search(40, 8, 8, 5, permindex.RERANKED, False)
        scored[chunks] = 0
        for p in order[0][:8].tolist():
            rows = np.flatnonzero((order[:, :8] == p).any(axis=1))
            for c in range(chunks):
                mine = rows[rows % chunks == c]
                part = pd.DataFrame({"id": mine, "row": mine, "v": [x[i].tobytes() for i in mine], "o": [order[i].tobytes() for i in mine], "chunks": chunks})
                got = search((p, c, 0), part, query)
                scored[chunks] += int(got["scored"].iloc[0]) if len(got) else 0
    most = np.maximum(permindex.quotas(8), 10).sum()  # twice the finds asked for at least
    assert 0 < scored[1] <= most and all(scored[c] <= most + 8 * c for c in (10, 40))


def test_orders_are_those_of_a_full_sort():
    rng = np.random.default_rng(4)
    x, pivots = rng.standard_normal((300, 8)), rng.standard_normal((90, 8))
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T
    for ordered in (1, 17, 90):
        assert (permindex.orders(x, pivots, ordered) == np.argsort(-near, axis=1, kind="stable")[:, :ordered]).all()


def test_files_opened():
    assert [permindex.probes(n) for n in (0, 100, 50_000, 800_000, 10**9)] == [32, 32, 32, 64, 381]
