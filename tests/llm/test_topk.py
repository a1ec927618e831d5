import numpy as np
import pytest

from fathom.llm.topk import nearest

SCHEMA = "vec_id long, embedding array<float>, code int"


def brute(rows, queries, k):
    code = {i: [x > 0 for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and i is not None}
    out = []
    for q in queries:
        if q in code:
            near = sorted((sum(a != b for a, b in zip(code[q], c)), i) for i, c in code.items() if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("dim", [10, 64, 100])
def test_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(400, dim)).astype(np.float32)
    base[100:160] = base[100]
    base[200:260] = base[200] + rng.normal(scale=0.4, size=(60, dim))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    v = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, x) for i, x, _ in rows], range(0, 400, 20), 5)
    for blocks in ({}, {"code_block": 90, "query_block": 7}):
        got = nearest(v, v.filter("vec_id % 20 = 0"), k=5, **blocks).collect()
        assert sorted(map(tuple, got)) == want


def test_edge_vectors(spark):
    rows = [(1, [1.0, -1.0], 0), (1, [1.0, -1.0], 0), (2, None, 0), (3, [], 0), (4, [float("nan"), 1.0], 0), (5, [None, 1.0], 0),
            (6, [0.0, 0.0], 0), (None, [1.0, 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [2.0, -3.0], 0)]
    v = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, nearest(v, v, k=3).collect()))
    assert got == [(1, 1, 9, 0), (1, 2, 6, 1), (6, 1, 1, 1), (6, 2, 9, 1), (9, 1, 1, 0), (9, 2, 6, 1)]
    assert nearest(v.limit(0), v, k=3).count() == 0 and nearest(v, v.limit(0), k=3).count() == 0
