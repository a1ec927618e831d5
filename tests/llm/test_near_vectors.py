import numpy as np

from fathom.llm.near_vectors import near_duplicates
from tests.llm.helpers import least_reachable

SCHEMA = "vec_id long, embedding array<double>, label int, node int"


def clustered(seed=0, n=900, dim=32):
    """Noise around centres at all cosines from far below to far above the threshold."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, dim))
    x = centre[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * rng.uniform(0.05, 0.4, (n, 1))
    x[10:40] = x[10]
    x[50] = 3 * x[51]
    return x


def test_recall_and_components(spark):
    x = clustered()
    rows = [(i, v.tolist(), i % 3, 0) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(df, cell_rows=60, home_block=16, other_block=40).orderBy("vec_id").collect()
    n = np.array([r.n_links for r in got])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.99 * link.sum() > 0
    whole = near_duplicates(df, cell_rows=10_000).orderBy("vec_id").collect()
    assert [r.n_links for r in whole] == link.sum(axis=1).tolist()
    assert [r.component_id for r in whole] == least_reachable(list(range(len(x))), lambda i, j: link[i, j])
    assert all(r.kept == (r.vec_id == r.component_id) for r in whole)


def test_edge_vectors(spark):
    rows = [(1, [1.0, 0.0], 0, 0), (2, [2.0, 0.0], 0, 0), (3, [1.0, 0.0], 0, 0), (3, [1.0, 0.0], 0, 0), (4, None, 0, 0), (5, [0.0, 0.0], 0, 0),
            (6, [None, 1.0], 0, 0), (7, [float("nan"), 1.0], 0, 0), (8, [], 0, 0), (None, [1.0, 0.0], 0, 0), (9, [1.0, 0.0, 0.0], 0, 0),
            (10, [float("inf"), 0.0], 0, 0), (11, [0.0, 1e-300], 0, 0), (12, [0.0, 1e300], 0, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 13
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False) and got[None] == (0, None, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10))
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame(rows[4:7], SCHEMA)).count() == 3


def test_different_vectors_under_one_id_keep_their_links(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.001, 0.0]), (7, [0.0, 1.0, 0.001])]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
        assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]
