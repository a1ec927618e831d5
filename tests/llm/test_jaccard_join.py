import random

import pytest
from pyspark.sql import functions as F

from fathom.llm.jaccard_join import near_duplicate_groups, one_per_group
from tests.llm.helpers import DOCS, SF, edge_docs, least_reachable, shingles


def want(rows):
    sets = [shingles(t) for _, t, *_ in rows]

    def linked(i, j):
        o = len(sets[i] & sets[j])
        return o > 0 and 100 * o >= 80 * len(sets[i] | sets[j])

    return [len(s) for s in sets], least_reachable([r[0] for r in rows], linked)


def held(spark, rows, **how):
    n, comp = want(rows)
    got = near_duplicate_groups(spark.createDataFrame(rows, DOCS), **how).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(r[0], a, b) for r, a, b in zip(rows, n, comp)]


def test_table(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").collect()))
    held(spark, rows)


@pytest.mark.parametrize("seed,frequent", [(1, 3), (2, 32), (3, 1)])
def test_edited_copies_around_the_threshold(spark, seed, frequent):
    """Chains of edits, shared passages and sizes at the filters' limits, in any order."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 90))] for _ in range(8)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at:at + rng.randint(0, 2)] = [rng.choice(vocab) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            w = w[:max(1, int(len(w) * rng.uniform(0.7, 1)))]
        if rng.random() < 0.2:
            w += base[0]
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w), None, None, 0))
    held(spark, rows, frequent=frequent)


def test_edge_rows(spark):
    docs = edge_docs(spark).selectExpr("*", "1 as th", "2 as node", "3 as gid")
    got = near_duplicate_groups(docs)
    assert got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by[10].component_id == 1 and by[10].n_shingles == by[1].n_shingles == 10
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (2, 3, 4)) and by[7].n_shingles == 1
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, None, 7, 8, 9]))
    assert near_duplicate_groups(docs.limit(0)).count() == 0 and one_per_group(docs.limit(0)).count() == 0


def test_many_near_copies_meet_in_one_component(spark):
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i % 60] + [f"e{i}"] + base[i % 60 + 1:]), None, None, 0) for i in range(400)]
    got = near_duplicate_groups(spark.createDataFrame(rows, DOCS)).agg(F.min("component_id"), F.max("component_id")).first()
    assert tuple(got) == (0, 0)


def test_texts_of_one_id_with_equal_32_bit_hashes_all_stay(spark):
    a, b = (" ".join(f"w{i}x{j}" for j in range(40)) for i in (38755, 83392))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i in (None, 5) for t in (a, b)] + [(5, a, None, None, 0)], DOCS)
    assert docs.selectExpr("hash(text) as h").distinct().count() == 1
    # a and b stand under a null id and under 5: one of each stays, that of the known id
    assert sorted((r.doc_id, r.text) for r in one_per_group(docs).collect()) == sorted([(5, a), (5, b)])
    bare = one_per_group(docs.filter("doc_id is null")).collect()
    assert sorted(r.text for r in bare) == sorted([a, b])
