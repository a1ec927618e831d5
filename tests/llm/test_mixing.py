import pytest
from pyspark.sql import functions as F

from fathom.llm.mixing import SLOPES, mix, position, training_rows
from tests.llm.helpers import DOCS, SF, edge_docs, words


def filled(sizes, total, cap=2):
    """Targets by sharing out again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_:
        left = total - sum(target[s] for s in names if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
        open_ -= over
    return target


@pytest.mark.parametrize("table", ["sf", "edge"])
def test_targets_and_taken_words(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "sf" else edge_docs(spark)
    rows = mix(docs).collect()
    texts = [(r.source, len(words(r.text))) for r in docs.collect()]
    sizes = {}
    for s, n in texts:
        sizes[s] = sizes.get(s, 0) + n
    want = filled(sizes, 1.5 * sum(sizes.values()))
    assert len(rows) == len(texts) and sorted(r.size for r in rows) == sorted(n for _, n in texts)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, mix(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_position_inverts_the_schedule(spark):
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    for s in SLOPES:
        due = F.col("t") * (1 - s) + s * F.col("t") * F.col("t")
        assert t.filter(F.abs(position(due, F.lit(s)) - F.col("t")) > 1e-9).count() == 0


def test_training_rows_follow_the_mix(spark):
    docs = edge_docs(spark)
    mixed = mix(docs)
    out = training_rows(docs, mixed)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    for r in mixed.groupBy("doc_id").agg(F.sum("taken").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        assert 0 <= got.get(r.doc_id, 0) - r.n <= r.rows
    empty = spark.createDataFrame([], DOCS)
    assert mix(empty).count() == 0 and training_rows(empty, mix(empty)).count() == 0
