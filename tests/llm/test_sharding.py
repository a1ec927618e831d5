"""Operator 12 against a plain sort."""

import zlib
from hashlib import md5

from pyspark.sql import functions as F

from fathom.llm import sharding as S

from .helpers import edge_docs


def brute(rows, shards=8, slack=S.SLACK):
    """Sorted (doc_id, size, crc, shard, slot) of (doc_id, text)."""
    def key(r):
        i, t = r
        b = ":".join([str(i) if i is not None else "null"] + (["null"] if t is None else []))
        return md5((t or "").encode()).hexdigest(), md5(b.encode()).hexdigest()

    size = {}
    for r in rows:
        size[key(r)[0]] = size.get(key(r)[0], 0) + len((r[1] or "").encode()) + 1
    total, at, seen, out, slots = sum(size.values()), 0, {}, [], {}
    for r in sorted(rows, key=key):
        t, n = key(r)[0], len((r[1] or "").encode()) + 1
        first = seen.setdefault(t, at)
        mid = 2 * first + size[t] if size[t] * shards <= slack * total else 2 * at + n
        k = min(shards - 1, mid * shards // (2 * total))
        slots[k] = slots.get(k, -1) + 1
        out.append((r[0], n, zlib.crc32((r[1] or "").encode()), k, slots[k]))
        at += n
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)


def corpus(n=3000):
    rows = [(i, f"text {i} " + "word " * (i * i % 97)) for i in range(n)]
    rows += [(10_000 + i, "a hot copy") for i in range(n // 2)] + [(20_000, "same row")] * 700 + [(30_000 + i, None) for i in range(300)]
    return rows + [(40_000, "long " * 20_000), (40_001, ""), (None, "no id"), (None, None), (40_002, "ünï 漢字 😀")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_places_equal_a_plain_sort_whatever_the_ranges(spark):
    rows = corpus()
    want = brute(rows)
    df = frame(spark, rows)
    for least in (1, 40, 2048):
        assert result(S.shard(df, least=least)) == want
    share = sum(r[1] for r in want) / 8
    by = {k: sum(r[1] for r in want if r[3] == k) for k in range(8)}
    assert all(abs(b - share) <= max(S.SLACK * share, 100_001) for b in by.values())


def test_hot_texts_are_cut_into_parts(spark):
    rows = S.sized(frame(spark, corpus())).withColumn("x", F.lit(0)).drop("x").cache()
    cut = S.ranges(rows, least=64).groupBy("__r", "__sub").count().collect()
    n = sum(r[2] for r in cut)
    assert len({r[0] for r in cut if r[1]}) >= 1                      # the hot copy's range is cut
    assert max(r[2] for r in cut) <= 6 * n / 64 and n == rows.count()


def test_edge_rows_extra_columns_and_empty(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(S.shard(docs.select("doc_id", "text"))) == brute(rows)
    clash = docs.withColumns({c: F.lit(1) for c in ("__a", "__b", "size", "shard", "slot", "__n")})
    got = S.shard(clash)
    assert got.count() == len(rows) and sorted(r.shard for r in got.collect()) == sorted(r[3] for r in brute(rows))
    assert S.shard(docs.limit(0)).count() == 0


def test_written_shards_hold_all_rows_in_order_of_slots(spark, tmp_path):
    docs = edge_docs(spark)
    placed = S.shard(docs, shards=3)
    S.write_shards(docs, placed, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for k, n in placed.groupBy("shard").count().collect():
        assert sorted(r.slot for r in back.filter(F.col("shard") == k).collect()) == list(range(n))
