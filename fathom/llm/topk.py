"""Operator 5, exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of 16 bits, each with its own index. A code within Hamming
distance m * (r + 1) - 1 of a query is within r of it in some segment, so after all
segments have been probed up to radius r every code up to that distance has been verified.
The radius grows until the k-th verified distance is covered; nothing is missed.

Rows with one code are one class. Codes and queries are dealt out in blocks of bounded size;
a task indexes one block of codes and probes it for one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import read_table, stage

SEGMENT = 16
CODE_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 12


def sign_codes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, code): one bit a component (1 if above 0), packed, padded to 64-bit words.
    Null or empty vectors, and vectors with a null or non-finite component, have no code."""
    v = F.col(embedding)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(sound).filter("vec_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False)
            width = int(size.max() + 63) // 64 * 64
            bits = np.zeros((b.num_rows, width), dtype=np.uint8)
            bits[np.arange(width) < size[:, None]] = flat > 0
            packed = np.packbits(bits, axis=1)
            codes = [row[:(n + 63) // 64 * 8].tobytes() for row, n in zip(packed, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], ["vec_id", "code"])

    return rows.mapInArrow(run, "vec_id long, code binary")


def _matrix(codes: list[bytes]) -> np.ndarray:
    n = max(map(len, codes))
    return np.frombuffer(b"".join(c.ljust(n, b"\0") for c in codes), dtype=np.uint8).reshape(len(codes), n)


def masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], dtype=np.uint16)


class SegmentIndex:
    """The m segment tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.words = codes.view(np.uint64)
        segs = codes.view(np.uint16)
        self.m = segs.shape[1]
        self.order = [np.argsort(segs[:, s], kind="stable") for s in range(self.m)]
        self.start = [np.searchsorted(segs[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def distance(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[rows] ^ q.view(np.uint64)).sum(axis=1)

    def probe(self, segs: np.ndarray, radius: int) -> np.ndarray:
        """Rows that are at distance ``radius`` of the query in some segment."""
        found = []
        flips = masks(radius)
        for s in range(self.m):
            keys = segs[s] ^ flips
            lo, n = self.start[s][keys], self.start[s][keys.astype(np.int64) + 1] - self.start[s][keys]
            total = int(n.sum())
            if total:
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
                found.append(self.order[s][at])
        return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)

    def search(self, q: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold the k nearest entries (``weight`` of them a row) with ties, and their distances."""
        segs = q.view(np.uint16)
        seen = np.zeros(len(self.words), dtype=bool)
        rows, dist = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for radius in range(SEGMENT + 1):
            new = self.probe(segs, radius)
            new = new[~seen[new]]
            seen[new] = True
            rows, dist = np.r_[rows, new], np.r_[dist, self.distance(q, new)]
            o = np.argsort(dist, kind="stable")
            rows, dist = rows[o], dist[o]
            enough = np.searchsorted(np.cumsum(weight[rows]), k)
            if enough < len(rows) and dist[enough] <= self.m * (radius + 1) - 1:
                return rows[dist <= dist[enough]], dist[dist <= dist[enough]]
        return rows, dist


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
            code_block: int = CODE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` other vectors nearest to each query vector by
    Hamming distance of their sign codes, equal distances by vec_id; fewer if there are fewer.

    ``queries`` has the columns of ``vectors``. Vectors without a code (null, empty, non-finite)
    are neither found nor answered. Rows repeated with id and code count once. A class of equal
    codes passes its k + 1 smallest ids on, which is all that any answer can use."""
    ids = Window.partitionBy("code").orderBy("vec_id")
    codes = sign_codes(vectors, vec_id, embedding).distinct().withColumn("n", F.row_number().over(ids)).filter(F.col("n") <= k + 1)
    codes = stage(codes.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = stage(sign_codes(queries, vec_id, embedding).distinct())
    asked_codes = asked.select("code").distinct()
    n_codes, n_asked = codes.count(), asked_codes.count()
    cb, qb = max(1, -(-n_codes // code_block)), max(1, -(-n_asked // query_block))
    left = codes.select(F.pmod(F.xxhash64("code"), F.lit(cb)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), "code", "ids")
    right = asked_codes.select(F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"), F.pmod(F.xxhash64("code"), F.lit(qb)).alias("qb"), "code")

    def run(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(ask):
            both = _matrix([*index["code"], *ask["code"]])
            table = SegmentIndex(np.ascontiguousarray(both[:len(index)]))
            entries = index["ids"].tolist()
            weight = np.array([len(x) for x in entries])
            for code, q in zip(ask["code"], both[len(index):]):
                rows, dist = table.search(np.ascontiguousarray(q), weight, k + 1)
                near = sorted((int(d), int(v)) for r, d in zip(rows, dist) for v in entries[r])[:k + 1]
                out += [(code, d, v) for d, v in near]
        return pd.DataFrame(out, columns=["code", "distance", "vec_id"])

    part = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(run, "code binary, distance long, vec_id long")
    best = Window.partitionBy("code").orderBy("distance", "vec_id")
    top = part.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    top = top.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("near"))
    q = asked.select(F.col("vec_id").alias("query_id"), "code").join(top, "code")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return q.select("query_id", F.posexplode(others).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", F.col("x.distance").cast("int").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for each vector whose id is divisible by 50."""
    v = read_table(spark, sf_dir, "embeddings")
    return nearest(v, v.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
        list_sum(list_transform(list_zip(q.b, v.b), lambda z: (z[1] <> z[2])::INTEGER))::INTEGER AS distance
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
