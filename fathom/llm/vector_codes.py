"""Operator 13, compressing vectors to product codes by exact integer arithmetic.

Components become integers; each of ``PARTS`` equal parts of a vector is coded by the nearest of
``ENTRIES`` codebook entries, which are learned by a few rounds of k-means on all rows. All
arithmetic is on whole numbers: matrix products run in float64 on limbs of the integers, so small
that no product's sum reaches 2**53, and are put together again in int64 (or in Python's integers
where a sum could leave int64). The codes so do not depend on the order of rows or on the machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import read_table, slices, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond this are taken as this (components of 2**50 and more at the default scale).
LARGEST = 1 << 62
#: Label totals are sent to all tasks up to this many labels, and joined with a shuffle beyond.
SENT_LABELS = 100_000
INT64 = (1 << 63) - 1


def integers(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole: not null, with finite components only.
    ``v`` holds floor(scale * component), held to +-2**62."""
    x = F.col("__x")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(LARGEST)
    as_int = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c * F.lit(float(scale))))).cast("long"))
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                             F.col(vector).cast("array<double>").alias("__x"))
    return rows.filter(x.isNotNull() & whole).select("vec_id", "label", as_int.alias("v"))


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays x with a = sum of x[k] * 2**(bits * k) and |x[k]| <= 2**bits."""
    out, a, top = [], a.astype(np.int64), 1 << bits
    while a.size and (a.min() < -top or a.max() > top):
        out.append((a & (top - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def _size(a: np.ndarray) -> int:
    return max(-int(a.min()), int(a.max()), 0) if a.size else 0


def dots(a: np.ndarray, b: np.ndarray, exact: bool = False) -> np.ndarray:
    """The dot products of the rows of two integer matrices, exactly: int64, or Python's integers
    if ``exact`` asks for room beyond int64."""
    d = a.shape[1]
    bits = (53 - max(d - 1, 0).bit_length()) // 2
    out = np.zeros((len(a), len(b)), dtype=object if exact else np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            p = (x @ y.T).astype(np.int64)
            out += (p.astype(object) if exact else p) * (1 << bits * (i + j))
    return out


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for every row of ``part``; the
    first of equally near ones."""
    exact = 4 * max(part.shape[1], 1) * max(_size(part), _size(book)) ** 2 > INT64
    kind = object if exact else np.int64
    own = (part.astype(kind) ** 2).sum(axis=1)
    score = (book.astype(kind) ** 2).sum(axis=1)[None, :] - 2 * dots(part, book, exact)
    best = score.argmin(axis=1)
    return best, own + score[np.arange(len(part)), best]


def _matrices(batches: Iterator[pa.RecordBatch], width: int):
    """(batch, its vectors as one integer matrix, filled up with zeros to ``width``)."""
    for b in slices(batches, "v", 1 << 19):
        v = b.column("v")
        n = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((b.num_rows, width), dtype=np.int64)
        row = np.repeat(np.arange(b.num_rows), n)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        yield b, out


def _sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, component sums) of the parts that are nearest to each entry. A
    task sends one row an entry and position; Spark adds them up."""
    parts, entries, d = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), dtype=np.int64)
        high, low = np.zeros((2, parts, entries, d), dtype=np.int64)
        for _, m in _matrices(batches, parts * d):
            for p in range(parts):
                x = m[:, p * d:(p + 1) * d]
                at = nearest(x, books[p])[0]
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(high[p], at, x >> 31)
                np.add.at(low[p], at, x & 0x7FFFFFFF)
        p, e, k = np.nonzero(np.broadcast_to(n[:, :, None] > 0, high.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, k, n[p, e], high[p, e, k], low[p, e, k])],
                                         names=["p", "e", "k", "n", "high", "low"])

    got = rows.select("v").mapInArrow(partial, "p long, e long, k long, n long, high long, low long")
    total = got.groupBy("p", "e", "k").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in total.collect():  # parts * entries * positions rows at most
        out.setdefault((r.p, r.e), (int(r.n), [0] * d))[1][r.k] = (int(r.high) << 31) + int(r.low)
    return out


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, position] for ``rows`` of :func:`integers`.

    They start as the parts of the rows with the smallest ids (nulls last; rows alike in id in
    order of their vectors). A round assigns every part to its nearest entry and moves each entry
    to the rounded-down mean of its parts; entries without parts stay. Vectors are filled up with
    zeros to the widest one's width, rounded up to a multiple of ``parts``; with fewer rows than
    ``entries`` there are as many entries as rows."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    d = -(-width // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.zeros((parts, len(first), d), dtype=np.int64)
    for e, r in enumerate(first):
        books[:, e] = np.array([*r.v, *[0] * (parts * d - len(r.v))], dtype=np.int64).reshape(parts, d)
    for _ in range(rounds if d and len(first) else 0):
        for (p, e), (n, s) in _sums(rows, books).items():
            books[p, e] = [x // n for x in s]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to what the
    code stands for (held to the largest long)."""
    parts, entries, d = books.shape
    kinds = dict(rows.dtypes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in _matrices(batches, parts * d):
            error = np.zeros(len(m), dtype=object)
            digits = np.zeros((len(m), parts), dtype=np.uint8)
            for p in range(parts if entries and d else 0):
                digits[:, p], dist = nearest(m[:, p * d:(p + 1) * d], books[p])
                error = error + dist.astype(object)
            text = digits.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                 pa.array([min(e, INT64) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approx``: the vector that a code stands for, as doubles."""
    entry = F.array(*[F.array(*[F.array(*[F.lit(int(x) / scale) for x in e]) for e in b]) for b in books])
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.element_at(F.element_at(entry, p + 1), (F.conv(
        F.substring(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int") + 1)))
    return codes.withColumn("approx", F.flatten(parts))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): (vec_id, label, code, error) for every whole vector, and the codebooks.

    Null vectors and vectors with null or non-finite components have no row. Repeated rows each
    have theirs. No whole vector: no rows, codebooks without entries. The integers are written
    once; each round reads them and sends sums only."""
    rows = stage(integers(embeddings, vec_id, vector, label, scale))
    books = learn(rows, parts, entries, rounds)
    return encode(rows, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of a label (null: a label of its own)."""
    total = codes.groupBy(F.col("label").alias("__label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(INT64).cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = stage(total)
    if total.count() <= SENT_LABELS:
        total = F.broadcast(total)
    return codes.join(total, codes["label"].eqNullSafe(total["__label"])).drop("__label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read_table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error",
                                           F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _round_sql(r: int) -> str:
    floor_mean = "(s - ((s % n) + n) % n) // n"
    return f""",
a{r} AS MATERIALIZED (SELECT rid, p, min(d * 16 + e) AS de FROM (
    SELECT x.rid, x.p, c.e, sum((x.x - c.c) * (x.x - c.c))::BIGINT AS d FROM parts x JOIN c{r} c USING (p, k) GROUP BY ALL) GROUP BY rid, p),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, c.k, coalesce(({floor_mean})::BIGINT, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT x.p, a.de % 16 AS e, x.k, sum(x.x)::BIGINT AS s, count(*) AS n FROM parts x JOIN a{r} a USING (rid, p) GROUP BY ALL) m
    ON c.p = m.p AND c.e = m.e AND c.k = m.k)"""


SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
w AS (SELECT (max(len(v)) + 7) // 8 AS d FROM kept),
parts AS MATERIALIZED (
  SELECT rid, i // d AS p, i % d AS k, coalesce(v[i + 1], 0) AS x
  FROM (SELECT rid, v, d, unnest(range(8 * d)) AS i FROM kept, w)),
c0 AS MATERIALIZED (SELECT p, rid AS e, k, x AS c FROM parts WHERE rid < 16)""" + "".join(_round_sql(r) for r in range(ROUNDS)) + f""",
last AS (SELECT rid, p, min(d * 16 + e) AS de FROM (
    SELECT x.rid, x.p, c.e, sum((x.x - c.c) * (x.x - c.c))::BIGINT AS d FROM parts x JOIN c{ROUNDS} c USING (p, k) GROUP BY ALL) GROUP BY rid, p),
coded AS (SELECT kept.vec_id, kept.label, rid, string_agg(printf('%02x', (de % 16)::INTEGER), '' ORDER BY p) AS code, sum(de // 16)::BIGINT AS error
          FROM last JOIN kept USING (rid) GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded
"""
