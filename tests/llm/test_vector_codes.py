"""Operator 13 against plain Python integers."""

import hashlib
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id -> sorted (code, error)), codebooks, in exact integers."""
    kept = sorted(((i, lab, [floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = -(-max((len(v) for *_, v in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * d - len(v)))[p * d:(p + 1) * d] for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        dist = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return dist.index(min(dist)), min(dist)

    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    out = []
    for (i, lab, _), c in zip(kept, cut):
        got = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in got), min(sum(x for _, x in got), V.INT64)))
    return out, books


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = V.compress(df)
    return sorted(map(tuple, codes.collect()), key=str), books.tolist()


def as_rows(rng, n, width, spread=1.0):
    return [(int(i), [float(x) for x in rng.normal(0, spread, width)], int(i) % 3) for i in range(n)]


@pytest.mark.parametrize("spread", [0.2, 3e4, 1e10])
def test_codes_are_exact_at_any_size_of_numbers(spark, spread):
    rows = as_rows(np.random.default_rng(int(spread)), 60, 24, spread)
    want, books = brute(rows)
    got, learned = run(spark, rows)
    assert got == sorted(want, key=str) and learned == books


def test_ties_repeats_nulls_and_widths(spark):
    nan, inf = float("nan"), float("inf")
    rows = as_rows(np.random.default_rng(1), 12, 16) + [
        (3, [0.0] * 16, None), (3, [0.0] * 16, None), (3, [1.0] * 16, 1), (None, [0.5] * 16, None), (50, None, 1), (51, [nan] * 16, 1),
        (52, [inf] + [0.0] * 15, 1), (53, [None] + [0.0] * 15, 1), (54, [0.25] * 5, 2), (55, [], 2), (56, [-1e-9] * 16, 2)]
    want, books = brute(rows)
    got, learned = run(spark, rows)
    assert got == sorted(want, key=str) and learned == books
    assert {r[0] for r in got}.isdisjoint({50, 51, 52, 53})


def test_few_rows_no_rows_and_other_columns(spark):
    rows = as_rows(np.random.default_rng(2), 3, 8)
    want, books = brute(rows)
    assert run(spark, rows) == (sorted(want, key=str), books)
    assert run(spark, rows[:0])[0] == []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({
        c: F.lit(1) for c in ("v", "code", "error", "__x", "__label", "n")})
    codes, _ = V.compress(df)
    out = V.with_label_errors(codes)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and out.count() == 3


def test_label_errors_and_decoding(spark, monkeypatch):
    rows = as_rows(np.random.default_rng(3), 40, 16) + [(100, [0.1] * 16, None), (101, [0.9] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = V.compress(df)
    want = {}
    for _, lab, _, e in brute(rows)[0]:
        want[lab] = want.get(lab, 0) + e
    for bound in (V.SENT_LABELS, 1):
        monkeypatch.setattr(V, "SENT_LABELS", bound)
        assert {(r.label, r.label_error) for r in V.with_label_errors(codes).collect()} == set(want.items())
    for r in V.decode(codes, books).collect():
        flat = [x / V.SCALE for p in range(8) for x in books[p][int(r.code[2 * p:2 * p + 2], 16)].tolist()]
        assert r.approx == flat
    flat = ",".join(str(x) for b in books.tolist() for e in b for x in e)
    assert V.codebooks_sha256(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_limbs_and_dots():
    rng = np.random.default_rng(4)
    for top in (100, 1 << 30, 1 << 61):
        a, b = rng.integers(-top, top, (5, 7)), rng.integers(-top, top, (6, 7))
        for x in V.limbs(a, 25):
            assert np.abs(x).max() <= 1 << 25
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
        assert V.dots(a, b, exact=True).tolist() == want
