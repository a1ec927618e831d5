"""Operator 11 against comparing all words with all."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from fathom.llm import spelling as S

from .helpers import edge_docs


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def counted(rows, least_length=5, least_count=3, damage=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    out, form = [], {}
    rows = {}
    for w in n:
        own = [v for v in n if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        rows[w] = len(own)
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, n[w], rows[w], n.get(form[w])))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def small_alphabet():
    """Many near words: letters a, b, é, with equal letters in rows and ties."""
    rows, x = [], 12345
    for i in range(120):
        words = []
        for _ in range(40):
            x = (x * 1103515245 + 12345) % (1 << 31)
            size = 5 + x % 3
            words.append("".join("abé"[(x >> (3 + k)) * 7 % 11 % 3] for k in range(size)))
        rows.append((i, " ".join(words) + " Xylophone xylophones-xylophone"))
    return rows


def test_equal_to_all_pairs(spark):
    rows = small_alphabet()
    n = counted(rows)
    assert len(n) > 60
    assert result(S.variants(docs(spark, rows))) == brute(n)


def test_real_words(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 40").collect()]
    n = counted(rows, 4, 1, 5)
    got = result(S.variants(docs(spark, rows), least_length=4, least_count=1, damage=5))
    assert {(r[0], r[3]) for r in got} == set(n.items())
    some = dict(sorted(n.items())[:1500])
    assert result(S.variants(docs(spark, [(0, " ".join(" ".join([w] * k) for w, k in some.items()))]), least_length=4, least_count=1, damage=None)) == brute(some)


def test_chains_end_at_the_last_form(spark):
    words = [("aaaaa" + "b" * k, 3 * 2 ** k) for k in range(9)]
    text = " ".join(" ".join([w] * n) for w, n in words)
    got = {r.word: r.root for r in S.variants(docs(spark, [(1, text)]), damage=None).collect()}
    assert set(got.values()) == {"aaaaabbbbbbbb"} and len(got) == 9


def test_long_words_nulls_and_ties(spark):
    long = "x" * 30_000
    rows = [(1, long), (2, long), (None, long + " " + long[1:]), (3, long[1:] + " " + long[1:]), (4, None), (5, ""), (6, "ab×cd " * 4), (7, "ABCDE abcde abcdé " * 3)]
    n = counted(rows, damage=None)
    assert result(S.variants(docs(spark, rows), damage=None)) == brute(n)
    assert S.variants(docs(spark, rows).limit(0)).count() == 0
    wide = edge_docs(spark).withColumns({c: F.lit(1) for c in ("id", "run", "word", "n", "p", "__id")})
    assert result(S.variants(wide, least_count=1)) == brute(counted([(r.doc_id, r.text) for r in wide.collect()], least_count=1))


def test_a_colliding_numbering_is_thrown_away(spark, monkeypatch):
    words = docs(spark, [(1, "abcde abcdf bbcde abcd")]).selectExpr("explode(split(text, ' ')) as word").repartition(1)
    assert S.number_nodes(words) == 1
    import fathom.llm.spelling as M
    monkeypatch.setattr(M, "count", lambda start: iter([0, 7]))

    real = M._tries

    def clash(b, seed):
        out = list(real(b, seed))
        if seed == 0:
            out[5] = out[5] % 2
        return tuple(out)
    monkeypatch.setattr(M, "_tries", clash)
    assert S.number_nodes(words) == 7
