import random
from collections import Counter

import pytest

from fathom.llm.substring_dedup import remove_repeats
from tests.llm.helpers import DOCS, SF, edge_docs, words


def brute(texts, k):
    ws = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + k]) for w in ws for i in range(len(w) - k + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def held(docs, **how):
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], how.get("window", 35)))]
    got = remove_repeats(docs, **how).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got))) == sorted(map(str, want))
    assert all(sum(s.stop - s.start for s in r.removed) == r.n_removed for r in got)
    return got


def test_tables(spark):
    held(spark.read.parquet(f"{SF}/documents.parquet"))
    got = held(edge_docs(spark).selectExpr("*", "1 as kid", "2 as th", "'t' as t", "0 as kept"))
    assert got[0].kid == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_copies(spark, seed):
    """Few words, shared passages with edits, repeats within a text, windows cut at text ends."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(rng.choice([3, 30, 400]))]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(4, 40))] for _ in range(6)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.3 and p:
                p[rng.randrange(len(p))] = "edit"
            w += p
        rows.append((i % 70, rng.choice([" ", "\n", "  "]).join(w), None, None, 0))
    held(spark.createDataFrame(rows, DOCS), window=10, anchor=4)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_of_one_id_with_equal_32_bit_hashes(spark):
    """The first two are alike in F.hash, under a null id and a repeated one; only one of each is copied in part."""
    a, b = (" ".join(f"w{i}x{j}" for j in range(40)) for i in (38755, 83392))
    rows = [(i, t, None, None, 0) for i in (None, 5) for t in (a, b)]
    one = spark.createDataFrame(rows, DOCS)
    assert one.selectExpr("hash(text) as h").distinct().count() == 1
    held(spark.createDataFrame([*rows[:2], (9, "edit " + a[:a.index("x38")], None, None, 0)], DOCS))
    held(spark.createDataFrame([*rows[2:], (9, b + " " + " ".join(f"more{j}" for j in range(50)), None, None, 0)], DOCS))
    held(spark.createDataFrame([rows[0], (None, "short", None, None, 0), (None, None, None, None, 0), (None, "", None, None, 0), rows[0]], DOCS))
