import math
import random
import zlib

import numpy as np
import pyarrow as pa

from fathom.llm.lang_id import ContextTrees, excess, held_out, letter_limits, plain_letters, predict, query, train
from tests.llm.helpers import DOCS, SF, edge_docs


def slow_bits(samples, text, depth):
    """Code length of ``text`` under counts of ``samples``, byte by byte with escapes."""
    counts = {}
    for t in samples:
        for i in range(len(t)):
            for o in range(min(i, depth) + 1):
                c = counts.setdefault(t[i - o:i], {})
                c[t[i]] = c.get(t[i], 0) + 1
    bits = 0.0
    for i, b in enumerate(text):
        for o in range(min(i, depth), -1, -1):
            c = counts.get(text[i - o:i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if b in c:
                bits -= math.log2(c[b] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(5)
    samples = {l: [bytes(rng.choice(a) for _ in range(rng.randint(0, 60))) for _ in range(12)] for l, a in (("x", b"aab c"), ("y", b"abdde "))}
    trees = ContextTrees.fit(samples, depth=3, min_count=1, max_nodes=10 ** 6)
    texts = [bytes(rng.choice(b"abcdez ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    off = np.cumsum([0] + [len(t) for t in texts])
    got = trees.code_lengths(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
    want = [[slow_bits(samples[l], t, 3) for l in ("x", "y")] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = query(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.filter(~held_out("doc_id")))
    rows = edge_docs(spark).selectExpr("*", "'old' as lang_pred")
    got = predict(rows, model).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 7) or r.text is None) and (r.lang_pred != "und" or r.score == 0)
    assert predict(rows.limit(0), model).count() == 0


def test_labels_do_not_matter_to_predictions_and_nothing_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    model = train(docs)
    plain = predict(docs, model).select("doc_id", "lang_pred", "score").collect()
    other = predict(docs.selectExpr("doc_id", "text", "'zz' as lang", "null as source"), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(plain) == sorted(other)
    none = train(spark.createDataFrame([], DOCS))
    assert {r.lang_pred for r in predict(docs, none).collect()} == {"und"}


def test_plain_letters_and_their_excess():
    got = plain_letters(pa.array(["The CAT, 12 abc9def x_y\n sat!", "Größe: 7", None, "", "12 34"]))
    assert got.to_pylist() == ["the cat sat", "größe", None, "", ""]
    rng = random.Random(4)
    samples = {l: [" ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(20)).encode() for _ in range(12)] for l, a in (("x", "aabc"), ("y", "dde"))}
    samples["z"] = [b"zzz zz"]  # one text: the others' figures
    limits = letter_limits(samples)
    assert sorted(limits) == ["x", "y", "z"] and limits["z"][0] == max(limits["x"][0], limits["y"][0])
    texts = pa.array(["abca baac cabb aabc", "abca ddee baac 77", "qwrt pksf hjkl mnvt", None, "12"])
    over = excess(ContextTrees.fit(samples), limits, texts)
    assert over[0] < 4 and over[2] > over[1] and over[2] > 8 and list(over[3:]) == [0, 0]
    none = ContextTrees.fit({})
    assert letter_limits({}) == {} and list(excess(none, {}, texts)) == [0] * 5
