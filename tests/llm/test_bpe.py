import hashlib
import random

import public_tokenizers as P
import pytest

from fathom.llm.bpe import Codec, decode, digests, encode, read_ranks, round_trip
from fathom.llm.token_counts import CountedText, apply_edits, build_trees, sample_edits, with_edits
from tests.llm.helpers import DOCS, SF, edge_docs

RANKS = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
BITS = ["a", "b", "the", " ", "  ", "\n", "é", "ß", "1", "23", "'", "'s", "'re", "'ll", "!", "--", "日", "\x1c", "\r\n", "\t", "ing", "ll"]


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, P.PATTERN, leaf=24)


def mess(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_tree_equals_the_plain_encoding(codec):
    rng = random.Random(1)
    for _ in range(4000):
        t = mess(rng, rng.randint(0, 120))
        assert codec.encode(t) == codec.enc.encode_ordinary(t)
    for n in range(120):  # one long pre-token: the seam is found by pairs of tokens
        t = rng.choice(["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(5 * n)), "abcdefg" * n, "a" * n, "=" * 3 * n])
        assert codec.encode(t) == codec.enc.encode_ordinary(t) and codec.decode(codec.encode(t)).decode() == t


def test_documents_digest_as_the_library_does(spark, codec):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs(spark)):
        want = []
        for r in docs.collect():
            ids = codec.enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, digests(docs, RANKS, P.PATTERN).collect()))) == sorted(map(str, want))


def test_columns_stay_and_empty_table(spark):
    docs = edge_docs(spark).selectExpr("*", "'old' as ids", "'old' as decoded")
    out = decode(encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(out.columns) == sorted(docs.columns) and out.filter("decoded is null").count() == 0
    both = round_trip(docs, RANKS, P.PATTERN)
    assert sorted(map(str, both.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, out.select("doc_id", "ids", "decoded").collect()))
    assert digests(spark.createDataFrame([], DOCS), RANKS, P.PATTERN).count() == 0


def test_edits_count_as_a_full_encoding(codec):
    rng = random.Random(2)
    for _ in range(600):
        t = mess(rng, rng.randint(0, 200))
        x = CountedText.of(t, codec, 16)
        for _ in range(6):
            s = rng.randint(-2, len(t) + 3)
            e, put = s + rng.randint(-1, 30), mess(rng, rng.randint(0, 8))
            a = min(max(s, 0), len(t))
            b = min(max(e, a), len(t))
            t = t[:a] + put + t[b:]
            x.edit(s, e, put)
            assert x.text == t and x.chars.total == len(t) and x.tokens.total == len(codec.enc.encode_ordinary(t))


def test_only_the_edited_region_is_encoded(codec):
    x = CountedText.of("some words of text " * 2000, codec, 256)
    x.edit(20_000, 20_004, "new")
    assert x.encoded < 1000


def test_edited_documents(spark, codec):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs(spark)):
        trees = build_trees(docs, RANKS, P.PATTERN)
        for r in trees.select("text", "n_tokens").collect():
            assert r.n_tokens == len(codec.enc.encode_ordinary(r.text or ""))
        out = apply_edits(trees.withColumn("edits", sample_edits()), RANKS, P.PATTERN)
        for r in out.select("text", "n_tokens").collect():
            assert r.n_tokens == len(codec.enc.encode_ordinary(r.text or ""))
    assert build_trees(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_edit_tables_and_null_edits(spark, codec):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 4, 7, "2"), (3, 1, 0, 9, "new"), (2, 1, None, 1, "x"), (9, 1, 0, 0, "y")],
                                  "doc_id long, seq int, start long, stop long, put string")
    trees = with_edits(build_trees(docs, RANKS, P.PATTERN), edits)
    got = {r.doc_id: r for r in apply_edits(trees, RANKS, P.PATTERN).collect()}
    assert (got[1].text, got[2].text, got[3].text) == ("1 2 three", "four", "new")
    assert got[2].n_chars_encoded == 0 and got[3].n_tokens_before == 0 and got[3].n_tokens == len(codec.encode("new"))


def test_many_edits_in_one_place_stay_cheap(codec):
    t = CountedText.of("some words to start with. " * 40, codec)
    at, spent = 300, []
    for k in range(300):
        put = f" edit {k}: " + "new text, more words; " * 13
        before = t.encoded
        t.edit(at, at, put)
        spent.append(t.encoded - before)
        at += len(put)
    assert t.tokens.total == len(codec.encode(t.text)) and t.chars.total == len(t.text)
    assert max(spent[-20:]) <= 3 * max(spent[:3]), (spent[:3], spent[-3:])
    t.edit(0, len(t.text) - 30, "")
    assert t.tokens.total == len(codec.encode(t.text)) and t.chars.total == len(t.text)


def test_edits_join_tables_with_clashing_columns(spark):
    trees = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, e long, seq long")
    edits = spark.createDataFrame([(1, 0, 0, 1, "x")], "doc_id long, seq long, start long, stop long, put string")
    got = with_edits(trees, edits)
    assert got.columns == ["doc_id", "text", "e", "seq", "edits"] and got.first().edits[0].put == "x" and got.first().e == 5
