"""Operator 2, token counts that follow edits.

Per document a segment tree over stretches of pre-tokens is kept: every leaf has its length
in characters and in tokens, every inner node the sums below it. An edit encodes only the
leaves that it touches and their boundary context anew and updates the sums above them.

A leaf ends where a non-space is followed by a space or newline: such a place ends a
pre-token whatever stands around it, so leaves count alone as they count together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.bpe import LEAF, Codec, _ends_token, read_ranks
from fathom.llm.common import read_table, slices

#: A leaf is closed at the first sure pre-token end after so many characters.
LEAF_CHARS = 512


def leaf_lengths(text: str, leaf_chars: int) -> list[int]:
    out, start, n = [], 0, len(text)
    while start < n:
        i = min(start + leaf_chars, n)
        while i < n and not _ends_token(text, i):
            i += 1
        out.append(i - start)
        start = i
    return out


class SegmentTree:
    """Sums over leaves in one heap array: node i has the children 2i and 2i + 1."""

    def __init__(self, heap: np.ndarray):
        self.heap, self.cap = heap, len(heap) // 2

    @classmethod
    def of(cls, leaves: list[int]) -> "SegmentTree":
        cap = 1 << max(len(leaves) - 1, 0).bit_length()
        heap = np.zeros(2 * cap, dtype=np.int64)
        heap[cap:cap + len(leaves)] = leaves
        lo = cap
        while lo > 1:
            heap[lo // 2:lo] = heap[lo:2 * lo:2] + heap[lo + 1:2 * lo:2]
            lo //= 2
        return cls(heap)

    @property
    def total(self) -> int:
        return int(self.heap[1])

    def put(self, leaf: int, value: int) -> None:
        i, d = self.cap + leaf, value - int(self.heap[self.cap + leaf])
        while i:
            self.heap[i] += d
            i //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds offset ``at`` (the last non-empty one at the end), and its start."""
        i, start = 1, 0
        at = min(at, max(self.total - 1, 0))
        while i < self.cap:
            left = int(self.heap[2 * i])
            i, start = (2 * i, start) if at - start < left else (2 * i + 1, start + left)
        return i - self.cap, start


class CountedText:
    """A text with its trees of characters and tokens."""

    def __init__(self, text: str, chars: SegmentTree, tokens: SegmentTree, codec: Codec, leaf_chars: int = LEAF_CHARS):
        self.text, self.chars, self.tokens, self.codec, self.encoded = text, chars, tokens, codec, 0
        self.leaf_chars = leaf_chars

    @classmethod
    def of(cls, text: str, codec: Codec, leaf_chars: int = LEAF_CHARS) -> "CountedText":
        sizes, counts, at = leaf_lengths(text, leaf_chars), [], 0
        for n in sizes:
            counts.append(len(codec.encode(text[at:at + n])))
            at += n
        return cls(text, SegmentTree.of(sizes), SegmentTree.of(counts), codec, leaf_chars)

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replace text[start:stop] by ``put``; bounds are cut to the text."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if start == stop and not put:
            return
        # context: the character on either side of the edit decides whether a leaf's end is still sure
        first, a = self.chars.find(max(start - 1, 0))
        last, b = self.chars.find(stop)
        b += int(self.chars.heap[self.chars.cap + last])
        region = self.text[a:start] + put + self.text[stop:b]
        self.text = self.text[:start] + put + self.text[stop:]
        self.encoded += len(region)
        if len(region) > 2 * self.leaf_chars:
            self._cut(first, last, region)
            return
        for leaf in range(first, last + 1):
            self.chars.put(leaf, 0)
            self.tokens.put(leaf, 0)
        self.chars.put(first, len(region))
        self.tokens.put(first, len(self.codec.encode(region)))

    def _cut(self, first: int, last: int, region: str) -> None:
        """Put several leaves in place of ``first`` to ``last``, so that no edit meets a long one (but
        where a text has no sure end). The sums are made anew; leaves that edits have emptied go."""
        sizes, counts, at = leaf_lengths(region, self.leaf_chars), [], 0
        for n in sizes:
            counts.append(len(self.codec.encode(region[at:at + n])))
            at += n
        chars, tokens = (t.heap[t.cap:] for t in (self.chars, self.tokens))
        held = chars > 0
        left, right = np.flatnonzero(held[:first]), np.flatnonzero(held[last + 1:]) + last + 1
        self.chars = SegmentTree.of(np.concatenate([chars[left], sizes, chars[right]]))
        self.tokens = SegmentTree.of(np.concatenate([tokens[left], counts, tokens[right]]))


def _run(df: DataFrame, ranks: bytes, pattern: str, keep: list[str], new: list[tuple[str, str, pa.DataType]], text: str, row) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [n for n, _, _ in new]
    keep = [c for c in keep if c not in names]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` {t}" for n, t, _ in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern, LEAF)
        for b in slices(batches, text):
            got = list(zip(*[row(codec, r) for r in b.to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(v, k) for v, (_, _, k) in zip(got, new)],
                [*keep, *names])

    return df.mapInArrow(run, schema)


def build_trees(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` plus ``n_tokens`` and the trees ``char_sums`` and ``token_sums`` (heap order).

    A null or empty text counts 0. Rows are independent: repeated rows and null ids stay."""
    def row(codec: Codec, r: dict) -> tuple:
        t = CountedText.of(r[text] or "", codec, leaf_chars)
        return t.tokens.total, t.chars.heap, t.tokens.heap

    sums = pa.list_(pa.int64())
    return _run(docs, ranks, pattern, docs.columns, [
        ("n_tokens", "long", pa.int64()), ("char_sums", "array<long>", sums), ("token_sums", "array<long>", sums)], text, row)


def apply_edits(trees: DataFrame, ranks: bytes, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """``trees`` after the row's ``edits``, an array of (start, stop, put) that are applied
    in turn, each to the text as the one before left it: new ``text``, trees and ``n_tokens``,
    plus ``n_tokens_before`` and ``n_chars_encoded`` (characters that were encoded anew).

    Null edits, or a null field in one, change nothing. A null text that is edited counts as
    empty. Bounds outside the text are cut to it."""
    def row(codec: Codec, r: dict) -> tuple:
        t = CountedText(r[text] or "", SegmentTree(np.array(r["char_sums"])), SegmentTree(np.array(r["token_sums"])), codec)
        for e in r[edits] or []:
            if e is not None and None not in e.values():
                t.edit(**e)
        return t.text if t.encoded else r[text], t.tokens.total, r["n_tokens"], t.encoded, t.chars.heap, t.tokens.heap

    sums = pa.list_(pa.int64())
    return _run(trees, ranks, pattern, [c for c in trees.columns if c != edits], [
        (text, "string", pa.string()), ("n_tokens", "long", pa.int64()), ("n_tokens_before", "long", pa.int64()),
        ("n_chars_encoded", "long", pa.int64()), ("char_sums", "array<long>", sums), ("token_sums", "array<long>", sums)], text, row)


def with_edits(trees: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``trees`` with the rows (key, seq, start, stop, put) of ``edits`` as an array in order of
    ``seq``. The edits of one call go to the task that holds their document; a long log is
    applied in several calls."""
    e = edits.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "put"))).alias("__edits"))
    j = trees.join(e, trees[key] == e["__key"], "left")
    return j.withColumn("edits", F.transform("__edits", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["put"].alias("put")))).drop("__edits", "__key")


def sample_edits(key: str = "doc_id", text: str = "text"):
    """Three edits that follow from a row: a cut of 9 characters, a replaced stretch of 5, and an
    insertion, at places given by the id's hash."""
    n = F.coalesce(F.length(text), F.lit(0)) + 1
    h = F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0))

    def one(salt: int, width: int, put) -> F.Column:
        at = F.pmod(h * salt, n).cast("long")
        return F.struct(at.alias("start"), (at + width).alias("stop"), put.alias("put"))

    return F.array(one(1, 9, F.lit("")), one(7, 5, F.concat(F.lit(" re'written "), F.col(key).cast("string"))), one(31, 0, F.lit("\n  in'sert")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits to each."""
    import public_tokenizers
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = build_trees(docs, ranks, public_tokenizers.PATTERN).withColumn("edits", sample_edits())
    done = apply_edits(trees, ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens_before", "n_tokens", "n_chars_encoded", F.sha2("text", 256).alias("text_sha256"))
