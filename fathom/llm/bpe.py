"""Operator 4, byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until a piece is short, each piece is encoded alone, and neighbours are
joined by encoding a window around the seam anew. The window grows until the tokens
outside it are known to stay:

* between pre-tokens: a place where a non-space is followed by a space or newline always
  ends a pre-token and the rest of the text is split without looking back, so a window
  between two such places changes nothing outside it;
* inside one long pre-token: a token sequence is the BPE encoding of its bytes if every two
  neighbours are what their joint bytes encode to, so the window may stop where the pairs
  at both its edges hold.

Spark deals the documents out; a task holds one slice of texts at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import gives_back, read_table, slices

LEAF = 8192


def tokenizer(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _ends_token(text: str, i: int) -> bool:
    return text[i] in " \n" and not text[i - 1].isspace()


def _last_seam(text: str, reach: int) -> int:
    """The last sure pre-token end among the last ``reach`` characters, else 0."""
    for i in range(len(text) - 1, max(len(text) - reach, 0), -1):
        if _ends_token(text, i):
            return i
    return 0


def _first_seam(text: str, reach: int) -> int:
    for i in range(1, min(reach, len(text))):
        if _ends_token(text, i):
            return i
    return len(text)


class Codec:
    """Encodes and decodes one text after another with a fixed rank table."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF):
        self.enc = tokenizer(ranks, pattern)
        self.split = regex.compile(pattern)
        self.leaf = leaf

    # inside one pre-token -------------------------------------------------------------
    def _pair(self, a: int, b: int) -> bool:
        joint = self.enc.decode_single_token_bytes(a) + self.enc.decode_single_token_bytes(b)
        return self.enc._encode_single_piece(joint) == [a, b]

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.enc._encode_single_piece(data)
        mid = len(data) // 2
        left, right = self.piece(data[:mid]), self.piece(data[mid:])
        k = 4
        while k < max(len(left), len(right)):
            a, b = max(len(left) - k, 0), min(k, len(right))
            seam = self.piece(self.enc.decode_bytes(left[a:] + right[:b]))
            if (not a or self._pair(left[a - 1], seam[0])) and (b == len(right) or self._pair(seam[-1], right[b])):
                return left[:a] + seam + right[b:]
            k *= 2
        return self.enc._encode_single_piece(data)

    # across pre-tokens ----------------------------------------------------------------
    def _window(self, text: str) -> list[int]:
        """A window's tokens; only a window without any sure end is long."""
        if len(text) <= self.leaf:
            return self.enc.encode_ordinary(text)
        return [t for p in self.split.findall(text) for t in self.piece(p.encode())]

    def join(self, lt: str, left: list[int], rt: str, right: list[int]) -> list[int]:
        """Encoding of ``lt + rt`` from the encodings of both."""
        reach = 64
        while True:
            a, b = _last_seam(lt, reach), _first_seam(rt, reach)
            if (a or reach >= len(lt)) and (b < len(rt) or reach >= len(rt)):
                break
            reach *= 4
        tail = len(self._window(lt[a:])) if a else len(left)
        head = len(self._window(rt[:b])) if b < len(rt) else len(right)
        return left[:len(left) - tail] + self._window(lt[a:] + rt[:b]) + right[head:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.enc.encode_ordinary(text)
        mid = len(text) // 2
        lt, rt = text[:mid], text[mid:]
        return self.join(lt, self.encode(lt), rt, self.encode(rt))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.enc.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


IDS = ("array<int>", pa.list_(pa.int32()))
BYTES = ("binary", pa.binary())


def _mapped(df: DataFrame, column: str, new: dict[str, tuple[str, pa.DataType]], ranks: bytes, pattern: str, leaf: int,
            work: Callable) -> DataFrame:
    """``df`` with the columns ``new``, the values that ``work`` makes of each value of ``column``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # the rank file: about 1 MB
    names = [c for c in df.columns if c not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in new]
                       + [f"`{c}` {t}" for c, (t, _) in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern, leaf)
        for b in slices(batches, column, 1 << 19):
            got = list(zip(*[work(codec, v.as_py()) for v in b.column(b.schema.get_field_index(column))]))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(v, t) for v, (_, t) in zip(got, new.values())],
                [*names, *new])

    return df.mapInArrow(gives_back(run), schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``df`` plus ``out``: the token ids of ``text`` (null text: none). A column named
    ``out`` that was there is replaced; all rows and other columns stay as they are."""
    return _mapped(df, text, {out: IDS}, ranks, pattern, leaf, lambda codec, v: (codec.encode(v or ""),))


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """``df`` plus ``out``: the bytes of the token ids (null ids: none)."""
    return _mapped(df, ids, {out: BYTES}, ranks, pattern, leaf, lambda codec, v: (codec.decode(v or []),))


def round_trip(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded",
               leaf: int = LEAF) -> DataFrame:
    """:func:`encode` and then :func:`decode` in one pass: ids are decoded where they were made."""
    def work(codec: Codec, v: str | None) -> tuple:
        tokens = codec.encode(v or "")
        return tokens, codec.decode(tokens)

    return _mapped(df, text, {ids: IDS, out: BYTES}, ranks, pattern, leaf, work)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digests(df: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode, and digest both."""
    both = round_trip(df, ranks, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                   read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
