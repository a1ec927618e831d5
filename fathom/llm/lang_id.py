"""Operator 10, language ID by prediction by partial matching over bytes.

Every language has a context tree: counts of the byte that follows each context of up to
``depth`` bytes. A byte that a context has seen c times of n, with q distinct bytes seen,
costs -log2(c / (n + q)); another costs the escape -log2(q / (n + q)) plus what the next
shorter context asks, down to the uniform 8 bits. Statistics are frozen after training, so
a text's code length under a language is an exact sum; the shortest wins.

The contexts of all languages share one tree, whose nodes hold the complete cost of each
byte in each language, escapes included. Scoring walks the tree for all bytes of a slice of
texts at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import gives_back, read_table, slices, stage

#: Bounds of the training sample and the model: documents per language, bytes of a document
#: that may be in it, tree nodes. Model size is nodes * bytes seen * (4 + 4 * languages).
DOCS_PER_LANG, DOC_BYTES, MAX_NODES = 400, 1 << 16, 4_000
DEPTH, MIN_COUNT = 4, 6
UND = "und"
#: Up to so many languages' counts are sent to all tasks.
BROADCAST_LANGS = 10_000
LETTER = regex.compile(r"\p{L}")
NO_LETTERS = r"([a-z0-9_]*[0-9_][a-z0-9_]*|[^\pL\pM])+"
#: Bytes of the pieces whose costs give the spread of a language's code length.
PIECE = 32


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context of ``order`` bytes, byte) keys and their counts; contexts stay within a text."""
    keys = []
    for t in texts:
        b = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
        n = len(b) - order
        if n > 0:
            k = np.zeros(n, dtype=np.uint64)
            for i in range(order + 1):
                k = (k << np.uint64(8)) | b[i:i + n]
            keys.append(k)
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


class ContextTrees:
    """Shared context tree with costs in bits: ``cost[node * symbols + symbol, language]``."""

    def __init__(self, langs: list[str], symbol: np.ndarray, child: np.ndarray, cost: np.ndarray, depth: int):
        self.langs, self.symbol, self.child, self.cost, self.depth = langs, symbol, child, cost, depth

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], depth: int = DEPTH, min_count: int = MIN_COUNT,
            max_nodes: int = MAX_NODES) -> "ContextTrees":
        langs = sorted(samples)
        grams = {(l, o): _grams(samples[l], o) for l in langs for o in range(depth + 1)}
        seen = np.unique(np.concatenate([grams[l, 0][0] for l in langs] or [np.empty(0, np.uint64)])).astype(np.int64)
        width = len(seen) + 1  # the last symbol: any byte not seen in training
        symbol = np.full(256, width - 1, dtype=np.int32)
        symbol[seen] = np.arange(len(seen))
        # contexts often enough seen in any language; a context's shorter ones are seen as often
        nodes, total = [np.zeros(1, np.uint64)], [np.array([np.iinfo(np.int64).max])]
        for o in range(1, depth + 1):
            ctx = np.concatenate([grams[l, o][0] >> np.uint64(8) for l in langs] or [np.empty(0, np.uint64)])
            c, at = np.unique(ctx, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([grams[l, o][1] for l in langs] or [[]]), minlength=len(c)).astype(np.int64)
            nodes.append(c[n >= min_count])
            total.append(n[n >= min_count])
        every = np.sort(np.concatenate(total))[::-1]
        floor = every[max_nodes] + 1 if len(every) > max_nodes else min_count
        nodes = [c[n >= floor] for c, n in zip(nodes, total)]
        base = np.cumsum([0] + [len(c) for c in nodes])
        child = np.full((base[-1], width), -1, dtype=np.int32)
        cost = np.full((base[-1], width, len(langs)), 8.0, dtype=np.float32)
        for o, c in enumerate(nodes):
            me = base[o] + np.arange(len(c))
            if o:  # a node's parent lacks its oldest byte
                short = c & np.uint64((1 << 8 * (o - 1)) - 1)
                at = np.searchsorted(nodes[o - 1], short)
                ok = (at < len(nodes[o - 1])) & (nodes[o - 1][np.minimum(at, max(len(nodes[o - 1]) - 1, 0))] == short)
                parent = np.where(ok, base[o - 1] + at, 0)
                child[parent[ok], symbol[(c >> np.uint64(8 * (o - 1))).astype(np.int64)][ok]] = me[ok]
                cost[me] = cost[parent]
            for j, l in enumerate(langs):
                k, n = grams[l, o]
                at = np.searchsorted(c, k >> np.uint64(8))
                ok = (at < len(c)) & (c[np.minimum(at, len(c) - 1)] == k >> np.uint64(8)) if len(c) else np.zeros(len(k), bool)
                counts = np.zeros((len(c), width))
                counts[at[ok], symbol[(k & np.uint64(255)).astype(np.int64)][ok]] = n[ok]
                sums, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = np.where(counts > 0, -np.log2(counts / (sums + kinds)), -np.log2(kinds / (sums + kinds)) + cost[me, :, j])
                cost[me, :, j] = np.where(sums > 0, own, cost[me, :, j])
        return cls(langs, symbol, child.reshape(-1), cost.reshape(-1, max(len(langs), 1)) if langs else cost.reshape(base[-1] * width, 0), depth)

    def byte_costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every byte of the texts ``data[offsets[i]:offsets[i + 1]]`` under every language."""
        width = int(self.symbol.max()) + 1
        sym = self.symbol[data]
        start = np.repeat(offsets[:-1], np.diff(offsets))
        past = np.arange(len(data)) - start
        node = np.zeros(len(data), dtype=np.int32)
        alive = np.flatnonzero(past >= 1)
        for d in range(1, self.depth + 1):
            nxt = self.child[node[alive] * width + sym[alive - d]]
            on = nxt >= 0
            alive = alive[on]
            node[alive] = nxt[on]
            alive = alive[past[alive] > d]
        return self.cost[node * width + sym]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text under every language."""
        bits = self.byte_costs(data, offsets)
        out = np.zeros((len(offsets) - 1, self.cost.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            out[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and offsets (n + 1); a null text has none."""
    t = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset:t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], dtype=np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def plain_letters(texts: pa.Array) -> pa.Array:
    """The letters of every text in lower case, one space for all between them. Runs of ASCII letters
    with a digit or ``_`` in them (keys, numbers, names in code) are left out."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), NO_LETTERS, " "), " ")


def letter_costs(trees: ContextTrees, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the letters of every text cost: bits, bytes, language that describes them best; and bits of
    all whole pieces. Each piece is described by the language that does it best, so that a text in two
    learned languages costs no more than texts in one."""
    data, off = flat_bytes(plain_letters(texts))
    n = np.diff(off)
    many = -(-n // PIECE)
    to = np.r_[0, np.cumsum(many)]
    start = np.repeat(off[:-1] - to[:-1] * PIECE, many) + np.arange(to[-1]) * PIECE
    bits, best = np.zeros(len(n)), np.zeros(len(n), dtype=np.int64)
    if not len(start) or not trees.langs:
        return bits, n, best, np.empty(0)
    cost = np.add.reduceat(trees.byte_costs(data, off), start, axis=0, dtype=np.float64)
    least, some = cost.min(axis=1), np.flatnonzero(n)
    bits[some] = np.add.reduceat(least, to[some])
    best[some] = np.add.reduceat(cost, to[some], axis=0).argmin(axis=1)
    return bits, n, best, least[np.diff(np.r_[start, len(data)]) == PIECE]


def letter_limits(samples: dict[str, list[bytes]], **tree) -> dict[str, tuple[float, float, float]]:
    """What letters cost in texts of each language: (mean bits a byte, variance of a byte, variance of a text).

    Each half of a language's distinct texts is scored by trees of the other halves, so that no
    text is described by itself. A language of one text gets the highest of the others' figures."""
    texts = {l: list(dict.fromkeys(v)) for l, v in samples.items()}
    texts = {l: v for l, v in texts.items() if len(v) > 1}
    trees = [ContextTrees.fit({l: v[1 - k::2] for l, v in texts.items()}, **tree) for k in (0, 1)]
    out = {}
    for l, v in texts.items():
        halves = [letter_costs(trees[k], pa.array([t.decode() for t in v[k::2]], pa.large_string())) for k in (0, 1)]
        c, n, _, piece = (np.concatenate(x) for x in zip(*halves))
        c, n = c[n > 0], n[n > 0]
        if len(piece):
            mean = c.sum() / n.sum()
            byte = np.mean((piece - PIECE * mean) ** 2) / PIECE
            # texts count alike, but for those so short that their bytes tell little of the text
            share = n / (n + 4 * PIECE)
            out[l] = (mean, byte, max(0.0, np.average((c / n - mean) ** 2 - byte / n, weights=share)))
    most = tuple(np.max(list(out.values()), axis=0)) if out else (np.inf, 1.0, 0.0)
    return {l: out.get(l, most) for l in samples}


def excess(trees: ContextTrees, limits: dict[str, tuple[float, float, float]], texts: pa.Array) -> np.ndarray:
    """By how many standard deviations, which shrink with the bytes, the letters of each text cost more than
    they do in the language that describes them best; 0 without letters or languages."""
    bits, n, best, _ = letter_costs(trees, texts)
    if not trees.langs:
        return bits
    mean, byte, text = np.array([limits[l] for l in trees.langs]).T[:, best]
    some = np.maximum(n, 1)
    return np.where(n > 0, (bits / some - mean) / np.sqrt(np.maximum(text + byte / some, 1e-9)), 0.0)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG,
           doc_bytes: int = DOC_BYTES) -> dict[str, list[bytes]]:
    """Texts to learn from: per language of ``docs`` the ``docs_per_lang`` rows of least hash that
    are not longer than ``doc_bytes``, so the driver sees at most their product a language.

    A language's count of rows sets the part of the hash range that is looked at: four times
    what is wanted is expected there, whatever the size of the input."""
    size = F.octet_length(text)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & size.between(1, doc_bytes)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit(10), F.col(order)), F.lit(1 << 32)).alias("h"), F.col(order).alias("o"))
    counts = stage(rows.groupBy("lang").agg((F.lit(4.0 * docs_per_lang * 2 ** 32) / F.count(F.lit(1))).alias("reach")))
    if counts.count() <= BROADCAST_LANGS:  # so that rows out of reach are not shuffled
        counts = F.broadcast(counts)
    rows = rows.join(counts, "lang").filter(F.col("h") < F.col("reach")).drop("reach")
    first = Window.partitionBy("lang").orderBy("h", "o", "text")
    got = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= docs_per_lang).select("lang", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for r in got:
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return samples


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG,
          doc_bytes: int = DOC_BYTES, **tree) -> ContextTrees:
    """Trees from a :func:`sample` of ``docs``."""
    return ContextTrees.fit(sample(docs, text, lang, order, docs_per_lang, doc_bytes), **tree)


def predict(docs: DataFrame, model: ContextTrees, text: str = "text",
            limits: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``bits_per_byte`` (columns of these names are replaced),
    and with ``limits`` (of :func:`letter_limits`) ``excess``, see there.

    ``score``: the weight 2**-bits of the best language among all. A null text, one without a
    letter, and every text if nothing was learned: ``und``, score 0, null bits. Ties go to the
    first language in code-point order. Whole texts count; rows are independent."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(
        (model.langs, model.symbol, model.child, model.cost, model.depth)))
    new = ["lang_pred", "score", "bits_per_byte"] + ["excess"] * (limits is not None)
    keep = [f for f in docs.schema if f.name not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["lang_pred string, score double, bits_per_byte double"]
                       + ["excess double"] * (limits is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = ContextTrees(*pickle.loads(shared.value))
        for b in slices(batches, text, 1 << 18):
            data, off = flat_bytes(b.column(b.schema.get_field_index(text)))
            bits = trees.code_lengths(data, off)
            letters = np.array([bool(v and LETTER.search(v)) for v in b.column(b.schema.get_field_index(text)).to_pylist()], dtype=bool)
            known = letters & bool(trees.langs)
            if trees.langs:
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                pred = np.array(trees.langs, dtype=object)[best]
                rate = low / np.maximum(np.diff(off), 1)
            else:
                pred, score, rate = np.full(len(bits), UND, dtype=object), np.zeros(len(bits)), np.zeros(len(bits))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(f.name)) for f in keep]
                + [pa.array(np.where(known, pred, UND), pa.string()), pa.array(np.where(known, score, 0.0)),
                   pa.array(rate, pa.float64(), mask=~known)]
                + ([pa.array(excess(trees, limits, b.column(b.schema.get_field_index(text))))] if limits is not None else []), [*[f.name for f in keep], *new])

    return docs.mapInArrow(gives_back(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out("doc_id")))
    return predict(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
