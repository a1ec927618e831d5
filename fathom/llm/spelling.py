"""Operator 11, grouping spelling variants of the words of a corpus.

Two words are near if one code point is inserted, deleted or replaced. Every prefix of a word is a
node of the trie of all words, every suffix one of the trie of the reversed words, and a node has
a number. A word with position i skipped is the pair (node of what is before i, node of what is
behind); a word as it stands is such a pair at every place between its letters. Words that share a
skipped pair differ by a replacement there; a skipped pair that equals another word's plain pair is
a deletion. A pair holds one plain word and one skipped word a letter at most, so its group is
bounded by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import mix64, read_table, slices, stage
from fathom.llm.crc_sql import crc32, utf8
from fathom.operators.sequence import with_row_index

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, DAMAGE = 5, 3, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts with their counts over the corpus.

    Of every ``damage``-th (document, run), by crc32, one code point is deleted (None: no run is
    changed). Null text: no runs; null id: the empty string in the hash. Counts are summed within
    tasks first."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if damage:
        h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
        at = (h % F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(h % damage == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _tries(b: pa.RecordBatch, seed: int):
    """(row of each letter, place in its word, letter, nodes of prefixes, nodes of suffixes): the
    nodes of a word of n letters are n + 1 numbers from ``at[row]`` on, by the prefix's end and the
    suffix's start."""
    words = b.column("word").to_pylist()
    size = np.array([len(w) for w in words], dtype=np.int64)
    c = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    i = np.arange(len(c)) - start[row]
    letter = mix64(c + np.uint64(seed))
    odd = _odd(int(size.max(initial=0)), seed)
    at = start + np.arange(len(words))
    nodes = []
    for place, own in ((i, start), (size[row] - 1 - i, start)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(letter * odd[place], dtype=np.uint64)])
        full = np.repeat(np.arange(len(words)), size + 1)
        j = np.arange(len(c) + len(words)) - at[full]
        upto = total[start[full] + j] - total[start[full]]
        nodes.append(upto if place is i else total[start[full] + size[full]] - total[start[full]] - upto)
    return size, row, i, c, at, mix64(nodes[0]).astype(np.int64), mix64(nodes[1]).astype(np.int64)


def number_nodes(words: DataFrame) -> int:
    """A seed by which no two nodes of the tries of ``words`` (word) get one number.

    A node's number is a hash of its letters. All edges (node, parent, letter, depth) are grouped by
    node: if each node has one parent, letter and depth, then by induction from the root it stands
    for one prefix, and the numbering is exact. Else the next seed is tried."""
    for seed in count(1):
        def edges(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "word", 1 << 18):
                size, row, i, c, at, prefix, suffix = _tries(b, seed)
                here = at[row] + i
                for side, node, parent, depth in ((0, prefix[here + 1], prefix[here], i + 1), (1, suffix[here], suffix[here + 1], size[row] - i)):
                    e = np.unique(np.stack([node, parent, c.astype(np.int64), depth]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(e.shape[1], side)), *map(pa.array, e)], names=["side", "node", "parent", "c", "depth"])

        e = words.select("word").mapInArrow(edges, "side long, node long, parent long, c long, depth long")
        own = F.struct("parent", "c", "depth")
        if e.groupBy("side", "node").agg(F.min(own).alias("a"), F.max(own).alias("b")).filter("a != b").isEmpty():
            return seed


#: How a pair stands in a word: as it is, or with one letter skipped; the first of equal letters in a row stands for all.
PLAIN, SKIPPED, SKIPPED_FIRST = 0, 1, 2


def pairs(words: DataFrame, seed: int) -> DataFrame:
    """(p, s, kind, id, n): the pairs of trie nodes of every word."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "word", 1 << 18):
            size, row, i, c, at, prefix, suffix = _tries(b, seed)
            here = at[row] + i
            full = np.repeat(np.arange(b.num_rows), size + 1)
            first = (i == 0) | (c != np.r_[c[:1], c[:-1]])
            p, s = np.r_[prefix, prefix[here]], np.r_[suffix, suffix[here + 1]]
            kind = np.r_[np.full(len(full), PLAIN), np.where(first, SKIPPED_FIRST, SKIPPED)]
            take = pa.array(np.r_[full, row])
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), pa.array(kind), b.column("id").take(take), b.column("n").take(take)],
                                             names=["p", "s", "kind", "id", "n"])

    return words.mapInArrow(emit, "p long, s long, kind long, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) for the words (id, word, n) that have near words: how many, and the one of
    largest n (ties: least id) as (n, -id).

    A group of a pair is summed up without pairing its words: a skipped word's neighbours there
    are the other skipped ones and, counted at the first of equal letters only, the plain one."""
    w = Window.partitionBy("p", "s")
    me = F.struct("n", (-F.col("id")).alias("m"))
    skipped, plain = F.col("kind") > PLAIN, F.col("kind") == PLAIN
    first = F.col("kind") == SKIPPED_FIRST
    g = pairs(words, number_nodes(words)).withColumns({
        "skips": F.count(F.when(skipped, 1)).over(w), "firsts": F.count(F.when(first, 1)).over(w),
        "whole": F.max(F.when(plain, me)).over(w), "top": F.max(F.when(skipped, me)).over(w), "top_first": F.max(F.when(first, me)).over(w)})
    g = g.withColumn("next", F.max(F.when(skipped & (me != F.col("top")), me)).over(w))
    near = F.when(plain, F.col("firsts")).otherwise(F.col("skips") - 1 + (first & F.col("whole").isNotNull()).cast("long"))
    best = F.when(plain, F.col("top_first")).otherwise(F.greatest(
        F.when(me == F.col("top"), F.col("next")).otherwise(F.col("top")), F.when(first, F.col("whole"))))
    return g.select("id", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) for every (id, form): the last word reached by following forms; ids without one
    are their own root. Each round doubles the steps; only words on their way are joined."""
    t = stage(links.select("id", F.coalesce("form", "id").alias("root"), F.col("form").isNotNull().alias("open")))
    while not t.filter("open").isEmpty():
        on = t.select(F.col("id").alias("root"), F.col("root").alias("then"), F.col("open").alias("more"))
        t = stage(t.filter("open").join(on, "root").select("id", F.col("then").alias("root"), F.col("more").alias("open")).unionByName(t.filter("not open")))
    return t.select("id", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, damage: int | None = DAMAGE, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus.

    ``form``: the near word of largest n (ties: first in code-point order) if its n is at least
    ``ratio`` times the word's, else null; ``root``: the end of the chain of forms. Words are
    numbered in code-point order. Null and empty texts have no words; repeated rows count again;
    no words, no rows. A word of any length is O(length) in time and memory."""
    found = stage(count_words(docs, doc_id, text, least_length, least_count, damage))
    words = stage(with_row_index(found, ["word"], "id"))
    near = stage(neighbours(words))
    formed = words.join(near, "id", "left").withColumn("has", F.col("best.n") >= ratio * F.col("n"))
    formed = stage(formed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                 F.when(F.col("has"), -F.col("best.m")).alias("form"), F.when(F.col("has"), F.col("best.n")).alias("form_n")))
    name = words.select(F.col("id").alias("__id"), F.col("word").alias("__word"))
    out = formed.join(roots(formed), "id")
    out = out.join(name, out["root"] == name["__id"]).select(*formed.columns, F.col("__word").alias("root"))
    out = out.join(name, out["form"] == name["__id"], "left")
    return out.select("word", F.col("__word").alias("form"), "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY ALL),
h AS (SELECT *, {crc32(utf8("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
skips AS MATERIALIZED (SELECT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT s.word, w.word AS other FROM skips s JOIN words w ON w.word = s.a || s.b),
near AS (SELECT x.word, y.word AS other FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT word, other FROM shorter UNION SELECT other, word FROM shorter),
best AS (SELECT near.word, count(*) AS n_near, min({{'m': -w.n, 'w': near.other}}) AS top FROM near JOIN words w ON w.word = near.other GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 2 * words.n THEN top.w END AS form,
         CASE WHEN -top.m >= 2 * words.n THEN -top.m END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, cur, depth) AS (SELECT word, word, 0 FROM formed
  UNION ALL SELECT chain.word, formed.form, depth + 1 FROM chain JOIN formed ON formed.word = chain.cur WHERE formed.form IS NOT NULL),
ends AS (SELECT word, arg_max(cur, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""
