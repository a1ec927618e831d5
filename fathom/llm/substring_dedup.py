"""Operator 9, substring dedup: words covered by a long word window that occurs elsewhere.

A de Bruijn graph of word windows, built in compacted form. The edges are the windows of
``window`` words. Consecutive windows of a document that share a minimizer (the least hash
of an ``anchor``-word stretch inside) make a stretch: a path of edges that is cut out the
same way wherever its words stand. So

1. a window can only occur twice if its minimizer does: minimizers are counted, and
   stretches with a unique one are done;
2. a minimizer whose stretches are all equal has only repeated windows; for the others the
   windows of each distinct stretch are counted one by one;
3. repeated stretches are nodes of the compacted graph; where one has a single successor
   and that has a single predecessor they join into one path, found by joining degrees;
4. paths go back to their source coordinates, one span a document and path, and the words
   under the spans are removed.

Hashes have 64 bits each; a window counts as repeated on equal (minimizer, window) hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import (
    drop_table, mix64, read_table, slices, split_words, stage, stage_table, window_hashes, word_hashes)

WINDOW, ANCHOR = 35, 8
LOW32 = np.uint64(0xFFFFFFFF)


def _minimizers(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: place of its minimizer (leftmost of equals), and all anchor hashes."""
    g = window_hashes(h, anchor, seed=2)
    key = (g & ~LOW32) | np.arange(len(g), dtype=np.uint64)
    span, have = window - anchor + 1, 1
    while have < span:  # least of ``have`` consecutive keys, doubled until it spans the window
        step = min(have, span - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return (key & LOW32).astype(np.int64), g


def stretches(words: pa.Array, off: np.ndarray, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Stretches of all rows: row, start (word within the row), n windows, hashes of minimizer and content."""
    h = word_hashes(words)
    none = {k: np.empty(0, dtype=np.int64) for k in ("row", "start", "n", "m", "sk", "at")}
    if len(h) < window:
        return none | {"e": np.empty(0, dtype=np.uint64)}
    e = window_hashes(h, window, seed=3)
    place, g = _minimizers(h, window, anchor)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(e)]
    at = np.flatnonzero(np.arange(len(e)) + window <= off[1:][row])  # windows within one row
    if not len(at):
        return none | {"e": e}
    new = np.r_[True, (place[at][1:] != place[at][:-1]) | (row[at][1:] != row[at][:-1])]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(at)])
    i = at[first]
    sk = mix64(e[i] * np.uint64(0x9E3779B97F4A7C15) + e[i + n - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64))
    return {"row": row[i], "start": i - off[row[i]], "n": n, "m": g[place[i]].view(np.int64), "sk": sk.view(np.int64), "at": i, "e": e}


def find_stretches(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(m, sk, kid, th, start, n) of all stretches of all ``texts``, rows (kid, th, t)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            off, words = split_words(b.column(2))
            s = stretches(words, off, window, anchor)
            row = pa.array(s["row"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(s["m"]), pa.array(s["sk"]), b.column(0).take(row), b.column(1).take(row),
                 pa.array(s["start"].astype(np.int32)), pa.array(s["n"].astype(np.int32))], ["m", "sk", "kid", "th", "start", "n"])

    return texts.mapInArrow(
        run, "m long, sk long, kid long, th long, start int, n int")


def repeated_windows(texts: DataFrame, seen: DataFrame, window: int, anchor: int) -> DataFrame:
    """(m, sk, mask), staged: for stretches whose minimizer has several, bit i of ``mask`` tells that
    window i occurs twice or more. One copy of each distinct stretch is looked up and counts
    as often as the stretch occurs."""
    rep = seen.groupBy("m", "sk", "n").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("kid", "th", "start")).alias("r"))
    wanted = rep.groupBy(F.col("r.kid").alias("kid"), F.col("r.th").alias("th")).agg(
        F.collect_list(F.struct("m", "sk", "r.start", "n", "c")).alias("want"))
    looked_up = texts.join(wanted, ["kid", "th"]).select("t", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            off, words = split_words(b.column(0))
            e = window_hashes(word_hashes(words), window, seed=3)
            want, row = pc.list_flatten(b.column(1)), np.asarray(pc.list_parent_indices(b.column(1)))
            m, sk, start, n, c = (np.asarray(want.field(i)) for i in range(5))
            k = np.repeat(np.arange(len(m)), n)
            bit = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[k]), pa.array(sk[k]), pa.array(bit.astype(np.int32)), pa.array(c[k]),
                 pa.array(e[off[row[k]] + start[k] + bit].view(np.int64))], ["m", "sk", "bit", "c", "e"])

    # rows alike in id and text share a key and are all looked up; their windows do occur twice
    w = stage_table(looked_up.mapInArrow(run, "m long, sk long, bit int, c long, e long"))
    twice = stage(w.groupBy("m", "e").agg(F.sum("c").alias("c")).filter("c > 1").select("m", "e"))
    masks = stage_table(w.join(twice, ["m", "e"]).groupBy("m", "sk").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    drop_table(w)
    return masks


def compact(found: DataFrame, window: int) -> DataFrame:
    """Spans (kid, th, start, stop) of wholly repeated stretches, joined along nonbranching paths.

    Degrees come from all places where a stretch is followed by another one at once. A span
    starts where the step into a stretch branches, on either side, or isn't there."""
    doc = Window.partitionBy("kid", "th").orderBy("start")
    s = found.withColumns({"to": F.lead("sk").over(doc), "to_start": F.lead("start").over(doc)})
    s = s.withColumn("to", F.when(F.col("to_start") == F.col("start") + F.col("n"), F.col("to"))).drop("to_start")
    steps = s.filter("to is not null")
    out = steps.groupBy(F.col("sk").alias("a")).agg(F.min("to").alias("lo"), F.max("to").alias("hi")).filter("lo = hi").select("a")
    into = steps.groupBy(F.col("to").alias("b")).agg(F.min("sk").alias("lo"), F.max("sk").alias("hi")).filter("lo = hi").select("b")
    plain = steps.select("sk", "to").distinct().join(out, F.col("sk") == F.col("a")).join(into, F.col("to") == F.col("b")).select(
        F.col("sk").alias("a"), F.lit(True).alias("goes_on"))
    s = s.join(plain, s["sk"] == plain["a"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)) & F.col("to").isNotNull())
    head = ~F.coalesce(F.lag("goes_on").over(doc), F.lit(False))
    s = s.withColumn("run", F.sum(head.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("kid", "th", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n") - 1 + window).alias("stop")).drop("run")


def repeated_spans(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(kid, th, start, stop), staged: word spans all of whose windows occur elsewhere as well."""
    every = find_stretches(texts, window, anchor)
    twice = every.groupBy("m").agg(F.count(F.lit(1)).alias("c"), (F.min("sk") == F.max("sk")).alias("alone")).filter("c > 1")
    # staged, so that the join reads plain shuffles, whose hot minimizers Spark can split
    seen = stage_table(every.join(stage(twice.select("m", "alone")), "m"))
    masks = repeated_windows(texts, seen.filter("not alone"), window, anchor)
    some = seen.filter("not alone").join(masks, ["m", "sk"])
    full = F.expr("mask = shiftleft(1L, n) - 1")
    whole = seen.filter("alone").select("kid", "th", "start", "n", "sk").unionByName(
        some.filter(full).select("kid", "th", "start", "n", "sk")).distinct()
    bits = F.expr("filter(sequence(0, n - 1), i -> (mask & shiftleft(1L, i)) <> 0)")
    parts = some.filter(~full).select("kid", "th", "start", F.explode(bits).alias("i")).select(
        "kid", "th", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + window).alias("stop"))
    spans = stage(compact(whole, window).unionByName(parts))
    drop_table(seen, masks)
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_words``, ``n_removed``, ``kept`` (the kept words
    joined by one space) and ``removed`` (the word spans taken out, as (start, stop) in order).

    A word goes if some ``window`` of consecutive words over it starts anywhere else as well.
    Texts shorter than a window lose nothing; a null text has no words and an empty ``kept``.
    Rows that repeat a text repeat its windows, whatever their ids; null ids are ids."""
    if not 0 < window - anchor < 62:
        raise ValueError("a stretch must have fewer than 63 windows")
    # rows alike in the key, two 64-bit hashes of id and text, get alike results (a null text has the
    # words of an empty one, and hashes that skip nulls could take it for another's id)
    key = {k: F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit(""))) for k, seed in (("__kid", 1), ("__th", 2))}
    texts = docs.select(key["__kid"].alias("kid"), key["__th"].alias("th"), F.col(text).alias("t"))
    spans = repeated_spans(texts, window, anchor)
    lists = spans.groupBy(F.col("kid").alias("__kid"), F.col("th").alias("__th")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__spans"))
    own = [f for f in docs.schema if f.name not in ("n_words", "n_removed", "kept", "removed")]
    rows = docs.withColumns(key).join(lists, ["__kid", "__th"], "left").select(
        *[f.name for f in own], F.col(text).alias("__t"), "__spans")
    names = [f.name for f in own]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__t"):
            off, words = split_words(b.column(len(names)))
            edge = np.zeros(len(words) + 1, dtype=np.int64)  # +1 where a span starts, -1 where one stops
            s, row = pc.list_flatten(b.column(len(names) + 1)), np.asarray(pc.list_parent_indices(b.column(len(names) + 1)))
            np.add.at(edge, off[row] + np.asarray(s.field(0)), 1)
            np.add.at(edge, off[row] + np.asarray(s.field(1)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            before = np.r_[0, np.cumsum(~gone)][off]
            kept = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.filter(pa.array(~gone)))
            n = np.diff(off)
            # spans of the result: runs of removed words within a row
            start = np.zeros(len(words) + 1, dtype=bool)
            start[off] = True
            on = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | start[:-1])) if len(words) else np.empty(0, dtype=np.int64)
            stop = np.flatnonzero(gone & (np.r_[~gone[1:], True] | start[1:])) + 1 if len(words) else on
            at = np.searchsorted(off, on, side="right") - 1
            cut = np.searchsorted(at, np.arange(len(n) + 1))
            removed = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array((on - off[at]).astype(np.int32)), pa.array((stop - off[at]).astype(np.int32))], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(names))] + [pa.array(n), pa.array(n - np.diff(before)), pc.binary_join(
                    kept, pa.scalar(" ", pa.large_string())).cast(pa.string()), removed.cast(span)], [*names, "n_words", "n_removed", "kept", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return rows.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept string, removed array<struct<start:int,stop:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT g.rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM g JOIN d USING (rid)),
r AS (SELECT rid, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
c AS (SELECT rid, list(DISTINCT j) AS gone FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM r) GROUP BY rid),
o AS (SELECT doc_id, w, coalesce(gone, []) AS gone, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept
      FROM d LEFT JOIN c USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM o
"""
