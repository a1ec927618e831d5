"""Operator 7, n-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct word n-grams. In one global order of all
n-grams, two sets with a Jaccard similarity of ``threshold`` share an n-gram among the first
n - ceil(threshold * n) + 1 of each: its prefix. Documents with equal prefix and size are
one group, and groups are matched, not documents:

1. order: n-grams of hash cells that hold frequent ones come last, so that passages that many
   documents share seldom are in a prefix. Any order gives the same links; this one keeps the
   lists of a prefix n-gram short;
2. group pairs that share a prefix n-gram are filtered by size and by place in the prefix;
3. they are expanded to their members. Pairs whose outlines (how many n-grams a set has in each
   of 128 hash parts) leave no room for enough shared ones go; the others are verified on whole sets.

Links are wanted for their components, so a list is first matched against one group of it
only (its pivot). What those links join need not be matched again; after that every pair of
groups of one list that is still in different components is verified as well. Nothing is
skipped: two documents that link either share a component by then or are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import (
    components, drop_table, gives_back, mix64, null_safe, read_table, slices, split_words, stage, stage_table, window_hashes, word_hashes)

SHINGLE, PERCENT = 5, 80
#: N-grams are counted in CELLS hash cells; a cell over its fair share by FREQUENT documents (and two
#: deviations of chance) counts as frequent. The odd cell that is over by chance does no harm.
CELLS, FREQUENT = 1 << 20, 16
#: Bytes of text that a task makes sets of at once: its arrays are many times as large.
SLICE = 1 << 19
#: Up to so many documents to look up are sent to all tasks (16 bytes each).
BROADCAST_ROWS = 1 << 20


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; the whole text is one if it is shorter."""
    off, words = split_words(texts, lower=True)
    h = word_hashes(words)
    grams = window_hashes(h, k)
    out = []
    for a, b in zip(off[:-1], off[1:]):
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(window_hashes(h[a:b], int(b - a), seed=100 + int(b - a)))
    return out


def _sets(df: DataFrame, text: str, k: int, row, schema: str, kinds: list[tuple[str, pa.DataType]], keep: list[str]) -> DataFrame:
    """``keep`` columns plus what ``row`` makes of each text's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, SLICE):
            got = [row(s) for s in shingle_sets(b.column(b.schema.get_field_index(text)), k)]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(v, t) for v, (_, t) in zip(zip(*got), kinds)],
                [*keep, *[n for n, _ in kinds]])

    return df.mapInArrow(gives_back(run), schema)


def frequent_cells(docs: DataFrame, text: str, k: int, frequent: int, cells: int) -> np.ndarray:
    """Which hash cells hold frequent n-grams (one flag a cell), counted over all documents. A
    task adds up its n-grams in one array, so what is shuffled doesn't depend on their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, dtype=np.int64)
        for b in slices(batches, text, SLICE):
            for s in shingle_sets(b.column(0), k):
                np.add.at(sums, (s % np.uint64(cells)).astype(np.int64), 1)
        used = np.flatnonzero(sums)
        for i in range(0, len(used), 1 << 16):
            part = used[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[part])], ["cell", "c"])

    counts = stage(docs.select(text).mapInArrow(gives_back(run), "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")))
    mean = (counts.agg(F.sum("c")).first()[0] or 0) / cells
    over = counts.filter(F.col("c") >= mean + max(frequent, 2 * mean ** 0.5)).select("cell").toArrow()
    flags = np.zeros(cells, dtype=bool)
    flags[np.asarray(over["cell"])] = True
    return flags


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent * n / 100) + 1 of ``s`` in the order: others, then those of
    frequent cells, by hash within each."""
    need = len(s) + (-percent * len(s) // 100) + 1
    often = frequent[(s % np.uint64(len(frequent))).astype(np.int64)]
    return np.concatenate([s[~often], s[often]])[:need]


def _node(s: np.ndarray) -> int:
    """A number for the set: order plays no part."""
    both = np.sum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True, dtype=np.uint64) + np.uint64(len(s))
    return int(mix64(both).view(np.int64)[0])


PARTS = 128


def _outline(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(20) & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)


def prefixes(keyed: DataFrame, text: str, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, th, n, node, gid, prefix, outline): ``node`` names the set, ``gid`` its size and prefix."""
    shared = keyed.sparkSession.sparkContext.broadcast(frequent)  # one byte a cell

    def row(s: np.ndarray) -> tuple:
        p = prefix(s, shared.value, percent) if len(s) else s
        place = np.arange(1, len(p) + 1, dtype=np.uint64)
        gid = mix64(np.sum(mix64(p + place), keepdims=True, dtype=np.uint64) + np.uint64(len(s)))
        return len(s), _node(s), int(gid.view(np.int64)[0]), p.view(np.int64), _outline(s)

    return _sets(keyed, text, k, row, "doc_id long, th long, n int, node long, gid long, prefix array<long>, outline array<int>",
                 [("n", pa.int32()), ("node", pa.int64()), ("gid", pa.int64()), ("prefix", pa.list_(pa.int64())),
                  ("outline", pa.list_(pa.int32()))], ["doc_id", "th"])


def _may_link(a: str, b: str, percent: int) -> str:
    """Size filter, and what two sets can share from a common prefix n-gram on."""
    return (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
            f"{100 + percent} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {percent} * ({a}.n + {b}.n)")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets link."""
    a = sets.select(F.col("node").alias("u"), F.col("s").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return stage(pairs.join(a, "u").join(b, "v").filter(
        (100 + percent) * both >= percent * (F.size("su") + F.size("sv"))).select("u", "v"))


def _looked_up(keyed: DataFrame, members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(node, s): whole sets of the nodes in ``pairs``, each from one of its documents. (Rows alike in
    id and text give a set twice; a link that is found twice is one link.)"""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(members, "node").select(
        F.col("r.doc_id").alias("rid"), F.col("r.th").alias("rth")).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else the texts are shuffled to them
        wanted = F.broadcast(wanted)
    texts = keyed.join(wanted, null_safe(keyed, wanted, {"doc_id": "rid", "th": "rth"})).select("t")
    return stage(_sets(texts, "t", k, lambda s: (_node(s), s.view(np.int64)), "node long, s array<long>",
                       [("node", pa.int64()), ("s", pa.list_(pa.int64()))], []))


def _with_room(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose outlines allow a link: sets share at most the lesser count of each part."""
    m = members.select("node", "n", "outline").dropDuplicates(["node"])
    a = m.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("outline").alias("ou"))
    b = m.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("outline").alias("ov"))
    shared = F.aggregate(F.zip_with("ou", "ov", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return pairs.join(a, "u").join(b, "v").filter((100 + percent) * shared >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def pivot_pairs(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Node pairs of every group with the pivot of each list and size class it is in, and of
    every member with its group's. Classes span a size ratio of 100 / percent, and there are two
    sets of them, half a class apart, so that sizes that can link share one. The pivot is where the
    n-gram stands first: of edited copies the least edited, as what is rare comes first."""
    step = F.floor(F.log("n") * (2 / np.log(100 / percent)))
    sized = lists.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.floor(step / 2).alias("c")), F.struct(F.lit(1).alias("k"), F.floor((step + 1) / 2).alias("c")))).alias("x"))
    sized = sized.select("token", "gid", "n", "pos", "x.k", "x.c")
    pivot = sized.groupBy("token", "k", "c").agg(
        F.min(F.struct("pos", "gid", "n")).alias("p"), F.min("gid").alias("lo"), F.max("gid").alias("hi")).filter(
        "lo <> hi").select("token", "k", "c", "p.*").alias("p")
    near = sized.alias("a").join(pivot, ["token", "k", "c"]).filter(_may_link("a", "p", percent)).select(
        F.col("a.gid").alias("g"), F.col("p.gid").alias("pg")).filter("g <> pg").distinct()
    first = members.groupBy("gid").agg(F.min("node").alias("node"))
    out = near.join(first.select(F.col("gid").alias("g"), F.col("node").alias("u")), "g").join(
        first.select(F.col("gid").alias("pg"), F.col("node").alias("v")), "pg").select("u", "v")
    inside = members.join(first.withColumnRenamed("node", "v"), "gid").select(F.col("node").alias("u"), "v")
    return _ordered(out.unionByName(inside))


def open_pairs(lists: DataFrame, members: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All node pairs that may link and are in different components: of groups that share a
    list, or of one group. In a list, the groups outside its largest component meet all others."""
    placed = stage(members.join(comp, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("comp")))
    parts = placed.select("gid", "comp").distinct()
    rows = lists.join(parts, "gid")
    main = rows.groupBy("token", "comp").count().groupBy("token").agg(
        F.max(F.struct("count", "comp")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    rows = stage(rows.join(main.select("token", F.col("top.comp").alias("main")), "token"))
    few, many = rows.filter("comp <> main").alias("a"), rows.alias("b")
    pairs = few.join(many, F.expr("a.token = b.token and a.comp <> b.comp and a.gid <> b.gid and "
                                  "(b.comp = b.main or (a.comp, a.gid) < (b.comp, b.gid)) and " + _may_link("a", "b", percent))).select(
        F.col("a.gid").alias("g"), F.col("a.comp").alias("gc"), F.col("b.gid").alias("h"), F.col("b.comp").alias("hc")).distinct()
    inside = parts.alias("a").join(parts.alias("b"), F.expr("a.gid = b.gid and a.comp < b.comp")).select(
        F.col("a.gid").alias("g"), F.col("a.comp").alias("gc"), F.col("b.gid").alias("h"), F.col("b.comp").alias("hc"))
    a = placed.select(F.col("gid").alias("g"), F.col("comp").alias("gc"), F.col("node").alias("u"))
    b = placed.select(F.col("gid").alias("h"), F.col("comp").alias("hc"), F.col("node").alias("v"))
    return _ordered(pairs.unionByName(inside).join(a, ["g", "gc"]).join(b, ["h", "hc"]).select("u", "v"))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                          percent: int = PERCENT, frequent: int = FREQUENT,
                          cells: int = CELLS) -> DataFrame:
    """(doc_id, th, n_shingles, node, component, component_id), one row per row of ``docs``.

    Two documents link if 100 * shared >= ``percent`` * united distinct n-grams of their words,
    A-Z in lower case. ``component`` names the documents linked with each other, directly or
    not (``node`` if there are none), and ``component_id`` is the least doc_id among them. A
    null or empty text has no n-grams, no links and null ``component``. Equal sets are one
    node. Null ids are kept; a component of null ids alone has a null ``component_id``."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    often = frequent_cells(keyed, "t", shingle, frequent, cells)
    p = stage_table(prefixes(keyed, "t", shingle, percent, often))
    # lists: prefix n-grams that two groups or more share
    shared = stage(p.select("gid", F.explode("prefix").alias("token")).groupBy("token").agg(
        F.min("gid").alias("lo"), F.max("gid").alias("hi")).filter("lo <> hi").select("token"))
    lists = stage(p.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).join(shared, "token").distinct())
    nodes = p.filter("n > 0").groupBy("gid", "node").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    several = nodes.groupBy("gid").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("gid")
    members = stage(nodes.join(lists.select("gid").unionByName(several).distinct(), "gid"))
    drawn = p.select(F.col("node"), F.col("doc_id").alias("rid"), F.col("th").alias("rth"), "n", "outline")
    one = members.select(F.col("node").alias("node1"), "r", "gid")
    members = stage_table(drawn.join(one, (drawn["node"] == one["node1"]) & drawn["rid"].eqNullSafe(one["r.doc_id"]) & (
        drawn["rth"] == one["r.th"])).select("gid", "node", "r", "n", "outline").dropDuplicates(["node"]))
    rows = stage(p.select("doc_id", "th", "n", "node"))
    drop_table(p)
    p = rows
    pairs = stage(_with_room(pivot_pairs(lists, members.select("gid", "node"), percent), members, percent))
    links = _verified(pairs, _looked_up(keyed, members, pairs, shingle), percent)
    pairs = stage(_with_room(open_pairs(lists, members.select("gid", "node"), components(links), percent), members, percent))
    more = _verified(pairs, _looked_up(keyed, members, pairs, shingle), percent)
    drop_table(members)
    comp = components(links.unionByName(more))
    named = p.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(comp, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "least")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("least")
    out = p.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return out.join(named, "node", "left").select(
        "doc_id", "th", "n_shingles", "node", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
            F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one of least id stays (of
    rows with that id, the one whose text hashes least). Documents without n-grams all stay."""
    g = near_duplicate_groups(docs, doc_id, text, **how)
    # written by itself: one plan for this and the documents keeps much more in the driver at once
    stay = stage(g.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))).alias("r")).filter(
        "component is not null").select(F.col("r.doc_id").alias("__id"), F.col("r.th").alias("__h")))
    keyed = docs.withColumns({"__id0": F.col(doc_id).cast("long"), "__th0": F.xxhash64(text)})
    kept = keyed.join(stay, null_safe(keyed, stay, {"__id0": "__id", "__th0": "__h"})).dropDuplicates(["__id0", "__th0"]).select(*docs.columns)
    bare = docs.filter(~F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return kept.unionByName(bare)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(v) FROM r WHERE r.u = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""
