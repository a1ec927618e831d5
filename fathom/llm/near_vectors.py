"""Operator 8, near-duplicate vectors: spherical k-means cells, blocked cosine products.

Centroids are fitted on a bounded sample; every vector has a home cell (its best centroid)
and is also compared in each cell whose centroid is within ``margin`` of that. Within a
cell, blocks of home vectors are multiplied with blocks of all its vectors, one pair of
blocks a task. A pair is found if either vector is compared in the other's home cell.
A task passes on sums and a spanning set of links, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import components, null_safe, read_table, stage
from fathom.operators.sequence import with_row_index

THRESHOLD = 0.95
#: Bounds of the k-means fit: sampled vectors, cells; vectors a cell aims at; cosine margin.
SAMPLE, MAX_CELLS, CELL_ROWS, MARGIN = 16_384, 1024, 1000, 0.08
HOME_BLOCK, OTHER_BLOCK = 1024, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of the unit rows of ``x``, started from its first k rows."""
    c = x[:k].copy()
    for _ in range(rounds):
        best = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        n = np.linalg.norm(sums, axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column)).reshape(-1, width)


def assign(classes: DataFrame, cell_rows: int, max_cells: int, margin: float) -> DataFrame:
    """(node, weight, home, cells, v): unit vectors with their cells. Vectors of another width
    than the most frequent one share a cell, -width, which blocks keep in bounds."""
    widths = classes.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return classes.select("node", "weight", F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells"), "v")
    width, n = widths["w"], widths["count"]
    sample = classes.filter(F.size("v") == width).select("v", F.xxhash64(F.lit(8), "node").alias("h"), "node").orderBy(
        "h", "node").limit(SAMPLE).select("v").toArrow()
    k = max(1, min(max_cells, n // cell_rows, sample.num_rows))
    shared = classes.sparkSession.sparkContext.broadcast(spherical_kmeans(_unit(_rows(sample.column(0), width)), k))

    def run(batches):
        for batch in batches:
            for b in [batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)]:
                size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                home, cells, units = -size.astype(np.int32), [[-int(s)] for s in size], [None] * len(size)
                for w in np.unique(size):
                    own = np.flatnonzero(size == w)
                    x = _unit(_rows(b.column(2).take(pa.array(own)), int(w)))
                    s = x @ shared.value.T if w == width else None
                    for j, i in enumerate(own):
                        units[i] = x[j]
                        if s is not None:
                            home[i] = s[j].argmax()
                            cells[i] = np.flatnonzero(s[j] >= s[j].max() - margin)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32())),
                     pa.array(units, pa.list_(pa.float64()))], ["node", "weight", "home", "cells", "v"])

    return classes.mapInArrow(run, "node long, weight long, home int, cells array<int>, v array<double>")


def _least(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label reachable over the links of a block pair, for its two sides."""
    big = np.iinfo(np.int64).max
    while True:
        to_a = np.minimum(a, np.where(link, b, big).min(axis=1))
        to_b = np.minimum(b, np.where(link, to_a[:, None], big).min(axis=0))
        if (to_a == a).all() and (to_b == b).all():
            return a, b
        a, b = to_a, to_b


def compare(assigned: DataFrame, threshold: float, home_block: int, other_block: int) -> DataFrame:
    """(node, n, root): per block pair, the weight of a vector's links and the least node it reaches."""
    part = F.explode("cells").alias("cell")
    sizes = assigned.select("home", part).groupBy("cell").agg(
        F.ceil(F.count(F.when(F.col("home") == F.col("cell"), 1)) / home_block).alias("hb"),
        F.ceil(F.count(F.lit(1)) / other_block).alias("ob"))
    rows = assigned.select("*", part).join(sizes, "cell").withColumn("h", F.xxhash64(F.lit(80), "node"))

    def side(flag: int, own: str, other: str, df: DataFrame) -> DataFrame:
        mine, others = F.pmod("h", F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        cols = [mine.alias("i"), others.alias("j")] if not flag else [others.alias("i"), mine.alias("j")]
        return df.select("cell", F.lit(flag).alias("side"), *cols, "node", "weight", "home", "cells", "v")

    both = side(0, "hb", "ob", rows.filter("home = cell")).unionByName(side(1, "ob", "hb", rows.filter("hb > 0")))

    def run(t: pa.Table) -> pa.Table:
        cell, flag = t["cell"][0].as_py(), np.asarray(t["side"])
        width = pc.list_value_length(t["v"])[0].as_py()
        x, node, weight, home = _rows(t["v"], width), np.asarray(t["node"]), np.asarray(t["weight"]), np.asarray(t["home"])
        a, b = np.flatnonzero(flag == 0), np.flatnonzero(flag == 1)
        empty = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(a) or not len(b):
            return empty
        link = (x[a] @ x[b].T >= threshold) & (node[a][:, None] != node[b])
        guest = home[b] != cell
        # a pair that both home cells see counts in the lower of the two
        cells = t["cells"].combine_chunks().take(pa.array(a))
        flat, owner = np.asarray(pc.list_flatten(cells)), np.asarray(pc.list_parent_indices(cells))
        for c in np.unique(home[b][guest]):
            if c < cell:
                link[np.ix_(owner[flat == c], np.flatnonzero(home[b] == c))] = False
        if not link.any():
            return empty
        got_a, got_b = link @ weight[b], np.where(guest, link.T @ weight[a], 0)
        root_a, root_b = _least(link, node[a], node[b])
        on_a, on_b = link.any(axis=1), link.any(axis=0)
        return pa.table({"node": np.r_[node[a][on_a], node[b][on_b]], "n": np.r_[got_a[on_a], got_b[on_b]],
                         "root": np.r_[root_a[on_a], root_b[on_b]]})

    return both.groupBy("cell", "i", "j").applyInArrow(run, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, margin: float = MARGIN,
                    home_block: int = HOME_BLOCK, other_block: int = OTHER_BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs with cosine >= ``threshold``.

    Equal vectors are one class, compared once. A vector that is null, empty, zero or holds a
    null or non-finite component, or has a null id, links with nothing and is its own
    component (kept, except for a null id). A row repeated with id and vector comes back once;
    different vectors under one id are vectors of their own."""
    v = F.col(embedding)
    sound = F.coalesce(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
                       & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(sound, v.cast("array<double>")).alias("v"))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("v"), "v"), "sound": F.col("v").isNotNull()})
    ids = rows.groupBy("vec_id", "h1", "h2", "sound").agg(F.lit(1).alias("one")).drop("one")
    size = stage(ids.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")))
    # classes are numbered in order of their least id, so that two with one id stay apart
    size = stage(with_row_index(size, ["least", "h1", "h2"], "node"))
    one = rows.filter("sound").select(F.col("vec_id").alias("least"), "h1", "h2", "v").join(size, ["least", "h1", "h2"])
    classes = one.groupBy("node", "weight").agg(F.first("v").alias("v"))
    found = stage(compare(stage(assign(stage(classes), cell_rows, max_cells, margin)), threshold, home_block, other_block))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    table = size.join(links, "node", "left").join(comp, "node", "left")
    table = table.withColumn("root", F.coalesce("component", "node"))
    first = size.select(F.col("node").alias("root"), F.col("least").alias("component_id"))
    table = table.drop("component").join(first, "root").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), "weight", "n", "component_id")
    out = ids.join(table, null_safe(ids, table, {"h1": "c1", "h2": "c2"}) & ids["sound"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
      AND a.e IS NOT NULL AND b.e IS NOT NULL AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
r AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.u LEFT JOIN n ON v.vec_id = n.u
"""
