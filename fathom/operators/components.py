"""Connected components of a boolean grid, 4-neighbour, by tiles and their borders.

1. Images are cut into tiles of bounded size. Inside a tile the cells are united in one
   vectorised pass; a part is named by its first cell in column-major order.
2. Where two cells face each other across a border between tiles, their parts make an edge.
   Only these go into the graph, so it has an edge for each border cell at most.
3. The graph is solved with the alternating large-star / small-star algorithm (Kiveris et
   al., "Connected Components in MapReduce and Beyond", SoCC 2014): O(log^2 n) rounds, each a
   group-by + join; lineage is cut with reliable checkpoints.
4. Each component is labelled by the rank of its first cell in column-major order (ping index
   fastest), which is the numbering of a scan-order labelling. The numbers go back to the
   tiles (one row a part), and each tile labels its own cells.

Images of one tile need neither graph nor numbers from outside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.sequence import rank_within
from fathom.session import cut_lineage

#: Width and height of a tile.
TILE = 512


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls equal, and keep the keys of ``a``."""
    b = b.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"__k_{k}"])
    return a.join(b, cond, how).drop(*[f"__k_{k}" for k in keys])


def _sym(e: DataFrame, g: list[str]) -> DataFrame:
    both = e.unionByName(e.select(*g, F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter(F.col("u") != F.col("v")).distinct()


def _large_star(e: DataFrame, g: list[str]) -> DataFrame:
    m = e.groupBy(*g, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    out = _match(e.filter(F.col("v") > F.col("u")), m, [*g, "u"]).select(
        *g, F.col("v").alias("u"), F.col("m").alias("v"))
    return _sym(out, g)


def _small_star(e: DataFrame, g: list[str]) -> DataFrame:
    low = e.filter(F.col("v") < F.col("u"))
    m = low.groupBy(*g, "u").agg(F.min("v").alias("m"))
    spokes = _match(low, m, [*g, "u"]).select(*g, F.col("v").alias("u"), F.col("m").alias("v"))
    centre = m.select(*g, "u", F.col("m").alias("v"))
    return _sym(spokes.unionByName(centre), g)


def _all_stars(e: DataFrame, g: list[str]) -> bool:
    """Is every node a centre, with larger neighbours only, or a tip with one smaller neighbour?"""
    n = e.groupBy(*g, "u").agg(F.count(F.when(F.col("v") < F.col("u"), 1)).alias("down"),
                               F.count(F.when(F.col("v") > F.col("u"), 1)).alias("up"))
    return n.filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def star_components(nodes: DataFrame, edges: DataFrame, g: Sequence[str]) -> DataFrame:
    """``nodes`` with ``root``, the component minimum. ``nodes``: (*g, u, ...); ``edges``: (*g, u, v).

    Every round is written to the shared checkpoint folder: the plan of a round refers
    to the previous edge set several times, so an uncut lineage would grow geometrically."""
    g = list(g)
    e = cut_lineage(_sym(edges.select(*g, "u", "v"), g))
    while not _all_stars(e, g):
        e = cut_lineage(_small_star(_large_star(e, g), g))
    best = e.groupBy(*g, "u").agg(F.min("v").alias("__m"))
    return _match(nodes, best, [*g, "u"], "left").withColumn(
        "root", F.least(F.col("u"), F.coalesce(F.col("__m"), F.col("u")))).drop("__m")


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes, from edges (a, b)."""
    root = np.arange(n)
    while len(a):
        # every root hooks onto its least smaller neighbour, then all chains are cut short
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def first_cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each cell (x, y) of one tile, the row of its component's first cell in column-major order."""
    if not len(x):
        return np.empty(0, dtype=np.int64)
    x, y = x - x.min(), y - y.min()
    w = int(x.max()) + 2                          # an empty column parts the lines
    place = y * w + x
    row = np.full(w * (int(y.max()) + 2), -1, dtype=np.int64)
    row[place] = np.arange(len(place))
    taken = np.flatnonzero(row >= 0)              # cells in column-major order
    rank = np.full(len(row), -1, dtype=np.int64)
    rank[taken] = np.arange(len(taken))
    edges = [(rank[taken], rank[taken + step]) for step in (1, w)]
    a, b = (np.concatenate(s) for s in zip(*[(p[q >= 0], q[q >= 0]) for p, q in edges]))
    return row[taken[unite(len(taken), a, b)[rank[place]]]]


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


def tile_of(c: str, tile: int) -> Column:
    return F.floor((F.col(c) - 1) / tile)


def tile_parts(cells: DataFrame, g: Sequence[str], xi: str, yi: str, nx: str, tile: int) -> DataFrame:
    """(*g, __tx, __ty, u, side, bx, by) of ``cells`` with their tile: a row with ``side`` 0 for each part
    of a tile, and one for each cell at a border, named by the place before the border it lies at:
    in the direction of pings (``side`` 1) or of depth (2). ``u``: the first cell of the part."""
    key = [*g, "__tx", "__ty"]
    schema = T.StructType([*[cells.schema[c] for c in key], *[T.StructField(c, T.LongType()) for c in ("u", "side", "bx", "by")]])

    def run(t: pa.Table) -> pa.Table:
        x, y, n = _ints(t, xi), _ints(t, yi), _ints(t, nx)
        u = ((y - 1) * n + x)[first_cells(x, y)]
        own = np.unique(u)
        none = np.zeros(len(own), dtype=np.int64)
        found = [(own, none, none, none)]
        for side, at in ((1, x), (2, y)):
            for step in (0, 1):                    # the last cell before a border, the first behind one
                i = np.flatnonzero((at - step) % tile == 0)
                i = i[at[i] > step]
                found.append((u[i], np.full(len(i), side), x[i] - step * (side == 1), y[i] - step * (side == 2)))
        cols = [np.concatenate(c) for c in zip(*found)]
        head = t.select(key).take(pa.array(np.zeros(len(cols[0]), dtype=np.int64)))
        return pa.Table.from_arrays([*head.columns, *[pa.array(c.astype(np.int64)) for c in cols]], names=schema.names)

    return cells.groupBy(*key).applyInArrow(run, schema)


def border_edges(parts: DataFrame, g: Sequence[str]) -> DataFrame:
    """(*g, u, v): parts that face each other across a border, from :func:`tile_parts`."""
    return parts.filter("side > 0").groupBy(*g, "side", "bx", "by").agg(
        F.min("u").alias("u"), F.max("u").alias("v")).filter("u <> v").select(*g, "u", "v").distinct()


def connected_components(cells: DataFrame, group: Sequence[str], xi: str = "xi", yi: str = "yi",
                         nx: str = "nx", out_col: str = "comp", tile: int = TILE) -> DataFrame:
    """Label 4-connected components of ``cells`` (the TRUE cells of a mask).

    ``cells`` holds (*group, xi, yi, nx) with 1-based ping rank ``xi``, depth rank ``yi``
    and the group's ping count ``nx``. Returns the same rows plus ``out_col`` = 1..k. A null
    group is a group; repeated cells count as one. ``tile`` changes how much a task holds, not
    the result."""
    g = list(group)
    key = [*g, "__tx", "__ty"]
    kept = cells.columns
    schema = T.StructType([*cells.schema.fields, T.StructField(out_col, T.LongType())])
    cells = cut_lineage(cells.withColumns({"__tx": tile_of(xi, tile), "__ty": tile_of(yi, tile)}))

    def labelled(t: pa.Table, comp: np.ndarray) -> pa.Table:
        return t.select(kept).append_column(out_col, pa.array(comp.astype(np.int64)))

    def starts(t: pa.Table) -> np.ndarray:
        x, y = _ints(t, xi), _ints(t, yi)
        return ((y - 1) * _ints(t, nx) + x)[first_cells(x, y)]

    def alone(t: pa.Table) -> pa.Table:
        return labelled(t, np.unique(starts(t), return_inverse=True)[1] + 1)

    size = cells.agg(F.max(xi), F.max(yi)).first()
    if max(size[0] or 0, size[1] or 0) <= tile:
        return cells.groupBy(*key).applyInArrow(alone, schema)

    parts = cut_lineage(tile_parts(cells, g, xi, yi, nx, tile))
    own = parts.filter("side = 0").select(*key, "u")
    roots = cut_lineage(star_components(own, border_edges(parts, g), g))
    numbers = rank_within(cut_lineage(roots.select(*g, "root").distinct()), g, ["root"], "__comp")
    names = _match(roots, numbers, [*g, "root"]).select(*key, "u", "__comp")

    def by_name(t: pa.Table, named: pa.Table) -> pa.Table:
        u, comp = _ints(named, "u"), _ints(named, "__comp")
        order = np.argsort(u)
        return labelled(t, comp[order][np.searchsorted(u[order], starts(t))])

    return cells.groupBy(*key).cogroup(names.groupBy(*key)).applyInArrow(by_name, schema)
