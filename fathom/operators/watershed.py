"""Marker-controlled watershed of one image per group, by one rule for every size.

A path from a marker cell has the key (level, generation, steps): the highest value on it,
how many further cells of just that value it has since reaching it, and how many lower cells
since the last of those. Every step makes the key larger. A cell's key is the least over all
paths to it, and its label is that of the 8-neighbour of least key (the first in column-major
scan order if several have it); marker cells have the least key and keep their label. Equal
values are so flooded outwards from where they are entered, like a first-in-first-out queue.

Images are cut into tiles of bounded size. A tile is flooded in one task (lowest key first,
so each cell is settled once); what its edge cells end with goes to the tiles beside it. A list
holds the tiles beside an edge cell that has changed; only they are flooded again. Keys only fall,
and when the list is empty every cell obeys the rule. An image of one tile needs no exchange.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import cut_lineage

TILE = 512
#: Tiles on the work list that are sent to all tasks; a longer list is joined with a shuffle.
SENT_TILES = 100_000

Key = tuple[float, int, int]
Halo = list[tuple[int, int, Key, int]]


def flood(values: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Labels of one whole image."""
    return settle(values, markers)[0]


def settle(values: np.ndarray, markers: np.ndarray, halo: Halo = (), origin: tuple[int, int] = (0, 0)):
    """Labels and keys of a dense 2-D ``values`` array [ping, depth] from integer ``markers``.

    ``halo``: settled cells just outside, as (i, j, key, label). ``origin``: where the array
    starts in its image (the scan order within a tile is that of its image). Cells that nothing
    reaches have label 0 and key None.

    Cells lie in one list with a border around, column-major. A key is one integer: the rank of its
    level among the values at hand, then generation and steps of 31 bits each; with the cell's place
    behind it, it is an entry of the queue."""
    nx, ny = values.shape
    w = nx + 2
    size = w * (ny + 2)
    shift = size.bit_length()
    levels = np.unique(np.concatenate([values.ravel(), np.array([k[0] for _, _, k, _ in halo if k[0] > float("-inf")], dtype=np.float64)]))
    rank = np.zeros((ny + 2, w), dtype=np.int64)
    rank[1:-1, 1:-1] = (np.searchsorted(levels, values) + 1).T      # 0: below all, the level of markers
    labels = np.zeros((ny + 2, w), dtype=np.int64)
    labels[1:-1, 1:-1] = markers.T
    open_ = np.zeros((ny + 2, w), dtype=bool)
    open_[1:-1, 1:-1] = markers.T <= 0
    start = np.flatnonzero(labels > 0)
    rank, seg, free = rank.ravel().tolist(), np.where(labels > 0, labels, 0).ravel().tolist(), open_.ravel().tolist()
    keys: list[int | None] = [None] * size
    heap = []
    for p in start.tolist():
        keys[p] = 0
        heap.append(p)
    for i, j, (level, gen, steps), lab in halo:
        p = (j + 1) * w + i + 1
        r = int(np.searchsorted(levels, level)) + 1 if level > float("-inf") else 0
        seg[p] = lab
        heap.append((((r << 62) | (gen << 31) | steps) << shift) | p)
    heapq.heapify(heap)
    around = (-w - 1, -w, -w + 1, -1, 1, w - 1, w, w + 1)
    mask, pop, push = (1 << shift) - 1, heapq.heappop, heapq.heappush
    while heap:
        e = pop(heap)
        p, k = e & mask, e >> shift
        lab, level = seg[p], k >> 62
        for d in around:
            q = p + d
            if 0 <= q < size and free[q]:
                free[q] = False
                r = rank[q]
                new = r << 62 if r > level else ((k >> 31) + 1) << 31 if r == level else k + 1
                keys[q], seg[q] = new, lab
                push(heap, (new << shift) | q)
    low = (1 << 31) - 1

    def key(p: int) -> Key | None:
        k = keys[p]
        if k is None:
            return None
        r = k >> 62
        return (float(levels[r - 1]) if r else float("-inf")), (k >> 31) & low, k & low

    out = np.array(seg, dtype=np.int64).reshape(ny + 2, w)[1:-1, 1:-1].T
    return out, _Keys(lambda i, j: key((j + 1) * w + i + 1))


class _Keys:
    """Keys by [ping][depth], unpacked when asked for."""

    def __init__(self, at):
        self.at = at

    def __getitem__(self, i: int):
        return _Row(lambda j: self.at(i, j))


class _Row:
    def __init__(self, at):
        self.at = at

    def __getitem__(self, j: int):
        return self.at(j)


def _flood_tile(pdf: pd.DataFrame, halo: pd.DataFrame | None, xi: str, yi: str, value: str, marker: str):
    """(row places, labels, a function from a row's place to its key) of one tile's cells."""
    x, y = pdf[xi].to_numpy(np.int64), pdf[yi].to_numpy(np.int64)
    ox, oy = int(x.min()), int(y.min())
    shape = int(x.max()) - ox + 1, int(y.max()) - oy + 1
    vals, marks = np.full(shape, np.inf), np.zeros(shape, dtype=np.int64)
    vals[x - ox, y - oy] = pdf[value].to_numpy(np.float64)
    marks[x - ox, y - oy] = pdf[marker].fillna(0).to_numpy(np.int64)
    around = [] if halo is None else [(int(i) - ox, int(j) - oy, (float(a), int(b), int(c)), int(lab)) for i, j, a, b, c, lab in
                                      zip(halo["hx"], halo["hy"], halo["level"], halo["gen"], halo["steps"], halo["lab"])]
    seg, keys = settle(vals, marks, around, (ox, oy))
    return seg[x - ox, y - oy], lambda r: keys[int(x[r]) - ox][int(y[r]) - oy]


def watershed(grid: DataFrame, group: Sequence[str], xi: str = "xi", yi: str = "yi",
              value: str = "Sv_mean", marker: str = "comp", out_col: str = "label", tile: int = TILE,
              rounds: list[int] | None = None) -> DataFrame:
    """Per group: flood ``value`` from ``marker`` labels (0 = unlabelled) on the dense grid.

    Returns every input column except ``marker``, plus ``out_col``. ``tile`` changes how much a
    task holds, not the result. ``rounds`` is given how many tiles each round has flooded."""
    g = list(group)
    at = {"__tx": F.floor((F.col(xi) - 1) / tile), "__ty": F.floor((F.col(yi) - 1) / tile)}
    cells = grid.withColumns(at)
    tiles = [*g, "__tx", "__ty"]
    kept = [f for f in grid.schema.fields if f.name != marker]
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    names = [f.name for f in kept]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out_col}` long"])

    def label(pdf: pd.DataFrame, halo: pd.DataFrame | None = None) -> pd.DataFrame:
        return pdf[names].assign(**{out_col: _flood_tile(pdf, halo, xi, yi, value, marker)[0]})

    size = grid.agg(F.max(xi), F.max(yi)).first()
    if max(size[0] or 0, size[1] or 0) <= tile:
        return cells.groupBy(*tiles).applyInPandas(lambda pdf: label(pdf), out_schema)

    cells = cut_lineage(cells)
    edge_schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in g], "hx long", "hy long", "level double", "gen long", "steps long", "lab long"])

    def edges(pdf: pd.DataFrame, halo: pd.DataFrame) -> pd.DataFrame:
        cols = [*g, "hx", "hy", "level", "gen", "steps", "lab"]
        if not len(pdf):
            return pd.DataFrame(columns=cols)
        seg, key = _flood_tile(pdf, halo, xi, yi, value, marker)
        x, y = pdf[xi].to_numpy(np.int64), pdf[yi].to_numpy(np.int64)
        rim = np.flatnonzero((x % tile <= 1) | (y % tile <= 1)).tolist()
        rim = [(r, k) for r in rim if (k := key(r)) is not None]
        at = [r for r, _ in rim]
        return pd.DataFrame({**{c: pdf[c].iloc[at] for c in g}, "hx": x[at], "hy": y[at], "level": [k[0] for _, k in rim],
                             "gen": [k[1] for _, k in rim], "steps": [k[2] for _, k in rim], "lab": seg[at]})

    def home(rim: DataFrame) -> DataFrame:
        """Edge cells with the tile they lie in."""
        return rim.withColumns({"__tx": F.floor((F.col("hx") - 1) / tile), "__ty": F.floor((F.col("hy") - 1) / tile)})

    def beside(rim: DataFrame) -> DataFrame:
        """Edge cells under every other tile that one of their neighbours is in."""
        near = F.array_distinct(F.flatten(F.array(*[F.array(F.struct(
            F.floor((F.col("hx") - 1 + dx) / tile).alias("tx"), F.floor((F.col("hy") - 1 + dy) / tile).alias("ty")))
            for dx in (-1, 0, 1) for dy in (-1, 0, 1)])))
        own = (F.col("t.tx") == F.floor((F.col("hx") - 1) / tile)) & (F.col("t.ty") == F.floor((F.col("hy") - 1) / tile))
        return rim.withColumn("t", F.explode(near)).filter(~own).select(
            *rim.columns, F.col("t.tx").alias("__tx"), F.col("t.ty").alias("__ty"))

    def of(side: DataFrame, work: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows of ``side`` whose tile is on the list ``work`` (or, left_anti, is not)."""
        cond = F.lit(True)
        for c in tiles:
            cond = cond & side[c].eqNullSafe(work[f"__k{c}"])
        return side.join(work, cond, how)

    # The work list: a tile is flooded if an edge cell beside it has changed since its last flood.
    # ``rim`` holds the edge cells of all tiles as they are.
    rim = cut_lineage(cells.groupBy(*tiles).applyInPandas(lambda pdf: edges(pdf, None), edge_schema))
    changed = rim
    existing = cut_lineage(cells.select(*tiles).distinct())
    if rounds is not None:
        rounds.append(existing.count())
    while True:
        work = beside(changed).select(*[F.col(c).alias(f"__k{c}") for c in tiles]).distinct()
        cond = F.lit(True)
        for c in tiles:
            cond = cond & work[f"__k{c}"].eqNullSafe(existing[c])
        work = cut_lineage(work.join(existing, cond, "left_semi"))
        n = work.count()
        if not n:
            break
        if rounds is not None:
            rounds.append(n)
        if n <= SENT_TILES:
            work = F.broadcast(work)
        halo = of(beside(rim), work)
        new = cut_lineage(of(cells, work).groupBy(*tiles).cogroup(halo.groupBy(*tiles)).applyInPandas(edges, edge_schema))
        changed = cut_lineage(new.exceptAll(of(home(rim), work).select(*rim.columns)))
        rim = cut_lineage(of(home(rim), work, "left_anti").select(*rim.columns).unionByName(new))
    return cells.groupBy(*tiles).cogroup(beside(rim).groupBy(*tiles)).applyInPandas(
        lambda pdf, halo: label(pdf, halo) if len(pdf) else pd.DataFrame(columns=[*names, out_col]), out_schema)
