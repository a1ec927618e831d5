"""Labels by tiles and their borders against a flood fill in scan order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators.components import border_edges, connected_components, first_cells, tile_of, tile_parts


def scan_order(grid):
    """Labels 1..k of a boolean grid [ping, depth], numbered in column-major order."""
    lab, nxt = np.zeros(grid.shape, dtype=int), 0
    for y in range(grid.shape[1]):
        for x in range(grid.shape[0]):
            if not grid[x, y] or lab[x, y]:
                continue
            nxt += 1
            lab[x, y], stack = nxt, [(x, y)]
            while stack:
                a, b = stack.pop()
                for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c[0] < grid.shape[0] and 0 <= c[1] < grid.shape[1] and grid[c] and not lab[c]:
                        lab[c] = nxt
                        stack.append(c)
    return lab


def spiral(n):
    """A one-cell-wide path from the corner to the middle, one cell between its turns."""
    grid = np.zeros((n, n), dtype=bool)
    x = y = turns = 0
    dx, dy = 1, 0
    grid[0, 0] = True
    while turns < 2:
        a, b = x + dx, y + dy
        c, d = x + 2 * dx, y + 2 * dy
        if 0 <= a < n and 0 <= b < n and not (0 <= c < n and 0 <= d < n and grid[c, d]):
            x, y, turns = a, b, 0
            grid[x, y] = True
        else:
            dx, dy, turns = -dy, dx, turns + 1
    return grid


def rows_of(name, grid):
    return [(name, int(x) + 1, int(y) + 1, grid.shape[0]) for x, y in np.argwhere(grid)]


@pytest.mark.parametrize("seed", range(12))
def test_one_tile_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    grid = rng.random((rng.integers(1, 40), rng.integers(1, 40))) < rng.uniform(0.1, 0.9)
    x, y = np.nonzero(grid)
    mix = rng.permutation(len(x))
    x, y = x[mix] + 100, y[mix] + 7
    first = first_cells(x, y)
    start = (y * 1000 + x)[first]
    assert (np.unique(start, return_inverse=True)[1] + 1 == scan_order(grid)[x - 100, y - 7]).all()


def test_one_tile_spiral():
    x, y = np.nonzero(spiral(41))
    assert len(x) > 600 and len(set(first_cells(x, y).tolist())) == 1


SCHEMA = "g string, xi int, yi int, nx int"


@pytest.mark.parametrize("tile", [1, 3, 8, 64])
def test_tiles_do_not_change_labels(spark, tile):
    rng = np.random.default_rng(5)
    images = {"a": rng.random((23, 17)) < 0.55, "b": spiral(19), None: rng.random((9, 30)) < 0.6, "c": np.ones((10, 10), dtype=bool)}
    rows = [r for k, v in images.items() for r in rows_of(k, v)]
    cells = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["g"], r["xi"], r["yi"]): r["comp"] for r in connected_components(cells, ["g"], tile=tile).collect()}
    assert len(got) == len(rows)
    for k, v in images.items():
        lab = scan_order(v)
        assert all(got[k, x, y] == lab[x - 1, y - 1] for _, x, y, _ in rows_of(k, v))


def test_graph_is_bounded_by_border_cells(spark):
    rng = np.random.default_rng(8)
    tile, grid = 16, rng.random((64, 48)) < 0.6
    cells = spark.createDataFrame(rows_of("a", grid), SCHEMA).withColumns({"__tx": tile_of("xi", tile), "__ty": tile_of("yi", tile)})
    parts = tile_parts(cells, ["g"], "xi", "yi", "nx", tile)
    edges = border_edges(parts, ["g"])
    at_border = cells.filter(((F.col("xi") % tile <= 1) | (F.col("yi") % tile <= 1))).count()
    faces = sum(int((grid[i - 1] & grid[i]).sum()) for i in range(tile, 64, tile)) + sum(
        int((grid[:, j - 1] & grid[:, j]).sum()) for j in range(tile, 48, tile))
    assert 0 < edges.count() <= faces <= at_border < cells.count()


@pytest.mark.parametrize("tile", [2, 512])
def test_empty_repeated_and_clashing(spark, tile):
    none = connected_components(spark.createDataFrame([], SCHEMA), ["g"], tile=tile)
    assert none.count() == 0 and none.columns == ["g", "xi", "yi", "nx", "comp"]
    rows = [("a", 1, 1, 4, 7), ("a", 1, 1, 4, 8), ("a", 2, 1, 4, None), ("a", 4, 1, 4, 1), ("a", 3, 2, 4, 0)]
    cells = spark.createDataFrame(rows, "g string, xi int, yi int, nx int, root int").withColumns(
        {"u": F.col("root"), "side": F.lit("x"), "v": F.lit(None).cast("double")})
    out = connected_components(cells, ["g"], tile=tile)
    assert out.columns == [*cells.columns, "comp"]
    assert sorted((r["xi"], r["comp"], r["root"], r["side"]) for r in out.collect() if r["root"] is not None) == [
        (1, 1, 7, "x"), (1, 1, 8, "x"), (3, 3, 0, "x"), (4, 2, 1, "x")]


def test_no_group_columns(spark):
    grid = spiral(11)
    cells = spark.createDataFrame(rows_of("a", grid), SCHEMA).drop("g")
    assert {r["comp"] for r in connected_components(cells, [], tile=4).collect()} == {1}
