"""Watershed and component properties on small random grids."""

import numpy as np
import pandas as pd
import pytest

from fathom.operators.watershed import flood


def test_flood_covers_and_keeps_markers():
    rng = np.random.default_rng(3)
    vals = rng.normal(-75, 8, size=(12, 9))
    marks = np.zeros((12, 9), dtype=np.int64)
    marks[2, 3] = 1
    marks[9, 6] = 2
    seg = flood(vals, marks)
    assert (seg > 0).all()
    assert seg[2, 3] == 1 and seg[9, 6] == 2


def test_flood_low_first():
    # a valley of low values from marker 1 reaches the far cell before marker 2's ridge
    vals = np.array([[0.0, 0.0, 0.0, 0.0, 9.0, 9.0]]).T.repeat(1, axis=1)
    marks = np.array([[1, 0, 0, 0, 0, 2]]).T
    seg = flood(vals, marks)
    assert list(seg[:, 0]) == [1, 1, 1, 1, 2, 2]


def test_flood_no_markers_stays_zero():
    seg = flood(np.zeros((3, 3)), np.zeros((3, 3), dtype=np.int64))
    assert (seg == 0).all()


def test_grid_pipeline_pixels_sum(spark):
    """Sum of segment pixels equals the number of cells (watershed covers every cell)."""
    from pyspark.sql import functions as F

    from fathom.operators import grid as G
    rng = np.random.default_rng(5)
    rows = [("d", int(x), float(y * 10), float(rng.normal(-65, 6)))
            for x in range(15) for y in range(12) if rng.random() > 0.1]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "x", "y", "v"]))
    dense = G.densify(df, ["g"], "x", "y", "v")
    lab = G.label_grid(dense, ["g"], "v", use_watershed=True)
    segs = G.segment_stats(lab, ["g"], "x", "y", "v")
    assert segs.agg(F.sum("npixels")).first()[0] == dense.count() == 15 * 12
    comps = G.components(G.with_mask(dense, "v"), ["g"])
    # every component number appears as a watershed label
    ws_labels = {r["label"] for r in lab.select("label").distinct().collect()}
    assert {r["comp"] for r in comps.select("comp").distinct().collect()} <= ws_labels


@pytest.mark.parametrize("parts", [1, 5])
def test_components_invariant_to_partitions(spark, parts):
    from fathom.operators.components import connected_components
    rng = np.random.default_rng(11)
    cells = [("a", x, y, 20) for x in range(1, 21) for y in range(1, 16) if rng.random() < 0.45]
    df = spark.createDataFrame(cells, "g string, xi int, yi int, nx int").repartition(parts)
    got = {(r["xi"], r["yi"]): r["comp"] for r in connected_components(df, ["g"]).collect()}
    # reference: scan-order union-find in numpy
    grid = np.zeros((21, 16), dtype=bool)
    for _, x, y, _ in cells:
        grid[x, y] = True
    lab = np.zeros_like(grid, dtype=int)
    nxt = 0
    order = sorted(((x, y) for _, x, y, _ in cells), key=lambda c: (c[1], c[0]))
    for start in order:
        if lab[start]:
            continue
        nxt += 1
        stack = [start]
        lab[start] = nxt
        while stack:
            cx, cy = stack.pop()
            for nx_, ny_ in ((cx + 1, cy), (cx - 1, cy), (cx, cy + 1), (cx, cy - 1)):
                if 0 <= nx_ < 21 and 0 <= ny_ < 16 and grid[nx_, ny_] and not lab[nx_, ny_]:
                    lab[nx_, ny_] = nxt
                    stack.append((nx_, ny_))
    assert got == {(x, y): lab[x, y] for _, x, y, _ in cells}




def slow_flood(vals, marks):
    """The rule by relaxation: keys to a fixpoint, then labels down the least neighbours."""
    nx, ny = vals.shape
    inf = (float("inf"), 0, 0)
    key = {(i, j): (float("-inf"), 0, 0) if marks[i, j] > 0 else inf for i in range(nx) for j in range(ny)}
    near = {(i, j): [(a, b) for a in range(i - 1, i + 2) for b in range(j - 1, j + 2) if (a, b) in key and (a, b) != (i, j)] for i, j in key}
    todo = True
    while todo:
        todo = False
        for c in key:
            if marks[c] > 0:
                continue
            for u in near[c]:
                if key[u] != inf:
                    level, gen, steps = key[u]
                    x = vals[c]
                    new = (x, 0, 0) if x > level else (level, gen + 1, 0) if x == level else (level, gen, steps + 1)
                    if new < key[c]:
                        key[c], todo = new, True
    out = np.zeros(vals.shape, dtype=np.int64)
    for c in sorted(key, key=key.get):
        if marks[c] > 0:
            out[c] = marks[c]
        elif key[c] != inf:
            out[c] = out[min(near[c], key=lambda u: (key[u], u[1], u[0]))]
    return out


def fifo_flood(vals, marks):
    """Lowest value first, first in first out among equals: the published algorithm."""
    import heapq
    seg, heap, age = marks.copy(), [], 0
    order = [(i, j) for j in range(vals.shape[1]) for i in range(vals.shape[0]) if marks[i, j] > 0]

    def spread(i, j):
        nonlocal age
        for b in range(max(j - 1, 0), min(j + 2, vals.shape[1])):
            for a in range(max(i - 1, 0), min(i + 2, vals.shape[0])):
                if seg[a, b] == 0:
                    seg[a, b] = seg[i, j]
                    heapq.heappush(heap, (vals[a, b], age, a, b))
                    age += 1

    for i, j in order:
        spread(i, j)
    while heap:
        _, _, i, j = heapq.heappop(heap)
        spread(i, j)
    return seg


def random_images(n, seed=5):
    rng = np.random.default_rng(seed)
    for k in range(n):
        nx, ny = rng.integers(3, 20, 2)
        vals = rng.normal((-70, -86, -95)[k % 3], 10, (nx, ny)) if k % 4 else rng.permutation(nx * ny).reshape(nx, ny).astype(float)
        if k % 4:
            vals = np.maximum(vals, -90)  # a few to most cells equal
        marks = np.zeros((nx, ny), dtype=np.int64)
        for lab in range(1, rng.integers(0, 6) + 1):
            marks[rng.integers(nx), rng.integers(ny)] = lab
        yield k, vals, marks


def test_flood_follows_the_rule_and_the_queue():
    """210 images: the heap settles what relaxation does; without ties it is the published queue."""
    from fathom.operators.watershed import flood
    same = cells = 0
    for k, vals, marks in random_images(210):
        got = flood(vals, marks)
        assert (got == slow_flood(vals, marks)).all(), k
        if k % 4 == 0:
            assert (got == fifo_flood(vals, marks)).all(), k
        else:
            same += int((got == fifo_flood(vals, marks)).sum())
            cells += vals.size
    assert same > 0.9 * cells  # ties are broken by place, not by age


def test_tiles_do_not_change_the_watershed(spark):
    from fathom.operators.watershed import flood, watershed
    images = list(random_images(60))
    rows = [(k, i + 1, j + 1, float(v[i, j]), int(m[i, j])) for k, v, m in images for i in range(v.shape[0]) for j in range(v.shape[1])]
    df = spark.createDataFrame(rows, "g int, xi int, yi int, Sv_mean double, comp long")
    want = {(k, i + 1, j + 1): int(w[i, j]) for k, v, m in images for w in [flood(v, m)] for i in range(v.shape[0]) for j in range(v.shape[1])}
    for tile in (512, 7):
        out = watershed(df, ["g"], tile=tile)
        assert out.columns == ["g", "xi", "yi", "Sv_mean", "label"]
        assert {(r.g, r.xi, r.yi): r.label for r in out.collect()} == want, tile
    assert watershed(df.limit(0), ["g"]).count() == 0


def test_densify_salted_equals_plain(spark):
    from fathom.operators.grid import densify
    rng = np.random.default_rng(8)
    rows = [(g, int(x), float(y), float(rng.normal(-70, 9))) for g in ("a", "b") for x in range(30)
            for y in range(0, 200, 10) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "g string, x int, y double, v double")
    one = densify(df, ["g"], "x", "y", "v")
    many = densify(df, ["g"], "x", "y", "v", cells_per_task=37)
    assert one.count() == many.count() == 2 * 30 * 20
    assert one.exceptAll(many).count() == 0


def test_only_tiles_beside_a_change_are_flooded_again(spark):
    """Nine images that are settled at once, and one that a marker in its corner floods tile by tile."""
    from fathom.operators.watershed import flood, watershed
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g in range(10):
        vals = np.maximum(rng.normal(-85, 6, (48, 16)), -90)
        marks = np.zeros(vals.shape, dtype=np.int64) if not g else np.arange(1, vals.size + 1).reshape(vals.shape)
        if not g:
            marks[0, 0], marks[2, 15] = 1, 2
        seg = flood(vals, marks)
        rows += [(g, i + 1, j + 1, float(vals[i, j]), int(marks[i, j])) for i in range(48) for j in range(16)]
        want |= {(g, i + 1, j + 1): int(seg[i, j]) for i in range(48) for j in range(16)}
    df = spark.createDataFrame(rows, "g int, xi int, yi int, Sv_mean double, comp long")
    rounds = []
    got = {(r.g, r.xi, r.yi): r.label for r in watershed(df, ["g"], tile=8, rounds=rounds).collect()}
    assert got == want
    assert rounds[0] == 120 and len(rounds) > 4 and max(rounds[2:]) <= 12, rounds


def test_two_files_that_share_a_day_are_two_images(spark, tmp_path):
    """20:00 to 02:00 UTC-8 around a month's end: the local day is cut by the files, each with its labels."""
    from fathom.plans.grids import detect_files
    head = "Interval,Layer depth min,Sv mean,Date_M,Time_M\n"

    def cell(day, hour, depth, sv):
        return f"{hour},{depth},{sv},{day}, {hour:02d}:00:00.0000\n"

    def day(d, hours):
        return "".join(cell(d, h, z, -50 if z < 40 else -80 - z / 100) for h in hours for z in (20, 30, 40, 50, 600))

    (tmp_path / "2019-11.csv").write_text(head + day("20191130", (20, 21, 22)))       # 12:00 to 14:00 local, 30 November
    late = head.replace("Sv mean,Date_M", "Date_M,Sv mean")
    body = day("20191201", (1, 2, 3))                                                  # 17:00 to 19:00 local, 30 November
    swap = "".join(",".join([a, b, d, c, e]) + "\n" for a, b, c, d, e in (x.split(",") for x in body.splitlines()))
    (tmp_path / "2019-12.csv").write_text(late + swap)
    segs, lay = detect_files(spark, str(tmp_path))
    got = sorted((r.file, str(r.date), r.school_id, r.npixels, r.width) for r in segs.collect())
    assert got == [("2019-11.csv", "2019-11-30", "2019-11-30-S1", 12, 3), ("2019-12.csv", "2019-11-30", "2019-11-30-S1", 12, 3)]
    assert lay.count() == 6


def test_layer_metrics_against_running_sums(spark):
    from pyspark.sql import functions as F

    from fathom.operators import grid as G
    rng = np.random.default_rng(21)
    rows = [(d, x, y + 1, x, 10.0 * (y + 1), float(v), int(lab)) for d in ("a", "b", None) for x in range(1, 9)
            for y, (v, lab) in enumerate(zip(rng.choice([-90.0, -75.0, -62.0, -55.0, -40.0], 12), rng.integers(0, 4, 12)))]
    rows += [("quiet", 1, y + 1, 1, 10.0 * (y + 1), -90.0, 0) for y in range(12)]
    lab = spark.createDataFrame(rows, "g string, xi int, yi int, x int, y double, v double, label long").repartition(5)
    kept = spark.createDataFrame([("a", 2), ("b", 1), ("b", 3)], "g string, label long")
    out = G.layer_metrics(lab, kept, ["g"], "x", "y", "v")
    assert out.columns == ["g", "datetime", "cm", "layertop", "layerbase"]
    got = {(r["g"], r["datetime"]): r for r in out.collect()}
    blank = {("a", 2), ("b", 1), ("b", 3)}
    assert len(got) == 25
    for d, x in got:
        col = [(r[4], 0.0 if (d, r[6]) in blank else 10 ** (r[5] / 10)) for r in rows if (r[0], r[1]) == (d, x)]
        top = next((y for i, (y, _) in enumerate(col) if sum(s for _, s in col[:i + 1]) > G.LAYER_EPS), None)
        base = next((y for i, (y, _) in reversed(list(enumerate(col))) if sum(s for _, s in col[i:]) > G.LAYER_EPS), None)
        total = sum(s for _, s in col)
        assert (got[d, x]["layertop"], got[d, x]["layerbase"]) == (top, base)
        assert got[d, x]["cm"] == pytest.approx(sum(y * s for y, s in col) / total)
    assert got["quiet", 1]["layertop"] is None and got["quiet", 1]["layerbase"] is None
    assert G.layer_metrics(lab.filter(F.lit(False)), kept, ["g"], "x", "y", "v").count() == 0
