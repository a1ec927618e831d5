"""Grid (image-like) operators re-aimed as keyed DataFrame jobs.

A grid is a long table (*group, x, y, value): one row per cell, ``group`` selects the
image (a day), ``x`` is the ping time and ``y`` the depth. Matrix positions are the
ranks ``xi``/``yi`` of a cell's coordinates among the group's distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.math import floor_clamp, from_db
from fathom.operators.aggregates import weighted_mean
from fathom.operators.components import connected_components
from fathom.operators.relational import flag_in
from fathom.operators.sequence import rank_axes
from fathom.operators.watershed import watershed

FLOOR_DB = -90.0
THRESHOLD_DB = -60.0
LAYER_EPS = 1e-6


CELLS_PER_TASK = 1 << 21


def densify(df: DataFrame, group: Sequence[str], x: str, y: str, v: str,
            floor: float = FLOOR_DB, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """G1: every (x, y) of a group's axes; missing cells and values below ``floor`` become
    ``floor``. Adds ranks ``xi``, ``yi`` (1-based) and the group's ping count ``nx``.

    The image of a group is the product of its two axes. A plain join on the group key
    would build a big image in one task, so each group's pings are split into
    ``ceil(nx * ny / cells_per_task)`` salt buckets and its depth axis is copied once per
    bucket: every task builds at most about ``cells_per_task`` cells."""
    g = list(group)
    ranks = rank_axes(df, g, [x, y])
    xs = ranks[x].withColumnRenamed("__rank", "xi")
    ys = ranks[y].withColumnRenamed("__rank", "yi")
    size = xs.groupBy(*g).agg(F.max("xi").alias("nx")).join(
        ys.groupBy(*g).agg(F.max("yi").alias("__ny")), g)
    size = size.withColumn("__s", F.greatest(F.lit(1), F.ceil(
        F.col("nx") * F.col("__ny") / F.lit(float(cells_per_task)))).cast("int")).drop("__ny")
    xs = xs.join(size, g).withColumn("__salt", F.pmod(F.col("xi"), F.col("__s")))
    ys = ys.join(size.select(*g, "__s"), g).select(
        *g, y, "yi", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)).alias("__salt"))
    cells = xs.join(ys, [*g, "__salt"]).drop("__salt", "__s")
    obs = df.select(*g, x, y, v)
    return cells.join(obs, [*g, x, y], "left").withColumn(v, floor_clamp(v, floor, fill_null=True))


def with_mask(grid: DataFrame, v: str, threshold: float = THRESHOLD_DB, name: str = "mask") -> DataFrame:
    """Strict threshold mask."""
    return grid.withColumn(name, F.col(v) > F.lit(threshold))


def components(grid: DataFrame, group: Sequence[str], mask: str = "mask") -> DataFrame:
    """G3 on a dense grid: (*group, xi, yi, comp) for the TRUE cells."""
    cells = grid.filter(F.col(mask)).select(*group, "xi", "yi", "nx")
    return connected_components(cells, group).select(*group, "xi", "yi", "comp")


def label_grid(grid: DataFrame, group: Sequence[str], v: str, use_watershed: bool = True,
               threshold: float = THRESHOLD_DB) -> DataFrame:
    """G2+G3(+G4): attach a segment ``label`` to every cell.

    With ``use_watershed`` every cell of an image that has a marker is flooded to one
    (as the reference does); otherwise only mask cells carry their component number and
    the rest get 0."""
    g = list(group)
    masked = with_mask(grid, v, threshold)
    comps = components(masked, g)
    marked = masked.join(comps, [*g, "xi", "yi"], "left").withColumn(
        "comp", F.coalesce(F.col("comp"), F.lit(0)).cast("long"))
    if use_watershed:
        return watershed(marked, g, value=v, marker="comp")
    return marked.withColumnRenamed("comp", "label")


def segment_stats(labelled: DataFrame, group: Sequence[str], x: str, y: str, v: str,
                  include_background: bool = True) -> DataFrame:
    """A11+G5+J9: one row per (group, label): bounding box in index units, size, mean,
    sd and total of linear values, with coordinates restored (bottom = deepest depth,
    top = shallowest, since image rows run downwards) and the midpoint."""
    g = list(group)
    df = labelled if include_background else labelled.filter(F.col("label") > 0)
    sv = from_db(v)
    s = df.groupBy(*g, "label").agg(
        F.min("yi").alias("__ylo"), F.max("yi").alias("__yhi"),
        F.min("xi").alias("left"), F.max("xi").alias("right"),
        F.count(F.lit(1)).alias("npixels"),
        F.avg(sv).alias("mean"), F.stddev_samp(sv).alias("std"),
        F.min(x).alias("start_time"), F.max(y).alias("bottom"), F.min(y).alias("top"))
    return s.select(
        *g, "label", "bottom", "top", "left", "right",
        (F.col("__yhi") - F.col("__ylo") + 1).alias("height"),
        (F.col("right") - F.col("left") + 1).alias("width"),
        "npixels", "mean", "std", (F.col("mean") * F.col("npixels")).alias("total"),
        "start_time", ((F.col("bottom") + F.col("top")) / 2).alias("middle"))


def size_filter(segs: DataFrame, min_px: int = 2, max_px: int = 1000, max_width: int = 12,
                width_inclusive: bool = True) -> DataFrame:
    """min_px < npixels < max_px and width <= max_width (or < for the demo crop)."""
    w = F.col("width") <= max_width if width_inclusive else F.col("width") < max_width
    return segs.filter((F.col("npixels") > min_px) & (F.col("npixels") < max_px) & w)


def layer_metrics(labelled: DataFrame, kept: DataFrame, group: Sequence[str], x: str, y: str,
                  v: str, eps: float = LAYER_EPS) -> DataFrame:
    """G7+G8+W7: blank kept segments, then per ping the centre of mass sum(sv*y)/sum(sv),
    the first depth where the running sum from the top exceeds ``eps`` (layer top) and
    the first from the bottom (layer base). Never reached -> NULL."""
    g = list(group)
    flagged = flag_in(labelled, kept.select(*g, "label"), [*g, "label"], "__kept")
    sv = flagged.withColumn("__sv", F.when(F.col("__kept"), F.lit(0.0)).otherwise(from_db(v)))
    ping = Window.partitionBy(*g, "xi")   # one ping's column: bounded by the depth axis
    down = ping.orderBy("yi").rowsBetween(Window.unboundedPreceding, 0)
    up = ping.orderBy(F.col("yi").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = sv.withColumns({"__cd": F.sum("__sv").over(down), "__cu": F.sum("__sv").over(up)})
    return cum.groupBy(*g, "xi").agg(
        F.min(x).alias("datetime"),
        weighted_mean(y, "__sv").alias("cm"),
        F.min(F.when(F.col("__cd") > eps, F.col(y))).alias("layertop"),
        F.max(F.when(F.col("__cu") > eps, F.col(y))).alias("layerbase")).drop("xi")
