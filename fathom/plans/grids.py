"""Segment detection on echogram grids and what is derived from it
(SURVEY G1-G9, Q1, Q2, Q3, Q13-Q15).

Two chains: segments as the reference has them, flooded by the watershed (``watershed_*``
and ``detect_*``), and the components of the mask alone. Both have their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import math as M
from fathom.functions import time as T
from fathom.operators import aggregates as A
from fathom.operators import grid as G
from fathom.operators import relational as R
from fathom.operators import sequence as S
from fathom.plans.catalog import query
from fathom.session import cut_lineage
from fathom.sources import files as FS
from fathom.sources import literals as L
from fathom.sources.views import SQL as VIEW_SQL
from fathom.sources.views import v_env, v_grid, with_views

GROUP = ["date"]
X, Y, V = "datetime", "depth", "Sv_mean"
SMOOTH_ROWS = 6 * 3 + 1
SUMMARY_MAX_BOTTOM = 200


# ------------------------------------------------------------------ pipeline pieces


def dense_grid(spark, sf, group=GROUP, grid: DataFrame | None = None) -> DataFrame:
    # the analogue grid is an aggregation of lineitem; densify reads it three times
    # (two axes and the cells), so it is written once, like a real gridded source table
    src = cut_lineage(grid if grid is not None else v_grid(spark, sf))
    return G.densify(src, group, X, Y, V)


def labelled_grid(spark, sf, use_watershed: bool, group=GROUP, grid=None,
                  shared: bool = True) -> DataFrame:
    """Dense grid with segment labels; when ``shared`` (segments AND layers read it) it is
    materialised once instead of being recomputed for each output."""
    lab = G.label_grid(dense_grid(spark, sf, group, grid), group, V, use_watershed)
    return cut_lineage(lab) if shared else lab


def segments(lab: DataFrame, use_watershed: bool, group=GROUP, width_inclusive=True) -> DataFrame:
    segs = G.segment_stats(lab, group, X, Y, V, include_background=use_watershed)
    return G.size_filter(segs, width_inclusive=width_inclusive)


def with_school_id(segs: DataFrame) -> DataFrame:
    return segs.withColumn("school_id", M.segment_id("date", "label"))


def layers(lab: DataFrame, kept: DataFrame, group=GROUP) -> DataFrame:
    return G.layer_metrics(lab, kept, group, X, Y, V).withColumn("hour", F.hour("datetime"))


def smooth_layers(lay: DataFrame) -> DataFrame:
    """Q14: 19-row centred mean (replicated ends) over the whole series in time order."""
    # one row a ping, from a window over all cells: written, so that the index reads the pings
    idx = S.with_row_index(cut_lineage(lay), ["datetime", "date"], "__rn")
    return S.moving_mean(idx, "__rn", ["cm", "layertop", "layerbase"], SMOOTH_ROWS).drop("__rn")


def daily_summary(kept: DataFrame) -> DataFrame:
    """Q1: per-day count, backscatter sum, mean and max depth on a calendar spine; dB."""
    s = kept.filter(F.col("bottom") < SUMMARY_MAX_BOTTOM)
    per_day = s.groupBy("date").agg(
        F.count(F.lit(1)).alias("nschools"), F.sum("total").alias("sa"),
        A.mean_strict("middle").alias("mean_depth"), F.max("bottom").alias("max_depth"))
    spine = L.date_spine(s, "date")
    out = spine.join(per_day, "date", "left").withColumns({
        "nschools": F.coalesce("nschools", F.lit(0)).cast("long"),
        "sa": F.coalesce("sa", F.lit(0.0))})
    return out.withColumn("sa_db", M.to_db("sa")).orderBy("date")


def migration(smoothed: DataFrame, summary: DataFrame) -> DataFrame:
    """Q2: noon vs midnight medians of the smoothed layer metrics per day, their
    differences, and the day's segment summary."""
    lab = smoothed.withColumn("hourlabel", M.hour_label("hour")).filter(F.col("hourlabel") != "other")
    # both medians in one distributed quantile pass over the stacked columns
    stacked = lab.select("date", "hourlabel", F.explode(F.array(
        F.struct(F.lit("cm").alias("m"), F.col("cm_smooth").alias("v")),
        F.struct(F.lit("layertop").alias("m"), F.col("layertop_smooth").alias("v")))).alias("__s")) \
        .select("date", "hourlabel", "__s.m", "__s.v")
    med = A.exact_quantiles(stacked, "v", {"med": 0.5}, ["date", "hourlabel", "m"], nulls="propagate")
    long = A.pivot_wide(med, ["date", "hourlabel"], "m", "med", ["cm", "layertop"])
    wide = A.pivot_wide(long, ["date"], "hourlabel", "cm", ["noon", "midnight"], "cm_").join(
        A.pivot_wide(long, ["date"], "hourlabel", "layertop", ["noon", "midnight"], "layertop_"), "date")
    wide = wide.withColumns({"delta_cm": F.col("cm_noon") - F.col("cm_midnight"),
                             "delta_layertop": F.col("layertop_noon") - F.col("layertop_midnight")})
    out = wide.join(summary, "date", "left")
    return out.withColumns({"nschools": F.coalesce("nschools", F.lit(0)).cast("long"),
                            "sa": F.coalesce("sa", F.lit(0.0)),
                            "sa_db": M.neg_inf_to_null("sa_db")})


def ocean_daily(spark, sf) -> DataFrame:
    """Q3 (first half): skip-null daily means of the ocean records; NaN upwelling -> NULL."""
    env = v_env(spark, sf).filter(F.col("date").isNotNull())
    return env.groupBy("date").agg(A.mean_skip("temperature").alias("temperature"),
                                   A.mean_skip("upwelling").alias("upwelling"),
                                   A.mean_skip("sealevel_lowpass").alias("sealevel")) \
        .withColumn("upwelling", M.nan_to_null("upwelling"))


def mask_chain(spark, sf, shared: bool = True):
    lab = labelled_grid(spark, sf, use_watershed=False, shared=shared)
    kept = segments(lab, use_watershed=False)
    return lab, kept


def flood_chain(spark, sf):
    """Segments as the reference has them: every cell is flooded to a marker."""
    lab = labelled_grid(spark, sf, use_watershed=True)
    return lab, segments(lab, use_watershed=True)


def migration_table(spark, sf, use_watershed: bool = False) -> DataFrame:
    lab, kept = flood_chain(spark, sf) if use_watershed else mask_chain(spark, sf)
    return migration(smooth_layers(layers(lab, kept)), daily_summary(kept))


# ------------------------------------------------------------------ oracle SQL

_DENSE = """
  xs AS (SELECT date, datetime, CAST(dense_rank() OVER (PARTITION BY date ORDER BY datetime) AS INTEGER) AS xi
         FROM (SELECT DISTINCT date, datetime FROM v_grid)),
  nxs AS (SELECT date, max(xi) AS nx FROM xs GROUP BY date),
  ys AS (SELECT date, depth, CAST(dense_rank() OVER (PARTITION BY date ORDER BY depth) AS INTEGER) AS yi
         FROM (SELECT DISTINCT date, depth FROM v_grid)),
  dense AS (SELECT xs.date, xs.datetime, ys.depth, xs.xi, ys.yi, nxs.nx,
                   CASE WHEN g.Sv_mean IS NULL OR g.Sv_mean < -90 THEN -90.0 ELSE g.Sv_mean END AS Sv_mean
            FROM xs JOIN nxs ON xs.date = nxs.date JOIN ys ON xs.date = ys.date
            LEFT JOIN v_grid g ON g.date = xs.date AND g.datetime = xs.datetime AND g.depth = ys.depth)"""

_CC = _DENSE + """,
  mcell AS (SELECT date, xi, yi, (yi - 1) * nx + xi AS lin FROM dense WHERE Sv_mean > -60),
  nb(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
  cc(date, xi, yi, lab) USING KEY (date, xi, yi) AS (
    SELECT date, xi, yi, lin FROM mcell
    UNION
    SELECT n.date, n.xi, n.yi, min(c.lab)
    FROM cc c CROSS JOIN nb JOIN mcell n ON n.date = c.date AND n.xi = c.xi + nb.dx AND n.yi = c.yi + nb.dy
    JOIN recurring.cc cur ON cur.date = n.date AND cur.xi = n.xi AND cur.yi = n.yi
    GROUP BY n.date, n.xi, n.yi HAVING min(c.lab) < min(cur.lab)),
  comps AS (SELECT date, xi, yi, CAST(dense_rank() OVER (PARTITION BY date ORDER BY lab) AS BIGINT) AS comp FROM cc)"""

_MASK_LABELS = """,
  labelled AS (SELECT d.*, coalesce(c.comp, 0) AS label FROM dense d
               LEFT JOIN comps c ON d.date = c.date AND d.xi = c.xi AND d.yi = c.yi)"""

# The flood: keys (level, generation, steps) by relaxation, then each cell hangs on its
# neighbour of least key and takes the label of the marker at the root. A cell is one number
# (image, yi, xi) and so is a key (rank of the level, generation, steps), 20 bits a part.
_FLOOD_LABELS = """,
  nb8(d) AS (SELECT dx + dy * 1048576 FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) t(dx, dy)),
  cellv AS MATERIALIZED (
    SELECT (dense_rank() OVER (ORDER BY d.date) << 40) + (d.yi::BIGINT << 20) + d.xi AS id, d.date, d.xi, d.yi,
           dense_rank() OVER (ORDER BY d.Sv_mean) AS v, c.comp
    FROM dense d LEFT JOIN comps c ON d.date = c.date AND d.xi = c.xi AND d.yi = c.yi),
  wk(id, k) USING KEY (id) AS (
    SELECT id, CASE WHEN comp IS NOT NULL THEN 0 ELSE 1::BIGINT << 61 END FROM cellv
    UNION
    SELECT n.id, min(CASE WHEN n.v > u.k >> 40 THEN n.v << 40 WHEN n.v = u.k >> 40 THEN ((u.k >> 20) + 1) << 20 ELSE u.k + 1 END) AS k
    FROM wk u CROSS JOIN nb8 JOIN cellv n ON n.id = u.id + nb8.d JOIN recurring.wk cur ON cur.id = n.id
    WHERE u.k < 1::BIGINT << 61
    GROUP BY n.id
    HAVING min(CASE WHEN n.v > u.k >> 40 THEN n.v << 40 WHEN n.v = u.k >> 40 THEN ((u.k >> 20) + 1) << 20 ELSE u.k + 1 END) < min(cur.k)),
  par AS MATERIALIZED (
    SELECT c.id, min({'k': u.k, 'id': u.id}) AS p FROM wk c CROSS JOIN nb8 JOIN wk u ON u.id = c.id + nb8.d
    WHERE c.k > 0 AND u.k < 1::BIGINT << 61 GROUP BY c.id),
  wl(id, label) AS (
    SELECT id, comp FROM cellv WHERE comp IS NOT NULL
    UNION ALL
    SELECT par.id, wl.label FROM wl JOIN par ON par.p.id = wl.id),
  labelled AS MATERIALIZED (SELECT d.*, coalesce(wl.label, 0) AS label FROM dense d
               JOIN cellv c ON d.date = c.date AND d.xi = c.xi AND d.yi = c.yi LEFT JOIN wl ON wl.id = c.id)"""

_SEGS = """,
  segs AS (SELECT date, label, max(depth) AS bottom, min(depth) AS top, min(xi) AS "left", max(xi) AS "right",
                  max(yi) - min(yi) + 1 AS height, max(xi) - min(xi) + 1 AS width, count(*) AS npixels,
                  avg(pow(10.0, Sv_mean / 10)) AS mean, stddev_samp(pow(10.0, Sv_mean / 10)) AS std,
                  avg(pow(10.0, Sv_mean / 10)) * count(*) AS total, min(datetime) AS start_time,
                  (max(depth) + min(depth)) / 2 AS middle
           FROM labelled WHERE label >= {least} GROUP BY date, label),
  kept AS (SELECT * FROM segs WHERE npixels > 2 AND npixels < 1000 AND width <= 12)"""

_COMPS = _CC + _MASK_LABELS + _SEGS.format(least=1)
_FLOODED = _CC + _FLOOD_LABELS + _SEGS.format(least=0)

_LAYER_CTES = """,
  blank AS (SELECT l.*, CASE WHEN k.label IS NOT NULL THEN 0.0 ELSE pow(10.0, l.Sv_mean / 10) END AS sv
            FROM labelled l LEFT JOIN kept k ON l.date = k.date AND l.label = k.label),
  cum AS (SELECT *, sum(sv) OVER (PARTITION BY date, xi ORDER BY yi ROWS UNBOUNDED PRECEDING) AS cd,
                 sum(sv) OVER (PARTITION BY date, xi ORDER BY yi DESC ROWS UNBOUNDED PRECEDING) AS cu FROM blank),
  layers AS (SELECT date, min(datetime) AS datetime,
                    CASE WHEN sum(sv) <> 0 THEN sum(sv * depth) / sum(sv) ELSE 'NaN'::DOUBLE END AS cm,
                    min(CASE WHEN cd > 1e-6 THEN depth END) AS layertop,
                    max(CASE WHEN cu > 1e-6 THEN depth END) AS layerbase,
                    CAST(hour(min(datetime)) AS INTEGER) AS hour
             FROM cum GROUP BY date, xi)"""


def _smooth_sql(c: str) -> str:
    full = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return (f"CASE WHEN count({c}) OVER w = count(*) OVER w THEN (sum({c}) OVER w"
            # an end's value counts only in windows that reach over it: 0 * NaN would be NaN
            f" + CASE WHEN rn < 10 THEN (10 - rn) * first_value({c}) OVER (ORDER BY rn {full}) ELSE 0 END"
            f" + CASE WHEN rn + 9 > N THEN (rn + 9 - N) * last_value({c}) OVER (ORDER BY rn {full}) ELSE 0 END) / 19 END AS {c}_smooth")


_LAYERS, _WS_LAYERS = _COMPS + _LAYER_CTES, _FLOODED + _LAYER_CTES

_SUMMARY_CTES = f""",
  sk AS (SELECT * FROM kept WHERE bottom < {SUMMARY_MAX_BOTTOM}),
  days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sk),
  per_day AS (SELECT date, count(*) AS nschools, sum(total) AS sa,
                     CASE WHEN count(middle) = count(*) THEN avg(middle) END AS mean_depth,
                     max(bottom) AS max_depth FROM sk GROUP BY date),
  summary AS (SELECT days.date, coalesce(p.nschools, 0) AS nschools, coalesce(p.sa, 0.0) AS sa,
                     p.mean_depth, p.max_depth,
                     CASE WHEN coalesce(p.sa, 0.0) = 0 THEN '-Infinity'::DOUBLE ELSE 10 * log10(coalesce(p.sa, 0.0)) END AS sa_db
              FROM days LEFT JOIN per_day p ON days.date = p.date),
  lr AS (SELECT *, row_number() OVER (ORDER BY datetime, date) AS rn, count(*) OVER () AS N FROM layers),
  smoothed AS (SELECT date, datetime, cm, layertop, layerbase, hour, {_smooth_sql("cm")}, {_smooth_sql("layertop")},
                      {_smooth_sql("layerbase")}
               FROM lr WINDOW w AS (ORDER BY rn ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)),
  hl AS (SELECT *, CASE WHEN hour IN (12, 13, 14) THEN 'noon' WHEN hour IN (0, 1, 2) THEN 'midnight'
                        ELSE 'other' END AS hourlabel FROM smoothed),
  mig0 AS (SELECT date, hourlabel,
                  CASE WHEN count(CASE WHEN NOT isnan(cm_smooth) THEN 1 END) = count(*) THEN quantile_cont(cm_smooth, 0.5) END AS cm,
                  CASE WHEN count(layertop_smooth) = count(*) THEN quantile_cont(layertop_smooth, 0.5) END AS layertop
           FROM hl WHERE hourlabel <> 'other' GROUP BY date, hourlabel),
  mig1 AS (SELECT date, max(CASE WHEN hourlabel = 'noon' THEN cm END) AS cm_noon,
                  max(CASE WHEN hourlabel = 'midnight' THEN cm END) AS cm_midnight,
                  max(CASE WHEN hourlabel = 'noon' THEN layertop END) AS layertop_noon,
                  max(CASE WHEN hourlabel = 'midnight' THEN layertop END) AS layertop_midnight
           FROM mig0 GROUP BY date),
  migration AS (SELECT m.*, m.cm_noon - m.cm_midnight AS delta_cm, m.layertop_noon - m.layertop_midnight AS delta_layertop,
                       coalesce(s.nschools, 0) AS nschools, coalesce(s.sa, 0.0) AS sa, s.mean_depth, s.max_depth,
                       CASE WHEN s.sa_db = '-Infinity'::DOUBLE THEN NULL ELSE s.sa_db END AS sa_db
                FROM mig1 m LEFT JOIN summary s ON m.date = s.date)"""

_SUMMARY, _WS_SUMMARY = _LAYERS + _SUMMARY_CTES, _WS_LAYERS + _SUMMARY_CTES

_OCEAN_CTES = """,
  oc AS (SELECT date, avg(temperature) AS temperature,
                CASE WHEN isnan(avg(upwelling)) THEN NULL ELSE avg(upwelling) END AS upwelling,
                avg(sealevel_lowpass) AS sealevel
         FROM v_env WHERE date IS NOT NULL GROUP BY date),
  ocean AS (SELECT oc.temperature, oc.upwelling, oc.sealevel, m.* FROM oc RIGHT JOIN migration m ON oc.date = m.date)"""


_OCEAN, _WS_OCEAN = _SUMMARY + _OCEAN_CTES, _WS_SUMMARY + _OCEAN_CTES


def grid_sql(body: str, cte: str = _COMPS, views=("v_grid",)) -> str:
    sql = f"WITH RECURSIVE {cte}\n{body}"
    return with_views(sql, *views) if views else sql


# ------------------------------------------------------------------ queries


@query("densify", ops="G1 W11 P12", sql=grid_sql(
    "SELECT date, datetime, depth, xi, yi, nx, Sv_mean FROM dense", _DENSE))
def q_densify(spark, sf):
    return dense_grid(spark, sf).select("date", "datetime", "depth", "xi", "yi", "nx", "Sv_mean")


@query("grid_mask", ops="G2 M1", sql=grid_sql("""
    SELECT date, xi, yi, Sv_mean > -60 AS mask, pow(10.0, Sv_mean / 10) AS sv FROM dense""", _DENSE))
def q_grid_mask(spark, sf):
    return G.with_mask(dense_grid(spark, sf), V).select("date", "xi", "yi", "mask",
                                                       M.from_db(V).alias("sv"))


@query("components", ops="G3", sql=grid_sql("SELECT date, xi, yi, comp FROM comps"))
def q_components(spark, sf):
    return G.components(G.with_mask(dense_grid(spark, sf), V), GROUP)


@query("watershed", ops="G4", sql=grid_sql("SELECT date, xi, yi, label FROM labelled", _FLOODED))
def q_watershed(spark, sf):
    return labelled_grid(spark, sf, use_watershed=True, shared=False).select("date", "xi", "yi", "label")


@query("segment_stats", ops="A11 G5 J9 J10 A8", sql=grid_sql("SELECT * FROM segs"))
def q_segment_stats(spark, sf):
    lab = labelled_grid(spark, sf, use_watershed=False, shared=False)
    return G.segment_stats(lab, GROUP, X, Y, V, include_background=False)


@query("segment_filter", ops="G6 M8", sql=grid_sql(
    "SELECT *, CAST(date AS VARCHAR) || '-S' || CAST(label AS VARCHAR) AS school_id FROM kept"))
def q_segment_filter(spark, sf):
    _, kept = mask_chain(spark, sf, shared=False)
    return with_school_id(kept)


@query("center_of_mass", ops="G7 A12 P9", sql=grid_sql(
    "SELECT date, datetime, cm FROM layers", _LAYERS))
def q_center_of_mass(spark, sf):
    lab, kept = mask_chain(spark, sf)
    return layers(lab, kept).select("date", "datetime", "cm")


@query("layer_edges", ops="W7 O2", sql=grid_sql(
    "SELECT date, datetime, layertop, layerbase FROM layers", _LAYERS))
def q_layer_edges(spark, sf):
    lab, kept = mask_chain(spark, sf)
    return layers(lab, kept).select("date", "datetime", "layertop", "layerbase")


@query("layer_metrics", ops="G8 D8", sql=grid_sql("SELECT * FROM layers", _LAYERS))
def q_layer_metrics(spark, sf):
    lab, kept = mask_chain(spark, sf)
    return layers(lab, kept)


@query("daily_summary", ops="Q1 P6 A1 A2 A3 A5 S9 J1 P14 M2 O1", sql=grid_sql(
    "SELECT * FROM summary ORDER BY date", _SUMMARY))
def q_daily_summary(spark, sf):
    _, kept = mask_chain(spark, sf, shared=False)
    return daily_summary(kept)


@query("smoothed_layers", ops="Q14 W1 W10", sql=grid_sql(
    "SELECT date, datetime, cm, layertop, layerbase, hour, cm_smooth, layertop_smooth, layerbase_smooth FROM smoothed",
    _SUMMARY))
def q_smoothed_layers(spark, sf):
    lab, kept = mask_chain(spark, sf)
    return smooth_layers(layers(lab, kept))


@query("migration", ops="Q2 P15 A6 A20 J2 J3 P14 M6", sql=grid_sql("SELECT * FROM migration", _SUMMARY))
def q_migration(spark, sf):
    return migration_table(spark, sf)


@query("environment_join", ops="Q3 P10 A4 P14 J4", sql=grid_sql(
    "SELECT * FROM ocean", _OCEAN, views=("v_grid", "v_env")))
def q_environment_join(spark, sf):
    return ocean_daily(spark, sf).join(migration_table(spark, sf), "date", "right")


# -- the reference's own chain: watershed segments


@query("detect_segments", ops="G9 G4 M8", sql=grid_sql(
    "SELECT *, CAST(date AS VARCHAR) || '-S' || CAST(label AS VARCHAR) AS school_id FROM kept", _FLOODED))
def q_detect_segments(spark, sf):
    lab = labelled_grid(spark, sf, use_watershed=True, shared=False)
    return with_school_id(segments(lab, use_watershed=True))


_SMOOTH_COLS = "date, datetime, cm, layertop, layerbase, hour, cm_smooth, layertop_smooth, layerbase_smooth"


@query("detect_layers", ops="G9 Q14", sql=grid_sql(f"SELECT {_SMOOTH_COLS} FROM smoothed", _WS_SUMMARY))
def q_detect_layers(spark, sf):
    lab = labelled_grid(spark, sf, use_watershed=True)
    return smooth_layers(layers(lab, segments(lab, use_watershed=True)))


@query("watershed_summary", ops="Q1 G9", sql=grid_sql("SELECT * FROM summary ORDER BY date", _WS_SUMMARY))
def q_watershed_summary(spark, sf):
    lab = labelled_grid(spark, sf, use_watershed=True, shared=False)
    return daily_summary(segments(lab, use_watershed=True))


@query("watershed_migration", ops="Q2 Q13", sql=grid_sql("SELECT * FROM migration", _WS_SUMMARY))
def q_watershed_migration(spark, sf):
    return migration_table(spark, sf, use_watershed=True)


@query("watershed_environment", ops="Q3", sql=grid_sql("SELECT * FROM ocean", _WS_OCEAN, views=("v_grid", "v_env")))
def q_watershed_environment(spark, sf):
    return ocean_daily(spark, sf).join(migration_table(spark, sf, use_watershed=True), "date", "right")


# -- Q13: detection over files as written


FILE_GROUP = ["file", "date"]
DETECT_DEPTHS = (15, 500)


def detect(grid: DataFrame, group=GROUP, width_inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    """G9 for every image of ``grid``: (kept segments with their ids, layer metrics of every ping).
    ``group`` names what makes an image; the labelled grid is written once."""
    src = cut_lineage(grid)
    lab = cut_lineage(G.label_grid(G.densify(src, group, X, Y, V), group, V))
    kept = segments(lab, True, group, width_inclusive)
    return with_school_id(kept), layers(lab, kept, group)


def detect_files(spark, path: str, depths=DETECT_DEPTHS, unit: str = "([^/]+)$") -> tuple[DataFrame, DataFrame]:
    """Q13: detection over a directory of grid exports, each file read by its own header and cut into
    images by itself: a local day that two files share is two images, with labels of their own.

    ``file`` is what ``unit`` finds in a file's path; by default its name. A folder can so stand for
    one export that was written in parts."""
    from fathom.plans.tables import grid_columns
    rows = FS.read_dir(spark, path, FS.GRID_CSV, glob="*.csv", name="file", full_path=True)
    rows = rows.filter(F.col("Layer_depth_min").between(*depths))
    grid = rows.select(F.regexp_extract("file", unit, 1).alias("file"), *grid_columns()).drop("hour")
    return detect(grid, FILE_GROUP)


def smooth_files(lay: DataFrame) -> DataFrame:
    """Q14 over the layers of all files, one behind the other in order of their names."""
    idx = S.with_row_index(cut_lineage(lay), ["file", "date", "datetime"], "__rn")
    return S.moving_mean(idx, "__rn", ["cm", "layertop", "layerbase"], SMOOTH_ROWS).drop("__rn")


# Pings every 3 hours: on the local clock the last ones of a month belong to the next month's file.
_CRUISE = VIEW_SQL["v_grid"].replace("l_linenumber * 2", "l_linenumber * 3")
_FILE_IMAGES = f"""
  SELECT datetime, depth, Sv_mean, CAST(datetime AS DATE) AS day, strftime(datetime + INTERVAL 8 HOUR, '%Y-%m') AS file
  FROM v_grid0 WHERE depth BETWEEN {DETECT_DEPTHS[0]} AND {DETECT_DEPTHS[1]}"""


def _by_file(sql: str) -> str:
    """The detection SQL over images (file, day): ``date`` there is a number of the image."""
    views = f"""v_grid0 AS ({_CRUISE}), cells AS ({_FILE_IMAGES}),
      images AS MATERIALIZED (SELECT file, day, row_number() OVER (ORDER BY file, day) AS date FROM (SELECT DISTINCT file, day FROM cells)),
      v_grid AS MATERIALIZED (SELECT images.date, cells.datetime, cells.depth, cells.Sv_mean FROM cells JOIN images USING (file, day)),"""
    return sql.replace("WITH RECURSIVE", f"WITH RECURSIVE {views}", 1)


def cruise(spark, sf) -> DataFrame:
    """The test grid with pings at ship date + 3 h x line number."""
    return v_grid(spark, sf, ping_hours=3)


def export_files(spark, sf) -> str:
    """The cruise as monthly exports on the UTC clock, each file's columns in one of three orders."""
    from fathom.plans.tables import export_columns, scratch
    path = scratch(spark)
    utc = cruise(spark, sf).withColumn("__month", F.date_format(T.shift_hours("datetime", 8), "yyyy-MM")).select(
        "__month", *export_columns())
    utc = cut_lineage(utc)
    names = [c for c in utc.columns if c != "__month"]
    for k in range(3):
        part = utc.filter(F.month(F.to_date("__month", "yyyy-MM")) % 3 == k).withColumnRenamed("__month", "month")
        part.select("month", *names[k:], *names[:k]).repartition("month").write.mode("append").partitionBy("month").option(
            "header", "true").option("nullValue", "NA").csv(path)
    return path


MONTH = "month=([^/]+)/"


@query("detect_files", ops="Q13 S1 S2 G9 P4", sql=_by_file(grid_sql("""
    SELECT images.file, day AS date, label, bottom, top, "left", "right", height, width, npixels, mean, std, total, start_time, middle,
           CAST(day AS VARCHAR) || '-S' || CAST(label AS VARCHAR) AS school_id
    FROM kept JOIN images ON images.date = kept.date""", _FLOODED, views=())))
def q_detect_files(spark, sf):
    """Monthly CSV exports with columns in different orders: depths from 15 to 500, the date of the
    local clock, one image for each file and local day."""
    return detect_files(spark, export_files(spark, sf), unit=MONTH)[0]


@query("detect_files_layers", ops="Q13 Q14 G8", sql=_by_file(grid_sql(f"""
    SELECT images.file, day AS date, datetime, cm, layertop, layerbase, hour, cm_smooth, layertop_smooth, layerbase_smooth
    FROM smoothed JOIN images ON images.date = smoothed.date""", _WS_SUMMARY.replace(
        "row_number() OVER (ORDER BY datetime, date) AS rn", "row_number() OVER (ORDER BY date, datetime) AS rn"), views=())))
def q_detect_files_layers(spark, sf):
    """The layer metrics of the same images, smoothed along the files."""
    return smooth_files(detect_files(spark, export_files(spark, sf), unit=MONTH)[1])


# -- Q15: a few days as one image

DEMO = ("1996-01-01 00:00:00", "1996-04-01 00:00:00", 300)

_DEMO_GRID = f"""
  SELECT min(CAST(datetime AS DATE)) OVER () AS date, datetime, depth, Sv_mean FROM v_grid0
  WHERE datetime > TIMESTAMP '{DEMO[0]}' AND datetime < TIMESTAMP '{DEMO[1]}' AND depth < {DEMO[2]}"""


def _demo_sql(body: str, cte: str) -> str:
    sql = grid_sql(body, cte.replace("width <= 12", "width < 12"), views=())
    return sql.replace("WITH RECURSIVE", f"WITH RECURSIVE v_grid0 AS ({VIEW_SQL['v_grid']}), v_grid AS ({_DEMO_GRID}),", 1)


def demo(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The demo crop as ONE image (no per-day grouping): a time window, depth < 300 and
    width < 12; ``date`` is the crop's first date. The watershed's tiles spread it over tasks."""
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in DEMO[:2])
    crop = v_grid(spark, sf).filter(R.between_open("datetime", lo, hi) & (F.col("depth") < DEMO[2])).drop("date")
    one = R.with_scalar(crop, crop.agg(F.min(F.to_date("datetime")).alias("date")))
    lab = labelled_grid(spark, sf, use_watershed=True, grid=one)
    return lab, segments(lab, use_watershed=True, width_inclusive=False)


@query("detect_demo", ops="Q15 P4", sql=_demo_sql(
    "SELECT *, CAST(date AS VARCHAR) || '-S' || CAST(label AS VARCHAR) AS school_id FROM kept", _FLOODED))
def q_detect_demo(spark, sf):
    return with_school_id(demo(spark, sf)[1])


@query("detect_demo_layers", ops="Q15 G8", sql=_demo_sql("SELECT date, datetime, cm, layertop, layerbase FROM layers", _WS_LAYERS))
def q_detect_demo_layers(spark, sf):
    return layers(*demo(spark, sf)).drop("hour")
