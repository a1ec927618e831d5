"""Echogram extraction: crops, overlays and transition windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import math as M
from fathom.functions import time as T
from fathom.operators import relational as R
from fathom.plans.catalog import query
from fathom.plans.grids import _WS_SUMMARY, flood_chain, grid_sql, layers, smooth_layers
from fathom.sources import literals as L
from fathom.sources.views import table, v_grid, with_views

PROP = 0.25
# transition windows: outer start, inner start, inner end, outer end
WINDOWS = [
    ("1996-04-01 00:00", "1996-04-06 00:00", "1996-04-09 00:00", "1996-04-14 00:00"),
    ("1999-08-16 00:00", "1999-08-21 00:00", "1999-08-24 00:00", "1999-08-29 00:00"),
]
FIG_TIME = ("1997-03-06 22:00", "1997-03-20 01:00")
FIG_DEPTH = (700, 300)


def echo_frame(spark, sf) -> DataFrame:
    """The plotting reader: positive depths, values below -90 dB raised to -90 (NULL kept)."""
    g = v_grid(spark, sf).withColumn("datetime_round", F.col("datetime"))
    return g.filter(F.col("depth") > 0).withColumn("Sv_mean", M.floor_clamp("Sv_mean", -90, False))


def click_series(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderdate").alias("datetime")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def rescale_overlay(echo: DataFrame, clicks: DataFrame, key: str = "date") -> DataFrame:
    """Per image, clicks strictly inside its time limits, rescaled onto its
    depth axis (-range*prop*n/nmax + dmax - 1), plus the secondary-axis inverse."""
    lim = echo.groupBy(key).agg(F.min("datetime_round").alias("tmin"), F.max("datetime_round").alias("tmax"),
                                F.min("depth").alias("dmin"), F.max("depth").alias("dmax"))
    c = clicks.withColumn(key, T.month_start("datetime"))
    # equi-join on the image key, then the strict time window
    inside = c.join(lim, key).filter(R.between_open("datetime", F.col("tmin"), F.col("tmax")))
    nmax = inside.groupBy(key).agg(F.max("n").alias("nmax"))
    out = inside.join(nmax, key).withColumn("depth", M.rescale("n", "nmax", "dmin", "dmax", PROP))
    return out.select(key, "datetime", "n", "depth",
                      M.unscale("depth", "nmax", "dmin", "dmax", PROP).alias("n_axis"))


def bounds(spark) -> DataFrame:
    rows = [tuple(dt.datetime.strptime(s, "%Y-%m-%d %H:%M") for s in w) for w in WINDOWS]
    return L.intervals(spark, rows)


def transition_windows(spark, echo: DataFrame) -> DataFrame:
    """Cells of the fine (2-min) grid inside each inner window and of the coarse
    (10-min) grid inside each outer window; lower bound on the ping time, upper bound on
    the re-binned, local-time column."""
    b = bounds(spark)
    fine = echo.withColumn("datetime_round", T.shift_hours(T.floor_time("datetime", "2 minutes"), -8))
    coarse = echo.withColumn("datetime_round", T.shift_hours(T.floor_time("datetime", "10 minutes"), -8))
    inner = R.interval_join(fine, b, "datetime", "datetime_round", "inner_start", "inner_end") \
        .withColumn("ring", F.lit("inner"))
    outer = R.interval_join(coarse, b, "datetime", "datetime_round", "outer_start", "outer_end") \
        .withColumn("ring", F.lit("outer"))
    cols = [T.year_month("inner_start").alias("window"), "ring", "datetime", "datetime_round", "depth",
            M.squish("Sv_mean", -85, -55).alias("Sv_mean")]
    return inner.select(*cols).unionByName(outer.select(*cols))


def _bounds_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"TIMESTAMP '{s}:00'" for s in w) + ")" for w in WINDOWS)
    return f"b(outer_start, inner_start, inner_end, outer_end) AS (VALUES {rows})"


_ECHO_SQL = "echo AS (SELECT *, datetime AS datetime_round FROM v_grid WHERE depth > 0)"


@query("rescale_overlay", ops="Q11 M7 J7 P4", sql=with_views(f"""
    WITH {_ECHO_SQL},
      lim AS (SELECT date, min(datetime_round) AS tmin, max(datetime_round) AS tmax,
                     min(depth) AS dmin, max(depth) AS dmax FROM echo GROUP BY date),
      c AS (SELECT o_orderdate AS datetime, CAST(count(*) AS DOUBLE) AS n,
                   CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders GROUP BY o_orderdate),
      inside AS (SELECT c.*, lim.tmin, lim.tmax, lim.dmin, lim.dmax FROM c JOIN lim USING (date)
                 WHERE c.datetime > lim.tmin AND c.datetime < lim.tmax),
      nm AS (SELECT date, max(n) AS nmax FROM inside GROUP BY date),
      r AS (SELECT inside.*, nm.nmax, -(dmax - dmin) * {PROP} * n / nmax + dmax - 1 AS depth
            FROM inside JOIN nm USING (date))
    SELECT date, datetime, n, depth, (depth - dmax) * -nmax / (dmax - dmin) / {PROP} AS n_axis FROM r""",
                                                   "v_grid"))
def q_rescale_overlay(spark, sf):
    return rescale_overlay(echo_frame(spark, sf), click_series(spark, sf))


@query("echogram_cells", ops="Q11 P12 P13 P19", sql=with_views(f"""
    WITH {_ECHO_SQL}
    SELECT date, datetime_round, depth,
           CASE WHEN Sv_mean < -90 THEN -90.0 ELSE Sv_mean END AS Sv_raw,
           least(greatest(CASE WHEN Sv_mean < -90 THEN -90.0 ELSE Sv_mean END, -90.0), -60.0) AS Sv_fill
    FROM echo
    WHERE datetime_round BETWEEN TIMESTAMP '{FIG_TIME[0]}:00' AND TIMESTAMP '{FIG_TIME[1]}:00'
      AND depth BETWEEN {min(FIG_DEPTH)} AND {max(FIG_DEPTH)}""", "v_grid"))
def q_echogram_cells(spark, sf):
    lo, hi = (F.lit(f"{t}:00").cast("timestamp_ntz") for t in FIG_TIME)
    e = echo_frame(spark, sf).filter(F.col("datetime_round").between(lo, hi))
    e = R.crop(e, "datetime_round", "depth", None, FIG_DEPTH)
    return e.select("date", "datetime_round", "depth", F.col("Sv_mean").alias("Sv_raw"),
                    M.squish("Sv_mean", -90, -60).alias("Sv_fill"))


@query("interval_join", ops="Q12 S10 J8 D7 D2 P13 D10", sql=with_views(f"""
    WITH {_ECHO_SQL}, {_bounds_sql()},
      fine AS (SELECT *, time_bucket(INTERVAL '2 minutes', datetime) - INTERVAL 8 HOUR AS dr FROM echo),
      coarse AS (SELECT *, time_bucket(INTERVAL '10 minutes', datetime) - INTERVAL 8 HOUR AS dr FROM echo)
    SELECT strftime(b.inner_start, '%Y-%m') AS window, 'inner' AS ring, f.datetime, f.dr AS datetime_round,
           f.depth, least(greatest(f.Sv_mean, -85.0), -55.0) AS Sv_mean
    FROM fine f JOIN b ON f.datetime > b.inner_start AND f.dr < b.inner_end
    UNION ALL
    SELECT strftime(b.inner_start, '%Y-%m'), 'outer', c.datetime, c.dr, c.depth, least(greatest(c.Sv_mean, -85.0), -55.0)
    FROM coarse c JOIN b ON c.datetime > b.outer_start AND c.dr < b.outer_end""", "v_grid"))
def q_interval_join(spark, sf):
    return transition_windows(spark, echo_frame(spark, sf))


@query("transition_layertop", ops="Q12 Q14 J8", sql=grid_sql(f"""
    SELECT strftime(b.inner_start, '%Y-%m') AS window, s.datetime, s.layertop_smooth,
           s.datetime > b.inner_start AND s.datetime < b.inner_end AS inner_window
    FROM smoothed s JOIN b ON s.datetime > b.outer_start AND s.datetime < b.outer_end""", _WS_SUMMARY + ", " + _bounds_sql()))
def q_transition_layertop(spark, sf):
    """The line over the transition panels: smoothed layer top inside the nested windows."""
    lab, kept = flood_chain(spark, sf)
    s = smooth_layers(layers(lab, kept)).select("datetime", "layertop_smooth")
    j = R.interval_join(s, bounds(spark), "datetime", "datetime", "outer_start", "outer_end")
    return j.select(T.year_month("inner_start").alias("window"), "datetime", "layertop_smooth",
                    R.between_open("datetime", F.col("inner_start"), F.col("inner_end")).alias("inner_window"))


@query("interval_layer", ops="Q12 J8 A12", sql=with_views(f"""
    WITH {_bounds_sql()},
      cm AS (SELECT datetime, sum(pow(10.0, Sv_mean / 10) * depth) / sum(pow(10.0, Sv_mean / 10)) AS cm
             FROM v_grid GROUP BY datetime)
    SELECT strftime(b.inner_start, '%Y-%m') AS window, cm.datetime, cm.cm,
           cm.datetime > b.inner_start AND cm.datetime < b.inner_end AS inner_window
    FROM cm JOIN b ON cm.datetime > b.outer_start AND cm.datetime < b.outer_end""", "v_grid"))
def q_interval_layer(spark, sf):
    from fathom.operators.aggregates import weighted_mean
    g = v_grid(spark, sf)
    cm = g.groupBy("datetime").agg(weighted_mean("depth", M.from_db("Sv_mean")).alias("cm"))
    j = R.interval_join(cm, bounds(spark), "datetime", "datetime", "outer_start", "outer_end")
    return j.select(T.year_month("inner_start").alias("window"), "datetime", "cm",
                    R.between_open("datetime", F.col("inner_start"), F.col("inner_end")).alias("inner_window"))


_WATCHES = """
  SELECT o_orderkey AS watch, o_orderdate - INTERVAL 1 DAY AS opens,
         o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 97 = 0 THEN 400 ELSE 1 + o_orderkey % 5 END AS INTEGER)) AS closes FROM orders"""


@query("interval_index", ops="J8", sql=f"""
    SELECT watch, count(*) AS pings, min(l_shipdate) AS first_ping, sum(l_quantity) AS quantity
    FROM lineitem JOIN ({_WATCHES}) ON l_shipdate > opens AND l_shipdate < closes GROUP BY watch""")
def q_interval_index(spark, sf):
    """As many overlapping windows as there are orders, a few days long and some over a year: cells are
    found through the index of intervals, in totals of cells."""
    days = F.when(F.col("o_orderkey") % 97 == 0, 400).otherwise(1 + F.col("o_orderkey") % 5).cast("int")
    watches = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("watch"), F.timestamp_add("DAY", F.lit(-1), "o_orderdate").alias("opens"),
        F.timestamp_add("DAY", days, "o_orderdate").alias("closes"))
    pings = table(spark, sf, "lineitem").select("l_shipdate", "l_quantity")
    j = R.interval_join(pings, watches, "l_shipdate", "l_shipdate", "opens", "closes", totals={
        "pings": (F.lit(1), "sum"), "first_ping": (F.col("l_shipdate"), "min"), "quantity": (F.col("l_quantity"), "sum")})
    return j.groupBy("watch").agg(F.sum("pings").alias("pings"), F.min("first_ping").alias("first_ping"), F.sum("quantity").alias("quantity"))
