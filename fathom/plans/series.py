"""Count-series and layer-series analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import time as T
from fathom.operators import aggregates as A
from fathom.operators import relational as R
from fathom.operators import sequence as S
from fathom.plans.catalog import query
from fathom.session import cut_lineage
from fathom.sources.views import v_count, v_grid, v_layer, v_user, with_views

LAYER_SHIFT_HOURS = -8   # the layer table is stored in UTC, the click series in local time
BOUT_QUANTILE = 0.95
DILATE_BACK, DILATE_AHEAD = 4, 1
BOUT_CUTOFF_SECONDS = 250 * 60


# ------------------------------------------------------------------ operators


def layer_series(spark, sf) -> DataFrame:
    lay = v_layer(spark, sf)
    return lay.withColumn("datetime_round", T.shift_hours("datetime_round", LAYER_SHIFT_HOURS))


def series_diff_join(clicks: DataFrame, layer: DataFrame) -> DataFrame:
    """Q4: first differences of both series, left-joined on the time key, layer-less rows dropped."""
    c = S.diff0(S.with_row_index(clicks.select("datetime_round", "n"), ["datetime_round"], "__rn"),
                "__rn", ["n"]).drop("__rn")
    lyr = S.diff0(S.with_row_index(layer.select("datetime_round", "layer_base", "center_of_mass"),
                                   ["datetime_round"], "__rn"),
                  "__rn", ["layer_base", "center_of_mass"]).drop("__rn")
    return c.join(lyr, "datetime_round", "left").filter(F.col("layer_base").isNotNull())


def label_bouts(clicks: DataFrame, q: float = BOUT_QUANTILE, back: int = DILATE_BACK,
                ahead: int = DILATE_AHEAD) -> DataFrame:
    """Q5 (first half): global q-quantile threshold, dilated exceedance flag, run labels."""
    thr = cut_lineage(A.exact_quantiles(clicks, "n", {"bout_thresh": q}))   # one row, whatever the input
    idx = S.with_row_index(clicks, ["datetime_round"], "__rn").crossJoin(F.broadcast(thr))
    flagged = idx.withColumn("__x", F.col("n") > F.col("bout_thresh"))
    dil = S.dilate(flagged, "__rn", "__x", "bout", back, ahead)
    return S.label_runs(dil, "__rn", "bout", "bout_label").drop("__rn", "__x")


def bout_rows(labelled: DataFrame, layer: DataFrame) -> DataFrame:
    """Q5 (second half): bout rows with seconds since bout start and depth relative to the
    bout's first row; rows past the cutoff or with any null dropped."""
    rows = R.natural_left_join(labelled.filter("bout"), layer)
    # per-bout start time and first layer depth: aggregates, not partitioned windows
    starts = rows.groupBy("bout_label").agg(
        F.min("datetime_round").alias("__t0"),
        F.min_by("layer_base", "datetime_round").alias("__d0"))
    out = rows.join(starts, "bout_label").select(
        *rows.columns,
        F.timestamp_diff("SECOND", F.col("__t0"), F.col("datetime_round")).cast("double").alias("bout_time"),
        (F.col("layer_base") - F.col("__d0")).alias("rel_depth"))
    out = out.filter(F.col("year").isNotNull() & (F.col("bout_time") <= BOUT_CUTOFF_SECONDS))
    return out.dropna("any")


def bout_profile(rows: DataFrame) -> DataFrame:
    """Q6: depth change by elapsed time: quantile bands of -rel_depth, sd/n, count."""
    rows = cut_lineage(rows.select("bout_time", "rel_depth"))   # read by every pass of the quantiles
    neg = rows.select("bout_time", (-F.col("rel_depth")).alias("neg_rel"))
    qs = A.exact_quantiles(neg, "neg_rel", {"q25": 0.25, "q75": 0.75, "q40": 0.40, "q60": 0.60,
                                            "rel_depth": 0.5}, ["bout_time"])
    basic = rows.groupBy("bout_time").agg(A.sd_over_n("rel_depth").alias("se"),
                                          F.count(F.lit(1)).alias("n"))
    return basic.join(qs, "bout_time")


def bout_table(rows: DataFrame) -> DataFrame:
    """Q7: one row per bout: extent (local and UTC), clicks, path length, max change,
    initial dive speed (2nd value / 20), duration, date and fractional hour."""
    # the rows of bouts are few beside the series, and dear to find: written once
    idx = S.with_row_index(cut_lineage(rows.select("bout_label", "datetime_round", "n", "rel_depth")),
                           ["bout_label", "datetime_round"], "__rn")

    def build(w):
        l1 = F.lag("bout_label", 1).over(w)
        l2 = F.lag("bout_label", 2).over(w)
        same1 = l1.isNotNull() & (l1 == F.col("bout_label"))
        return {
            "__step": F.when(same1, F.abs(F.col("rel_depth") - F.lag("rel_depth", 1).over(w))),
            "__second": same1 & (l2.isNull() | (l2 != F.col("bout_label"))),
        }

    steps = S.block_window(idx, "__rn", 2, 0, build)
    start, end = F.min("datetime_round"), T.shift_minutes(F.max("datetime_round"), 10)
    b = steps.groupBy("bout_label").agg(
        start.alias("bout_start"), end.alias("bout_end"),
        T.shift_hours(start, 8).alias("bout_start_utc"), T.shift_hours(end, 8).alias("bout_end_utc"),
        F.sum("n").alias("nclicks"),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("layerdist"),
        F.max("rel_depth").alias("maxchange"),
        (F.max(F.when(F.col("__second"), F.col("rel_depth"))) / 20).alias("init_dive_speed"),
        F.when(F.count("__step") == F.count(F.lit(1)) - 1,
               F.coalesce(F.sum("__step"), F.lit(0.0))).alias("distance"))
    return b.withColumns({
        "duration": T.duration("bout_start", "bout_end", "minutes"),
        "date": F.to_date("bout_start"),
        "hour": T.frac_hour("bout_start"),
    })


def bouts(spark, sf) -> DataFrame:
    return bout_table(bout_rows(label_bouts(v_count(spark, sf)), layer_series(spark, sf)))


# ------------------------------------------------------------------ oracle SQL pieces

_LAYER = f"""layer AS (SELECT datetime_round + INTERVAL ({LAYER_SHIFT_HOURS}) HOUR AS datetime_round,
                              layer_base, center_of_mass, year FROM v_layer)"""

_DIFF_SQL = with_views(f"""
WITH {_LAYER},
  c AS (SELECT datetime_round, n,
               CAST(CASE WHEN row_number() OVER (ORDER BY datetime_round) = 1 THEN 0
                    ELSE n - lag(n) OVER (ORDER BY datetime_round) END AS DOUBLE) AS dn FROM v_count),
  d AS (SELECT datetime_round, layer_base, center_of_mass,
               CASE WHEN row_number() OVER (ORDER BY datetime_round) = 1 THEN 0.0
                    ELSE layer_base - lag(layer_base) OVER (ORDER BY datetime_round) END AS dlayer_base,
               CASE WHEN row_number() OVER (ORDER BY datetime_round) = 1 THEN 0.0
                    ELSE center_of_mass - lag(center_of_mass) OVER (ORDER BY datetime_round) END AS dcenter_of_mass
        FROM layer)
SELECT c.*, d.layer_base, d.center_of_mass, d.dlayer_base, d.dcenter_of_mass
FROM c LEFT JOIN d USING (datetime_round) WHERE d.layer_base IS NOT NULL""", "v_count", "v_layer")

_LABEL_CTE = f"""
  thr AS (SELECT quantile_cont(n, {BOUT_QUANTILE}) AS bout_thresh FROM v_count),
  s AS (SELECT datetime_round, n, bout_thresh, CAST(n > bout_thresh AS INTEGER) AS x,
               row_number() OVER (ORDER BY datetime_round) AS rn FROM v_count, thr),
  dl AS (SELECT datetime_round, n, bout_thresh, rn,
                CASE WHEN rn < {DILATE_BACK}
                     THEN max(x) OVER (ORDER BY rn ROWS BETWEEN {DILATE_BACK} PRECEDING AND CURRENT ROW)
                     ELSE max(x) OVER (ORDER BY rn ROWS BETWEEN {DILATE_BACK} PRECEDING AND {DILATE_AHEAD} FOLLOWING)
                END = 1 AS bout FROM s),
  st AS (SELECT *, CASE WHEN bout AND NOT coalesce(lag(bout) OVER (ORDER BY rn), false) THEN 1 ELSE 0 END AS st FROM dl),
  lab AS (SELECT datetime_round, n, bout_thresh, bout,
                 CAST(CASE WHEN bout THEN sum(st) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS BIGINT) AS bout_label
          FROM st)"""

_ROWS_CTE = _LABEL_CTE + f""",
  {_LAYER},
  j AS (SELECT lab.*, layer.layer_base, layer.center_of_mass, layer.year FROM lab
        LEFT JOIN layer ON lab.datetime_round IS NOT DISTINCT FROM layer.datetime_round WHERE lab.bout),
  b0 AS (SELECT bout_label, min(datetime_round) AS t0, arg_min_null(layer_base, datetime_round) AS d0 FROM j GROUP BY bout_label),
  rows AS (SELECT j.*, CAST(date_diff('second', b0.t0, j.datetime_round) AS DOUBLE) AS bout_time,
                  j.layer_base - b0.d0 AS rel_depth
           FROM j JOIN b0 USING (bout_label)
           WHERE j.year IS NOT NULL AND date_diff('second', b0.t0, j.datetime_round) <= {BOUT_CUTOFF_SECONDS}
             AND j.layer_base IS NOT NULL AND j.center_of_mass IS NOT NULL AND b0.d0 IS NOT NULL
             AND NOT isnan(j.layer_base) AND NOT isnan(j.center_of_mass) AND NOT isnan(j.layer_base - b0.d0))"""

_BOUTS_CTE = _ROWS_CTE + """,
  o AS (SELECT *, row_number() OVER (PARTITION BY bout_label ORDER BY datetime_round) AS k,
               abs(rel_depth - lag(rel_depth) OVER (PARTITION BY bout_label ORDER BY datetime_round)) AS step
        FROM rows),
  bt AS (SELECT bout_label, min(datetime_round) AS bout_start, max(datetime_round) + INTERVAL 10 MINUTE AS bout_end,
                min(datetime_round) + INTERVAL 8 HOUR AS bout_start_utc,
                max(datetime_round) + INTERVAL 10 MINUTE + INTERVAL 8 HOUR AS bout_end_utc,
                CAST(sum(n) AS BIGINT) AS nclicks, coalesce(sum(step), 0.0) AS layerdist, max(rel_depth) AS maxchange,
                max(CASE WHEN k = 2 THEN rel_depth END) / 20 AS init_dive_speed,
                CASE WHEN count(step) = count(*) - 1 THEN coalesce(sum(step), 0.0) END AS distance
         FROM o GROUP BY bout_label),
  bouts AS (SELECT *, date_diff('microsecond', bout_start, bout_end) / 1e6 / 60.0 AS duration,
                   CAST(bout_start AS DATE) AS date, hour(bout_start) + minute(bout_start) / 60.0 AS hour
            FROM bt)"""


def _sql(body: str, cte: str) -> str:
    return with_views(f"WITH {cte}\n{body}", "v_count", "v_layer")


# ------------------------------------------------------------------ queries


@query("series_diff_join", ops="Q4 W2 J5 P10 W10", sql=_DIFF_SQL)
def q_series_diff_join(spark, sf):
    return series_diff_join(v_count(spark, sf), layer_series(spark, sf))


@query("cross_corr", ops="Q4 W9", sql=with_views(f"""
WITH {_LAYER},
  c AS (SELECT datetime_round, n - lag(n) OVER (ORDER BY datetime_round) AS dn0,
               row_number() OVER (ORDER BY datetime_round) AS r FROM v_count),
  d AS (SELECT datetime_round, layer_base - lag(layer_base) OVER (ORDER BY datetime_round) AS dl0,
               row_number() OVER (ORDER BY datetime_round) AS r FROM layer),
  j AS (SELECT c.datetime_round, CASE WHEN c.r = 1 THEN 0.0 ELSE c.dn0 END AS x,
               CASE WHEN d.r = 1 THEN 0.0 ELSE d.dl0 END AS y, d.r AS dr
        FROM c LEFT JOIN d USING (datetime_round) WHERE d.r IS NOT NULL),
  idx AS (SELECT row_number() OVER (ORDER BY datetime_round) AS i, x, y FROM j),
  cc AS (SELECT i, x - (SELECT avg(x) FROM idx) AS xc, y - (SELECT avg(y) FROM idx) AS yc FROM idx),
  v AS (SELECT sum(xc * xc) / count(xc) AS vx, sum(yc * yc) / count(yc) AS vy FROM cc),
  lags AS (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS lag),
  p AS (SELECT lags.lag, sum(a.xc * b.yc) AS s, count(a.xc * b.yc) AS cnt
        FROM lags CROSS JOIN cc b JOIN cc a ON a.i = b.i + lags.lag GROUP BY lags.lag)
SELECT lag, CASE WHEN cnt > 0 THEN greatest(-1.0, least(1.0, (s / (cnt + abs(lag))) / sqrt(vx * vy))) END AS acf
FROM p, v""", "v_count", "v_layer"))
def q_cross_corr(spark, sf):
    d = series_diff_join(v_count(spark, sf), layer_series(spark, sf))
    idx = S.with_row_index(cut_lineage(d.select("datetime_round", "dn", "dlayer_base")), ["datetime_round"], "__rn")
    return S.cross_corr(idx, "__rn", "dn", "dlayer_base", 6)


@query("dilate", ops="W3 W10", sql=with_views(f"""
WITH s AS (SELECT datetime_round, n, CAST(n > 20 AS INTEGER) AS x,
                  row_number() OVER (ORDER BY datetime_round) AS rn FROM v_count)
SELECT datetime_round, n,
       CASE WHEN rn < {DILATE_BACK}
            THEN max(x) OVER (ORDER BY rn ROWS BETWEEN {DILATE_BACK} PRECEDING AND CURRENT ROW)
            ELSE max(x) OVER (ORDER BY rn ROWS BETWEEN {DILATE_BACK} PRECEDING AND {DILATE_AHEAD} FOLLOWING)
       END = 1 AS bout
FROM s""", "v_count"))
def q_dilate(spark, sf):
    idx = S.with_row_index(v_count(spark, sf), ["datetime_round"], "__rn").withColumn(
        "__x", F.col("n") > 20)
    return S.dilate(idx, "__rn", "__x", "bout", DILATE_BACK, DILATE_AHEAD).drop("__rn", "__x")


@query("bouts_label", ops="Q5 A7 J7 W3 W4", sql=_sql(
    "SELECT datetime_round, n, bout_thresh, bout, bout_label FROM lab", _LABEL_CTE))
def q_bouts_label(spark, sf):
    return label_bouts(v_count(spark, sf))


@query("bout_elapsed", ops="Q5 J6 W5 W6 P11", sql=_sql("SELECT * FROM rows", _ROWS_CTE))
def q_bout_elapsed(spark, sf):
    return bout_rows(label_bouts(v_count(spark, sf)), layer_series(spark, sf))


@query("bout_profile", ops="Q6 A6 A7 A9 A1", sql=_sql("""
SELECT bout_time, stddev_samp(rel_depth) / count(*) AS se, count(*) AS n,
       quantile_cont(-rel_depth, 0.25) AS q25, quantile_cont(-rel_depth, 0.75) AS q75,
       quantile_cont(-rel_depth, 0.40) AS q40, quantile_cont(-rel_depth, 0.60) AS q60,
       quantile_cont(-rel_depth, 0.5) AS rel_depth
FROM rows GROUP BY bout_time""", _ROWS_CTE))
def q_bout_profile(spark, sf):
    return bout_profile(bout_rows(label_bouts(v_count(spark, sf)), layer_series(spark, sf)))


@query("bout_table", ops="Q7 A5 A2 A16 A10 D3 D9 D8 W8", sql=_sql("SELECT * FROM bouts", _BOUTS_CTE))
def q_bout_table(spark, sf):
    return bouts(spark, sf)


@query("nth_value", ops="A10", sql=_sql("""
SELECT bout_label, arg_min_null(rel_depth, datetime_round) AS first_rel,
       max(CASE WHEN k = 2 THEN rel_depth END) AS second_rel
FROM (SELECT *, row_number() OVER (PARTITION BY bout_label ORDER BY datetime_round) AS k FROM rows)
GROUP BY bout_label""", _ROWS_CTE))
def q_nth_value(spark, sf):
    rows = bout_rows(label_bouts(v_count(spark, sf)), layer_series(spark, sf))
    idx = S.with_row_index(cut_lineage(rows.select("bout_label", "datetime_round", "rel_depth")),
                           ["bout_label", "datetime_round"], "__rn")
    pos = idx.join(idx.groupBy("bout_label").agg(F.min("__rn").alias("__r0")), "bout_label")
    k = F.col("__rn") - F.col("__r0") + 1
    return pos.groupBy("bout_label").agg(
        F.min_by("rel_depth", "datetime_round").alias("first_rel"),
        F.max(F.when(k == 2, F.col("rel_depth"))).alias("second_rel"))


@query("bouts_daily", ops="Q8 A1 A13 A14", sql=_sql("""
SELECT date, count(*) AS nbouts,
       (SELECT avg(c) FROM (SELECT count(*) AS c FROM bouts GROUP BY date))
         * (SELECT avg(distance) FROM bouts) AS daily_distance
FROM bouts GROUP BY date""", _BOUTS_CTE))
def q_bouts_daily(spark, sf):
    b = bouts(spark, sf)
    daily = b.groupBy("date").agg(F.count(F.lit(1)).alias("nbouts"))
    scal = daily.agg(F.avg("nbouts").alias("__a")).crossJoin(F.broadcast(b.agg(F.avg("distance").alias("__b"))))
    return R.with_scalar(daily, scal.select((F.col("__a") * F.col("__b")).alias("daily_distance")))


@query("daynight_share", ops="Q8 A15 M10", sql=_sql("""
SELECT daytime, nclicks, nclicks / sum(nclicks) OVER () AS p FROM (
  SELECT (hour > 6) AND (hour < 18) AS daytime, CAST(sum(nclicks) AS BIGINT) AS nclicks FROM bouts GROUP BY 1)""",
                                                    _BOUTS_CTE))
def q_daynight_share(spark, sf):
    b = bouts(spark, sf).withColumn("daytime", (F.col("hour") > 6) & (F.col("hour") < 18))
    g = b.groupBy("daytime").agg(F.sum("nclicks").alias("nclicks"))
    # at most three groups (true / false / null): the share uses a one-row total
    return R.with_scalar(g, g.agg(F.sum("nclicks").alias("__t"))).select(
        "daytime", "nclicks", (F.col("nclicks") / F.col("__t")).alias("p"))


MAXCHANGE_PROBS = (60, 65, 75, 80, 85, 90, 95, 99)
HIST_BINS = {"duration": 30, "maxchange": 30, "init_dive_speed": 50, "distance": 30, "nbouts": 30}

_STATS_SQL = ", ".join(
    ["avg(duration) AS duration_mean", "max(duration) AS duration_max", "avg(maxchange) AS maxchange_mean",
     "max(maxchange) AS maxchange_max"]
    + [f"quantile_cont(maxchange, {p / 100}) AS maxchange_q{p}" for p in MAXCHANGE_PROBS]
    + ["avg(init_dive_speed) AS init_dive_speed_mean", "median(init_dive_speed) AS init_dive_speed_median",
       "max(init_dive_speed) AS init_dive_speed_max", "median(distance) AS distance_median",
       "avg(distance) AS distance_mean", "max(distance) AS distance_max",
       "(SELECT avg(c) FROM (SELECT count(*) AS c FROM bouts GROUP BY date)) AS nbouts_mean"])


@query("bout_stats", ops="Q8 A13", sql=_sql(f"SELECT {_STATS_SQL} FROM bouts", _BOUTS_CTE))
def q_bout_stats(spark, sf):
    b = cut_lineage(bouts(spark, sf))
    simple = b.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in ("duration", "maxchange", "init_dive_speed", "distance")
                     for n, f in (("mean", F.avg), ("max", F.max))])
    q1 = A.exact_quantiles(b, "maxchange", {f"maxchange_q{p}": p / 100 for p in MAXCHANGE_PROBS})
    q2 = A.exact_quantiles(b, "init_dive_speed", {"init_dive_speed_median": 0.5})
    q3 = A.exact_quantiles(b, "distance", {"distance_median": 0.5})
    daily = b.groupBy("date").agg(F.count(F.lit(1)).alias("c")).agg(F.avg("c").alias("nbouts_mean"))
    return simple.crossJoin(F.broadcast(q1)).crossJoin(F.broadcast(q2)).crossJoin(F.broadcast(q3)).crossJoin(F.broadcast(daily))


def _hist_sql(name: str, source: str, bins: int) -> str:
    x = f"(SELECT CAST({name} AS DOUBLE) AS v FROM {source} WHERE {name} IS NOT NULL)"
    w = f"((mx - mn) / {bins})"
    return (f"SELECT '{name}' AS variable, s.bin, mn + (s.bin - 1) * {w} AS lo, mn + s.bin * {w} AS hi, coalesce(c.n, 0) AS n "
            f"FROM (SELECT CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin) s CROSS JOIN (SELECT min(v) AS mn, max(v) AS mx FROM {x}) "
            f"LEFT JOIN (SELECT least(coalesce(CAST(floor((v - r.a) / NULLIF((r.b - r.a) / {bins}, 0)) AS INTEGER), 0) + 1, {bins}) AS bin, count(*) AS n "
            f"FROM {x}, (SELECT min(v) AS a, max(v) AS b FROM {x}) r GROUP BY 1) c ON s.bin = c.bin")


@query("bout_histograms", ops="Q8 A17", sql=_sql(" UNION ALL ".join(
    _hist_sql(c, "daily" if c == "nbouts" else "bouts", n) for c, n in HIST_BINS.items()),
    _BOUTS_CTE + ", daily AS (SELECT date, count(*) AS nbouts FROM bouts GROUP BY date)"))
def q_bout_histograms(spark, sf):
    b = cut_lineage(bouts(spark, sf))
    daily = b.groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("nbouts"))
    parts = [A.histogram(daily if c == "nbouts" else b, c, n).select(F.lit(c).alias("variable"), "bin", "lo", "hi", "n")
             for c, n in HIST_BINS.items()]
    return R.union_all(parts)


@query("moving_mean", ops="Q14 W1 W10", sql=with_views("""
WITH s AS (SELECT datetime_round, layer_base, center_of_mass,
                  row_number() OVER (ORDER BY datetime_round) AS rn, count(*) OVER () AS N,
                  first_value(layer_base) OVER (ORDER BY datetime_round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f1,
                  last_value(layer_base) OVER (ORDER BY datetime_round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l1,
                  first_value(center_of_mass) OVER (ORDER BY datetime_round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f2,
                  last_value(center_of_mass) OVER (ORDER BY datetime_round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l2
           FROM v_layer)
SELECT datetime_round, layer_base, center_of_mass,
       CASE WHEN count(layer_base) OVER w = count(*) OVER w
            THEN (sum(layer_base) OVER w + greatest(0, 10 - rn) * f1 + greatest(0, rn + 9 - N) * l1) / 19 END AS layer_base_smooth,
       CASE WHEN count(center_of_mass) OVER w = count(*) OVER w
            THEN (sum(center_of_mass) OVER w + greatest(0, 10 - rn) * f2 + greatest(0, rn + 9 - N) * l2) / 19 END AS center_of_mass_smooth
FROM s WINDOW w AS (ORDER BY rn ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)""", "v_layer"))
def q_moving_mean(spark, sf):
    lay = v_layer(spark, sf).select("datetime_round", "layer_base", "center_of_mass")
    idx = S.with_row_index(lay, ["datetime_round"], "__rn")
    return S.moving_mean(idx, "__rn", ["layer_base", "center_of_mass"], 19).drop("__rn")


@query("axis_rank", ops="W11 G1", sql=with_views("""
SELECT date, depth, CAST(dense_rank() OVER (PARTITION BY date ORDER BY depth) AS BIGINT) AS y
FROM (SELECT DISTINCT date, depth FROM v_grid)""", "v_grid"))
def q_axis_rank(spark, sf):
    axis = v_grid(spark, sf).select("date", "depth").distinct()
    return S.rank_within(axis, ["date"], ["depth"], "y")


# ------------------------------------------------------------------ one series a user


SERIES = ["user_id"]
_USER_IDX = """s AS (SELECT *, row_number() OVER p AS rn, count(*) OVER (PARTITION BY user_id) AS len FROM v_user
                      WINDOW p AS (PARTITION BY user_id ORDER BY datetime_round))"""


def user_series(spark, sf) -> DataFrame:
    return S.with_row_index(v_user(spark, sf), ["user_id", "datetime_round"], "__rn")


@query("series_moving_mean", ops="W1 W10", sql=with_views(f"""
WITH {_USER_IDX}
SELECT user_id, datetime_round, n, level,
       (sum(level) OVER w + greatest(0, 10 - rn) * first_value(level) OVER a
        + greatest(0, rn + 9 - len) * last_value(level) OVER a) / 19 AS level_smooth
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING),
              a AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "v_user"))
def q_series_moving_mean(spark, sf):
    return S.moving_mean(user_series(spark, sf), "__rn", ["level"], 19, by=SERIES).drop("__rn")


@query("series_bouts", ops="W3 W4 W10", sql=with_views(f"""
WITH {_USER_IDX},
  d AS (SELECT *, CASE WHEN rn < {DILATE_BACK}
                  THEN max((level > 100)::INTEGER) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN {DILATE_BACK} PRECEDING AND CURRENT ROW)
                  ELSE max((level > 100)::INTEGER) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN {DILATE_BACK} PRECEDING AND {DILATE_AHEAD} FOLLOWING)
                  END = 1 AS bout FROM s),
  f AS (SELECT *, bout AND NOT coalesce(lag(bout) OVER (PARTITION BY user_id ORDER BY rn), false) AS starts FROM d)
SELECT user_id, datetime_round, n, level, bout,
       CASE WHEN bout THEN sum(starts::INTEGER) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS bout_label
FROM f""", "v_user"))
def q_series_bouts(spark, sf):
    idx = user_series(spark, sf).withColumn("__x", F.col("level") > 100)
    dil = S.dilate(idx, "__rn", "__x", "bout", DILATE_BACK, DILATE_AHEAD, by=SERIES)
    return S.label_runs(dil, "__rn", "bout", "bout_label", by=SERIES).drop("__rn", "__x")


@query("series_cross_corr", ops="W9 W2", sql=with_views(f"""
WITH {_USER_IDX},
  d AS (SELECT user_id, rn AS i, coalesce(n - lag(n) OVER p, 0)::DOUBLE AS x, CASE WHEN rn = 1 THEN 0.0 ELSE level - lag(level) OVER p END AS y
        FROM s WINDOW p AS (PARTITION BY user_id ORDER BY rn)),
  cc AS (SELECT user_id, i, x - avg(x) OVER (PARTITION BY user_id) AS xc, y - avg(y) OVER (PARTITION BY user_id) AS yc FROM d),
  v AS (SELECT user_id, sum(xc * xc) / count(xc) AS vx, sum(yc * yc) / count(yc) AS vy FROM cc GROUP BY user_id),
  lags AS (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS lag),
  p AS (SELECT v.user_id, lags.lag, sum(a.xc * b.yc) AS s, count(a.xc * b.yc) AS cnt, any_value(vx) AS vx, any_value(vy) AS vy
        FROM v CROSS JOIN lags LEFT JOIN cc b ON b.user_id = v.user_id LEFT JOIN cc a ON a.user_id = b.user_id AND a.i = b.i + lags.lag GROUP BY 1, 2)
SELECT user_id, lag, CASE WHEN cnt > 0 AND vx * vy > 0 THEN greatest(-1.0, least(1.0, (s / (cnt + abs(lag))) / sqrt(vx * vy))) END AS acf
FROM p""", "v_user"))
def q_series_cross_corr(spark, sf):
    idx = user_series(spark, sf)
    d = S.diff0(idx, "__rn", ["n", "level"], by=SERIES)
    return S.cross_corr(d, "__rn", "dn", "dlevel", 3, by=SERIES)
