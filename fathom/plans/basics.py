"""Leaf operators as queries: projections, filters, scalar functions, lookups, simple
aggregates (SURVEY §2.1-2.2, §2.4, §2.6-2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import math as M
from fathom.functions import time as T
from fathom.operators import aggregates as A
from fathom.operators import relational as R
from fathom.plans.catalog import query
from fathom.sources import literals as L
from fathom.session import cut_lineage
from fathom.sources.views import table, v_count, v_env, v_grid, v_layer, v_obs, with_views


# ------------------------------------------------------------------ projections


@query("swap_derive", ops="P1 P2", sql=with_views("""
    SELECT date, max(depth) AS bottom, min(depth) AS top, (max(depth) + min(depth)) / 2 AS middle
    FROM v_grid GROUP BY date""", "v_grid"))
def swap_derive(spark, sf):
    ext = v_grid(spark, sf).groupBy("date").agg(F.min("depth").alias("bottom"),
                                                 F.max("depth").alias("top"))
    # image rows run top-down: swap both at once, then derive the midpoint from the result
    swapped = R.derive(ext, {"bottom": F.col("top"), "top": F.col("bottom")})
    return R.derive_seq(swapped, [("middle", (F.col("bottom") + F.col("top")) / 2)])


@query("select_rename", ops="P3", sql="""
    SELECT ts AS datetime, CAST(value AS DOUBLE) AS n FROM events""")
def select_rename(spark, sf):
    return table(spark, sf, "events").select(F.col("ts").alias("datetime"),
                                             F.col("value").cast("double").alias("n"))


@query("range_filter", ops="P4 P5 P6", sql="""
    SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity * 10 AS depth, l_extendedprice
    FROM lineitem
    WHERE l_shipdate > TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
      AND l_quantity * 10 < 300 AND l_quantity * 10 BETWEEN 15 AND 500
      AND l_extendedprice > 2000""")
def range_filter(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("depth", F.col("l_quantity") * 10)
    return li.filter(
        R.between_open("l_shipdate", F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"),
                       F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
        & (F.col("depth") < 300) & R.in_range("depth", 15, 500, closed=True)
        & (F.col("l_extendedprice") > 2000)
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "depth", "l_extendedprice")


@query("category_filter", ops="P7", sql=with_views("""
    SELECT date, concept, depth_meters FROM v_obs WHERE activity = 'N'""", "v_obs"))
def category_filter(spark, sf):
    return v_obs(spark, sf).filter(F.col("activity") == "N").select("date", "concept", "depth_meters")


_BRANDS = ["Brand#1", "Brand#7", "Brand#13", "Brand#22"]


@query("membership", ops="P8", sql=with_views(f"""
    SELECT date, activity, concept, depth_meters FROM v_obs
    WHERE concept IN ({", ".join(repr(b) for b in _BRANDS)})""", "v_obs"))
def membership(spark, sf):
    return v_obs(spark, sf).filter(F.col("concept").isin(*_BRANDS)).select(
        "date", "activity", "concept", "depth_meters")


@query("flag_in_set", ops="P9", sql="""
    SELECT o_orderkey,
           o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned
    FROM orders""")
def flag_in_set(spark, sf):
    keys = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return R.flag_in(table(spark, sf, "orders").select("o_orderkey"), keys, ["o_orderkey"], "returned")


@query("not_null", ops="P10", sql=with_views("""
    SELECT date, temperature FROM v_env WHERE temperature IS NOT NULL""", "v_env"))
def not_null(spark, sf):
    return v_env(spark, sf).filter(F.col("temperature").isNotNull()).select("date", "temperature")


@query("drop_na", ops="P11", sql=with_views("""
    SELECT * FROM v_env WHERE temperature IS NOT NULL AND upwelling IS NOT NULL
      AND sealevel_lowpass IS NOT NULL AND NOT isnan(temperature) AND NOT isnan(upwelling)
      AND NOT isnan(sealevel_lowpass)""", "v_env"))
def drop_na(spark, sf):
    return v_env(spark, sf).dropna("any")


_JOINED_SQL = """
    SELECT c.datetime_round, c.n, l.layer_base FROM v_count c
    LEFT JOIN v_layer l ON c.datetime_round = l.datetime_round"""


def _count_layer(spark, sf):
    lay = v_layer(spark, sf).select("datetime_round", "layer_base")
    return v_count(spark, sf).join(lay, "datetime_round", "left")


@query("floor_clamp", ops="P12", sql=with_views(f"""
    SELECT datetime_round,
           CASE WHEN layer_base IS NULL OR layer_base < 40 THEN 40.0 ELSE layer_base END AS clamp_fill,
           CASE WHEN layer_base < 40 THEN 40.0 ELSE layer_base END AS clamp_keep
    FROM ({_JOINED_SQL})""", "v_count", "v_layer"))
def floor_clamp(spark, sf):
    return _count_layer(spark, sf).select(
        "datetime_round", M.floor_clamp("layer_base", 40, True).alias("clamp_fill"),
        M.floor_clamp("layer_base", 40, False).alias("clamp_keep"))


@query("squish", ops="P13", sql=with_views("""
    SELECT date, datetime, depth, least(greatest(Sv_mean, -75.0), -60.0) AS sv_squished
    FROM v_grid""", "v_grid"))
def squish(spark, sf):
    return v_grid(spark, sf).select("date", "datetime", "depth",
                                    M.squish("Sv_mean", -75, -60).alias("sv_squished"))


@query("replace_special", ops="P14 M2", sql=with_views(f"""
    SELECT datetime_round, coalesce(layer_base, 0.0) AS filled,
           CASE WHEN db = '-Infinity'::DOUBLE THEN NULL ELSE db END AS db_clean,
           CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio_clean
    FROM (SELECT datetime_round, layer_base,
                 CASE WHEN floor(n / 10) = 0 THEN '-Infinity'::DOUBLE ELSE 10 * log10(floor(n / 10)) END AS db,
                 CASE WHEN n % 2 = 0 THEN 'NaN'::DOUBLE ELSE n / 2.0 END AS ratio
          FROM ({_JOINED_SQL}))""", "v_count", "v_layer"))
def replace_special(spark, sf):
    df = _count_layer(spark, sf).select(
        "datetime_round", "layer_base",
        M.to_db(F.floor(F.col("n") / 10)).alias("db"),
        F.when(F.col("n") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("n") / 2.0).alias("ratio"))
    return df.select("datetime_round", M.null_to("layer_base", 0.0).alias("filled"),
                     M.neg_inf_to_null("db").alias("db_clean"), M.nan_to_null("ratio").alias("ratio_clean"))


@query("hour_label", ops="P15", sql=with_views("""
    SELECT datetime_round, CASE WHEN hour(datetime_round) IN (12, 13, 14) THEN 'noon'
                                WHEN hour(datetime_round) IN (0, 1, 2) THEN 'midnight'
                                ELSE 'other' END AS hourlabel
    FROM v_count""", "v_count"))
def hour_label(spark, sf):
    return v_count(spark, sf).select("datetime_round",
                                     M.hour_label(F.hour("datetime_round")).alias("hourlabel"))


@query("row_slice", ops="P16 W10", sql="""
    SELECT * FROM (
      SELECT l_orderkey, l_linenumber, l_shipdate,
             row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_nr
      FROM lineitem) WHERE row_nr BETWEEN 10000 AND 11000""")
def row_slice(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return R.row_slice(li, ["l_shipdate", "l_orderkey", "l_linenumber"], 10000, 11000)


@query("head_n", ops="P17 O3", sql="""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    ORDER BY l_orderkey, l_linenumber LIMIT 6""")
def head_n(spark, sf):
    return R.head(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
                  ["l_orderkey", "l_linenumber"], 6)


@query("distinct_sorted", ops="P18", sql=with_views(
    "SELECT DISTINCT depth FROM v_grid ORDER BY depth", "v_grid"))
def distinct_sorted(spark, sf):
    return R.distinct_sorted(v_grid(spark, sf), "depth")


@query("crop_window", ops="P19", sql=with_views("""
    SELECT date, datetime, depth, Sv_mean FROM v_grid
    WHERE datetime BETWEEN (SELECT min(datetime) FROM v_grid) AND (SELECT max(datetime) FROM v_grid)
      AND depth BETWEEN 100 AND 300""", "v_grid"))
def crop_window(spark, sf):
    return R.crop(v_grid(spark, sf), "datetime", "depth", None, (300, 100))


@query("order_by", ops="O1", sql=with_views(
    "SELECT datetime_round, n FROM v_count ORDER BY datetime_round", "v_count"))
def order_by(spark, sf):
    return v_count(spark, sf).orderBy("datetime_round")


@query("union_all", ops="U1", sql="""
    SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'N'""")
def union_all(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return R.union_all([li.filter(F.col("l_returnflag") == f) for f in ("R", "A", "N")])


# ------------------------------------------------------------------ sources


@query("lookup_join", ops="S7 J6", sql=with_views(f"""
    WITH lk(concept, "Group") AS (VALUES {L.brand_groups_sql()})
    SELECT o.date, lk."Group" AS "Group", count(*) AS n
    FROM v_obs o LEFT JOIN lk ON o.concept = lk.concept
    GROUP BY o.date, lk."Group" """, "v_obs"))
def lookup_join(spark, sf):
    lk = L.brand_groups(spark)
    joined = R.natural_left_join(v_obs(spark, sf), F.broadcast(lk))
    return joined.groupBy("date", "Group").agg(F.count(F.lit(1)).alias("n"))


@query("light_profile", ops="S8 M4", sql=with_views("""
    SELECT z AS depth, 2000 * exp(-0.08 * z) AS light
    FROM (SELECT unnest(range(0, CAST(ceil(max(depth_meters)) AS BIGINT) + 1)) AS z FROM v_obs)""",
                                                   "v_obs"))
def light_profile(spark, sf):
    top = v_obs(spark, sf).agg(F.ceil(F.max("depth_meters")).cast("long").alias("zmax"))
    depths = L.series_from(top, 0, "zmax", "depth")
    return depths.select("depth", M.attenuate(2000, 0.08, "depth").alias("light"))


@query("date_spine", ops="S9 D11 J1", sql="""
    WITH days AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date FROM orders),
         daily AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS norders FROM orders GROUP BY 1)
    SELECT days.date, coalesce(daily.norders, 0) AS norders FROM days LEFT JOIN daily USING (date)""")
def date_spine(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    daily = o.groupBy("date").agg(F.count(F.lit(1)).alias("norders"))
    spine = L.date_spine(o, "date")
    return spine.join(daily, "date", "left").select("date", F.coalesce("norders", F.lit(0)).alias("norders"))


# ------------------------------------------------------------------ scalar functions


@query("parse_datetime", ops="D1 D4", sql="""
    SELECT l_orderkey, l_linenumber,
           strptime(strftime(l_shipdate, '%Y%m%d') || ' ' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':07:30', '%Y%m%d %H:%M:%S') AS parsed,
           strptime(strftime(l_shipdate, '%m/%d/%Y') || ' 3:05', '%m/%d/%Y %H:%M') AS parsed_mdy,
           date_trunc('day', l_shipdate) + INTERVAL '2 hours 30 minutes 5 seconds' AS parsed_ymd
    FROM lineitem""")
def parse_datetime(spark, sf):
    li = table(spark, sf, "lineitem")
    date_int = F.date_format("l_shipdate", "yyyyMMdd").cast("int")
    time_s = F.concat(F.lit(" "), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":07:30"))
    mdy = F.concat(F.date_format("l_shipdate", "MM/dd/yyyy"), F.lit(" 3:05"))
    return li.select("l_orderkey", "l_linenumber",
                     T.parse_datetime(date_int, time_s).alias("parsed"),
                     T.parse_ts(mdy, T.PATTERNS["mdy_hm"]).alias("parsed_mdy"),
                     T.parse_ts(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T02:30:05")),
                                T.PATTERNS["ymd_hms"]).alias("parsed_ymd"))


@query("shift_hours", ops="D2 D3", sql="""
    SELECT event_id, ts - INTERVAL 8 HOUR AS local_ts, ts + INTERVAL 8 HOUR AS utc_ts,
           ts + INTERVAL 10 MINUTE AS bucket_end FROM events""")
def shift_hours(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", T.shift_hours("ts", -8).alias("local_ts"),
                     T.shift_hours("ts", 8).alias("utc_ts"), T.shift_minutes("ts", 10).alias("bucket_end"))


@query("relabel_zone", ops="D5", sql="""
    SELECT event_id, ts AS local_ts, timezone('UTC', timezone('America/Los_Angeles', ts)) AS instant_utc FROM events""")
def relabel_zone(spark, sf):
    """The clock stays; the instant that it names in the declared zone comes beside it."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.col("ts").alias("local_ts"),
                     T.zone_instant("ts", "America/Los_Angeles").alias("instant_utc"))


@query("floor_time", ops="D7 G10", sql="""
    SELECT event_id, time_bucket(INTERVAL '2 minutes', ts) AS ts_2min,
           time_bucket(INTERVAL '10 minutes', ts) AS ts_10min,
           time_bucket(INTERVAL '10 minutes', ts + INTERVAL 5 MINUTE) AS ts_round10 FROM events""")
def floor_time(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", T.floor_time("ts", "2 minutes").alias("ts_2min"),
                     T.floor_time("ts", "10 minutes").alias("ts_10min"),
                     T.round_time("ts", "10 minutes").alias("ts_round10"))


@query("date_parts", ops="D8 D10", sql="""
    SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute,
           CAST(ts AS DATE) AS date, hour(ts) + minute(ts) / 60.0 AS frac_hour,
           strftime(ts, '%Y-%m') AS year_month FROM events""")
def date_parts(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"),
                     F.to_date("ts").alias("date"), T.frac_hour("ts").alias("frac_hour"),
                     T.year_month("ts").alias("year_month"))


@query("db_linear", ops="M1 M2 M3", sql=with_views("""
    SELECT date, datetime, depth, pow(10.0, Sv_mean / 10) AS sv,
           10 * log10(pow(10.0, Sv_mean / 10)) AS Sv_back,
           CASE WHEN depth - 10 * floor(depth / 10) = 0 THEN '-Infinity'::DOUBLE
                ELSE 10 * log10(depth - 10 * floor(depth / 10)) END AS db_rem
    FROM v_grid""", "v_grid"))
def db_linear(spark, sf):
    g = v_grid(spark, sf)
    return g.select("date", "datetime", "depth", M.from_db("Sv_mean").alias("sv"),
                    M.to_db(M.from_db("Sv_mean")).alias("Sv_back"),
                    M.to_db(F.col("depth") - F.floor(F.col("depth") / 10) * 10).alias("db_rem"))


@query("segment_id", ops="M8", sql="""
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '-S' || CAST(o_orderkey AS VARCHAR) AS school_id
    FROM orders""")
def segment_id(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", M.segment_id(F.to_date("o_orderdate"), "o_orderkey").alias("school_id"))


@query("string_ops", ops="M9", sql="""
    SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base,
           regexp_replace(regexp_extract(url, '([^/]*)$', 1), '.html', '.png', 'g') AS figname,
           starts_with(url, 'https://') AS secure, suffix(url, '.html') AS is_html
    FROM pages""")
def string_ops(spark, sf):
    p = table(spark, sf, "pages")
    base = M.basename("url")
    return p.select("page_id", base.alias("base"), M.swap_suffix(base, ".html", ".png").alias("figname"),
                    F.col("url").startswith("https://").alias("secure"),
                    F.col("url").endswith(".html").alias("is_html"))


@query("casts", ops="M11", sql="""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_str,
           TRY_CAST(o_orderpriority AS DOUBLE) AS prio_num,
           TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS prio_int,
           CAST(o_orderdate AS DATE) AS odate FROM orders""")
def casts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("key_str"),
                    F.col("o_orderpriority").try_cast("double").alias("prio_num"),
                    F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("int").alias("prio_int"),
                    F.to_date("o_orderdate").alias("odate"))


# ------------------------------------------------------------------ aggregates


@query("group_count", ops="A1", sql=with_views("""
    SELECT date, activity, count(*) AS n FROM v_obs GROUP BY date, activity""", "v_obs"))
def group_count(spark, sf):
    return v_obs(spark, sf).groupBy("date", "activity").agg(F.count(F.lit(1)).alias("n"))


@query("mean_strict", ops="A3", sql=with_views("""
    SELECT date, CASE WHEN count(temperature) = count(*) THEN avg(temperature) END AS temperature,
           CASE WHEN count(upwelling) = count(*) THEN avg(upwelling) END AS upwelling
    FROM v_env GROUP BY date""", "v_env"))
def mean_strict(spark, sf):
    return v_env(spark, sf).groupBy("date").agg(A.mean_strict("temperature").alias("temperature"),
                                                A.mean_strict("upwelling").alias("upwelling"))


@query("mean_skip", ops="A4", sql=with_views("""
    SELECT date, avg(temperature) AS temperature, avg(upwelling) AS upwelling,
           avg(sealevel_lowpass) AS sealevel FROM v_env GROUP BY date""", "v_env"))
def mean_skip(spark, sf):
    return v_env(spark, sf).groupBy("date").agg(A.mean_skip("temperature").alias("temperature"),
                                                A.mean_skip("upwelling").alias("upwelling"),
                                                A.mean_skip("sealevel_lowpass").alias("sealevel"))


@query("extent", ops="A5", sql=with_views("""
    SELECT date, min(datetime) AS tmin, max(datetime) AS tmax, min(depth) AS dmin, max(depth) AS dmax
    FROM v_grid GROUP BY date""", "v_grid"))
def extent(spark, sf):
    return v_grid(spark, sf).groupBy("date").agg(
        F.min("datetime").alias("tmin"), F.max("datetime").alias("tmax"),
        F.min("depth").alias("dmin"), F.max("depth").alias("dmax"))


@query("group_median", ops="A6", sql=with_views("""
    SELECT date, depth, quantile_cont(Sv_mean, 0.5) AS sv_median FROM v_grid GROUP BY date, depth""",
                                                "v_grid"))
def group_median(spark, sf):
    # written once, like a real gridded source table: each pass of the quantiles reads it
    return A.exact_quantiles(cut_lineage(v_grid(spark, sf)), "Sv_mean", {"sv_median": 0.5}, ["date", "depth"])


@query("median_nulls", ops="A6", sql=with_views("""
    SELECT date, quantile_cont(temperature, 0.5) AS med_skip,
           CASE WHEN count(temperature) = count(*) THEN quantile_cont(temperature, 0.5) END AS med_strict
    FROM (SELECT CAST(date_trunc('year', date) AS DATE) AS date, temperature FROM v_env
          UNION ALL SELECT DATE '1900-01-01', NULL FROM v_env) GROUP BY date""", "v_env"))
def median_nulls(spark, sf):
    """Both treatments of nulls, with a group that has no values at all."""
    env = v_env(spark, sf).select(F.trunc("date", "year").alias("date"), "temperature")
    env = env.unionByName(env.select(F.lit("1900-01-01").cast("date").alias("date"), F.lit(None).cast("double").alias("temperature")))
    skip = A.exact_quantiles(env, "temperature", {"med_skip": 0.5}, ["date"])
    strict = A.exact_quantiles(env, "temperature", {"med_strict": 0.5}, ["date"], nulls="propagate")
    return skip.join(strict, "date")


@query("group_quantiles", ops="A7", sql=with_views("""
    SELECT activity, quantile_cont(depth_meters, 0.25) AS q25, quantile_cont(depth_meters, 0.40) AS q40,
           quantile_cont(depth_meters, 0.60) AS q60, quantile_cont(depth_meters, 0.75) AS q75,
           quantile_cont(depth_meters, 0.95) AS q95
    FROM v_obs GROUP BY activity""", "v_obs"))
def group_quantiles(spark, sf):
    return A.exact_quantiles(v_obs(spark, sf), "depth_meters",
                             {"q25": 0.25, "q40": 0.40, "q60": 0.60, "q75": 0.75, "q95": 0.95},
                             ["activity"])


@query("global_stats", ops="A13", sql=with_views("""
    SELECT avg(depth_meters) AS mean, max(depth_meters) AS max,
           quantile_cont(depth_meters, 0.5) AS median, quantile_cont(depth_meters, 0.9) AS q90
    FROM v_obs""", "v_obs"))
def global_stats(spark, sf):
    obs = v_obs(spark, sf)
    simple = obs.agg(F.avg("depth_meters").alias("mean"), F.max("depth_meters").alias("max"))
    qs = A.exact_quantiles(obs, "depth_meters", {"median": 0.5, "q90": 0.9})
    return R.with_scalar(simple, qs)


@query("mean_product", ops="A14", sql="""
    SELECT (SELECT avg(n) FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1))
         * (SELECT avg(o_totalprice) FROM orders) AS product""")
def mean_product(spark, sf):
    o = table(spark, sf, "orders")
    per_day = o.groupBy(F.to_date("o_orderdate")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.avg("n").alias("a"))
    price = o.agg(F.avg("o_totalprice").alias("b"))
    return R.with_scalar(per_day, price).select((F.col("a") * F.col("b")).alias("product"))


@query("histogram", ops="A17 M3", sql=with_views("""
    WITH x AS (SELECT log10(depth_meters) AS v FROM v_obs WHERE depth_meters > 0),
         r AS (SELECT min(v) AS mn, max(v) AS mx FROM x),
         b AS (SELECT least(CAST(floor((v - mn) / ((mx - mn) / 20)) AS INTEGER) + 1, 20) AS bin FROM x, r),
         c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
         s AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS bin)
    SELECT s.bin, mn + (s.bin - 1) * ((mx - mn) / 20) AS lo, mn + s.bin * ((mx - mn) / 20) AS hi,
           coalesce(c.n, 0) AS n
    FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin""", "v_obs"))
def histogram(spark, sf):
    return A.histogram(v_obs(spark, sf).filter(F.col("depth_meters") > 0), "depth_meters", 20, log10=True)


@query("histogram_density", ops="A18", sql=with_views("""
    WITH x AS (SELECT layer_base AS v FROM v_layer WHERE layer_base IS NOT NULL),
         r AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS tot FROM x),
         b AS (SELECT least(CAST(floor((v - mn) / ((mx - mn) / 30)) AS INTEGER) + 1, 30) AS bin FROM x, r),
         c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
         s AS (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin)
    SELECT s.bin, mn + (s.bin - 1) * ((mx - mn) / 30) AS lo, mn + s.bin * ((mx - mn) / 30) AS hi,
           coalesce(c.n, 0) AS n,
           coalesce(c.n, 0) / (tot * ((mn + s.bin * ((mx - mn) / 30)) - (mn + (s.bin - 1) * ((mx - mn) / 30)))) AS density
    FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin""", "v_layer"))
def histogram_density(spark, sf):
    return A.histogram(v_layer(spark, sf), "layer_base", 30, density=True)


@query("pivot_wide", ops="A20", sql=with_views("""
    SELECT date, max(CASE WHEN activity = 'A' THEN m END) AS depth_A,
           max(CASE WHEN activity = 'N' THEN m END) AS depth_N,
           max(CASE WHEN activity = 'R' THEN m END) AS depth_R
    FROM (SELECT date, activity, avg(depth_meters) AS m FROM v_obs GROUP BY date, activity)
    GROUP BY date""", "v_obs"))
def pivot_wide(spark, sf):
    long = v_obs(spark, sf).groupBy("date", "activity").agg(F.avg("depth_meters").alias("m"))
    return A.pivot_wide(long, ["date"], "activity", "m", ["A", "N", "R"], prefix="depth_")


@query("unpivot_long", ops="A21", sql=with_views("""
    SELECT date, name, value FROM (
      SELECT date, avg(temperature) AS temperature, avg(sealevel_lowpass) AS sealevel FROM v_env GROUP BY date)
    UNPIVOT INCLUDE NULLS (value FOR name IN (temperature, sealevel))""", "v_env"))
def unpivot_long(spark, sf):
    wide = v_env(spark, sf).groupBy("date").agg(F.avg("temperature").alias("temperature"),
                                                F.avg("sealevel_lowpass").alias("sealevel"))
    return A.unpivot_long(wide, ["date"])


@query("regrid_mean", ops="A22 D6", sql="""
    SELECT time_bucket(INTERVAL '10 minutes', ts + INTERVAL 5 MINUTE) AS datetime_round,
           CASE WHEN count(value) = count(*) THEN avg(value) END AS center_of_mass,
           CASE WHEN count(user_id) = count(*) THEN avg(user_id) END AS layertop
    FROM events GROUP BY 1""")
def regrid_mean(spark, sf):
    return A.regrid_mean(table(spark, sf, "events"), "ts", "10 minutes",
                         {"center_of_mass": "value", "layertop": "user_id"})


@query("scalar_broadcast", ops="J7", sql=with_views("""
    SELECT datetime_round, n, n / (SELECT max(n) FROM v_count) AS share_of_max FROM v_count""",
                                                    "v_count"))
def scalar_broadcast(spark, sf):
    c = v_count(spark, sf)
    return R.with_scalar(c, c.agg(F.max("n").alias("__nmax"))).select(
        "datetime_round", "n", (F.col("n") / F.col("__nmax")).alias("share_of_max"))


@query("natural_join", ops="J6", sql=with_views("""
    SELECT c.datetime_round, c.n, l.layer_base, l.center_of_mass, l.year
    FROM v_count c LEFT JOIN v_layer l ON c.datetime_round IS NOT DISTINCT FROM l.datetime_round""",
                                                "v_count", "v_layer"))
def natural_join(spark, sf):
    return R.natural_left_join(v_count(spark, sf), v_layer(spark, sf))


@query("right_join", ops="J4", sql=with_views("""
    SELECT e.temperature, m.date, m.n
    FROM (SELECT date, avg(temperature) AS temperature FROM v_env GROUP BY date) e
    RIGHT JOIN (SELECT date, count(*) AS n FROM v_obs WHERE activity = 'R' GROUP BY date) m
    ON e.date = m.date""", "v_env", "v_obs"))
def right_join(spark, sf):
    env = v_env(spark, sf).groupBy("date").agg(F.avg("temperature").alias("temperature"))
    m = v_obs(spark, sf).filter(F.col("activity") == "R").groupBy("date").agg(
        F.count(F.lit(1)).alias("n"))
    return env.join(m, "date", "right")
