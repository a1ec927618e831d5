"""Analogue views over the driver's test tables.

The reference's echosounder grids, click series, layer series, dive log and ocean
records are not available; these views give each operator an input of the same shape,
derived by Spark from the given tables so their size grows with them. Every view has a
DuckDB twin in :data:`SQL` used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.time import floor_time, month_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def v_grid(spark: SparkSession, sf_dir: str, ping_hours: int = 2) -> DataFrame:
    """Echogram cells: (date, datetime, depth, Sv_mean) from lineitem: one image per ship
    month, pings at ship date + 2 h x line number, depth = 10 x quantity."""
    li = table(spark, sf_dir, "lineitem")
    ping = F.timestamp_add("HOUR", F.col("l_linenumber") * ping_hours, F.col("l_shipdate"))
    return (li.groupBy(month_start("l_shipdate").alias("date"),
                       ping.alias("datetime"),
                       (F.col("l_quantity") * 10).alias("depth"))
            .agg((F.avg("l_extendedprice") / F.lit(7e10)).alias("__sv"))
            .select("date", "datetime", "depth",
                    (F.lit(10.0) * F.log10("__sv")).alias("Sv_mean")))


def v_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click series: events per hour bucket."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(floor_time("ts", "1 hour").alias("datetime_round")).agg(
        F.count(F.lit(1)).alias("n"))


def v_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series a user: (user_id, datetime_round, n, level), events and their mean value per hour bucket.
    Both the number of series and their rows grow with the table."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id", floor_time("ts", "1 hour").alias("datetime_round")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("level"))


def v_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer series with gaps: 'view' events per hour bucket."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return (ev.groupBy(floor_time("ts", "1 hour").alias("datetime_round"))
            .agg(F.avg("value").alias("layer_base"), F.max("value").alias("center_of_mass"))
            .withColumn("year", F.year("datetime_round")))


def v_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dive log: lineitem joined to part."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        month_start("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("activity"),
        F.col("p_brand").alias("concept"),
        (F.col("l_extendedprice") / 100).alias("depth_meters"),
        F.col("l_quantity").alias("temperature_celsius"),
        F.col("l_tax").alias("salinity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("oxygen_ml_per_l"),
        F.col("l_discount").alias("light_transmission"))


def v_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ocean records with gaps: orders by month; status decides which values are missing."""
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        month_start("o_orderdate").alias("date"),
        F.when(st != "F", F.col("o_totalprice") / 1000).alias("temperature"),
        F.when(st == "P", F.col("o_totalprice")).alias("upwelling"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 1e5)
        .alias("sealevel_lowpass"))


# DuckDB twins of the views, inlined as CTEs by the oracle SQL.
SQL = {
    "v_grid": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               l_shipdate + to_hours(l_linenumber * 2) AS datetime,
               l_quantity * 10 AS depth, 10 * log10(avg(l_extendedprice) / 7e10) AS Sv_mean
        FROM lineitem GROUP BY 1, 2, 3""",
    "v_count": """
        SELECT time_bucket(INTERVAL '1 hour', ts) AS datetime_round, count(*) AS n
        FROM events GROUP BY 1""",
    "v_user": """
        SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS datetime_round, count(*) AS n, avg(value) AS level
        FROM events GROUP BY 1, 2""",
    "v_layer": """
        SELECT time_bucket(INTERVAL '1 hour', ts) AS datetime_round, avg(value) AS layer_base,
               max(value) AS center_of_mass,
               CAST(year(time_bucket(INTERVAL '1 hour', ts)) AS INTEGER) AS year
        FROM events WHERE event_type = 'view' GROUP BY 1""",
    "v_obs": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag AS activity,
               p_brand AS concept, l_extendedprice / 100 AS depth_meters,
               l_quantity AS temperature_celsius, l_tax AS salinity,
               l_extendedprice / l_quantity AS oxygen_ml_per_l, l_discount AS light_transmission
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_env": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 1000 END AS temperature,
               CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS upwelling,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 1e5 END AS sealevel_lowpass
        FROM orders""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH`` clauses defining the named views."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
