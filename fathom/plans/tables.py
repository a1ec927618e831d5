"""Round trips through the file sources and sinks: a given table is written to the
shared checkpoint folder in the format of the reference's inputs and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import time as T
from fathom.plans.catalog import query
from fathom.session import ensure_checkpoint_dir
from fathom.sources import files as FS
from fathom.sources.views import table, v_grid, v_layer, with_views


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4()}"


def export_columns() -> list:
    """Echogram cells as the instrument software exports them: header names with spaces, other
    columns between, the clock 8 hours ahead."""
    utc = T.shift_hours("datetime", 8)
    return [F.lit("x").alias("Process ID"), F.date_format(utc, "yyyyMMdd").cast("int").alias("Date_M"),
            F.col("Sv_mean").alias("Sv mean"), F.date_format(utc, " HH:mm:ss.SSSS").alias("Time_M"),
            F.col("depth").alias("Layer depth min"), F.lit(None).cast("string").alias("1 note"),
            F.unix_micros(F.col("datetime").cast("timestamp")).alias("Interval")]


def write_grid_csv(spark: SparkSession, grid: DataFrame, path: str) -> None:
    """Cells as CSV exports, ``NA`` for a missing value."""
    grid.select(*export_columns()).write.option("header", "true").option("nullValue", "NA").csv(path)


def grid_columns() -> list:
    """(date, datetime, hour, depth, Sv_mean) on the local clock, from the columns of an export."""
    local = T.shift_hours(T.parse_datetime("Date_M", "Time_M"), -8)
    return [F.to_date(local).alias("date"), local.alias("datetime"), F.hour(local).alias("hour"),
            F.col("Layer_depth_min").alias("depth"), F.col("Sv_mean")]


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, datetime, hour, depth, Sv_mean) from exported CSV files, on the local clock."""
    return FS.read_csv(spark, path, FS.GRID_CSV).select(*grid_columns())


@query("csv_scan", ops="S1 D1", sql=with_views("""
    SELECT CAST(datetime AS DATE) AS date, datetime, CAST(hour(datetime) AS INTEGER) AS hour, depth, Sv_mean FROM v_grid""", "v_grid"))
def csv_scan(spark, sf):
    path = scratch(spark)
    write_grid_csv(spark, v_grid(spark, sf), path)
    return read_grid_csv(spark, path)


#: Orders of columns in which the exports of a directory are written; the last two have a column more.
EXPORT_COLUMNS = (["o_orderstatus", "o_totalprice", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"],
                  ["o_totalprice", "o_orderpriority", "o_orderkey", "o_orderstatus"], ["o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus"])


@query("csv_directory", ops="S2", sql="""
    SELECT o_orderkey, o_totalprice, o_orderstatus, (o_orderkey % 4)::INTEGER AS export FROM orders""")
def csv_directory(spark, sf):
    """A directory of exports whose columns stand in different orders: each file is read by its own
    header, each row has the export that its file's path names."""
    path = scratch(spark)
    for k, cols in enumerate(EXPORT_COLUMNS):
        part = table(spark, sf, "orders").filter(F.col("o_orderkey") % 4 == k)
        part.select(*cols).write.option("header", "true").csv(f"{path}/export-{k}")
    got = FS.read_dir(spark, path, "o_orderkey long, o_totalprice double, o_orderstatus string", glob="*.csv", full_path=True)
    return got.withColumn("export", F.regexp_extract("source_file", r"export-(\d+)/", 1).cast("int")).drop("source_file")


@query("feather_ingest", ops="S3", sql=with_views("SELECT datetime, datetime AS datetime_round, depth, Sv_mean FROM v_grid", "v_grid"))
def feather_ingest(spark, sf):
    """Feather files in the shared folder, read again by their record batches."""
    path = scratch(spark)
    FS.write_feather(v_grid(spark, sf).select("Sv_mean", "date", "depth", "datetime", F.col("datetime").alias("datetime_round")), path)
    return FS.read_feather(spark, path, FS.GRID_FEATHER)


@query("csv_auxiliary", ops="S4 D4", sql=with_views("""
    SELECT datetime_round, layer_base, center_of_mass, year FROM v_layer""", "v_layer"))
def csv_auxiliary(spark, sf):
    """The layer table as text: stamps with ``T``, ``NA`` for nulls, columns in another order."""
    path = scratch(spark)
    v_layer(spark, sf).select(
        "year", F.lit(1).alias("X1"), "center_of_mass", F.date_format("datetime_round", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime_round"),
        "layer_base").write.option("header", "true").option("nullValue", "NA").csv(path)
    got = FS.read_csv(spark, path, FS.LAYERBASE_CSV)
    return got.withColumn("datetime_round", T.parse_ts("datetime_round", T.PATTERNS["ymd_hms"]))


@query("file_selection", ops="S5", sql="SELECT o_orderstatus AS status, 1::BIGINT AS files FROM orders GROUP BY 1")
def file_selection(spark, sf):
    """Files picked by prefix, suffix and glob without reading them: one CSV file a status, among files of
    another kind and folders of another name."""
    path = scratch(spark)
    status = F.col("o_orderstatus")
    named = F.coalesce(F.concat(F.lit("status-"), status), F.lit("none"))
    o = table(spark, sf, "orders").select(named.alias("kind"), status.alias("status"), "o_orderkey")
    # a file has one writer: each status goes to a task of its own
    o.drop("status").repartition("kind").write.partitionBy("kind").option("header", "true").csv(path)
    o.filter("status = 'P'").select(F.concat(F.lit("other-"), "status").alias("kind"), "o_orderkey").write.mode("append").partitionBy(
        "kind").option("header", "true").csv(path)
    o.select(F.concat(F.lit("parquet-"), "kind").alias("kind"), "o_orderkey").write.mode("append").partitionBy("kind").parquet(path)
    got = FS.list_inputs(spark, path, prefix="part-", suffix=".csv", glob="part-*")
    # Spark writes some characters of a folder's name as %XX
    kind = F.url_decode(F.replace(F.regexp_extract("path", "/kind=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))
    got = got.select(kind.alias("kind")).filter(F.col("kind").startswith("status-") | (F.col("kind") == "none"))
    return got.groupBy(F.when(F.col("kind") != "none", F.substring("kind", len("status-") + 1, 2 ** 31 - 1)).alias("status")).agg(
        F.count(F.lit(1)).alias("files"))


@query("table_sink", ops="S6", sql=with_views("""
    SELECT date, count(*) AS cells, min(Sv_mean) AS lowest FROM v_grid WHERE date >= DATE '1996-01-01' GROUP BY date""", "v_grid"))
def table_sink(spark, sf):
    """A date-partitioned Parquet table; a range of dates is read back by partition pruning."""
    path = scratch(spark)
    FS.write_table(v_grid(spark, sf), path, partition_by=["date"])
    back = spark.read.parquet(path).filter(F.col("date") >= F.lit("1996-01-01").cast("date"))
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("cells"), F.min("Sv_mean").alias("lowest"))
