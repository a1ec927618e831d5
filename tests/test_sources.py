"""File sources and sinks on small files written to a scratch folder."""

import os

import pyarrow as pa
import pytest
import pyarrow.feather as feather
from pyspark.sql import functions as F

from fathom.functions import time as T
from fathom.sources import files as FS


def test_normalise_name():
    assert FS.normalise_name("Layer depth min") == "Layer_depth_min"
    assert FS.normalise_name("3db") == "_3db"
    assert FS.normalise_name("if") == "_if"


def test_grid_csv_dir_with_provenance(spark, tmp_path):
    d = tmp_path / "monthly"
    d.mkdir()
    (d / "grid-2019-11.csv").write_text(
        "Interval,Layer depth min,Sv mean,Date_M,Time_M\n1,15.0,-70.5,20191105, 12:00:05.0000\n"
        "2,20.0,,20191105, 12:10:05.0000\n")
    (d / "grid-2019-12.csv").write_text(
        "Interval,Layer depth min,Sv mean,Date_M,Time_M\n1,15.0,-65.0,20191201, 00:00:00.0000\n")
    df = FS.read_dir(spark, str(d), FS.GRID_CSV, glob="*.csv")
    assert df.columns == [*FS.GRID_CSV.fieldNames(), "source_file"]
    df = df.withColumn("datetime", T.shift_hours(T.parse_datetime("Date_M", "Time_M"), -8))
    rows = sorted(df.collect(), key=lambda r: (r["source_file"], r["Interval"]))
    assert [r["source_file"] for r in rows] == ["grid-2019-11.csv"] * 2 + ["grid-2019-12.csv"]
    assert rows[1]["Sv_mean"] is None
    assert str(rows[0]["datetime"]) == "2019-11-05 04:00:05"
    assert str(rows[2]["datetime"]) == "2019-11-30 16:00:00"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Date_M,Time_M,Interval,Layer depth min,Sv mean,Extra\n20191105, 04:00:05.0000,1,15.0,NA,x\n20191105, 04:00:06.0000,2,20.0,-70.5,\n")
    got = FS.read_csv(spark, str(p), FS.GRID_CSV).orderBy("Interval").collect()
    assert [(r.Interval, r.Layer_depth_min, r.Sv_mean, r.Date_M) for r in got] == [(1, 15.0, None, 20191105), (2, 20.0, -70.5, 20191105)]
    (tmp_path / "b.csv").write_text("Date_M,Interval\n20191105,1\n")
    with pytest.raises(ValueError, match="Layer_depth_min"):
        FS.read_csv(spark, str(tmp_path / "b.csv"), FS.GRID_CSV)
    (tmp_path / "bad.csv").write_text("x\none\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|cannot be cast|Malformed"):
        FS.read_csv(spark, str(tmp_path / "bad.csv"), "x int").collect()


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    d = tmp_path / "d [x]" / "deep"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (d / "b.csv").write_text("y,x\n20,10\n")
    (d / "c.csv").write_text('\ufeff"an ""extra"", col",x,1 note,y\n"7\n8",100,,200\n')
    (d / "d.csv").write_text("y , x\n")          # a header only
    (d / "e.csv").write_text("")                  # nothing
    (d / "_hidden.csv").write_text("q\n1\n")
    import gzip
    with gzip.open(d / "f.csv.gz", "wt") as f:
        f.write("x,y\n5,6\n")
    root = str(tmp_path / "d [x]").replace("[", "\\[").replace("]", "\\]")
    got = FS.read_dir(spark, root, "x int, y int", multiLine="true").orderBy("x").collect()
    assert [(r.x, r.y, r.source_file) for r in got] == [
        (1, 2, "a.csv"), (3, 4, "a.csv"), (5, 6, "f.csv.gz"), (10, 20, "b.csv"), (100, 200, "c.csv")]
    heads = {r.path.rsplit("/", 1)[1]: r.header for r in FS.read_headers(spark, root, {"recursiveFileLookup": "true"}).collect()}
    assert heads["c.csv"] == ['an "extra", col', "x", "1 note", "y"] and "e.csv" not in heads and "_hidden.csv" not in heads


def test_headers_in_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n" + "20,10,0\n" * 5)
    want = sorted(map(tuple, FS.read_headers(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(FS, "_arrow_reads", lambda path: False)
    assert sorted((p.replace("file:///", "file:/"), h) for p, h in FS.read_headers(spark, str(tmp_path)).collect()) == want
    assert FS.read_csv(spark, str(tmp_path), "x int, y int").agg(F.sum("x"), F.sum("y")).first() == (51, 102)


def test_long_headers_and_files_that_lack_a_column(spark, tmp_path):
    names = [f"column number {i}" for i in range(9000)]
    (tmp_path / "a.csv").write_text(",".join([*names, "x"]) + "\n" + ",".join(["0"] * 9000 + ["5"]) + "\n")
    got = FS.read_csv(spark, str(tmp_path), "x int, column_number_17 int", maxColumns="10000")
    assert [tuple(r) for r in got.collect()] == [(5, 0)]
    (tmp_path / "b.csv").write_text("y\n1\n")
    with pytest.raises(ValueError, match="b.csv: missing columns"):
        FS.read_csv(spark, str(tmp_path), "x int")
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError, match="ambiguous columns"):
        FS.read_csv(spark, str(tmp_path), "x int")
    empty = tmp_path / "none"
    empty.mkdir()
    assert FS.read_dir(spark, str(empty), "x int", glob="*.csv").columns == ["x", "source_file"]


def test_feather_file_is_split_by_its_batches(spark, tmp_path):
    t = pa.table({"Sv_mean": pa.array([float(i) for i in range(800)]), "other": pa.array(["x" * 50] * 800),
                  "depth": pa.array(range(800), pa.int32())})
    with pa.ipc.new_file(str(tmp_path / "a.feather"), t.schema) as w:
        w.write_table(t, max_chunksize=100)
    from pyspark.sql import types as T_
    schema = T_.StructType([T_.StructField("depth", T_.DoubleType()), T_.StructField("Sv_mean", T_.DoubleType())])
    df = FS.read_feather(spark, str(tmp_path), schema)
    one = spark.read.format("feather").schema(schema).option("glob", "*.feather").option("partitionBytes", "1").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and one.rdd.getNumPartitions() == 8
    assert sorted(map(tuple, one.collect())) == [(float(i), float(i)) for i in range(800)] == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="missing columns"):
        FS.read_feather(spark, str(tmp_path), T_.StructType([T_.StructField("no", T_.DoubleType())])).collect()


def test_feather_files_are_written_once_a_partition(spark, tmp_path):
    df = spark.range(1000, numPartitions=3).selectExpr("id as n")
    FS.write_feather(df, f"{tmp_path}/f", batch_rows=64)
    FS.write_feather(df, f"{tmp_path}/f", batch_rows=64)      # tasks that run twice
    assert sorted(os.listdir(f"{tmp_path}/f")) == [f"part-0000{i}.feather" for i in range(3)]
    assert pa.ipc.open_file(f"{tmp_path}/f/part-00001.feather").num_record_batches == 6
    assert FS.read_feather(spark, f"{tmp_path}/f", df.schema).agg(F.sum("n"), F.count("n")).first() == (499500, 1000)


def test_feather_ingest_and_selection(spark, tmp_path):
    for name, n in [("avoidance-a.feather", 3), ("auv-avoidance-b.feather", 2), ("avoidance-c.txt", 1)]:
        t = pa.table({"datetime": pa.array([1_000_000 * i for i in range(n)], pa.timestamp("us")),
                      "datetime_round": pa.array([0] * n, pa.timestamp("us")),
                      "depth": pa.array([float(i) for i in range(n)]),
                      "Sv_mean": pa.array([-70.0 - i for i in range(n)])})
        if name.endswith(".feather"):
            feather.write_feather(t, os.path.join(tmp_path, name))
        else:
            (tmp_path / name).write_text("x")
    sel = FS.list_inputs(spark, str(tmp_path), prefix="avoidance-", suffix=".feather", glob="*avoidance-*")
    assert [r["file_name"] for r in sel.collect()] == ["avoidance-a.feather"]
    df = FS.read_feather(spark, str(tmp_path), FS.GRID_FEATHER)
    assert df.count() == 5 and df.agg(F.min("Sv_mean")).first()[0] == -72.0


def test_write_partitioned_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("2019-01-01", 1.0), ("2019-01-02", 2.0)], "date string, v double") \
        .withColumn("date", F.to_date("date"))
    out = str(tmp_path / "tbl")
    FS.write_table(df, out, partition_by=["date"])
    back = spark.read.parquet(out)
    assert back.filter(F.col("date") == F.lit("2019-01-02").cast("date")).first()["v"] == 2.0


def test_file_selection_counts_the_files_of_every_status(spark, tmp_path):
    import __spark_entry__ as entry
    rows = [("P", 1), ("O", 2), ("F", 3), ("P", 4), (None, 5), ("none", 6), ("a+b %/c", 7)] * 3
    spark.createDataFrame(rows, "o_orderstatus string, o_orderkey long").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["file_selection"](spark, str(tmp_path))
    assert got.columns == ["status", "files"]
    assert {tuple(r) for r in got.collect()} == {(s, 1) for s in ("P", "O", "F", None, "none", "a+b %/c")}
