"""File sources and sinks.

All readers take an explicit schema (no inference pass over the data) and read the files of a
directory or glob together, CSV files in one scan for each kind of header; provenance comes from the
``_metadata`` column instead of a per-file loop on the driver.
"""

from __future__ import annotations

import codecs
import csv
import keyword
import logging
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


log = logging.getLogger(__name__)


def normalise_name(name: str) -> str:
    """Header name -> identifier: invalid characters become '_', a leading digit or a
    reserved word gets a '_' prefix ('Layer depth min' -> 'Layer_depth_min')."""
    s = re.sub(r"[^0-9A-Za-z_]", "_", name.strip())
    if not s or s[0].isdigit() or keyword.iskeyword(s):
        s = "_" + s
    return s


_HEAD_BYTES = 1 << 16


def _listed(spark: SparkSession, path: str | Sequence[str], options: dict) -> list[str]:
    """The files that Spark's CSV reader would read, in order of their paths (empty ones left out)."""
    r = spark.read.format("binaryFile")
    for k in ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter"):
        if k in options:
            r = r.option(k, options[k])
    files = r.load([path] if isinstance(path, str) else list(path)).filter("length > 0").select("path")
    return sorted(f.path for f in files.collect())


def _first_record(chunk: str, options: dict) -> list[str] | None:
    """The fields of the first record, or None if ``chunk`` may end inside it."""
    quote = options.get("quote", '"')
    end = next((i for i, c in enumerate(chunk) if c == "\n" and chunk.count(quote, 0, i) % 2 == 0), None)
    if end is None:
        return None
    return next(csv.reader([chunk[:end].rstrip("\r")], delimiter=options.get("sep", options.get("delimiter", ",")), quotechar=quote), [])


def _headers_in(paths: Iterator[str], options: dict) -> Iterator[tuple[str, list[str]]]:
    from pyarrow.fs import FileSystem
    code = options.get("encoding", options.get("charset", "utf-8"))
    for path in paths:
        fs, inner = FileSystem.from_uri(as_uri(path))
        with fs.open_input_stream(inner) as f:      # packed files are told by their names
            data, fields = b"", None
            while fields is None:
                more = f.read(_HEAD_BYTES)
                data += more
                text = codecs.getincrementaldecoder(code)().decode(data).removeprefix("\ufeff")
                fields = _first_record(text if more else text + "\n", options)
        yield path, fields


def read_headers(spark: SparkSession, path: str | Sequence[str], options: dict | None = None) -> DataFrame:
    """(path, header): the header of every CSV file under ``path``, as its list of names.

    Tasks share the files and read each one's first bytes only. In a store that only Spark can
    read, the files are scanned as text and the first line of each is kept (headers with line breaks
    inside quotes are not known there)."""
    options = dict(options or {})
    paths = _listed(spark, path, options)
    kind = "path string, header array<string>"
    if not paths:
        return spark.createDataFrame([], kind)
    if _arrow_reads(paths[0]):
        def heads(batches: Iterator) -> Iterator:
            import pyarrow as pa
            for b in batches:
                got = list(_headers_in(iter(b.column(0).to_pylist()), options))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()),
                                                  pa.array([h for _, h in got], pa.list_(pa.string()))], names=["path", "header"])

        tasks = min(len(paths), spark.sparkContext.defaultParallelism)
        return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(heads, kind)
    lines = spark.read.text([escape_path(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value",
        F.monotonically_increasing_id().alias("n"))
    first = lines.groupBy("path").agg(F.min_by("value", F.struct("at", "n")).alias("line"))

    @F.udf("array<string>")
    def fields(line: str):
        return _first_record(line.removeprefix("\ufeff") + "\n", options)

    return first.select("path", fields("line").alias("header"))


def _arrow_reads(path: str) -> bool:
    """Can Arrow open files of this store?"""
    from pyarrow.fs import FileSystem
    try:
        FileSystem.from_uri(as_uri(path))
        return True
    except Exception as e:   # the kinds of error differ between stores
        log.info("Arrow does not open %s: %s", path, e)
        return False


def _by_header(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, options: dict,
               extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The columns of ``schema`` and ``extra`` from CSV files, each read by its own header.

    Files whose headers are alike are one scan. Columns are found by normalised name, wherever they
    stand; others are not parsed. A file that lacks a declared column, or has it twice, fails the
    read before any row is read; empty files have no rows."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = {f.name: f.dataType for f in declared}
    alike: dict[tuple[str, ...], list[str]] = {}
    for r in read_headers(spark, path, options).collect():   # a name list a file, as many as Spark's own listing
        alike.setdefault(tuple(normalise_name(c) for c in r.header), []).append(r.path)
    frames = []
    for names, paths in sorted(alike.items(), key=lambda kv: min(kv[1])):
        twice = sorted({n for n in names if names.count(n) > 1 and n in kinds})
        missing = [n for n in kinds if n not in names]
        if missing or twice:
            raise ValueError(f"CSV header of {min(paths)}: missing columns {missing}, ambiguous columns {twice}")
        reader = spark.read.option("header", "true")
        for k, v in options.items():
            if k not in ("pathGlobFilter", "recursiveFileLookup"):
                reader = reader.option(k, v)
        as_read = T.StructType([T.StructField(n if n in kinds else f"__other{i}", kinds.get(n, T.StringType())) for i, n in enumerate(names)])
        df = reader.schema(as_read).csv([escape_path(p) for p in sorted(paths)])
        frames.append(df.select(*[F.col(f"`{n}`") for n in kinds], *[c.alias(n) for n, c in (extra or {}).items()]))
    if not frames:
        return spark.createDataFrame([], declared).withColumns({n: F.lit(None).cast("string") for n in extra or {}})
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def as_uri(path: str) -> str:
    """A path as Spark writes it (``file:/a b``) as a URI; plain local paths stay."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
    return f"{m[1]}://{m[2] or ''}{quote(m[3], safe='/')}" if m else path


def escape_path(path: str) -> str:
    """A file's own path, with the characters that Spark would take for a glob marked."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


CSV_OPTIONS = {"nullValue": "NA", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true",
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a declared schema, columns by normalised header name, each file by its own
    header; others are not parsed. ``NA`` and empty fields are null; a malformed row fails the read."""
    return _by_header(spark, path, schema, CSV_OPTIONS | options)


def read_dir(spark: SparkSession, directory: str, schema: T.StructType | str, fmt: str = "csv",
             glob: str | None = None, name: str = "source_file", full_path: bool = False, **options) -> DataFrame:
    """Every file of a directory, tagged with its file name, or with its path from the directory
    on (``full_path``): the reference loops over files in name order; order is restored by sorting
    on it. CSV files are read by their own headers, and may lie in subfolders."""
    if glob:
        options["pathGlobFilter"] = glob
    source = F.col("_metadata.file_path" if full_path else "_metadata.file_name")
    if full_path:
        inside = urlparse(directory.rstrip("/")).path + "/"
        source = F.element_at(F.split(source, re.escape(inside), 2), -1)
    if fmt == "csv":
        return _by_header(spark, directory, schema, CSV_OPTIONS | {"recursiveFileLookup": "true"} | options, {name: source})
    r = spark.read.schema(schema).format(fmt)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(directory).select("*", source.alias(name))


def list_inputs(spark: SparkSession, directory: str, prefix: str = "", suffix: str = "",
                glob: str | None = None) -> DataFrame:
    """File selection by glob, name prefix and suffix, without reading contents."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(directory).select(F.col("path"), F.col("length"),
                                     F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"))
    return files.filter(F.col("file_name").startswith(prefix) & F.col("file_name").endswith(suffix))


def read_feather(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.feather") -> DataFrame:
    """S3: Arrow IPC (Feather v2) files, a task for each run of record batches (see
    :mod:`fathom.sources.feather`); of a file's columns those of ``schema`` are read.

    In a store that only Spark can read, each file is one binary value and one task
    (:func:`decode_feather`), which bounds a file by 2 GB."""
    from fathom.sources.feather import FeatherSource
    if _arrow_reads(path):
        spark.dataSource.register(FeatherSource)
        return spark.read.format("feather").schema(schema).option("glob", glob).load(path)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    return decode_feather(raw, schema)


def decode_feather(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the Feather files in the one binary column of ``raw``, columns by name."""
    import pyarrow as pa
    target = arrow_schema(schema)

    def decode(batches: Iterator) -> Iterator:
        import pyarrow.feather as feather
        for b in batches:
            for content in b.column(0):
                tbl = feather.read_table(pa.BufferReader(content.as_buffer()), columns=target.names)
                yield from tbl.cast(target).to_batches()

    return raw.mapInArrow(decode, schema)


def arrow_schema(schema: T.StructType):
    import pyarrow as pa
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])


def _arrow_type(t: T.DataType):
    import pyarrow as pa
    return {
        T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.LongType: pa.int64(),
        T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(),
        T.TimestampNTZType: pa.timestamp("us"), T.TimestampType: pa.timestamp("us", tz="UTC"),
        T.DateType: pa.date32(),
    }[type(t)]


def write_feather(df: DataFrame, path: str, batch_rows: int = 65_536) -> None:
    """One Feather file a partition of ``df``, in record batches of ``batch_rows`` rows at most.

    A task writes under a name of its own and then gives the file its partition's name, so that a
    task run twice leaves one file."""
    from pyspark import TaskContext

    def save(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        fs, inner = FileSystem.from_uri(as_uri(path))
        fs.create_dir(inner, recursive=True)
        part = f"{inner}/part-{TaskContext.get().partitionId():05d}"
        draft, rows, writer = f"{part}-{uuid.uuid4()}.draft", 0, None
        for b in batches:
            if writer is None:
                out = fs.open_output_stream(draft)
                writer = pa.ipc.new_file(out, b.schema)
            for i in range(0, b.num_rows, batch_rows):
                writer.write_batch(b.slice(i, batch_rows))
            rows += b.num_rows
        if writer:
            writer.close()
            out.close()
            fs.move(draft, f"{part}.feather")
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    df.mapInArrow(save, "rows long").agg(F.sum("rows")).collect()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Table sink, optionally partitioned (e.g. by date, for partition pruning)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# Declared schemas of the reference's inputs (FIXTURES.md §1).
GRID_CSV = T.StructType([
    T.StructField("Interval", T.LongType()), T.StructField("Layer_depth_min", T.DoubleType()),
    T.StructField("Sv_mean", T.DoubleType()), T.StructField("Date_M", T.IntegerType()),
    T.StructField("Time_M", T.StringType())])
GRID_FEATHER = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()), T.StructField("datetime_round", T.TimestampNTZType()),
    T.StructField("depth", T.DoubleType()), T.StructField("Sv_mean", T.DoubleType())])
LAYERBASE_CSV = T.StructType([
    T.StructField("datetime_round", T.StringType()), T.StructField("layer_base", T.DoubleType()),
    T.StructField("center_of_mass", T.DoubleType()), T.StructField("year", T.IntegerType())])
OCEAN_CSV = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("upwelling", T.DoubleType()), T.StructField("sealevel_lowpass", T.DoubleType())])
DIVES_CSV = T.StructType([
    T.StructField("index_recorded_timestamp", T.StringType()), T.StructField("activity", T.StringType()),
    T.StructField("concept", T.StringType()), T.StructField("depth_meters", T.DoubleType()),
    T.StructField("light_transmission", T.DoubleType()), T.StructField("temperature_celsius", T.DoubleType()),
    T.StructField("salinity", T.DoubleType()), T.StructField("oxygen_ml_per_l", T.DoubleType())])
CENTER_OF_MASS_CSV = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("datetime", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("cm", "layertop", "layerbase")], T.StructField("hour", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("cm_smooth", "layertop_smooth", "layerbase_smooth")]])
SCHOOLS_CSV = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in ("bottom", "top")],
    *[T.StructField(c, T.LongType()) for c in ("left", "right", "height", "width", "npixels")],
    *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "total")],
    T.StructField("school_id", T.StringType()), T.StructField("start_time", T.StringType()),
    T.StructField("middle", T.DoubleType()), T.StructField("date", T.DateType())])
SCHOOLS_SUMMARY_CSV = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("nschools", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("sa", "mean_depth", "max_depth", "Sa")]])
CLICKS_FEATHER = T.StructType([
    T.StructField("time_round", T.TimestampNTZType()), T.StructField("n", T.LongType())])
