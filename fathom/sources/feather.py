"""A Spark data source for Arrow IPC files (Feather v2).

A file's footer tells where its record batches are. Runs of batches, cut by their bytes, are the
partitions of the scan, so a file of any size is read by many tasks, and none holds more than a
batch at a time. Only the columns of the declared schema are read from a batch.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fathom.sources.files import arrow_schema, as_uri

#: Bytes of batches that a task should read.
PARTITION_BYTES = 128 << 20


class BatchRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class FeatherSource(DataSource):
    """``spark.read.format("feather").schema(...).load(folder)``; options: ``glob``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatherReader(self.options, schema)


class FeatherReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        """One entry for each run of batches. Footers are small and read side by side."""
        from pyarrow.fs import FileSelector, FileSystem, FileType
        fs, inner = FileSystem.from_uri(as_uri(self.path))
        found = fs.get_file_info(inner)
        files = [found] if found.type == FileType.File else sorted(
            (f for f in fs.get_file_info(FileSelector(inner, recursive=True)) if f.type == FileType.File and f.size
             and fnmatch.fnmatch(f.base_name, self.glob) and f.base_name[0] not in "._"), key=lambda f: f.path)
        with ThreadPoolExecutor(16) as pool:
            ranges = list(pool.map(lambda f: self._ranges(fs, f), files))
        return [r for rs in ranges for r in rs] or [BatchRange("", 0, 0)]

    def _ranges(self, fs, file) -> list[BatchRange]:
        import pyarrow as pa
        with fs.open_input_file(file.path) as f:
            n = pa.ipc.open_file(f).num_record_batches
        each = max(1, int(n * self.bytes // max(file.size, 1)))   # batches of a file are alike in size
        return [BatchRange(file.path, i, min(i + each, n)) for i in range(0, n, each)]

    def read(self, partition: BatchRange) -> Iterator:
        import pyarrow as pa
        from pyarrow.fs import FileSystem
        if not partition.path:
            return
        target = arrow_schema(self.schema)
        fs, _ = FileSystem.from_uri(as_uri(self.path))
        with fs.open_input_file(partition.path) as f:
            names = pa.ipc.open_file(f).schema.names
            missing = [c for c in target.names if c not in names]
            if missing:
                raise ValueError(f"{partition.path}: missing columns {missing}")
            options = pa.ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in target.names))
            batches = pa.ipc.open_file(f, options=options)
            for i in range(partition.first, partition.last):
                t = pa.Table.from_batches([batches.get_batch(i)]).select(target.names)
                yield from t.cast(target).to_batches()
