"""Helpers shared by the operators: word hashing, row slices, stage tables, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import cut_lineage, ensure_checkpoint_dir

#: A word of the text contracts: a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy. The shuffle files
    behind it are let go: the driver's garbage is collected, which is what frees them."""
    out = cut_lineage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stage_table(df: DataFrame) -> DataFrame:
    """Like :func:`stage`, as a Parquet table in the shared checkpoint folder: smaller for many
    narrow rows. For results that are used up within an operator, which then drops it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete what :func:`stage_table` wrote."""
    for t in tables:
        jvm, sc = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(t._stage_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]):
    """Join condition left.k <=> right.v for every pair of ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[v]) for k, v in keys.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` (of a list: elements) each, one
    row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column)
        size = pc.list_value_length(v) if pa.types.is_list(v.type) else pc.binary_length(v)
        size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // max_bytes
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], b.num_rows]):
            yield b.slice(int(s), int(e - s))


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, after which the memory that Arrow keeps for later goes back to the system:
    Python workers live on between their tasks, beside whatever the executor does next."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Row offsets (n + 1) and the flat words of all rows; null and empty texts have none."""
    # copied to a buffer of its own: ascii_lower goes wrong on a slice whose offsets don't start at 0
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    off = parts.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.r_[0, np.cumsum(real)]
    return before[off], flat.filter(pa.array(real))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """uint64 hash of every word: its bytes are mixed in eight at a time."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    off = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    data = np.r_[raw, np.zeros(8, dtype=np.uint8)]
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=data, strides=(1,))
    at, left = off[:-1] - off[0], np.diff(off)
    out = mix64(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(n)
    while len(todo):
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[todo] = mix64(out[todo] ^ (chunk * np.uint64(0xD6E8FEB86659FD93)))
        on = left > 8
        todo, at, left = todo[on], at[on] + 8, left[on] - 8
    return out


def odd_powers(n: int, seed: int) -> np.ndarray:
    """n fixed odd uint64 multipliers, one per position of a window."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every k consecutive elements of ``h`` (len(h) - k + 1 values; none for k = 0)."""
    n = len(h) - k + 1
    if n <= 0 or k <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i, c in enumerate(odd_powers(k, seed)):
        out += h[i:i + n] * c
    return mix64(out)


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable, for every linked node.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014); each is one
    pre-aggregated group-by and one join whose key side has one row a node, so a hub's
    rows can be split. It ends when every link is a star: each node that has a smaller
    neighbour has exactly one, and that one has none.
    """
    e = stage(_both(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))))
    while True:
        low = stage(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") < F.col("u"), 1)).alias("down"),
                                       F.count(F.when(F.col("v") > F.col("u"), 1)).alias("up")))
        if low.filter("down > 1 or (down > 0 and up > 0)").isEmpty():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        near = low.select("u", F.least("u", "m").alias("m"))
        large = e.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        spokes = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(_both(spokes.unionByName(m.select("u", F.col("m").alias("v")))))
