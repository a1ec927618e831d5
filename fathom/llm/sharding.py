"""Operator 12, sharding: documents go to a fixed number of shards of near equal bytes.

Records stand in order of a hash of their text, so that equal texts lie side by side. Keys are
drawn with a chance in proportion to their size; quantiles of the sample cut the order into many
ranges of about equal bytes. Ranges that hold too many records are cut again, by further keys or,
where one text fills them, by a hash of the record. The exact sizes of the ranges and running
sums inside them tell each record's place in bytes, and with that its shard and slot: the sample
decides how work is spread, never the result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import read_table, stage
from fathom.llm.crc_sql import crc32_blocks, utf8

SHARDS = 8
#: At least so many ranges, and one more for each RANGE_ROWS records.
RANGES, RANGE_ROWS = 2048, 1 << 18
#: Sample keys drawn for each range, on average.
DRAWN = 8
#: Equal texts stay in one shard if together they are at most this part of a shard's share.
SLACK = 0.01


def _names(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """md5 of the text (null: empty), and of the id, whether the text is null, and a hash of any other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    rest = [F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.when(F.col(text).isNull(), "null")]
    rest += [F.xxhash64(*others).cast("string")] if others else []
    return F.md5(F.coalesce(F.col(text), F.lit(""))), F.md5(F.concat_ws(":", *rest))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, __a, __b, __n): one row for rows alike in all columns, ``__n`` of
    them. ``__a`` names the text, ``__b`` the rest of the row. Size: UTF-8 bytes and 1 (null text: 1)."""
    a, b = _names(docs, doc_id, text)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        a.alias("__a"), b.alias("__b"))
    return rows.groupBy("doc_id", "size", "text_crc32", "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))


def _unit(*cols) -> Column:
    """A number in [0, 1) that only the values of ``cols`` decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _draw(rows: DataFrame, weight: Column, rate: float, seed: int) -> list[str]:
    """Text keys, each drawn ``weight * rate`` times on average."""
    hits = (weight * F.lit(rate) + _unit(F.lit(seed), "__a", "__b")).cast("long")
    got = rows.select("__a", hits.alias("hits")).filter("hits > 0").groupBy("__a").agg(F.sum("hits").alias("hits"))
    return [k for r in sorted(got.collect()) for k in [r[0]] * min(r[1], DRAWN)]


def _range(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """``rows`` with ``__r``, the number of splitters up to the row's text key. Splitters lie in
    cells of the key's first hex digits, a few in each."""
    spark = rows.sparkSession
    digits = max(1, len(splitters).bit_length() // 4)
    cells: dict[str, list[str]] = {}
    for s in splitters:
        cells.setdefault(s[:digits], []).append(s)
    table, base = [], 0
    for c in (f"{i:0{digits}x}" for i in range(16 ** digits)):
        own = cells.get(c, [])
        table.append((c, base, own))
        base += len(own)
    cell = F.broadcast(spark.createDataFrame(table, "__cell string, __base long, __own array<string>"))
    at = rows.withColumn("__cell", F.substring("__a", 1, digits)).join(cell, "__cell")
    here = F.size(F.filter("__own", lambda s: s <= F.col("__a")))
    return at.withColumn("__r", F.col("__base") + here).drop("__cell", "__base", "__own")


def ranges(rows: DataFrame, least: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` of :func:`sized` with ``__r``, ``__sub``: ranges of text keys in ascending order, and
    the parts of a range that one text fills. A range has about equal bytes and at most
    4 times the average number of rows, but for chance."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("__n"))).first()
    wanted = max(least, n // range_rows)
    most = max(4 * n // wanted, 16)
    keys = _draw(rows, F.col("size") * F.col("__n"), DRAWN * wanted / max(total or 0, 1), 0)
    splitters = sorted(set(keys[DRAWN // 2::DRAWN]))
    full: dict[str, int] = {}
    seed = 0
    while True:
        seed += 1
        cut = _range(rows, splitters)
        counts = cut.groupBy("__r").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most).collect()
        over = {r[0]: r[1] for r in counts if not (r[0] and splitters[r[0] - 1] in full)}
        if not over:
            break
        inside = cut.filter(F.col("__r").isin(*over)) if len(over) <= 100 else cut.join(F.broadcast(
            rows.sparkSession.createDataFrame([(r,) for r in over], "__r long")), "__r")
        # a text that fills its range gets a range of its own: it begins at the key, the next one just behind
        texts = {r[0]: r[1] for r in inside.groupBy("__a").count().filter(F.col("count") > most // 2).collect()}
        full |= texts
        more = _draw(inside, F.lit(1.0), min(1.0, 4 * DRAWN / most), seed)
        splitters = sorted({*splitters, *more[::DRAWN], *texts, *(t + "0" for t in texts)})
    if not full:
        return cut.withColumn("__sub", F.lit(0))
    parts = [(bisect_right(splitters, t), 2 * c // most + 1) for t, c in full.items()]
    sub = F.broadcast(rows.sparkSession.createDataFrame(parts, "__r long, __m long"))
    part = F.floor(F.conv(F.substring("__b", 1, 8), 16, 10).cast("long") * F.coalesce("__m", F.lit(1)) / F.lit(float(1 << 32)))
    return cut.join(sub, "__r", "left").withColumn("__sub", part.cast("int")).drop("__m")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", slack: float = SLACK,
          least: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, __a, __b, shard, slot) for every row, by the law ``bytes``.

    A record goes to the shard that its middle byte falls into, of ``shards`` equal stretches of all
    bytes in order of md5(text) and md5(id). Equal texts of at most ``slack`` of a shard's share
    in all go by the middle of them together, larger groups are cut. So a shard's bytes differ from
    the share by ``slack`` or by the largest record at most. ``slot``: place in the shard, from 0.
    Null text is an empty text, null id is an id of its own; rows alike in all columns take slots
    side by side; an empty table gives no rows."""
    cut = stage(ranges(stage(sized(docs, doc_id, text)), least, range_rows))
    sums = cut.groupBy("__r", "__sub").agg(F.sum("__n").alias("n"), F.sum(F.col("size") * F.col("__n")).alias("bytes")).collect()
    sums.sort()
    table, rank, total = [], 0, 0
    whole: dict[int, list[int]] = {}
    for r, s, n, size in sums:  # one row a range
        table.append([r, s, rank, total])
        whole.setdefault(r, [total, 0])[1] += size
        rank, total = rank + n, total + size
    parted = {r for r, s, *_ in table if s}
    table = [(*t, *(whole[t[0]] if t[0] in parted else (None, None))) for t in table]
    base = F.broadcast(docs.sparkSession.createDataFrame(table, "__r long, __sub int, __rank0 long, __at0 long, __g0 long, __gsize long"))
    w = Window.partitionBy("__r", "__sub").orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("__r", "__sub", "__a")
    mass = F.col("size") * F.col("__n")
    rows = cut.withColumns({"__rank": F.coalesce(F.sum("__n").over(w), F.lit(0)), "__at": F.coalesce(F.sum(mass).over(w), F.lit(0))})
    rows = rows.withColumns({"__first": F.min("__at").over(same), "__size": F.sum(mass).over(same)})
    rows = rows.join(base, ["__r", "__sub"])
    rows = rows.withColumns({
        "__rank": F.col("__rank") + F.col("__rank0"), "__at": F.col("__at") + F.col("__at0"),
        "__first": F.coalesce(F.col("__g0"), F.col("__first") + F.col("__at0")), "__size": F.coalesce("__gsize", "__size")})
    # copies of a row, in two steps so that no array is long
    step = 1 << 16
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__n") - 1).cast("long"), F.lit(step).cast("long"))))
    rows = rows.withColumn("__j", F.explode(F.sequence(F.col("__k"), F.least(F.col("__k") + (step - 1), F.col("__n") - 1))))

    kept = F.col("__size") * shards <= F.lit(slack * total)
    rows = rows.withColumn("shard", F.when(kept, _stretch("__first", "__size", shards, total)).otherwise(
        _stretch("__at + __j * size", "size", shards, total)).cast("int"))
    placed = stage(rows.select("doc_id", "size", "text_crc32", "__a", "__b", "shard", (F.col("__rank") + F.col("__j")).alias("__rank")))
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("__rank")).collect()}
    start = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return placed.withColumn("slot", F.col("__rank") - F.element_at(start, F.col("shard") + 1)).drop("__rank")


def _stretch(start: str, size: str, shards: int, total: int) -> Column:
    """Which of ``shards`` equal stretches of ``total`` bytes holds the middle of a record, in whole numbers."""
    return F.expr(f"least({shards - 1}, ((2 * ({start}) + {size}) * {shards}) div {2 * max(total, 1)})")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """The rows of ``docs`` with ``shard`` and ``slot``, as Parquet in one folder a shard and in
    order of slots within and across its files."""
    a, b = _names(docs, doc_id, text)
    one = docs.withColumns({"__a": a, "__b": b}).dropDuplicates(["__a", "__b"])
    rows = one.join(placed.select("__a", "__b", F.col("shard").alias("__shard"), "slot"), ["__a", "__b"]).drop("__a", "__b")
    rows = rows.repartitionByRange("__shard", "slot").sortWithinPartitions("__shard", "slot")
    rows.withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))


_CRC = crc32_blocks("(SELECT a, any_value(t) AS t FROM d GROUP BY a)", "a", utf8("t"))

SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, md5(coalesce(text, '')) AS a,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), CASE WHEN text IS NULL THEN 'null' END)) AS b FROM documents),
crcs AS ({_CRC}),
o AS (SELECT *, row_number() OVER (ORDER BY a, b, rid) AS place, sum(size) OVER (ORDER BY a, b, rid ROWS UNBOUNDED PRECEDING) - size AS pos,
             sum(size) OVER (PARTITION BY a) AS gsize, sum(size) OVER () AS total FROM d),
g AS (SELECT *, min(pos) OVER (PARTITION BY a) AS g0 FROM o),
s AS (SELECT *, least({SHARDS - 1}, CASE WHEN gsize * {SHARDS} <= {SLACK}::DOUBLE * total THEN ((2 * g0 + gsize) * {SHARDS}) // (2 * total)
                          ELSE ((2 * pos + size) * {SHARDS}) // (2 * total) END)::INTEGER AS shard FROM g)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s JOIN crcs USING (a)
"""
