"""Ordered-sequence operators that never collapse to one task.

The reference treats a series as an in-memory vector: row ``i`` and its neighbours.
A ``Window.orderBy`` without ``partitionBy`` would reproduce that by pulling the whole
series into one task. Instead every global-order operation here goes through
:func:`with_row_index` (W10):

1. a uniform sample of the order's keys (the rows of least hash) gives range bounds, which
   from then on are literals, so that every evaluation deals rows out alike,
2. one aggregate counts the rows of each range (only the keys are read),
3. ``row = rows of all ranges before + rank inside the range``.

Nothing but the bounds and counts is kept: a lost executor's ranges are computed again and
come out the same, because the order is total.

Bounded windows (lag, moving mean, dilation) are evaluated per fixed-size block of rows, each
block carrying a halo of the neighbouring rows it needs (:func:`block_window`). Running sums
use per-block totals (:func:`prefix_sum`). All of them take ``by``, the columns that tell one
series from another: the index then runs over (series, order), so that a long series is cut into
blocks and many short ones share a block, and windows stay inside their series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathom.session import cut_lineage

_BLK, _HOME = "__blk", "__home"
DEFAULT_BLOCK_ROWS = 100_000
#: Rows a range should hold, and keys drawn for each shuffle partition (1024 at least).
RANGE_ROWS, DRAWN = 10_000, 8


def _range_bounds(df: DataFrame, order: Sequence[str], range_rows: int) -> list[tuple]:
    """Ascending keys that cut ``df`` into ranges of about ``range_rows`` rows, one a shuffle
    partition at most. The sample is the rows whose key has the least hash: as many as asked for
    whatever the size of the table, and the largest of these hashes tells that size."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = max(1024, DRAWN * most)
    keys = df.select(*order).withColumn("__u", F.xxhash64(*order))
    got = keys.orderBy("__u").limit(drawn).orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()
    share = (max((r["__u"] for r in got), default=0) + 2.0 ** 63) / 2.0 ** 64
    rows = len(got) if len(got) < drawn else len(got) / share
    ranges = min(most, max(1, round(rows / range_rows)))
    at = sorted({len(got) * i // ranges for i in range(1, ranges)})
    return [tuple(got[i][c] for c in order) for i in at]


def _range_of(df: DataFrame, order: Sequence[str], bounds: list[tuple], out: str) -> DataFrame:
    """``out``: how many of ``bounds`` are at or before the row's key, by bisection."""
    kinds = [df.schema[c].dataType for c in order]
    df = df.withColumn(out, F.lit(0))
    if not bounds:
        return df
    table = F.array(*[F.struct(*[F.lit(v).cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(b, kinds))]) for b in bounds])
    key = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        df = df.withColumn(out, F.when(F.get(table, F.col(out) + (step - 1)) <= key, F.col(out) + step).otherwise(F.col(out)))
        step //= 2
    return df


def with_row_index(df: DataFrame, order: Sequence[str], index_col: str = "rn",
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add a 1-based global row number in the ascending order (nulls first) of the columns
    ``order``.

    ``order`` must be a total order (add a tiebreak column) for the result to be deterministic.
    ``df`` is evaluated three times: for the sample and for the counts, where only the keys are
    read, and when the result is. If it takes long to make, write it first. The counts (one number a
    range) come back to the driver and are broadcast as offsets."""
    order = list(order)
    bounds = _range_bounds(df, order, range_rows)
    keys = df.select(*order)
    counts = {r[0]: r[1] for r in _range_of(keys, order, bounds, "__rid").groupBy("__rid").count().collect()} if bounds else {}
    rows, off = [], 0
    for rid in range(len(bounds) + 1):
        rows.append((rid, off))
        off += counts.get(rid, 0)
    offsets = df.sparkSession.createDataFrame(rows, "__rid int, __off long")
    w = Window.partitionBy("__rid").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    # a single range takes its number from the table, too: it is dealt out like the others
    offsets = F.broadcast(offsets)
    tagged = _range_of(df, order, bounds, "__rid").join(offsets, "__rid") if bounds else df.crossJoin(offsets)
    return tagged.withColumn(index_col, F.col("__off") + F.row_number().over(w)).drop("__rid", "__off")


def block_window(df: DataFrame, rn: str, before: int, after: int,
                 build: Callable[[WindowSpec], dict[str, Column]],
                 block_rows: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Evaluate row-frame window expressions over the global order ``rn``, within each series of ``by``.

    ``build(w)`` receives a window spec ordered by ``rn`` and returns new columns. Every
    frame must lie within ``[-before, +after]`` rows. Rows are cut into blocks of
    ``block_rows``; the last ``before`` rows of a block are copied into the next block and
    the first ``after`` rows into the previous one, so each block sees its neighbours.
    """
    before, after = max(int(before), 0), max(int(after), 0)
    block_rows = max(int(block_rows), before + after + 1)
    pos = F.pmod(F.col(rn) - 1, F.lit(block_rows))
    home = F.floor((F.col(rn) - 1) / F.lit(block_rows)).cast("long")
    targets = F.array(home)
    if before:
        targets = F.when(pos >= block_rows - before, F.array_union(targets, F.array(home + 1))) \
            .otherwise(targets)
    if after:
        targets = F.when(pos < after, F.array_union(targets, F.array(home - 1))).otherwise(targets)
    spread = df.withColumn(_HOME, home).withColumn(_BLK, F.explode(targets))
    w = Window.partitionBy(_BLK, *by).orderBy(rn)
    out = spread.withColumns(build(w))
    return out.filter(F.col(_BLK) == F.col(_HOME)).drop(_BLK, _HOME)


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    """a's columns ``by`` equal b's ``__k_`` columns; null is a value of its own, as in groupBy."""
    cond = F.lit(True)
    for c in by:
        cond = cond & a[c].eqNullSafe(b[f"__k_{c}"])
    return cond


def _renamed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__k_{c}" for c in by})


def _before(totals: DataFrame, by: list[str], levels: int, fan: int) -> DataFrame:
    """(by, block, __boff): sum of ``t`` over all earlier blocks of the series, ``fan`` blocks a window; the
    totals of those windows are summed the same way, level by level."""
    inner = Window.partitionBy(*by, "__up").orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    up = totals.withColumn("__up", F.floor(F.col(_BLK) / F.lit(fan)).cast("long"))
    within = up.withColumn("__boff", F.coalesce(F.sum("t").over(inner), F.lit(0)))
    if not levels:
        return within.select(*by, _BLK, "__boff")
    above = up.groupBy(*by, F.col("__up").alias(_BLK)).agg(F.sum("t").alias("t"))
    above = _before(above, by, levels - 1, fan).withColumnsRenamed({_BLK: "__up", "__boff": "__uoff"})
    above = _renamed(above, [*by, "__up"])
    return within.join(above, _same(within, above, [*by, "__up"])).select(
        *by, _BLK, (F.col("__boff") + F.col("__uoff")).alias("__boff"))


#: Rows that a series is sure to stay below.
MOST_ROWS = 10 ** 15


def prefix_sum(df: DataFrame, rn: str, value, out_col: str,
               block_rows: int = DEFAULT_BLOCK_ROWS, fan: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``value`` over the global order ``rn`` (inclusive), within each series of ``by``.

    Blocks have a fixed size whatever the length of the series; the totals of ``fan`` blocks are
    summed by one window, and theirs by another. With blocks so small that two levels might not
    do, the largest ``rn`` is looked up for their number."""
    by = list(by)
    v = value if isinstance(value, Column) else F.col(value)
    last = MOST_ROWS // block_rows
    if last >= fan * fan * fan:
        last = ((df.agg(F.max(rn)).first()[0] or 1) - 1) // block_rows
    levels = 0
    while last >= fan:
        last, levels = last // fan, levels + 1
    blk = F.floor((F.col(rn) - 1) / F.lit(block_rows)).cast("long")
    staged = df.withColumn(_BLK, blk).withColumn("__v", v)
    totals = staged.groupBy(*by, _BLK).agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("t"))
    base = _renamed(_before(totals, by, levels, fan), [*by, _BLK])
    w = Window.partitionBy(*by, _BLK).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    ran = staged.withColumn("__in", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return ran.join(base, _same(ran, base, [*by, _BLK])).withColumn(out_col, F.col("__boff") + F.col("__in")).select(*df.columns, out_col)


# ---------------------------------------------------------------- W1-W4, W9

def moving_mean(df: DataFrame, rn: str, cols: Sequence[str], k: int,
                border: str = "replicate", suffix: str = "_smooth",
                block_rows: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Centred ``k``-row moving mean. ``replicate`` pads each end of a series with its first/last
    value (so every window has ``k`` values); ``shrink`` averages what exists."""
    h = k // 2

    def build(w: WindowSpec) -> dict[str, Column]:
        n = F.count(F.lit(1))
        full, left, right = w.rowsBetween(-h, h), w.rowsBetween(-h, 0), w.rowsBetween(0, h)
        out = {}
        for c in cols:
            total, rows = F.sum(c).over(full), n.over(full)
            if border == "replicate":
                # a row near an end has that end in its frame
                total = (total + (h + 1 - n.over(left)) * F.first(c).over(left)
                         + (h + 1 - n.over(right)) * F.last(c).over(right)) / F.lit(float(k))
            else:
                total = total / rows
            out[c + suffix] = F.when(F.count(c).over(full) == rows, total)
        return out

    return block_window(df, rn, h, h, build, block_rows, by)


def diff0(df: DataFrame, rn: str, cols: Sequence[str], prefix: str = "d",
          block_rows: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """First difference with a leading 0 (``c(0, diff(x))``); nulls propagate."""
    def build(w):
        first = F.count(F.lit(1)).over(w.rowsBetween(-1, 0)) == 1
        return {f"{prefix}{c}": F.when(first, F.lit(0.0)).otherwise(
            F.col(c) - F.lag(c, 1).over(w)) for c in cols}
    return block_window(df, rn, 1, 0, build, block_rows, by)


def dilate(df: DataFrame, rn: str, flag: str, out_col: str, back: int = 4, ahead: int = 1,
           block_rows: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Binary dilation looking ``back`` rows behind and ``ahead`` rows ahead.
    The first ``back - 1`` rows of a series get no look-ahead (as in the reference's loop)."""
    def build(w):
        as_int = F.col(flag).cast("int")
        full = F.max(as_int).over(w.rowsBetween(-back, ahead))
        head = F.max(as_int).over(w.rowsBetween(-back, 0))
        early = F.count(F.lit(1)).over(w.rowsBetween(-back, 0)) < back
        return {out_col: F.when(early, head).otherwise(full) == 1}
    return block_window(df, rn, back, ahead, build, block_rows, by)


def label_runs(df: DataFrame, rn: str, flag: str, out_col: str,
               block_rows: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Number TRUE runs 1..k in order, from 1 in each series; FALSE rows get 0 (gaps and islands)."""
    def build(w):
        prev = F.lag(flag, 1).over(w)
        return {"__start": (F.col(flag) & (prev.isNull() | ~prev)).cast("long")}
    starts = block_window(df, rn, 1, 0, build, block_rows, by)
    ran = prefix_sum(starts, rn, "__start", "__runs", block_rows, by=by)
    return ran.withColumn(out_col, F.when(F.col(flag), F.col("__runs")).otherwise(F.lit(0))
                          .cast("long")).drop("__start", "__runs")


def cross_corr(df: DataFrame, rn: str, x: str, y: str, max_lag: int,
               block_rows: int = DEFAULT_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Sample cross-correlation of x and y at lags -max_lag..max_lag, one set a series.

    Each series loses its own (null-skipping) mean; the sum of products at lag k over
    pairwise-complete pairs is divided by (pairs + |k|) and normalised by the two lag-0
    autocovariances, clamped to [-1, 1]; NULL if one of them is 0. Lag k pairs x[t+k] with y[t].
    """
    by = list(by)
    stats = _renamed(df.groupBy(*by).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my")), by)
    # without ``by`` this is one row, else one a series
    joined = df.join(stats, _same(df, stats, by)) if by else df.crossJoin(F.broadcast(stats))
    centred = joined.withColumn("__xc", F.col(x) - F.col("__mx")).withColumn("__yc", F.col(y) - F.col("__my"))

    def build(w):
        out = {}
        for k in range(-max_lag, max_lag + 1):
            xk = F.lead("__xc", k).over(w) if k > 0 else (
                F.lag("__xc", -k).over(w) if k < 0 else F.col("__xc"))
            out[f"__p{k + max_lag}"] = xk * F.col("__yc")
        return out

    prods = block_window(centred, rn, max_lag, max_lag, build, block_rows, by)
    m = 2 * max_lag + 1
    sums = prods.groupBy(*by).agg(*[F.sum(f"__p{i}").alias(f"__s{i}") for i in range(m)],
                     *[F.count(f"__p{i}").alias(f"__c{i}") for i in range(m)],
                     F.try_divide(F.sum(F.col("__xc") * F.col("__xc")), F.count("__xc")).alias("__vx"),
                     F.try_divide(F.sum(F.col("__yc") * F.col("__yc")), F.count("__yc")).alias("__vy"))
    lags = sums.select(*by, F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"__s{k + max_lag}").alias("s"),
                 F.col(f"__c{k + max_lag}").alias("c"))
        for k in range(-max_lag, max_lag + 1)])).alias("__l"), "__vx", "__vy")
    cov = F.try_divide(F.col("__l.s"), F.col("__l.c") + F.abs(F.col("__l.lag")))
    r = F.try_divide(cov, F.sqrt(F.col("__vx") * F.col("__vy")))
    return lags.select(*by, F.col("__l.lag").cast("int").alias("lag"),
                       F.when((F.col("__l.c") > 0) & r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
                       .alias("acf"))


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out_col: str) -> DataFrame:
    """1-based position of each row inside its ``by`` group in ``order``.

    With distinct rows this is ``dense_rank``. Computed from the global index and a
    per-group minimum (an aggregate), so a huge group is still spread over many tasks."""
    by = list(by)
    idx = with_row_index(df, [*by, *order], "__gr")
    first = idx.groupBy(*by).agg(F.min("__gr").alias("__g0"))
    if not by:
        joined = idx.crossJoin(F.broadcast(first))
    else:
        # NULL is a group of its own, as in groupBy
        first = first.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__g0")
        cond = None
        for c in by:
            e = idx[c].eqNullSafe(first[f"__k_{c}"])
            cond = e if cond is None else cond & e
        joined = idx.join(first, cond).drop(*[f"__k_{c}" for c in by])
    return joined.withColumn(out_col, F.col("__gr") - F.col("__g0") + 1).drop("__gr", "__g0")


def rank_axes(df: DataFrame, by: Sequence[str], axes: Sequence[str]) -> dict[str, DataFrame]:
    """W11 for several axes at once: for each column in ``axes``, its distinct values per
    ``by`` group with their 1-based rank. One global index serves all axes (rows are
    tagged with their axis; the other axes' columns are NULL and sort first)."""
    by = list(by)
    parts = []
    for k, a in enumerate(axes):
        part = df.select(*by, a).distinct().withColumn("__axis", F.lit(k))
        for b in axes:
            if b != a:
                part = part.withColumn(b, F.lit(None).cast(df.schema[b].dataType))
        parts.append(part.select(*by, "__axis", *axes))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    # the axes are short beside their grids: written, so that the index reads them
    ranked = rank_within(cut_lineage(stacked), [*by, "__axis"], list(axes), "__rank")
    return {a: ranked.filter(F.col("__axis") == k).select(*by, a, F.col("__rank").cast("int").alias("__rank"))
            for k, a in enumerate(axes)}
