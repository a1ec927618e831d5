"""Projections, filters and joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions._util import as_col
from fathom.operators.sequence import with_row_index


def derive(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Simultaneous derivation; every expression sees the *old* columns
    (so ``{'bottom': col('top'), 'top': col('bottom')}`` swaps)."""
    keep = [F.col(c) for c in df.columns if c not in exprs]
    return df.select(*keep, *[e.alias(k) for k, e in exprs.items()])


def derive_seq(df: DataFrame, exprs: Sequence[tuple[str, Column]]) -> DataFrame:
    """Sequential derivation; later expressions see earlier results."""
    for name, e in exprs:
        df = df.withColumn(name, e)
    return df


def between_open(c, lo, hi) -> Column:
    """P4/P5 (open): lo < c < hi."""
    c = as_col(c)
    return (c > lo) & (c < hi)


def in_range(c, lo, hi, closed: bool = True) -> Column:
    """P5: chained comparison, closed (lo <= c <= hi) or open."""
    c = as_col(c)
    return c.between(lo, hi) if closed else between_open(c, lo, hi)


def flag_in(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Boolean column: is the row's key in ``keys``? (left join on distinct keys)."""
    k = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    return df.join(k, list(on), "left").withColumn(
        flag, F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")


SLICE_ROWS = 100_000


def row_slice(df: DataFrame, order: Sequence, first: int, last: int,
              rn: str = "row_nr") -> DataFrame:
    """1-based inclusive positional slice in ``order``.

    A slice near the start is a top-n (every task passes on its ``last`` first rows at most);
    one further down goes through the global row index."""
    if last > SLICE_ROWS:
        return with_row_index(df, order, rn).filter(F.col(rn).between(first, last))
    cols = [o if isinstance(o, Column) else F.col(o).asc_nulls_first() for o in order]
    top = df.orderBy(*cols).limit(last)
    place = F.row_number().over(Window.orderBy(*cols)).cast("long")
    return top.withColumn(rn, place).filter(F.col(rn) >= first)


def head(df: DataFrame, order: Sequence, n: int = 6) -> DataFrame:
    """First ``n`` rows in an explicit order (TakeOrderedAndProject: top-n per task)."""
    return df.orderBy(*order).limit(n)


def distinct_sorted(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(c).distinct().orderBy(c)


def crop(df: DataFrame, x: str, y: str, x_limits=None, y_limits=None) -> DataFrame:
    """Inclusive crop. Given limits are literals, so they reach the scan; a missing limit is
    the column's own minimum and maximum, which only nulls are outside of."""
    for c, lim in ((x, x_limits), (y, y_limits)):
        df = df.filter(F.col(c).isNotNull() if lim is None else F.col(c).between(min(lim), max(lim)))
    return df


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row. A second row raises; no row, no result."""
    n = F.count(F.lit(1))
    one = scalar.agg(*[F.first(c).alias(c) for c in scalar.columns], F.when(
        n > 1, F.raise_error(F.lit("with_scalar: more than one row")).cast("long")).otherwise(n).alias("__rows"))
    return df.crossJoin(F.broadcast(one.filter("__rows = 1").drop("__rows")))


def natural_left_join(a: DataFrame, b: DataFrame, null_matches: bool = True) -> DataFrame:
    """Left join on all shared column names; NULL keys match each other like dplyr."""
    common = [c for c in a.columns if c in b.columns]
    if not common:
        raise ValueError("natural join: no shared columns")
    if not null_matches:
        return a.join(b, common, "left")
    bb = b.select(*[F.col(c).alias(f"__k_{c}") for c in common],
                  *[c for c in b.columns if c not in common])
    cond = None
    for c in common:
        e = a[c].eqNullSafe(bb[f"__k_{c}"])
        cond = e if cond is None else cond & e
    return a.join(bb, cond, "left").drop(*[f"__k_{c}" for c in common])


#: So many intervals are compared with every row; more go through their index.
FEW_INTERVALS = 64
#: Entries of the index of intervals that are sent to all tasks.
SENT_ENTRIES = 100_000


def _axis(c: Column, kind: T.DataType) -> Column:
    """Place on the axis of a number, a date or a time, as a double of the same order."""
    if isinstance(kind, T.TimestampNTZType):
        c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    return c.cast("double")


def _level(length: Column) -> Column:
    """Least k with 2**k >= length, from -1 on; 1024 for an endless length."""
    k = F.ceil(F.log2(F.least(F.greatest(length, F.lit(0.5)), F.lit(2.0 ** 1023)))).cast("int")
    k = k + (F.pow(F.lit(2.0), F.least(k, F.lit(1023)).cast("double")) < F.least(length, F.lit(2.0 ** 1023))).cast("int")
    return F.when(length <= 0.5, F.lit(-1)).when(length > 2.0 ** 1023, F.lit(1024)).otherwise(k)


def _bin(c: Column, level: Column) -> Column:
    """The bin of width 2**level that holds ``c``; one bin for all at the endless level."""
    return F.when(level >= 1024, F.lit(0.0)).otherwise(F.floor(c / F.pow(F.lit(2.0), F.least(level, F.lit(1023)).cast("double"))).cast("double"))


#: Times that may lie in the bin of an interval's end, on average, if intervals take totals.
END_TIMES = 64


def _totals_of(of: Mapping[str, tuple[Column, str]], again: bool = False) -> list[Column]:
    """The aggregates ``of`` over rows, or ``again`` over totals of rows."""
    return [getattr(F, kind)(F.col(name) if again else c).alias(name) for name, (c, kind) in of.items()]


def _totals_join(cells: DataFrame, bounds: DataFrame, col: str, start: str, end: str, of: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Every interval of times with the totals that make up what lies inside it.

    ``cells`` has the totals of each time. They are added up in bins of a power of two's width, from
    the finest level, whose bins hold END_TIMES times on average at most, to that of the longest interval.
    An interval takes whole bins, two a level at most, for what lies between its ends' bins of the
    finest level; the times in these two are compared with it."""
    axis = {c: F.floor(_axis(F.col(c), kind)).cast("long") for c, kind in ((col, cells.schema[col].dataType), (start, bounds.schema[start].dataType),
                                                                           (end, bounds.schema[end].dataType))}
    cells = cells.filter(F.col(col).isNotNull()).withColumn("__x", axis[col])
    # null ends and those in the wrong order hold no time
    spans = bounds.filter(F.col(start) < F.col(end)).withColumns({"__s": axis[start], "__e": axis[end]})
    n, first, last = cells.agg(F.count(F.lit(1)), F.min("__x"), F.max("__x")).first()
    longest = spans.agg(F.max(F.col("__e").cast("double") - F.col("__s"))).first()[0] or 1.0
    top = max(1, int(longest).bit_length())
    # evenly spread times would have an eighth of END_TIMES a bin; clustered ones need finer bins
    even = max(1, (((last - first) * END_TIMES // 8 // n) if n else 1).bit_length())
    tried = sorted({*range(even, 0, -4), 1}, reverse=True)
    per = cells.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("__x", k).alias("b")) for k in tried])).alias("x"))
    load = {r[0]: r[1] for r in per.groupBy("x.k", "x.b").count().groupBy("k").agg(
        F.sum(F.col("count") * F.col("count")) / F.sum("count")).collect()}
    low = next((k for k in tried if load.get(k, 0) <= END_TIMES), 1)
    levels = range(low, max(low, top) + 1)

    finest = cells.groupBy(F.shiftright("__x", low).alias("__bin")).agg(*_totals_of(of, again=True))
    bins = finest.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("__bin", k - low).alias("b")) for k in levels])).alias("__x"))
    bins = bins.groupBy(F.col("__x.k").alias("__kk"), F.col("__x.b").alias("__bb")).agg(*_totals_of(of, again=True))
    times = cells.withColumn("__bb", F.shiftright("__x", low)).drop("__x")
    if n * (len(levels) + 1) <= SENT_ENTRIES:
        bins, times = F.broadcast(bins), F.broadcast(times)

    a, b = F.shiftright("__s", low), F.shiftright("__e", low)
    whole = []
    for k in levels:    # bins from one to before the other of this level lie inside
        lo, hi = -F.shiftright(-(a + 1), k - low), F.shiftright(b, k - low)
        for here, at in ((lo.bitwiseAND(1) == 1, lo), (hi.bitwiseAND(1) == 1, hi - 1)) if k < levels[-1] else ():
            whole.append(F.when((lo < hi) & here, F.struct(F.lit(k).alias("k"), at.alias("b"))))
    lo, hi = -F.shiftright(-(a + 1), levels[-1] - low), F.shiftright(b, levels[-1] - low)
    rest = F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda i: F.struct(F.lit(levels[-1]).alias("k"), i.alias("b"))))
    whole = F.concat(F.array_compact(F.array(*whole)), F.coalesce(rest, F.array())) if whole else F.coalesce(rest, F.array())
    out = [*bounds.columns, *of]
    inside = spans.withColumn("__x", F.explode(whole)).withColumns({"__k": F.col("__x.k"), "__bin": F.col("__x.b")})
    inside = inside.join(bins, (inside["__k"] == bins["__kk"]) & (inside["__bin"] == bins["__bb"])).select(*out)
    ends = spans.withColumn("__bin", F.explode(F.array_distinct(F.array(a, b))))
    ends = ends.join(times, (ends["__bin"] == times["__bb"]) & (F.col(col) > F.col(start)) & (F.col(col) < F.col(end))).select(*out)
    return inside.unionByName(ends)


def interval_join(df: DataFrame, bounds: DataFrame, lo_col: str, hi_col: str,
                  start: str, end: str, few: int = FEW_INTERVALS, totals: Mapping[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Every row with each interval that has lo_col > start AND hi_col < end.

    Up to ``few`` intervals are sent to all tasks and compared with every row. More are indexed
    by bins: an interval's level is that of the narrowest bins, of a power of two's width, that are
    no shorter than it, so it lies in two bins at most; a row, which may be a stretch itself (its
    lo_col may be above its hi_col, or an interval's start above its end), likewise. The two meet by an equi-join in a bin of the higher
    level of both, so each side is copied at most twice for each level that the other one has,
    whatever the lengths; the exact test comes after, and of two bins that hold both, one counts.
    Null bounds match nothing.

    With ``totals``, {name: (column, "sum", "min" or "max")} over points (lo_col is hi_col), an interval
    comes not with its rows but with their totals, in as many parts as it took to add them up; the same
    aggregate over the parts is that of all its rows. Nothing then grows with the number of rows an
    interval holds: rows of one time become one, and dates and times are added up in bins."""
    if totals is not None:
        if lo_col != hi_col:
            raise ValueError("interval_join: totals are taken of points")
        df = df.groupBy(lo_col).agg(*_totals_of(totals))
        kinds = {df.schema[lo_col].dataType, bounds.schema[start].dataType, bounds.schema[end].dataType}
        if len(kinds) == 1 and isinstance(kinds.pop(), (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return _totals_join(df, bounds, lo_col, start, end, totals)
        return interval_join(df, bounds, lo_col, hi_col, start, end, few).select(*bounds.columns, *totals)
    cond = (F.col(lo_col) > F.col(start)) & (F.col(hi_col) < F.col(end))
    if bounds.limit(few + 1).count() <= few:
        return df.join(F.broadcast(bounds), cond, "inner")
    lo, hi = (_axis(F.col(c), df.schema[c].dataType) for c in (lo_col, hi_col))
    rows = df.filter(F.col(lo_col).isNotNull() & F.col(hi_col).isNotNull()).withColumns(
        {"__a": F.least(lo, hi), "__b": lo}).withColumn("__kr", _level(F.col("__b") - F.col("__a")))
    ends = [_axis(F.col(c), bounds.schema[c].dataType) for c in (start, end)]
    spans = bounds.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns({"__s": F.least(*ends), "__e": F.greatest(*ends)})
    spans = spans.withColumn("__kb", _level(F.col("__e") - F.col("__s")))
    # a thousand levels at most, whatever the data
    of_rows = [r[0] for r in rows.select("__kr").distinct().collect()]
    of_spans = {r[0]: r[1] for r in spans.groupBy("__kb").count().collect()}

    def copies(side: DataFrame, own: str, other: list[int], first: str, last: str) -> DataFrame:
        # its own level, if the other side has one no higher, and the other side's higher ones
        k, most = F.col(own), F.array(*[F.lit(x) for x in sorted(other)] or [F.lit(None).cast("int")])
        here = F.when(F.array_min(most) <= k, F.array(k)).otherwise(F.array().cast("array<int>"))
        side = side.withColumn("__k", F.explode(F.concat(here, F.filter(most, lambda x: x > k))))
        ends = F.array_distinct(F.array(_bin(F.col(first), F.col("__k")), _bin(F.col(last), F.col("__k"))))
        return side.withColumn("__bin", F.explode(ends))

    rows = copies(rows, "__kr", list(of_spans), "__a", "__b")
    spans = copies(spans, "__kb", of_rows, "__s", "__e").withColumnsRenamed({"__k": "__kk", "__bin": "__bb"})
    if sum(of_spans.values()) * 2 * (len(of_rows) + 1) <= SENT_ENTRIES:
        spans = F.broadcast(spans)
    met = rows.join(spans, (rows["__k"] == spans["__kk"]) & (rows["__bin"] == spans["__bb"]))
    once = (F.col("__k") == F.greatest("__kr", "__kb")) & (
        F.col("__bin") == F.greatest(_bin(F.col("__a"), F.col("__k")), _bin(F.col("__s"), F.col("__k"))))
    return met.filter(once & cond).drop(*"__a __b __kr __k __bin __s __e __kb __kk __bb".split())


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
