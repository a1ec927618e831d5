"""Aggregations.

Everything is a hash aggregate with map-side partial combine, so a hot group costs one
partial row per task, not a third of the data in one task. Exact quantiles and medians
(which Spark's ``percentile`` would buffer per group) are found by counting digits
(:func:`exact_quantiles`).
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions._util import as_col
from fathom.functions.time import round_time
from fathom.session import cut_lineage


def mean_strict(c) -> Column:
    """A3: mean that is NULL as soon as one input is NULL (Julia/R default)."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def mean_skip(c) -> Column:
    """A4: mean over non-null values; all-null group -> NULL."""
    return F.avg(as_col(c))


def sd_over_n(c) -> Column:
    """The reference's 'se' = sd(x, na.rm=TRUE) / n() (n counts every row)."""
    return F.stddev_samp(as_col(c)) / F.count(F.lit(1))


def weighted_mean(x, w) -> Column:
    """sum(w*x)/sum(w); 0/0 -> NaN instead of an ANSI error."""
    num = F.sum(as_col(w) * as_col(x))
    den = F.sum(as_col(w))
    return F.when(den != 0, num / den).otherwise(F.lit(float("nan")))


def _sortable(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: a long that orders like the double ``value``, one for each number (null: null). It is
    put together from the exponent and the 52 bits of the fraction; -0.0 counts as 0.0."""
    x = f"abs(`{value}`)"
    df = df.withColumn("__e", F.expr(f"cast(greatest(floor(log2(least(greatest({x}, {2.0 ** -1022!r}D), {sys.float_info.max!r}D))), -1022) as int)"))
    df = df.withColumn("__m", F.expr(f"{x} / pow(2D, least(__e, 1023))"))
    # the logarithm may be off by one next to a power of two: then the fraction is not in [1, 2)
    bits = f"""CASE WHEN {x} = double('Infinity') THEN {2047 << 52}
        WHEN __m >= 2 THEN shiftleft(cast(__e + 1024 as bigint), 52) + cast((__m / 2 - 1) * {2.0 ** 52!r}D as bigint)
        WHEN __m >= 1 THEN shiftleft(cast(__e + 1023 as bigint), 52) + cast((__m - 1) * {2.0 ** 52!r}D as bigint)
        WHEN __e > -1022 THEN shiftleft(cast(__e + 1022 as bigint), 52) + cast((__m * 2 - 1) * {2.0 ** 52!r}D as bigint)
        ELSE cast(__m * {2.0 ** 52!r}D as bigint) END"""
    df = df.withColumn("__m", F.expr(bits))
    return df.withColumn(out, F.expr(f"CASE WHEN `{value}` < 0 THEN -__m ELSE __m END")).drop("__e", "__m")


#: Places of wanted ranks that are sent to all tasks; more are joined with a shuffle.
SENT_RANKS = 100_000

# Of the digits d with counts c in the array hist, the one that holds each wanted 0-based rank: the
# ranks of one digit together, with what is left of them inside it.
_PICK = """transform(wants, w -> aggregate(hist,
    named_struct('j', w.j, 'rank', w.rank, 'd', cast(null as bigint), 'v', cast(null as double)),
    (a, x) -> CASE WHEN a.d IS NOT NULL THEN a
                   WHEN a.rank < x.c THEN named_struct('j', a.j, 'rank', a.rank, 'd', x.d, 'v', x.v)
                   ELSE named_struct('j', a.j, 'rank', a.rank - x.c, 'd', a.d, 'v', a.v) END))"""
_BY_DIGIT = "explode(transform(array_distinct(transform(picks, p -> p.d)), d -> named_struct('d', d, 'wants', filter(picks, p -> p.d = d))))"


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                    by: Sequence[str] = (), nulls: str = "skip") -> DataFrame:
    """Exact R type-7 quantiles (linear interpolation), one row per group.

    ``nulls``: null and NaN values are skipped, or with ``"propagate"`` make their group's
    quantiles NULL; a group without values has NULLs.

    A radix select: values become longs of the same order, of which four passes look at 16 bits
    each. A pass counts the rows by (group, digit) among those that agree with a wanted rank in
    all earlier digits, and narrows every wanted rank of every group by one digit. The counts are
    summed within tasks, a group sends 65,536 of them at most for each wanted rank, and the rows
    themselves are neither sorted nor written: only where the wanted ranks stand is, after each
    pass, and it is sent to all tasks if it is counted to be short. ``df`` is read once a pass."""
    by = list(by)
    v = F.col(value).cast("double")
    group = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)]) if by else F.lit(0)
    held = _sortable(df.select(group.alias("__g"), F.when(~F.isnan(v), v).alias("__val")), "__val", "__key")
    entry = F.struct("d", "c", "v")

    top = held.groupBy("__g", F.shiftright("__key", 48).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    top = top.withColumn("v", F.lit(None).cast("double"))
    groups = top.groupBy(*(["__g"] if by else [])).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("__rows"), F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("c"))), F.lit(0)).alias("__n"),
        F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), entry))).alias("hist"))
    if not by:   # a global aggregate: one row, whatever the input
        groups = groups.withColumn("__g", F.lit(0))
    ranks = []
    for i, p in enumerate(probs.values()):
        h = f"floor((__n - 1) * {float(p)!r}D)"
        ranks += [f"named_struct('j', {2 * i}, 'rank', {h})", f"named_struct('j', {2 * i + 1}, 'rank', least({h} + 1, __n - 1))"]
    groups = cut_lineage(groups)     # counts of the first digit, one row a group
    hist = groups.filter("__n > 0").select(F.col("__g").alias("__h"), F.lit(0).cast("long").alias("prefix"), "hist",
                                           F.expr(f"array({', '.join(ranks)})").alias("wants"))
    for shift in (32, 16, 0):
        found = hist.select("__h", "prefix", F.expr(_PICK).alias("picks")).select("__h", "prefix", F.expr(_BY_DIGIT).alias("at"))
        found = found.select("__h", F.expr("shiftleft(prefix, 16) + at.d").alias("prefix"), F.expr("transform(at.wants, w -> struct(w.j, w.rank))").alias("wants"))
        found = cut_lineage(found)   # a row for each group and wanted digit
        if found.count() <= SENT_RANKS:
            found = F.broadcast(found)
        rows = held.join(found, held["__g"].eqNullSafe(found["__h"]) & F.shiftright("__key", shift + 16).eqNullSafe(found["prefix"]))
        # the last digit completes the value, so that one value stands for all rows
        counts = rows.groupBy("__h", "prefix", "wants", F.expr(f"shiftright(__key, {shift}) & 65535").alias("d")).agg(
            F.count(F.lit(1)).alias("c"), F.max("__val" if shift == 0 else F.lit(None).cast("double")).alias("v"))
        hist = counts.groupBy("__h", "prefix", "wants").agg(F.array_sort(F.collect_list(entry)).alias("hist"))
    last = hist.select("__h", F.explode(F.expr(_PICK)).alias("w")).select("__h", "w.j", "w.v")
    got = last.groupBy("__h").agg(*[F.expr(f"max(CASE WHEN j = {j} THEN v END)").alias(f"__v{j}") for j in range(2 * len(probs))])
    own = groups.select("__g", "__rows", "__n")
    out = own.join(got, own["__g"].eqNullSafe(got["__h"]), "left")
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        q = f"__v{2 * i} + ((__n - 1) * {float(p)!r}D - floor((__n - 1) * {float(p)!r}D)) * (__v{2 * i + 1} - __v{2 * i})"
        cols.append(F.expr(f"CASE WHEN __n = __rows THEN {q} END" if nulls == "propagate" else q).alias(name))
    return out.select(*[F.col(f"__g.c{i}").alias(c) for i, c in enumerate(by)], *cols)


def histogram(df: DataFrame, c: str, bins: int = 30, log10: bool = False,
              density: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins (the maximum
    falls in the last bin; if all values are equal they fall in the first); empty bins are emitted with 0. Density = n / (N * width)."""
    x = F.log10(F.col(c)) if log10 else F.col(c)
    vals = df.select(x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    rng = vals.agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"),
                   F.count(F.lit(1)).alias("__N"))
    width = (F.col("__mx") - F.col("__mn")) / F.lit(float(bins))
    binned = vals.crossJoin(F.broadcast(rng)).withColumn(
        "bin", F.least(F.coalesce(F.floor(F.try_divide(F.col("__x") - F.col("__mn"), width)), F.lit(0)).cast("int") + 1, F.lit(bins))
        .cast("int"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # bin ids 1..bins from the one-row range table
    spine = rng.select("__mn", "__mx", "__N", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    out = spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("__mn") + (F.col("bin") - 1) * width).alias("lo"),
        (F.col("__mn") + F.col("bin") * width).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        "__N")
    if density:
        out = out.withColumn("density", F.col("n") / (F.col("__N") * (F.col("hi") - F.col("lo"))))
    return out.drop("__N")


def binned_counts(df: DataFrame, keys: Sequence[Column | str], digits: int,
                  value: str, value_alias: str | None = None) -> DataFrame:
    """Counts by (keys..., value rounded half-even to ``digits``)."""
    v = F.bround(F.col(value), digits).alias(value_alias or value)
    return df.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("n"))


def pivot_wide(df: DataFrame, row: Sequence[str], col: str, val: str,
               values: Sequence[str], prefix: str = "") -> DataFrame:
    """Long -> wide with explicit pivot values. A duplicate (row, col) cell raises."""
    aggs = []
    for v in values:
        hit = F.col(col) == F.lit(v)
        dup = F.count(F.when(hit, F.lit(1))) > 1
        aggs.append(F.when(dup, F.raise_error(F.lit(f"pivot: duplicate cell for {col}={v}")))
                    .otherwise(F.max(F.when(hit, F.col(val)))).alias(f"{prefix}{v}"))
    return df.groupBy(*row).agg(*aggs)


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
                 name: str = "name", value: str = "value") -> DataFrame:
    """Wide -> long over all non-id columns."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, name, value)


def regrid_mean(df: DataFrame, ts: str, step: str, cols: Mapping[str, str],
                out_ts: str = "datetime_round") -> DataFrame:
    """Round timestamps to ``step`` and average (null-propagating) per bucket."""
    return df.groupBy(round_time(ts, step).alias(out_ts)).agg(
        *[mean_strict(src).alias(dst) for dst, src in cols.items()])
