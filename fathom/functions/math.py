"""Math, string and value-cleaning scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions._util import NEG_INF, as_col


def from_db(x) -> Column:
    """M1: decibel -> linear, 10^(x/10)."""
    return F.pow(F.lit(10.0), as_col(x) / F.lit(10.0))


def to_db(x) -> Column:
    """M2: linear -> decibel, 10*log10(x), with 0 -> -Infinity (Spark's log10(0) is NULL)."""
    x = as_col(x)
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.lit(10.0) * F.log10(x))


def attenuate(a: float, k: float, z) -> Column:
    """M4: a * exp(-k * z)."""
    return F.lit(float(a)) * F.exp(F.lit(-float(k)) * as_col(z))


def round_even(x, digits: int) -> Column:
    """M5: round half to even at ``digits`` (negative = tens, hundreds)."""
    return F.bround(as_col(x), digits)


def floor_clamp(x, floor: float, fill_null: bool = True) -> Column:
    """Values below ``floor`` -> floor; NULL -> floor only when ``fill_null``."""
    x = as_col(x)
    lo = F.lit(float(floor))
    if fill_null:
        return F.when(x.isNull() | (x < lo), lo).otherwise(x)
    return F.when(x < lo, lo).otherwise(x)


def squish(x, lo: float, hi: float) -> Column:
    """Move finite values into [lo, hi]; NULL, NaN and +-Inf are left alone."""
    x = as_col(x)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))).otherwise(x)


def null_to(x, value) -> Column:
    """NULL -> value."""
    return F.coalesce(as_col(x), F.lit(value))


def neg_inf_to_null(x) -> Column:
    """-Infinity -> NULL."""
    x = as_col(x)
    return F.when(x == F.lit(NEG_INF), F.lit(None).cast("double")).otherwise(x)


def nan_to_null(x) -> Column:
    """NaN -> NULL."""
    x = as_col(x)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def hour_label(hour, noon=(12, 13, 14), midnight=(0, 1, 2)) -> Column:
    """P15: 'noon' / 'midnight' / 'other' by hour of day."""
    h = as_col(hour)
    return (F.when(h.isin(*noon), F.lit("noon"))
            .when(h.isin(*midnight), F.lit("midnight"))
            .otherwise(F.lit("other")))


def rescale(n, nmax, dmin, dmax, prop) -> Column:
    """M7: map a count onto the depth axis: -(dmax-dmin)*prop*n/nmax + dmax - 1."""
    drange = as_col(dmax) - as_col(dmin)
    return -drange * F.lit(float(prop)) * as_col(n) / as_col(nmax) + as_col(dmax) - F.lit(1.0)


def unscale(x, nmax, dmin, dmax, prop) -> Column:
    """M7 inverse (secondary axis): (x - dmax) * -nmax / (dmax-dmin) / prop (no +1, as in the reference)."""
    drange = as_col(dmax) - as_col(dmin)
    return (as_col(x) - as_col(dmax)) * -as_col(nmax) / drange / F.lit(float(prop))


def segment_id(date, label) -> Column:
    """M8: '<date>-S<label>'."""
    return F.concat(as_col(date).cast("string"), F.lit("-S"), as_col(label).cast("string"))


def basename(path) -> Column:
    """M9: last path component."""
    return F.regexp_extract(as_col(path), r"([^/]*)$", 1)


def swap_suffix(path, pattern: str, repl: str) -> Column:
    """M9: regex replace, like R ``gsub`` (the pattern is a regex: '.' matches any char)."""
    return F.regexp_replace(as_col(path), pattern, repl)
