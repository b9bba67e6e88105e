"""Parsing, cleaning, rounding and small formulas as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _printed(code: Column) -> Column:
    return code.between(33, 126)


def strip(x: Column) -> Column:
    """Without white space at either end, of any kind that Unicode has.

    Text that starts and ends with printed ASCII, as nearly all does, goes by without a pattern.
    """
    return F.when(_printed(F.ascii(x)) & _printed(F.ascii(F.right(x, F.lit(1)))), x).otherwise(F.regexp_replace(x, r"(?U)^\s+|(?U)\s+$", ""))


def clean_stripped(x: Column) -> Column:
    """Stripped text with tabs as spaces; null is empty."""
    return F.replace(F.coalesce(x, F.lit("")), F.lit("\t"), F.lit(" "))


def clean_text(x: Column) -> Column:
    """Stripped text with tabs as spaces; null is empty."""
    return clean_stripped(strip(x))


def epoch_of(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), F.col(ts) if isinstance(ts, str) else ts)


def parse_ts(x: Column) -> Column:
    """Seconds since 1970 of text day/month/year hour:minute:second in UTC; else null."""
    return stripped_ts(strip(x))


def stripped_ts(text: Column) -> Column:
    form = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$"
    # text with a slash that hasn't this form stays as it is, which is no timestamp
    iso = F.regexp_replace(F.when(F.contains(text, F.lit("/")), text), form, "$3-$2-$1 $4:$5:$6")
    return epoch_of(iso.try_cast("timestamp_ntz"))


def parse_int(x: Column) -> Column:
    """An integer or null; a number with a decimal point is no integer."""
    return stripped_int(strip(x))


def stripped_int(y: Column) -> Column:
    return F.when(~F.contains(y, F.lit(".")), y.try_cast("bigint"))


def parse_float(x: Column) -> Column:
    """A float or null; Java's suffixes for floats aren't accepted."""
    return stripped_float(strip(x))


def stripped_float(y: Column) -> Column:
    suffix = F.right(y, F.lit(1)).isin("d", "D", "f", "F")
    return F.when(~suffix | ~y.rlike(r"(?i)[0-9.][df]$"), y.try_cast("double"))


def parse_float_or_zero(x: Column) -> Column:
    return F.coalesce(parse_float(x), F.lit(0.0))


def once(df: DataFrame, columns: dict[str, Column], *rest: str) -> DataFrame:
    """``columns`` and ``rest`` of ``df``, each computed once for a row whatever is done with it later.

    They go through a generator of one row, as filters aren't pushed below one; in a projection
    they would take a column's computation along and leave it in both places.
    """
    return df.select(*[F.col(c) for c in rest], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


_SPLIT = float(2**27 + 1)


def rounded(x: Column, digits: int, how: str = "exact") -> Column:
    """To ``digits`` decimals. ``exact``: by the exact binary value, ties to even, correctly rounded;
    ``decimal``: Spark's round, half up on the shortest decimal, which parts from it near ties (2.675).

    ``x * 10**digits`` is taken as a double and its error (by splitting both factors, which is exact);
    where the double lies half-way, or is the half-way point, the error decides.
    """
    if how == "decimal":
        return F.round(x, digits)
    s = float(10**digits)
    p = x * s
    high = x * _SPLIT - (x * _SPLIT - x)
    s_high = s * _SPLIT - (s * _SPLIT - s)
    low, s_low = x - high, s - s_high
    error = low * s_low - (((p - high * s_high) - low * s_high) - high * s_low)
    below = F.floor(p).cast("double")
    half = (p - below) - 0.5
    up = (half > 0) | ((half == 0) & ((error > 0) | ((error == 0) & (F.pmod(below, F.lit(2.0)) == 1.0))))
    fine = F.abs(p) < float(2**52)  # beyond, and for NaN and infinity, there is nothing to round
    return F.when(fine, (below + F.when(up, 1.0).otherwise(0.0)) / s).otherwise(x)


def hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def draught_direction(start: Column, end: Column, step: float) -> Column:
    """loss, gain, stable, or null where a draught is missing."""
    known = start.isNotNull() & end.isNotNull() & (start >= 0.01) & (end >= 0.01)
    return F.when(known, F.when(F.abs(end - start) < step, F.lit("stable")).when(end < start, F.lit("loss")).otherwise(F.lit("gain")))


def draught_confidence(one: Column, other: Column) -> Column:
    """What two vessels' draught directions say about a transfer between them."""
    moved = lambda d: d.isin("loss", "gain")
    return (
        F.when(one.isNull() & other.isNull(), "proximity_only")
        .when(moved(one) & moved(other) & (one != other), "draught_transfer")
        .when((moved(one) & other.isNull()) | (moved(other) & one.isNull()), "draught_partial")
        .otherwise("draught_unchanged")
    )


def amdahl(p: Column, n: Column) -> Column:
    """Speed-up of ``n`` workers where the share ``p`` runs in parallel."""
    return F.lit(1.0) / ((1.0 - p) + p / n)


def parallel_share(speedup: Column, n: Column) -> Column:
    """The share that runs in parallel, from a measured speed-up: 0 to 1; null for a speed-up of 0."""
    share = F.try_divide(F.try_divide(F.lit(1.0), speedup) - 1.0, F.try_divide(F.lit(1.0), n.cast("double")) - 1.0)
    return F.when(n == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
