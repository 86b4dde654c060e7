"""Numbers: coercion, guarded ratios, scaling, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text as a double, null where it is not a number."""
    return _col(c).try_cast("double")


def is_finite(c: Column | str) -> Column:
    c = _col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def to_count(c: Column | str) -> Column:
    """Whole number; null, NaN and infinities become 0, fractions are cut."""
    return F.when(is_finite(c), F.floor(F.abs(_col(c))) * F.signum(_col(c))).otherwise(0).cast("long")


def within_int32(c: Column | str) -> Column:
    """Null where a 32-bit integer column could not hold the value."""
    c = _col(c)
    return F.when(c.between(INT32_MIN, INT32_MAX), c)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Quotient, null for a zero or missing divisor."""
    part, whole = _col(part).cast("double"), _col(whole).cast("double")
    return F.when(whole != 0, part / whole)


def change_percent(current: Column | str, previous: Column | str, zero_prev: str = "inf") -> Column:
    """Per-cent change. From 0 to 0 is null; from 0 upwards is infinite or null."""
    current, previous = _col(current).cast("double"), _col(previous).cast("double")
    out = F.when(previous != 0, (current / previous - 1) * 100)
    if zero_prev == "inf":
        out = out.when((previous == 0) & (current != 0), F.signum(current) * float("inf"))
    return out


def log_bin(c: Column | str, low: float, width: float, plus_one: bool = False) -> Column:
    """Index of the log10 bin; null for values without a logarithm."""
    c = _col(c) + 1 if plus_one else _col(c)
    return F.when(c > 0, F.floor((F.log10(c) - low) / width)).cast("long")


def rescale(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    """Min-max rescale of a column; a constant column becomes `low`."""
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    at = F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(0.0)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.lit(low) + at * (high - low)))


def clean_counts(df: DataFrame, keep_text: list[str], counts: list[str]) -> DataFrame:
    """Every column but `keep_text` as a number, those in `counts` as whole numbers."""
    out = []
    for name in df.columns:
        if name in keep_text:
            out.append(F.col(name))
        elif name in counts:
            out.append(to_count(to_number(name)).alias(name))
        else:
            out.append(to_number(name).alias(name))
    return df.select(out)
