"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division that gives NULL for a zero denominator."""
    return F.try_divide(_col(numerator), _col(denominator))


def relative_change_pct(value: Column | str, baseline: Column | str) -> Column:
    """100 * (value - baseline) / baseline; NULL unless the baseline is positive."""
    v, b = _col(value), _col(baseline)
    return F.when(b > 0, 100.0 * (v - b) / b)


def clamp(x: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]. NULL stays NULL and NaN stays NaN, unlike least/greatest."""
    c = _col(x)
    return F.when(F.isnan(c), c).when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def week_start(day: Column | str) -> Column:
    """Monday of the week, as a DATE (no session time zone involved)."""
    return F.trunc(_col(day), "week")


def dow_sun0(day: Column | str) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(_col(day)) - F.lit(1)


def dow_mon0(day: Column | str) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_col(day))


def label(x: Column | str, missing: str = "Unknown") -> Column:
    """Any value as a text label, NULL as ``missing``."""
    return F.coalesce(_col(x).cast("string"), F.lit(missing))


def case_lookup(key: Column | str, mapping: dict, default) -> Column:
    """Look a key up in a small literal mapping."""
    k = _col(key)
    branches = [(k == F.lit(name), F.lit(value)) for name, value in mapping.items()]
    return first_match(branches, default)


def first_match(branches: list[tuple[Column, Column | float]], default) -> Column:
    """CASE over (condition, value) pairs, tested in order."""
    if not branches:
        return F.lit(default)
    (condition, value), *rest = branches
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(F.lit(default))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded double without a negative zero."""
    return F.round(_col(x), digits) + F.lit(0.0)
