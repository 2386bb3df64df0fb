"""Decimal rounding and multiples as Columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIE = 1e-12


def _even_half(scaled: Column) -> Column:
    """The nearest whole number; what lies within _TIE of a half goes to the even one."""
    low = F.floor(scaled).cast("double")
    part = scaled - low
    even = F.when(F.pmod(low, F.lit(2.0)) == 0, low).otherwise(low + 1)
    return F.when(part > 0.5 + _TIE, low + 1).when(part < 0.5 - _TIE, low).otherwise(even)


def quantize(v: Column, digits: int) -> Column:
    """Rounded half to even at a number of decimal digits; what isn't finite stays."""
    v, factor = v.cast("double"), F.lit(float(10**digits))
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, _even_half(v * factor) / factor).otherwise(v)


def is_multiple(v: Column, step: Column, digits: int = 12) -> Column:
    """Whether a ratio is whole within 10 ** -digits; not for steps that aren't positive."""
    ratio = v.cast("double") / F.when(step > 0, step.cast("double"))
    return F.coalesce((F.abs(ratio - F.floor(ratio + 0.5)) < 10.0**-digits) & ~F.isnan(ratio), F.lit(False))


def is_multiple_quantized(v: Column, step: Column, digits: int) -> Column:
    """The same of both sides rounded."""
    return is_multiple(quantize(v, digits), quantize(step, digits), digits)


def align_up(v: Column, step: Column) -> Column:
    """The next multiple upward; the remainder has the value's sign, and a step of 0 changes nothing."""
    rest = v % F.when(step != 0, step)
    return F.when(F.coalesce(rest, F.lit(0)) == 0, v).otherwise(v + (step - rest))
