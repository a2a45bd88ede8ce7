"""Exact number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zero(value: Column | str) -> Column:
    """The value, or 0 when null."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))


def div_half_up(num: Column, den: Column) -> Column:
    """``num / den`` rounded half up to a whole number (num ≥ 0, den > 0), in integers only.

    A decimal quotient would be rounded twice, once by the division and once by the rounding.
    """
    return F.call_function("div", num * 2 + den, den * 2)


def ratio(num: Column, den: Column, scale: int) -> Column:
    """``num / den`` rounded half up to `scale` places, as a decimal."""
    shifted = div_half_up(num * (10 ** scale), den)
    return (shifted.cast("decimal(18,0)") * F.expr(f"cast(1e-{scale} as decimal({scale + 1},{scale}))")
            ).cast(f"decimal(18,{scale})")
