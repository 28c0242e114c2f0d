"""Native Column expressions: divergence of readings, Halstead's quantities, maintainability, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.specs import THRESHOLD


def is_true(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def divergence(readings: list[Column], threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """(ratio, flag). Under two readings: both null. All zero: agree. Some zero: differ, without a ratio. Otherwise the
    ratio of the largest to the smallest, rounded to six places before it is held against the threshold."""
    values = [r.cast("double") for r in readings]
    n = reduce(lambda a, b: a + b, [r.isNotNull().cast("int") for r in values])
    zero = reduce(lambda a, b: a | b, [F.coalesce(r == 0, F.lit(False)) for r in values])
    high, low = (F.greatest(*values), F.least(*values)) if len(values) > 1 else (values[0], values[0])
    ratio = F.when((n >= 2) & ~zero, F.round(F.try_divide(high, low), 6))
    flag = F.when(n < 2, F.lit(None)).when((high == 0) & (low == 0), False).when(zero, True).otherwise(ratio - 1.0 > threshold)
    return ratio, flag.cast("boolean")


def log2(c: Column) -> Column:
    return F.when(c > 0, F.log2(c)).otherwise(0.0)


def halstead(h1: Column, h2: Column, n1: Column, n2: Column) -> dict[str, Column]:
    """Halstead (1977) from distinct and total operators and operands; unrounded."""
    vocabulary, length = h1 + h2, n1 + n2
    volume = length * log2(vocabulary)
    difficulty = F.when(h2 == 0, 0.0).otherwise(h1 / 2.0 * F.try_divide(n2.cast("double"), h2.cast("double")))
    return {"vocabulary": vocabulary, "length": length, "calculated_length": h1 * log2(h1) + h2 * log2(h2), "volume": volume, "difficulty": difficulty, "effort": difficulty * volume, "time": difficulty * volume / 18.0, "bugs": volume / 3000.0}


def maintainability(volume: Column, complexity: Column, lloc: Column, sloc: Column, comment_share: Column) -> tuple[Column, Column, Column]:
    """(index, saturated, path): 171 - 5.2 ln V - 0.23 G - 16.2 ln L + 50 sin sqrt(2.4 C), scaled to 0..100 (Coleman et al.
    1994). Without volume or source lines the index is 100 by definition: path 1; clamped at the top: path 2."""
    blind = (volume <= 0) | (sloc <= 0)
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1e-9))) - 0.23 * complexity - 16.2 * F.log(F.greatest(lloc.cast("double"), F.lit(1.0))) + 50 * F.sin(F.sqrt(2.4 * F.radians(comment_share * 100)))
    index = F.when(blind, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100 / 171)))
    full = index == 100.0
    return index, full, F.when(~full, 0).when(blind, 1).otherwise(2).cast("long")


def severity(ratio: Column, flag: Column) -> Column:
    return F.when(~is_true(flag), "agree").when(ratio.isNull(), "absent-present").when(ratio >= 5, "strong").when(ratio >= 1.5, "clear").otherwise("slight")
