"""Six-digit shifted floor, applied alike in Spark and in SQL before values are compared.

Sums of doubles differ in the last bit between engines. The odd shift keeps half-way values, which
are common in small fractions, away from the rounding boundary; adding zero removes -0.0.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1e6
SHIFT = 0.50123


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(SCALE) + F.lit(SHIFT)) / F.lit(SCALE)


def r6s(*names: str) -> list[Column]:
    return [r6(f"`{n}`").alias(n) for n in names]


def q6(expression: str, name: str | None = None) -> str:
    return f"floor(({expression}) * 1e6 + 5.0123e-1) / 1e6 + 0e0 AS {name or expression}"


def q6s(*names: str) -> str:
    return ", ".join(q6(n) for n in names)
