"""Scalar helpers: missing values, keyed hashing, bins, harmonic numbers, labels."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

EULER_GAMMA = 0.5772156649015329
# 1/(2n) - sum B2k/(2k n^2k): coefficients of the asymptotic series of the harmonic numbers.
HARMONIC_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240)
HARMONIC_EXACT_BELOW = 20


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it inside `body`; lambdas would re-evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def finite(c: ColumnLike) -> Column:
    """NaN and both infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def stripped(value: ColumnLike) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(col(value), r"(?U)^\s+|\s+$", "")


def to_number(c: ColumnLike) -> Column:
    """Any scalar as a finite double; text that is no number becomes NULL."""
    return finite(col(c).try_cast("double"))


def keyed_hash(keys: Sequence[ColumnLike], seed: int) -> Column:
    """Uniform 60-bit integer from a key and a seed; equal in every SQL engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def equal_width_bin(p: ColumnLike, bins: int, closed_last: bool = False) -> Column:
    """Index of the edge interval [i/bins, (i+1)/bins) that holds p, else NULL.

    The truncated product is only a first guess: both neighbouring edges are compared, because
    floor(p * bins) is off by one at some edges.
    """
    p = col(p)
    width = 1.0 / bins
    guess = F.floor(p * F.lit(float(bins)))
    index = (
        guess
        - (p < guess * F.lit(width)).cast("bigint")
        + (p >= (guess + 1) * F.lit(width)).cast("bigint")
    )
    top = (p <= 1.0) if closed_last else (p < 1.0)
    return F.when((p >= 0.0) & top, F.least(index, F.lit(bins - 1).cast("bigint"))).cast("int")


def harmonic(n: ColumnLike) -> Column:
    """H(n) = 1 + 1/2 + ... + 1/n for a non-negative whole n, to double precision."""
    n = col(n)
    exact, total = [0.0], 0.0
    for i in range(1, HARMONIC_EXACT_BELOW):
        total += 1.0 / i
        exact.append(total)
    table = F.array(*[F.lit(v) for v in exact])
    x = n.cast("double")
    inverse_square = F.try_divide(F.lit(1.0), x * x)
    tail = F.lit(0.0)
    for coefficient in reversed(HARMONIC_SERIES):
        tail = (tail + F.lit(coefficient)) * inverse_square
    series = F.ln(x) + F.lit(EULER_GAMMA) + F.try_divide(F.lit(0.5), x) + tail
    return F.when(n < HARMONIC_EXACT_BELOW, F.get(table, n.cast("int"))).otherwise(series)


def error_label(chosen: ColumnLike, gold: ColumnLike) -> Column:
    """1 when the chosen letter differs from the gold letter; a missing letter counts as ''."""
    chosen, gold = col(chosen), col(gold)
    return (
        F.upper(F.coalesce(chosen, F.lit(""))) != F.upper(F.coalesce(gold, F.lit("")))
    ).cast("int")


def prediction_error(predicted: ColumnLike, gold: ColumnLike) -> Column:
    """Like `error_label`, but a question without a gold letter is never an error."""
    gold = col(gold)
    return F.when(F.coalesce(gold, F.lit("")) == "", F.lit(0)).otherwise(
        error_label(predicted, gold)
    )
