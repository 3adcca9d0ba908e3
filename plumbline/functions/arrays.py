"""Array expressions for short arrays and for results as long as their input, inside the row."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ColumnLike, col, let


def _shifted(x: ColumnLike, body) -> Column:
    """Bind the array and its maximum once, then build `body(array, maximum)`."""
    x = col(x)
    pair = F.struct(x.alias("x"), F.array_max(x).alias("m"))
    return let(pair, lambda b: body(b.getField("x"), b.getField("m")))


def _exp_total(x: Column, m: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))


def softmax(x: ColumnLike) -> Column:
    """exp(v - max) normalised to one; an empty array stays empty."""

    def body(values: Column, m: Column) -> Column:
        return let(
            _exp_total(values, m), lambda s: F.transform(values, lambda v: F.exp(v - m) / s)
        )

    return F.when(F.size(col(x)) == 0, col(x)).otherwise(_shifted(x, body))


def logsumexp(x: ColumnLike) -> Column:
    return _shifted(x, lambda values, m: m + F.ln(_exp_total(values, m)))


def log_softmax(x: ColumnLike) -> Column:
    """v - logsumexp(array) for every element."""
    x = col(x)
    return F.when(F.size(x) == 0, x).otherwise(
        let(
            F.struct(x.alias("x"), logsumexp(x).alias("lse")),
            lambda b: F.transform(b.getField("x"), lambda v: v - b.getField("lse")),
        )
    )


def total(x: ColumnLike) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda acc, v: acc + v)


def top2_gap(x: ColumnLike) -> Column:
    """Largest minus second largest of the non-null values; a single value is its own gap."""
    return let(
        F.sort_array(F.array_compact(col(x)), asc=False),
        lambda s: F.coalesce(F.get(s, F.lit(0)) - F.get(s, F.lit(1)), F.get(s, F.lit(0))),
    )


def sorted_gini(x: ColumnLike) -> Column:
    """(2 * sum(i * q_i) - (n + 1)) / n over the ascending non-null values scaled to sum one."""

    def body(s: Column) -> Column:
        n = F.size(s).cast("double")
        mass = total(s)
        weighted = F.aggregate(
            F.zip_with(s, F.sequence(F.lit(1), F.size(s)), lambda v, i: v * i),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        return F.when(mass > 0, (2.0 * weighted / mass - (n + 1)) / n)

    return let(
        F.sort_array(F.array_compact(col(x))), lambda s: F.when(F.size(s) > 0, body(s))
    )
