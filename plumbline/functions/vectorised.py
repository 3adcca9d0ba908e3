"""Reductions of wide arrays (logits over a vocabulary, hidden vectors) as Arrow functions.

Higher-order functions visit one boxed element at a time; over a vocabulary of 32,000 the whole job
was about four times slower that way. Here an Arrow batch of rows is reduced at once and only a few
numbers per row come back. Spark bounds the bytes of a batch
(`spark.sql.execution.arrow.maxBytesPerBatch`). The kernels are nested functions, so that they are
sent by value and executors need numpy and pyarrow only.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ColumnLike, col

NORM_FLOOR = 1e-10
PROBABILITY_FLOOR = 1e-10
SUMMARY_FIELDS = (
    "peak", "total", "logsumexp", "entropy", "maxprob", "margin", "clamped_entropy"
)
SUMMARY_TYPE = ", ".join(f"{name} DOUBLE" for name in SUMMARY_FIELDS) + ", finite BOOLEAN"
CHANGE_TYPE = "norm DOUBLE, cosine DOUBLE"


def _summary_kernel(temperature: float):
    floor, fields = PROBABILITY_FLOOR, SUMMARY_FIELDS

    def kernel(logits):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(size > 0)
        results = {name: np.full(len(size), np.nan) for name in fields}
        clean = np.zeros(len(size), dtype=bool)
        if len(rows):
            flat = logits.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            flat = np.asarray(flat, dtype=float) / temperature
            width = size[rows].astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(width)[:-1]))
            with np.errstate(all="ignore"):
                peak = np.maximum.reduceat(flat, starts)
                shifted = flat - np.repeat(peak, width)
                power = np.exp(shifted)
                total = np.add.reduceat(power, starts)
                moment = np.add.reduceat(power * shifted, starts)
                log_total = np.log(total)
                logs = shifted - np.repeat(log_total, width)
                clamped = np.add.reduceat(power * np.maximum(logs, np.log(floor)), starts) / total
                # The second largest value: hide one occurrence of the largest and look again.
                at_peak = np.flatnonzero(flat == np.repeat(peak, width))
                owner = np.searchsorted(starts, at_peak, side="right")
                _, first = np.unique(owner, return_index=True)
                hidden = flat.copy()
                hidden[at_peak[first]] = -np.inf
                second = np.where(width > 1, np.maximum.reduceat(hidden, starts), np.nan)
                values = (
                    peak, total, peak + log_total, log_total - moment / total, 1.0 / total,
                    (peak - second) * temperature, -clamped,
                )
            for name, value in zip(fields, values):
                results[name][rows] = value
            clean[rows] = np.logical_and.reduceat(np.isfinite(flat), starts)
        absent = size == 0
        columns = [pa.array(results[name], mask=absent) for name in fields]
        return pa.StructArray.from_arrays(
            [*columns, pa.array(clean, mask=absent)], [*fields, "finite"]
        )

    return kernel


def logit_summary(logits: ColumnLike, temperature: float = 1.0) -> Column:
    """One struct per vector of softmax(logits / temperature): peak and total of the shifted
    exponentials, logsumexp, entropy, largest probability, entropy with clamped logarithms, the
    margin of the raw values, and whether all values are finite. An empty vector gives NULLs.

    With e = exp(v - peak): entropy = ln(sum e) - sum(e * (v - peak)) / sum e, and the largest
    probability is 1 / sum e. Keep the result in a column of its own, so that it is computed once.
    """
    reduce = F.arrow_udf(_typed(_summary_kernel(float(temperature)), 1), SUMMARY_TYPE)
    return reduce(col(logits))


def _change_kernel():
    floor = NORM_FLOOR

    def kernel(now, before, earlier):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def size(vectors):
            return pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)

        def flat(vectors, rows):
            values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            return np.asarray(values, dtype=float)

        width = size(now)
        norms, cosines = np.full(len(width), np.nan), np.full(len(width), np.nan)
        paired = (width > 0) & (width == size(before))
        chained = paired & (width == size(earlier))
        for known, with_earlier in ((paired & ~chained, False), (chained, True)):
            rows = np.flatnonzero(known)
            if not len(rows):
                continue
            starts = np.concatenate(([0], np.cumsum(width[rows].astype(np.int64))[:-1]))
            middle = flat(before, rows)
            change = flat(now, rows) - middle
            norms[rows] = np.sqrt(np.add.reduceat(change * change, starts))
            if with_earlier:
                last = middle - flat(earlier, rows)
                length = np.sqrt(np.add.reduceat(last * last, starts))
                cosines[rows] = np.add.reduceat(change * last, starts) / (
                    np.maximum(norms[rows], floor) * np.maximum(length, floor)
                )
        return pa.StructArray.from_arrays(
            [pa.array(norms, mask=~paired), pa.array(cosines, mask=~chained)], ["norm", "cosine"]
        )

    return kernel


def change_summary(now: ColumnLike, before: ColumnLike, earlier: ColumnLike) -> Column:
    """Norm of now - before, and its cosine with before - earlier (each norm clamped from below);
    NULL where a vector is missing."""
    return F.arrow_udf(_typed(_change_kernel(), 3), CHANGE_TYPE)(col(now), col(before), col(earlier))


def _typed(kernel, inputs: int):
    """Give the kernel the type hints by which Spark recognises a scalar Arrow function."""
    import pyarrow as pa

    names = kernel.__code__.co_varnames[:inputs]
    kernel.__annotations__ = {**{name: pa.Array for name in names}, "return": pa.Array}
    return kernel
