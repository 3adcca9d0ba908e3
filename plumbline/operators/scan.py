"""Ordered work over groups of any size: ranks, running sums, exact quantiles, neighbours.

A bare window per group puts the group into one task. Here a group is cut into pieces first, so
one group may hold most of the rows:

* `ordered_scan` range-partitions by (keys, order). Spark samples the boundaries, so a large group
  spreads over many partitions. Running sums are taken there, the placement is checkpointed once, and
  per-piece totals (one row per key and partition) give the offset that a piece needs.
* `hashed_scan` orders by a uniform keyed hash. The hash prefix is the piece, so neither sampling
  nor a checkpoint is needed.
* `neighbours` reads earlier rows of a dense sequence inside fixed-length blocks that overlap.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import keyed_hash
from ..session import checkpointed

PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the row position in the low 33 bits
HASH_BITS = 60
HASH_PIECE_BITS = 20
BLOCK_LENGTH = 4096


def _running(keys: Sequence[str], sums: Mapping[str, str]):
    """A pass over the Arrow batches of a sorted partition that adds the running sum `_run_<name>` of
    each entry name -> column, anew for each run of equal keys. A missing value adds nothing; the sum
    is missing until a value came. Inner functions travel to the workers
    whole, so these need not have the package."""

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        starts = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            column = batch.column(batch.schema.get_field_index(key))
            after, before = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.not_equal(after, before)
            if pa.types.is_floating(column.type):  # NaN is a key like any other
                differs = pc.and_not(differs, pc.and_(pc.is_nan(after), pc.is_nan(before)))
            starts[1:] |= differs.to_numpy(zero_copy_only=False)
        return starts

    def by_run(values: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Running sums of whole numbers that begin anew at each of the places `runs`."""
        upto = np.cumsum(values)
        return upto - np.repeat(upto[runs] - values[runs], sizes)

    def same(one, other) -> bool:
        return all(a == b or (a != a and b != b) for a, b in zip(one, other))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = changes(batch)
            first, final = (
                [batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys]
                for i in (0, batch.num_rows - 1)
            )
            if last is None or not same(first, last):
                carried = {}
            runs = np.flatnonzero(np.concatenate(([True], starts[1:])))
            sizes = np.diff(np.append(runs, batch.num_rows))
            added = []
            for name, column in sums.items():
                given = batch.column(batch.schema.get_field_index(column))
                whole = pa.types.is_integer(given.type)
                there = given.is_valid().to_numpy(zero_copy_only=False)
                filled = pc.fill_null(given, 0 if whole else 0.0).to_numpy(zero_copy_only=False)
                filled = filled.astype(np.int64 if whole else np.float64)
                total, seen = carried.get(name, (0, 0))
                filled[0] += total
                counts = there.astype(np.int64)
                counts[0] += seen
                counts = by_run(counts, runs, sizes)
                if whole:
                    sum_so_far = by_run(filled, runs, sizes)
                else:  # differences of long sums would lose digits
                    sum_so_far = np.concatenate([np.cumsum(part) for part in np.split(filled, runs[1:])])
                carried[name] = (sum_so_far[-1], counts[-1])
                added.append(pa.array(sum_so_far, mask=counts == 0))
            last = final
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, *[f"_run_{name}" for name in sums]]
            )

    return add


def ordered_scan(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Add `rank` (1-based position inside the key group), `rank_total` (group size) and, for each
    `sums` entry name -> column, the running sum `name` and the group sum `name_total`.

    `order` must be unique inside a group; key columns must not be NULL. A sum is over the values that
    are there, and NULL before the first of them. The rows cross one exchange: running sums are taken in
    the sorted partition before it is written, and the offsets of the pieces are added when it is read.
    """
    keys, order, sums = list(keys), list(order), dict(sums or {})
    pieces = ["_piece", *keys]
    whole = ("tinyint", "smallint", "int", "bigint")
    types = {c: t for c, t in df.dtypes}
    summed = {name: f"_sum_{name}" for name in sums}
    placed = (
        df.withColumns(
            {summed[n]: F.col(c).cast("bigint" if types[c] in whole else "double") for n, c in sums.items()}
        )
        .repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright("_at", PARTITION_SHIFT))
    )
    if sums:
        added = [T.StructField(f"_run_{name}", placed.schema[c].dataType) for name, c in summed.items()]
        schema = T.StructType([*placed.schema.fields, *added])
        placed = placed.mapInArrow(_running(keys, summed), schema).drop(*summed.values())
    placed = checkpointed(placed)
    # The last running sum of a piece is its total; the rows of a piece are in the order of `_at`.
    last = {name: F.max_by(f"_run_{name}", "_at") for name in sums}
    totals = placed.groupBy(*pieces).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_at").alias("_first"),
        *[expression.alias(f"_s_{name}") for name, expression in last.items()],
    )
    # Per key there is at most one row per range partition, so this window stays small.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *pieces,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(group).alias(f"{rank}_total"),
        *[
            expression
            for name in sums
            for expression in (
                F.sum(f"_s_{name}").over(before).alias(f"_before_{name}"),
                F.sum(f"_s_{name}").over(group).alias(f"{name}_total"),
            )
        ],
    )
    # Without keys there is a row for each range partition. With keys the table is written, so that the
    # optimizer knows its size: it goes to the rows, and not the rows to it, unless there are very many keys.
    offsets = checkpointed(offsets) if keys else F.broadcast(offsets)
    joined = placed.join(offsets, pieces)

    def running(name: str) -> Column:
        mine, earlier = F.col(f"_run_{name}"), F.col(f"_before_{name}")
        return F.coalesce(mine + earlier, mine, earlier)

    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("_at") + F.col("_shift")).alias(rank),
        F.col(f"{rank}_total"),
        *[
            expression
            for name in sums
            for expression in (running(name).alias(name), F.col(f"{name}_total"))
        ],
    )


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct non-null value; repeated values combine before the shuffle."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    keys: Sequence[str] = (),
    nearest: bool = False,
) -> DataFrame:
    """Exact quantiles of `value` per key group, one output column per `quantiles` entry.

    Position q * (n - 1), linear between the two neighbours; with `nearest` the position is rounded
    half to even and an actual value is returned. Values are counted per distinct value and ranked
    by `ordered_scan`, so no group is gathered in one task.
    """
    keys = list(keys)
    scanned = ordered_scan(
        value_counts(df, value, keys), [value], keys, {"upto": "n"}, rank="_rank"
    )
    size = F.col("upto_total").cast("double")

    def at(index: Column) -> Column:
        covered = (F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)
        return F.max(F.when(covered, F.col(value)))

    aggregates = []
    for name, q in quantiles.items():
        position = (size - 1) * F.lit(float(q))
        if nearest:
            aggregates.append(at(F.rint(position)).alias(f"{name}_lo"))
        else:
            aggregates.append(at(F.floor(position)).alias(f"{name}_lo"))
            aggregates.append(at(F.ceil(position)).alias(f"{name}_hi"))
            aggregates.append(F.max(position - F.floor(position)).alias(f"{name}_part"))
    picked = scanned.groupBy(*keys).agg(*aggregates)
    if nearest:
        results = [F.col(f"{name}_lo").alias(name) for name in quantiles]
    else:
        results = [
            (
                F.col(f"{name}_lo")
                + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_part")
            ).alias(name)
            for name in quantiles
        ]
    return picked.select(*keys, *results)


def hashed_scan(
    df: DataFrame, id_columns: Sequence[str], seed: int, strata: Sequence[str] = ()
) -> DataFrame:
    """Add `position` (1-based place in a seeded random order of the stratum) and `stratum_size`.

    Ids must be unique. The piece is the top bits of the hash: a stratum of any size spreads over
    up to 2^20 pieces, and the offsets come from one narrow count.
    """
    ids = list(id_columns)
    hashed = df.withColumn("_h", keyed_hash(ids, seed)).withColumn(
        "_piece", F.shiftright("_h", HASH_BITS - HASH_PIECE_BITS)
    )
    # Wrapped in a struct, NULL is a stratum like any other, and equal to itself in a join.
    keys = [f"_stratum{i}" for i in range(len(strata))]
    hashed = hashed.withColumns({k: F.struct(c) for k, c in zip(keys, strata)})
    pieces = [*keys, "_piece"]
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*pieces)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *pieces,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("stratum_size"),
        )
    )
    inside = Window.partitionBy(*pieces).orderBy("_h", *ids)
    return (
        hashed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, pieces)
        .select(
            *df.columns,
            (F.col("_local") + F.col("_before")).alias("position"),
            F.col("stratum_size"),
        )
    )


def hashed_parts(
    df: DataFrame,
    id_columns: Sequence[str],
    seed: int,
    fractions: Sequence[float],
    strata: Sequence[str] = (),
    counts: Sequence[int] = (),
) -> DataFrame:
    """Add `_part`: the number of the range of seeded random positions that a row falls in.

    Ranges follow one another: rint(fraction * stratum size) rows each, or fixed `counts` of the
    whole table; what is left has the number of ranges. A row's hash prefix decides, on the map
    side, unless the prefix holds a cut: only those pieces, about a millionth of a stratum each,
    are moved and ranked. NULL is a stratum like any other.
    """
    strata, ids = list(strata), list(id_columns)
    hashed = df.withColumn("_h", keyed_hash(ids, seed)).withColumn(
        "_piece", F.shiftright("_h", HASH_BITS - HASH_PIECE_BITS)
    )
    group = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    upto = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = (
        hashed.groupBy(*strata, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*strata, "_piece", "_n", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(group).alias("_size"))
    )
    edge, edges = F.lit(0.0), []
    for width in [*[F.rint(F.lit(float(f)) * F.col("_size")) for f in fractions], *[F.lit(float(c)) for c in counts]]:
        edge = edge + width
        edges.append(edge)
    # Per stratum: the last piece that lies wholly before each edge, and the rows up to there.
    cuts = sizes.groupBy(*strata).agg(
        *[
            F.coalesce(F.max(F.when(F.col("_upto") <= e, F.col("_piece"))), F.lit(-1)).alias(f"_in{i}")
            for i, e in enumerate(edges)
        ],
        *[
            F.min(F.when(F.col("_upto") > e, F.col("_piece"))).alias(f"_cut{i}")
            for i, e in enumerate(edges)
        ],
        *[F.max(e).cast("bigint").alias(f"_edge{i}") for i, e in enumerate(edges)],
    )
    cuts = cuts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], *cuts.columns[len(strata):])
    if strata:
        same = reduce(and_, [hashed[c].eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)])
        rows = hashed.join(cuts, same)
    else:
        # One row: a few numbers per cut.
        row = cuts.first()
        if row is None:
            return df.withColumn("_part", F.lit(0))
        rows = hashed.withColumns({c: F.lit(row[c]).cast("bigint") for c in cuts.columns})
    at_cut = reduce(or_, [F.coalesce(F.col("_piece") == F.col(f"_cut{i}"), F.lit(False)) for i in range(len(edges))])
    part = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        part = F.when(F.col("_piece") <= F.col(f"_in{i}"), F.lit(i)).otherwise(part)
    plain = rows.where(~at_cut).select(*[hashed[c] for c in df.columns], part.alias("_part"))
    # Positions inside the few pieces that hold a cut.
    local = rows.where(at_cut).withColumn(
        "_local", F.row_number().over(Window.partitionBy(*strata, "_piece").orderBy("_h", *ids))
    )
    before = sizes.select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(strata)],
        F.col("_piece").alias("_bp"),
        (F.col("_upto") - F.col("_n")).alias("_before"),
    )
    here = reduce(
        and_,
        [local[c].eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(strata)],
        local["_piece"] == F.col("_bp"),
    )
    ranked = local.join(before, here)
    place, part = F.col("_local") + F.col("_before"), F.lit(len(edges))
    for i in reversed(range(len(edges))):
        part = F.when(place <= F.col(f"_edge{i}"), F.lit(i)).otherwise(part)
    return plain.unionByName(ranked.select(*[local[c] for c in df.columns], part.alias("_part")))


def neighbours(
    df: DataFrame,
    step: str,
    columns: Mapping[str, tuple[str, int]],
    keys: Sequence[str] = (),
    block: int = BLOCK_LENGTH,
) -> DataFrame:
    """Add, for each entry name -> (column, distance), that column of the row `distance` steps
    earlier in the key group; NULL when that step is absent.

    Steps are whole numbers, unique inside a group. Every block of `block` steps also receives the
    last few rows of the block before, so a window never sees more than block + distance rows.
    """
    reach = max(distance for _, distance in columns.values())
    here = F.floor(F.col(step) / F.lit(block))
    # The floor of (step + reach) differs from the own block only for the last `reach` rows.
    ahead = F.floor((F.col(step) + F.lit(reach)) / F.lit(block))
    spread = df.withColumn("_own", here).withColumn(
        "_block", F.explode(F.array_distinct(F.array(here, ahead)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy(step)
    # Steps may have gaps, so every earlier row within reach is a candidate for the exact distance.
    added = []
    for name, (column, distance) in columns.items():
        earlier = F.lit(None)
        for back in range(1, distance + 1):
            earlier = F.when(
                F.lag(step, back).over(window) == F.col(step) - distance,
                F.lag(column, back).over(window),
            ).otherwise(earlier)
        added.append(earlier.alias(name))
    looked_up = spread.select("*", *added)
    return looked_up.where(F.col("_block") == F.col("_own")).select(*df.columns, *columns)
