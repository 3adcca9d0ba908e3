"""Dynamics of recorded vectors: states(seq, step, layer, vec) and attention(seq, step, head,
weights, prompt_len).

Nothing is windowed over a whole sequence: layers of one step form a group of a few rows, steps are
compared inside overlapping blocks, and the aggregates per sequence merge on the map side.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import total
from ..functions.vectorised import NORM_FLOOR, change_summary
from ..session import checkpointed
from .scan import exact_quantiles, neighbours

DEFAULT_LAYERS = (-4, -3, -2, -1)
PEARSON_FLOOR = 1e-8
RELIABLE_LENGTH = 5
TAIL = 0.95
SERIES = ("delta_tok", "delta_spread", "delta_time", "layer_cos", "time_cos", "prompt_mass")


def pick_layers(n_layers: int, layers: Sequence[int] = DEFAULT_LAYERS) -> list[int]:
    """Negative ids count from the end; invalid ids drop out; at least the last two remain."""
    wrapped = [i if i >= 0 else n_layers + i for i in layers]
    valid = [i for i in wrapped if 0 <= i < n_layers]
    return valid if len(valid) >= 2 else [max(0, n_layers - 2), n_layers - 1]


def count_layers(states: DataFrame) -> int:
    return int(states.agg(F.max("layer").alias("m")).first().m) + 1


def layer_dynamics(
    states: DataFrame, layers: Sequence[int], keys: Sequence[str] = ("seq",)
) -> DataFrame:
    """Per step: mean and spread of the norms of layer-to-layer changes, and the mean cosine of
    consecutive changes. Only the picked layers are read."""
    order = sorted(set(layers))
    window = Window.partitionBy(*keys, "step").orderBy("layer")
    stacked = (
        states.where(F.col("layer").isin(order))
        .withColumn("_v1", F.lag("vec", 1).over(window))
        .withColumn("_v2", F.lag("vec", 2).over(window))
        .where(F.col("_v1").isNotNull())
    )
    changed = stacked.select(*keys, "step", change_summary("vec", "_v1", "_v2").alias("_c"))
    measured = changed.select(
        *keys, "step", F.col("_c.norm").alias("_norm"), F.col("_c.cosine").alias("_cos")
    )
    return measured.groupBy(*keys, "step").agg(
        F.avg("_norm").alias("delta_tok"),
        F.stddev_samp("_norm").alias("delta_spread"),
        F.avg("_cos").alias("layer_cos"),
    )


def time_dynamics(
    states: DataFrame, layer: int, keys: Sequence[str] = ("seq",)
) -> DataFrame:
    """Per step of one layer: norm of the change since the step before, and its cosine with the
    previous change; NULL where the earlier steps are missing."""
    rows = states.where(F.col("layer") == layer).select(*keys, "step", "vec")
    paired = neighbours(rows, "step", {"_v1": ("vec", 1), "_v2": ("vec", 2)}, keys)
    changed = paired.select(*keys, "step", change_summary("vec", "_v1", "_v2").alias("_c"))
    return changed.select(
        *keys,
        "step",
        F.col("_c.norm").alias("delta_time"),
        F.col("_c.cosine").alias("time_cos"),
    )


def prompt_attention(attention: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Per step: attention on prompt positions, averaged over heads and clamped to [0, 1]."""
    on_prompt = total(F.slice("weights", F.lit(1), F.col("prompt_len")))
    mean = F.avg("_mass")
    return (
        attention.where(F.col("prompt_len") > 0)
        .select(*keys, "step", on_prompt.alias("_mass"))
        .groupBy(*keys, "step")
        .agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("prompt_mass"))
    )


def guarded_pearson(x: str, y: str) -> Column:
    """Pearson correlation; NULL when the product of the two root sums of squares is tiny."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).cast("double")
    scale = n * F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(scale > PEARSON_FLOOR, F.try_divide(n * F.covar_pop(x, y), scale))


def step_series(
    states: DataFrame,
    attention: DataFrame | None = None,
    layers: Sequence[int] = DEFAULT_LAYERS,
    fixed_layer: int = -1,
    n_layers: int | None = None,
    keys: Sequence[str] = ("seq",),
) -> DataFrame:
    """All six series per (keys, step); absent ones are NULL. Joins are by key and step, so a long
    sequence spreads over all tasks."""
    n_layers = n_layers or count_layers(states)
    fixed = min(max(fixed_layer if fixed_layer >= 0 else n_layers + fixed_layer, 0), n_layers - 1)
    on = [*keys, "step"]
    series = layer_dynamics(states, pick_layers(n_layers, layers), keys).join(
        time_dynamics(states, fixed, keys), on, "left"
    )
    if attention is None:
        return series.withColumn("prompt_mass", F.lit(None).cast("double"))
    return series.join(prompt_attention(attention, keys), on, "left")


def sequence_features(series: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per sequence: means, variation, 95 % points, consistency, pooled vector, length.

    The series, a few numbers per step, are written once: tails and moments both read them, and the
    vectors behind them are reduced and moved only once."""
    keys = list(keys)
    series = checkpointed(series.select(*keys, *SERIES))
    points = F.array(
        *[F.struct(F.lit(s).alias("series"), F.col(s).alias("value")) for s in SERIES]
    )
    long = series.select(*keys, F.inline(points))
    tails = (
        exact_quantiles(long, "value", {"p95": TAIL}, [*keys, "series"])
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("series") == s, F.col("p95"))).alias(f"{s}_p95") for s in SERIES])
    )
    moments = series.groupBy(*keys).agg(
        F.count("delta_tok").alias("icrp_resp_len"),
        *[F.count(s).alias(f"{s}_n") for s in SERIES],
        *[F.avg(s).alias(f"{s}_mean") for s in SERIES],
        *[F.stddev_pop(s).alias(f"{s}_std") for s in SERIES],
        guarded_pearson("delta_tok", "prompt_mass").alias("_pearson"),
    )
    joined = moments.join(tails, keys, "left")

    def variation(s: str) -> Column:
        return F.col(f"{s}_std") / F.greatest(F.col(f"{s}_mean"), F.lit(NORM_FLOOR))

    def moments_of(s: str) -> Column:
        """Three numbers, or none when the series is absent; the layer spread is always there."""
        nan = F.lit(float("nan"))
        parts = [F.coalesce(f"{s}_{m}", nan) for m in ("mean", "std", "p95")]
        present = F.lit(True) if s in ("delta_tok", "delta_spread") else F.col(f"{s}_n") > 0
        return F.when(present, F.array(*parts)).otherwise(F.array().cast("array<double>"))

    same_length = F.col("prompt_mass_n") == F.col("delta_tok_n")
    return joined.select(
        *keys,
        F.col("delta_tok_mean").alias("icrp_layer_delta_mean"),
        variation("delta_tok").alias("icrp_layer_delta_cv"),
        F.col("delta_tok_p95").alias("icrp_layer_delta_p95"),
        F.col("delta_time_mean").alias("icrp_time_delta_mean"),
        variation("delta_time").alias("icrp_time_delta_cv"),
        F.col("delta_time_p95").alias("icrp_time_delta_p95"),
        F.col("layer_cos_mean").alias("icrp_interlayer_cos_mean"),
        F.col("time_cos_mean").alias("icrp_temporal_cos_mean"),
        F.col("prompt_mass_mean").alias("icrp_prompt_mass_mean"),
        F.when(same_length, F.col("_pearson")).alias("icrp_pool_attn_cons"),
        "icrp_resp_len",
        F.flatten(F.array(*[moments_of(s) for s in SERIES])).alias("icrp_pool_vec"),
        (F.col("icrp_resp_len") >= RELIABLE_LENGTH).cast("int").alias("icrp_reliable"),
    )


def with_empty_responses(
    features: DataFrame, sequences: DataFrame, keys: Sequence[str] = ("seq",)
) -> DataFrame:
    """Keep sequences without any step: length 0, everything else NULL."""
    return sequences.select(*keys).join(features, list(keys), "left").withColumn(
        "icrp_resp_len", F.coalesce("icrp_resp_len", F.lit(0))
    )
