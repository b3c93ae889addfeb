"""Substitution of flagged pixels by seeded draws from clean ones, normalisation and baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, BT, draw, lower_median


def picked():
    """Column function: for each row of a list the value of source number draw mod count, sources by place; null without a draw or a source."""

    @F.arrow_udf("array<double>")
    def pick(places: pa.Array, values: pa.Array, sources: pa.Array, draws: pa.Array) -> pa.Array:
        size = pc.list_value_length(places).to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(len(size)), size)
        place, value, source, draw = (x.flatten() for x in (places, values, sources, draws))
        own = np.flatnonzero(source.to_numpy(zero_copy_only=False))
        own = own[np.lexsort((place.to_numpy()[own], group[own]))]
        count = np.bincount(group[own], minlength=len(size))
        at = np.flatnonzero(draw.is_valid().to_numpy(zero_copy_only=False) & (count > 0)[group])
        k = np.full(len(group), -1)
        k[at] = own[(np.cumsum(count) - count)[group[at]] + draw.fill_null(0).to_numpy()[at] % count[group[at]]]
        new = value.cast(pa.float64()).take(pa.array(k, mask=k < 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), new)

    return pick


def drawn(pixels: DataFrame, keys: list[str], order: str, replace: Column, source: Column, seed: int, empty: Column | None = None) -> DataFrame:
    """``replace`` pixels get the value of a ``source`` pixel of the same keys: number draw mod count in their order.

    One exchange: the rows of the keys, a channel or a time of a block, are gathered, draw and unfold again.
    """
    rest = [c for c in pixels.columns if c not in keys]
    row = F.struct(F.struct(*rest).alias("_row"), F.coalesce(source, F.lit(False)).alias("_src"), F.when(replace, draw(seed, *BC, "t")).alias("_draw"))
    own = pixels.groupBy(*keys).agg(F.collect_list(row).alias("_all"), F.count_if(source).alias("_n"))
    own = own.withColumn("_new", picked()(F.col(f"_all._row.{order}"), F.col("_all._row.v"), F.col("_all._src"), F.col("_all._draw")))
    own = own.select(*keys, "_n", F.inline(F.arrays_zip("_all", "_new"))).select(*keys, "_n", "_new", "_all._row.*", F.col("_all._draw").isNotNull().alias("_rep"))
    missing = F.col("v") if empty is None else F.when(F.col("_rep") & (F.col("_n") == 0), empty).otherwise(F.col("v"))
    return own.withColumn("v", F.coalesce("_new", missing)).drop("_n", "_new", "_rep")


def in_channel(pixels: DataFrame, mask: str, seed: int = 1) -> DataFrame:
    """Masked pixels from clean ones of their channel; channels without clean pixels stay."""
    return drawn(pixels, BC, "t", F.col(mask), ~F.col(mask), seed)


def across_channels(pixels: DataFrame, flag: str, mask: str, seed: int = 1) -> DataFrame:
    """Pixels of flagged channels from unmasked ones of the other channels at their time; 0 if there are none."""
    return drawn(pixels, BT, "chan", F.col(flag), ~F.col(flag) & ~F.col(mask), seed, F.lit(0.0))


def by_class(pixels: DataFrame, label: str, pulsar: int = 5, line: int = 1, share: float = 0.05, seed: int = 1, aware: bool = True) -> DataFrame:
    """Class-aware cleaning: along time where more than ``share`` of the channel is clean, then along channels for what is
    still unchanged. Pulsar pixels stay, but for those in channels that hold a line; without ``aware`` they are like others."""
    c = Window.partitionBy(*BC)
    lined = F.bool_or(F.col(label) == line).over(c)
    enough = F.avg((F.col(label) == 0).cast("double")).over(c) > share
    wanted = (F.col(label) != 0) & ((F.col(label) != pulsar) | F.col("_lined")) if aware else F.col(label) != 0
    own = pixels.withColumns({"_lined": lined, "_enough": enough, "_old": F.col("v")})
    own = drawn(own, BC, "t", wanted & F.col("_enough"), F.col(label) == 0, seed)
    left = (F.col(label) != 0) & (F.abs(F.col("v") - F.col("_old")) < 1e-7)
    left = left & (F.col(label) != pulsar) if aware else left
    own = drawn(own, BT, "chan", left, F.col(label) == 0, seed + 1)
    return own.drop("_lined", "_enough", "_old")


def without_baseline(grid: DataFrame) -> DataFrame:
    m = grid.groupBy(*BC).agg(lower_median("v").alias("_med"))
    return grid.join(m, BC).withColumn("v", F.col("v") - F.col("_med")).drop("_med")


def normalised(grid: DataFrame, k: float = 3.0, keys: list[str] = B) -> DataFrame:
    """mean - k std to 0, mean + k std to 1, clamped; 0.5 where the deviation vanishes."""
    s = grid.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    x = (F.col("v") - (F.col("_m") - k * F.col("_s"))) / (2 * k * F.col("_s"))
    return grid.join(s, keys).withColumn("v", F.when(F.col("_s") <= 1e-6, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).drop("_m", "_s")


def standardised(grid: DataFrame, k: float = 1.0, keys: list[str] = B) -> DataFrame:
    """(v - mean) / (k std); 0 where the deviation vanishes."""
    s = grid.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return grid.join(s, keys).withColumn("v", F.when(F.col("_s") <= 1e-6, 0.0).otherwise((F.col("v") - F.col("_m")) / (k * F.col("_s")))).drop("_m", "_s")


def pulses_to_median(pixels: DataFrame, pulse: str) -> DataFrame:
    """Pulse pixels take their block's median."""
    s = pixels.groupBy(*B).agg(F.percentile("v", 0.5).alias("_med"))
    return pixels.join(s, B).withColumn("v", F.when(F.col(pulse), F.col("_med")).otherwise(F.col("v"))).drop("_med")
