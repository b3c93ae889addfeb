"""Labelled signals added to grids. Every random choice is a seeded draw from keys, so results are repeatable in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, draw

DELAY = 4148.808


def uniform(seed: int, *keys: str) -> Column:
    return draw(seed, *keys) / 4294967296.0


def _added(grid: DataFrame, signal: DataFrame, keys: list[str], code: int) -> DataFrame:
    """v plus the sum of the signal's rows at the keys; their label where any of them marks the pixel."""
    s = signal.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.bool_or("_l").alias("_l"))
    own = grid.join(s, keys, "left")
    return own.withColumns({"v": F.col("v") + F.coalesce("_s", F.lit(0.0)), "label": F.when(F.coalesce("_l", F.lit(False)), code).otherwise(F.col("label"))}).drop("_s", "_l")


def pulse_train(grid: DataFrame, freq: Column, top: float, dm: float, period: float, t0: float, sigma: float, height: float, tbin: float, code: int = 8) -> DataFrame:
    """Dispersed Gaussian pulses; labelled within 2.5 sigma of the nearest arrival. An expression of each pixel alone."""
    late = DELAY * dm * (F.pow(freq, -2) - top**-2)
    phase = F.pmod(F.col("t") * tbin - t0 - late, F.lit(period))
    far = F.least(phase, period - phase)
    return grid.withColumns({"v": F.col("v") + height * F.exp(-far * far / (2 * sigma * sigma)), "label": F.when(far < 2.5 * sigma, code).otherwise(F.col("label"))})


def band(grid: DataFrame, centre: float, width: float, height: float, shape: str = "gaussian", duty: float = 1.0, seed: int = 1, code: int = 1) -> DataFrame:
    """A band of channels, on at times whose draw is below ``duty``; labelled where its profile exceeds 5 %."""
    far = F.abs(F.col("chan") - centre)
    profile = F.exp(-far * far / (2 * width * width)) if shape == "gaussian" else F.when(far <= width, 1.0).otherwise(0.0)
    on = uniform(seed, *B, "t") < duty if duty < 1 else F.lit(True)
    return grid.withColumns({"v": F.when(on, F.col("v") + height * profile).otherwise(F.col("v")), "label": F.when(on & (profile > 0.05), code).otherwise(F.col("label"))})


def periodic_band(grid: DataFrame, lo: int, hi: int, period: int, duty: float, height: float, code: int = 1) -> DataFrame:
    on = F.col("chan").between(lo, hi) & (F.col("t") % period < duty * period)
    return grid.withColumns({"v": F.when(on, F.col("v") + height).otherwise(F.col("v")), "label": F.when(on, code).otherwise(F.col("label"))})


def _seeds(grid: DataFrame, n: int, nchan: int, nsamp: int, seed: int, per_source: bool) -> DataFrame:
    """n places in each block; with per_source all blocks of a source share them."""
    keys = ["source"] if per_source else B
    own = grid.select(*B).distinct().select(*B, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    at = lambda k, size: (draw(seed + k, *keys, "_i") % size).cast("int")
    return own.select(*B, "_i", at(0, nchan).alias("c"), at(1, nsamp).alias("x"), uniform(seed + 2, *keys, "_i").alias("u"))


def clusters(grid: DataFrame, n: int, nchan: int, nsamp: int, height: float, seed: int = 1, stretch: int = 1, code: int = 6, per_source: bool = False) -> DataFrame:
    """Small rectangles of points, up to 3 x 3, taller in frequency by ``stretch``."""
    s = _seeds(grid, n, nchan, nsamp, seed, per_source)
    high, wide = (F.floor(F.col("u") * 3) * stretch).cast("int"), F.floor(F.col("u") * 9 % 3).cast("int")
    cells = s.select(*B, "c", "x", "u", F.explode(F.sequence(F.lit(0), high)).alias("i"))
    cells = cells.select(*B, (F.col("c") + F.col("i")).alias("chan"), "x", F.explode(F.sequence(F.lit(0), wide)).alias("j"))
    cells = cells.select(*B, "chan", (F.col("x") + F.col("j")).alias("t"), F.lit(height).alias("_s"), F.lit(True).alias("_l"))
    return _added(grid, cells, [*BC, "t"], code)


def blobs(grid: DataFrame, n: int, nchan: int, nsamp: int, height: float, sigma_c: float, sigma_t: float, seed: int = 1, least: float = 0.05, code: int = 7) -> DataFrame:
    """Gaussian blobs over a box of three sigma; labelled where they exceed ``least`` of the peak."""
    s = _seeds(grid, n, nchan, nsamp, seed, False)
    rc, rt = int(3 * sigma_c), int(3 * sigma_t)
    cells = s.select(*B, "c", "x", F.explode(F.sequence(F.lit(-rc), F.lit(rc))).alias("i")).select("*", F.explode(F.sequence(F.lit(-rt), F.lit(rt))).alias("j"))
    g = F.exp(-(F.col("i") * F.col("i") / (2 * sigma_c**2) + F.col("j") * F.col("j") / (2 * sigma_t**2)))
    cells = cells.select(*B, (F.col("c") + F.col("i")).alias("chan"), (F.col("x") + F.col("j")).alias("t"), (height * g).alias("_s"), (g > least).alias("_l"))
    return _added(grid, cells, [*BC, "t"], code)


def bursts(grid: DataFrame, n: int, height_c: int, width_t: int, nchan: int, nsamp: int, height: float, fill: float = 0.7, seed: int = 1, code: int = 7) -> DataFrame:
    """Dense rectangles whose pixels are on with probability ``fill``; the whole rectangle is labelled."""
    s = _seeds(grid, n, nchan, nsamp, seed, False)
    cells = s.select(*B, "_i", "c", "x", F.explode(F.sequence(F.lit(0), F.lit(height_c - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width_t - 1))).alias("j"))
    on = uniform(seed + 5, *B, "_i", "i", "j") < fill
    cells = cells.select(*B, (F.col("c") + F.col("i")).alias("chan"), (F.col("x") + F.col("j")).alias("t"), F.when(on, height).otherwise(0.0).alias("_s"), F.lit(True).alias("_l"))
    return _added(grid, cells, [*BC, "t"], code)


def impulses(grid: DataFrame, n: int, nsamp: int, height: float, cluster: int = 1, seed: int = 1, code: int = 2) -> DataFrame:
    """Times at which all channels jump; ``cluster`` times in a row each."""
    s = _seeds(grid, n, 1, nsamp, seed, False)
    times = s.select(*B, F.explode(F.sequence(F.col("x"), F.col("x") + cluster - 1)).alias("t")).distinct().select(*B, "t", F.lit(height).alias("_s"), F.lit(True).alias("_l"))
    return _added(grid, times, [*B, "t"], code)
