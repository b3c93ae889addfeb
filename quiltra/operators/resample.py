"""Resampling, reshaping and tiling of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, draw


def block_mean(grid: DataFrame, by_chan: int, by_time: int, nchan: int | None = None, nsamp: int | None = None) -> DataFrame:
    """Means of by_chan x by_time cells. With a size given, the cells after the last whole group go."""
    if nchan is not None:
        grid = grid.filter(F.col("chan") < nchan // by_chan * by_chan)
    if nsamp is not None:
        grid = grid.filter(F.col("t") < nsamp // by_time * by_time)
    keys = [F.floor(F.col("chan") / by_chan).cast("int").alias("chan"), F.floor(F.col("t") / by_time).cast("int").alias("t")]
    return grid.groupBy(*B, *keys).agg(F.avg("v").alias("v"))


def strict_block_mean(grid: DataFrame, by_chan: int, by_time: int, nchan: int, nsamp: int) -> DataFrame:
    if nchan % by_chan or nsamp % by_time:
        raise ValueError(f"{nchan} x {nsamp} can't be divided by {by_chan} x {by_time}")
    return block_mean(grid, by_chan, by_time)


def nearest(coarse: DataFrame, src: tuple[int, int], dst: tuple[int, int], value: str) -> DataFrame:
    """Nearest-neighbour growth from src to dst (channels, times): target i takes source floor(i * src / dst).

    Each coarse cell is turned into its own targets; nothing is joined.
    """
    def targets(at: Column, s: int, d: int) -> Column:
        return F.sequence(F.ceil(at * d / s).cast("int"), (F.ceil((at + 1) * d / s) - 1).cast("int"))

    own = coarse.select(*B, F.explode(targets(F.col("chan"), src[0], dst[0])).alias("chan"), "t", value)
    return own.select(*BC, F.explode(targets(F.col("t"), src[1], dst[1])).alias("t"), value)


def bilinear(grid: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Bilinear growth with half-pixel centres, borders repeated: each source cell sends its weighted share to its targets.

    Missing source cells count as 0, so a block has all dst cells whatever it has of src.
    """
    def shares(at: str, s: int, d: int) -> Column:
        lo, hi = F.greatest(F.lit(0), F.floor((F.col(at) - 1) * d / s) - 1), F.least(F.lit(d - 1), F.ceil((F.col(at) + 2) * d / s) + 1)
        place = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(float(s - 1)), (i + 0.5) * s / d - 0.5))
        weigh = lambda i: F.struct(i.cast("int").alias("i"), F.greatest(F.lit(0.0), 1 - F.abs(place(i) - F.col(at))).alias("w"))
        return F.filter(F.transform(F.sequence(lo.cast("int"), hi.cast("int")), weigh), lambda x: x["w"] > 0)

    own = grid.select(*B, F.explode(shares("chan", src[0], dst[0])).alias("c"), "t", "v").select(*B, "c", F.explode(shares("t", src[1], dst[1])).alias("x"), "v")
    sent = own.select(*B, F.col("c.i").alias("chan"), F.col("x.i").alias("t"), (F.col("v") * F.col("c.w") * F.col("x.w")).alias("v"))
    every = [F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias(c) for c, d in zip(("chan", "t"), dst)]
    nothing = grid.groupBy(*B).agg(F.max(F.when(F.col("v").isNotNull(), 0.0)).alias("v")).select(*B, "v", every[0]).select(*BC, every[1], "v")
    return sent.unionByName(nothing).groupBy(*BC, "t").agg(F.sum("v").alias("v"))


def flipped(grid: DataFrame, nchan: int) -> DataFrame:
    return grid.withColumn("chan", (F.lit(nchan - 1) - F.col("chan")).cast("int"))


def transposed(grid: DataFrame) -> DataFrame:
    """Channels and times change places."""
    return grid.select(*B, F.col("t").alias("chan"), F.col("chan").alias("t"), "v")


def focus_crop(labels: DataFrame, height: int, width: int, nchan: int, nsamp: int, focus: int, share: float, seed: int = 1) -> DataFrame:
    """A height x width crop of each block: with probability ``share`` around one of its pixels of class ``focus``."""
    pixel = labels.filter(F.col("label") == focus).withColumn("r", draw(seed, *BC, "t")).groupBy(*B).agg(F.min(F.struct("r", "chan", "t")).alias("p"))
    corner = labels.select(*B).distinct().withColumn("u", draw(seed + 1, *B)).withColumn("w", draw(seed + 2, *B)).join(pixel, B, "left")
    focused = F.col("p").isNotNull() & (F.col("u") % 1000 < share * 1000)
    at = lambda p, r, n, k: F.greatest(F.lit(0), F.least(F.lit(n - k), F.when(focused, p - k // 2).otherwise(r % (n - k + 1)))).cast("int")
    corner = corner.select(*B, at(F.col("p.chan"), F.col("u"), nchan, height).alias("c0"), at(F.col("p.t"), F.col("w"), nsamp, width).alias("t0"))
    own = labels.join(corner, B).filter(F.col("chan").between(F.col("c0"), F.col("c0") + height - 1) & F.col("t").between(F.col("t0"), F.col("t0") + width - 1))
    return own.withColumns({"chan": F.col("chan") - F.col("c0"), "t": F.col("t") - F.col("t0")}).drop("c0", "t0")


def tile_starts(n: int, window: int, stride: int) -> list[int]:
    """Starts of sliding tiles; the last one ends at n."""
    starts = list(range(0, max(1, n - window + 1), stride))
    return starts if starts[-1] + window >= n else [*starts, n - window]


def tiles(grid: DataFrame, nsamp: int, window: int, stride: int) -> DataFrame:
    """Every pixel once for each tile along time that holds it, as column ``tile`` (its start)."""
    starts = F.array(*map(F.lit, tile_starts(nsamp, window, stride)))
    inside = F.filter(starts, lambda s: (s <= F.col("t")) & (F.col("t") < s + window))
    return grid.select("*", F.explode(inside).alias("tile"))


def merged_tiles(scored: DataFrame, value: str) -> DataFrame:
    return scored.groupBy(*BC, "t").agg(F.avg(value).alias(value))


def padded(grid: DataFrame, nchan: int, nsamp: int, value: float = 0.0) -> DataFrame:
    from quiltra.sources.grids import filled

    return filled(grid, nchan, nsamp, value)
