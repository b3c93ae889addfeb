"""Whole labelling flows, composed of the detectors; each is one chain over a grid partitioned by block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quiltra.functions.exprs import B, BC, BT
from quiltra.operators import detect as D
from quiltra.operators import morphology as M
from quiltra.operators import stats
from quiltra.operators import substitute as X
from quiltra.sources.grids import by_block

#: Detectors by name: pixels (BC, t, v, m_point) of blocks of nchan x nsamp -> the same pixels with m_horiz.
DETECTORS = {}


def detector(name: str):
    def add(f):
        DETECTORS[name] = f
        return f

    return add


@detector("sigma")
def sigma_pixels(pixels: DataFrame, nchan: int, nsamp: int, k: float, fallback: float) -> DataFrame:
    """Whole channels: clipped deviations, without isolated runs; then means among the channels left; then all means at ``fallback``.

    Points are left out of deviations and means. A channel of points takes all its values for its deviation and its last
    mean, and has no part among the channels left.
    """
    from quiltra.operators.runs import without_isolated

    spread = stats.channel_spread(pixels, "m_point").select(*BC, "std")
    means = pixels.groupBy(*BC).agg(F.avg(F.when(~F.col("m_point"), F.col("v"))).alias("mean"), F.avg("v").alias("_all"))
    a = D.clip_channels(spread.join(means, BC), k).withColumnRenamed("flag", "_a")
    stay = without_isolated(a, B, "chan", "_a").select(*B, F.explode(F.sequence("first", "last")).alias("chan"), F.lit(True).alias("_s"))
    b = a.join(stay, BC, "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    c = D.mean_outliers(b, 3.0, "_s").withColumnRenamed("flag", "_b").withColumn("mean", F.coalesce("mean", "_all"))
    flags = D.mean_outliers(c, fallback, centre="mean").select(*BC, (F.col("_s") | F.col("_b") | F.col("flag")).alias("m_horiz"))
    return M.looked_up(pixels, flags, "chan")


@detector("iqrm")
def iqrm_pixels(pixels: DataFrame, nchan: int, nsamp: int, k: float, fallback: float) -> DataFrame:
    """Whole channels by Tukey's rule or votes on their deviations, and the pixels of the others by votes along time."""
    return D.iqrm_or_tukey(pixels, nchan, nsamp).withColumnRenamed("m", "m_horiz")


@detector("tukey")
def tukey_pixels(pixels: DataFrame, nchan: int, nsamp: int, k: float, fallback: float) -> DataFrame:
    """Pixels by Tukey's rule along their channel's time."""
    return D.tukey_time(by_block(pixels), 3.0).withColumnRenamed("m", "m_horiz")


@dataclass(frozen=True)
class PulseTrain:
    """A dispersed pulse train: widths in samples, times in seconds, frequencies in MHz; ``inter_*`` is a second pulse."""

    dm: float
    period: float
    t0: float
    width: int
    tbin: float
    nsamp: int
    inter_width: int = 0
    inter_t0: float | None = None
    lowest: float = 0.0
    highest: float = 1e6


def pulse_pixels(channels: DataFrame, freq: str, p: PulseTrain) -> DataFrame:
    """Pixels of the train and, if it has a width, of the interpulse (half a period later unless said otherwise), in the
    channels from the lowest to the highest frequency. Delays are those to the highest channel of all."""
    train = lambda t0, width: D.pulses(channels, freq, p.dm, p.period, t0, width, p.tbin, p.nsamp, within=(p.lowest, p.highest))
    out = train(p.t0, p.width)
    if p.inter_width:
        out = out.unionByName(train(p.t0 + p.period / 2 if p.inter_t0 is None else p.inter_t0, p.inter_width)).distinct()
    return out


def joined_mask(pixels: DataFrame, found: DataFrame | None, keys: list[str], name: str) -> DataFrame:
    """pixels with the mask ``name``: whether their keys are among those found."""
    if found is None:
        return pixels.withColumn(name, F.lit(False))
    return pixels.join(found.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left").withColumn(name, F.coalesce("_f", F.lit(False))).drop("_f")


def times_of(runs: DataFrame) -> DataFrame:
    return runs.select(*B, F.explode(F.sequence("first", "last")).alias("t"))


def full_flow(
    grid: DataFrame, nchan: int, nsamp: int, k_in: float = 3.0, k_out: float = 3.0, fallback: float = 2.0, detector: str = "sigma", substitute: bool = True, area: int = 5000, least: int = 1, seed: int = 1,
    pulse: DataFrame | None = None, with_blocks: bool = True, with_vertical: bool = True, periods: tuple[int, int, int, float] | None = None,
) -> DataFrame:
    """All masks and the prioritised label of each pixel: points, channels, times, repeated columns, blocks, kinds of channels.

    ``detector`` names one of DETECTORS. Times and repeated columns are looked for in the substituted values. ``pulse`` has
    the pixels (BC, t) of known pulses; ``periods`` (shortest, longest, pairs, share) turns on the periodic mask. m_global holds
    all masks but those two. final_med and final_rms are the median of all values of the block and the deviation about it.
    """
    own = D.clip(by_block(grid), k_in).withColumnRenamed("m", "m_point").withColumn("_v", F.col("v"))
    boxed = {"m_block": M.boxed_components(area=area, diamond=7)} if with_blocks else {}
    own = M.joined_points(own, "m_point", 1, **boxed)
    own = own if with_blocks else own.withColumn("m_block", F.lit(False))
    # Pixels carry their own value beside the substituted one, so masks of either need no join of pixels.
    work = M.kept(X.in_channel(own, "m_point", seed) if substitute else own, "points")
    # Detectors bring blocks together, and what follows up to the next table stays within them.
    c = Window.partitionBy(*BC)
    work = DETECTORS[detector](work, nchan, nsamp, k_out, fallback).select(*work.columns, "m_horiz")
    work = work.withColumns({"_any": F.bool_or("m_horiz").over(c), "_cancel": F.avg(F.col("m_point").cast("double")).over(c) > 0.3})
    work = work.withColumns({"_flag": F.col("_any") & ~F.col("_cancel"), "m_horiz": F.col("m_horiz") & ~F.col("_cancel")}).drop("_any", "_cancel")
    if substitute:
        work = X.across_channels(work, "_flag", "m_point", seed + 1)
    work = M.kept(work, "work")
    out = work.withColumn("v", F.col("_v")).drop("_v", "_flag")
    # Facts of times, channels and blocks meet the pixels by block, in one exchange.
    if with_vertical:
        hot = D.vertical(work.withColumn("_x", F.col("m_horiz") | F.col("m_point")), "_x", 4.0, least).filter("flag").select(*BT)
        times = hot.unionByName(times_of(D.repeated_columns(work, 1e-6, 0.02, 0.98, 16))).distinct()
        out = M.looked_up(out, times.withColumn("m_vert", F.lit(True)), "t").withColumn("m_vert", F.coalesce("m_vert", F.lit(False)))
    else:
        out = out.withColumn("m_vert", F.lit(False))
    if pulse is not None:
        out = M.looked_up(out, pulse.groupBy(*BC).agg(F.collect_set("t").alias("_hit")), "chan")
        out = out.withColumn("m_pulse", F.coalesce(F.array_contains("_hit", F.col("t")), F.lit(False))).drop("_hit")
    else:
        out = out.withColumn("m_pulse", F.lit(False))
    kinds = D.channel_kinds(work.groupBy(*BC).agg(F.avg("_v").alias("mean"), F.bool_or("_flag").alias("flag")))
    out = M.looked_up(out, kinds.select(*B, F.explode(F.sequence("first", "last")).alias("chan"), "kind"), "chan")
    out = out.withColumns({f"m_{k}": F.coalesce(F.col("kind") == k, F.lit(False)) for k in ("bright", "dark", "complex")}).drop("kind")
    final = stats.rms_about_median(work.select(*BC, "t", F.col("_v").alias("v")), B).select(*B, F.col("med").alias("final_med"), F.col("rms").alias("final_rms"))
    out = out.join(final.hint("shuffle_hash"), B, "left")
    out = D.periodic_points(out, "m_point", *periods) if periods else out.withColumn("m_periodic", F.lit(False))
    every = ["m_point", "m_horiz", "m_vert", "m_block", "m_bright", "m_dark", "m_complex"]
    return out.withColumns({"m_global": F.greatest(*every), "label": M.labels_by_priority(M.FULL_ORDER)})


def short_flow(grid: DataFrame, pulse: DataFrame, k_in: float = 6.0, k_out: float = 3.0, area: int = 5000, seed: int = 1) -> DataFrame:
    """The shorter flow: pulse pixels set aside first, averaged medians, robust stripes and repeats of the substituted values,
    cleaned points."""
    own = joined_mask(grid, pulse, [*BC, "t"], "m_pulse")
    own = D.clip(X.pulses_to_median(own, "m_pulse"), k_in, "avg").withColumnRenamed("m", "m_point").withColumn("_v", F.col("v"))
    work = M.kept(X.in_channel(M.blocks(own, "m_point", 7, 7, area), "m_point", seed), "points")
    ch = D.clip_channels(stats.channel_spread(work, "m_point"), k_out, kind="avg", floor_zero=False)
    ch = M.kept(ch.join(D.cancelled(work, "m_point"), BC).select(*BC, (F.col("flag") & ~F.col("cancel")).alias("m_horiz")), "channels")
    work = M.kept(work.join(ch, BC), "work")
    hot = D.vertical_robust(work, "m_point", flag="m_horiz").filter("flag").select(*BT)
    out = work.withColumn("v", F.col("_v")).drop("_v")
    out = joined_mask(out, hot.unionByName(times_of(D.repeated_columns(work, 1e-5, 0.01, 0.98, 2))), BT, "m_vert")
    out = M.cleaned_points(out, "m_point")
    return out.withColumn("label", M.labels_by_priority(M.SIMPLE_ORDER))


def weights(reach: int, n: int, sigma: float, taps: int) -> np.ndarray:
    """Gaussian weights [n places, ``reach`` cells] of the cells at the offsets -taps/2 .. taps - taps/2 - 1 from a place, else 0."""
    o = np.arange(reach)[None, :] - np.arange(n)[:, None]
    return np.where((o >= -(taps // 2)) & (o < taps - taps // 2), np.exp(-o * o / (2 * sigma * sigma)), 0.0)


def surface(chan: np.ndarray, t: np.ndarray, v: np.ndarray, counted: np.ndarray, nchan: int, nsamp: int, down: int = 3, height: int = 21, width: int = 31, sigma_c: float = 2.5, sigma_t: float = 5.0) -> np.ndarray:
    """The smooth surface at each pixel of one block: Gaussian sums of means over down x down cells, over sums of the weights of cells with a mean."""
    shape = [max(-(-n // down), at.max() // down + 1) for n, at in ((nchan, chan), (nsamp, t))]
    cell = chan // down * shape[1] + t // down
    some = counted & ~np.isnan(v)
    n = np.bincount(cell[some], minlength=shape[0] * shape[1])
    mean = np.bincount(cell[some], v[some], len(n)) / np.maximum(n, 1)
    here = np.bincount(cell[counted], minlength=len(n)) > 0
    c, w = (weights(reach, -(-size // down), sigma, taps) for reach, size, sigma, taps in ((shape[0], nchan, sigma_c, height), (shape[1], nsamp, sigma_t, width)))
    total, weight = (c @ x.reshape(shape) @ w.T for x in (mean, here.astype(float)))
    soft = np.zeros(shape)
    soft[: len(c), : len(w)] = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
    return soft.ravel()[cell]


def arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a block as arrays; missing values are NaN, missing flags unset."""
    columns = (table[c].combine_chunks() for c in names)
    return [(x.fill_null(False) if pa.types.is_boolean(x.type) else x).to_numpy(zero_copy_only=False) for x in columns]


def low_pass_residual(grid: DataFrame, nchan: int, nsamp: int, down: int = 3, height: int = 21, width: int = 31, sigma_c: float = 2.5, sigma_t: float = 5.0, mask: str | None = None) -> DataFrame:
    """Values less a surface: means of down x down cells over unmasked pixels, Gaussian weights along both axes, grown back.

    A normalised convolution: sums of weighted values and sums of weights, in which cells without unmasked pixels have none.
    Where no cell with a weight is in reach the surface is 0. A block is gathered once, and a sum along an axis is a product
    with the weights; no cell is sent to the places it reaches.
    """

    def run(table: pa.Table) -> pa.Table:
        chan, t, v = arrays(table, "chan", "t", "v")
        counted = ~arrays(table, mask)[0] & pc.is_valid(table[mask]).to_numpy() if mask else np.ones(len(v), bool)
        rest = pc.subtract(table["v"], pa.array(surface(chan, t, v, counted, nchan, nsamp, down, height, width, sigma_c, sigma_t)))
        return table.set_column(table.schema.get_field_index("v"), "v", rest)

    return grid.groupBy(*B).applyInArrow(run, grid.schema)


def strategy(grid: DataFrame, nchan: int, nsamp: int, first: float = 6.0, sizes: int = 4, rounds: int = 2, base: float = 1.0, step: float = 2.0, eta: float = 0.2, k_time: float = 3.5, k_chan: float = 1.5, k_last: float = 4.0) -> DataFrame:
    """Flags by rounds of falling thresholds, factor = step ** (rounds + 1 - round).

    A round: SumThreshold along both axes at ``first`` * base * factor times the noise of the block's unflagged pixels, times of
    outlying RMS (k_time) and channels (k_chan * factor) of the same values, then the original values less their low-pass
    surface, flagged pixels left out of it. After the rounds: SumThreshold at factor 1, rank dilation along both axes, times of
    outlying RMS (k_last) of the original values. One exchange gathers a block for all its rounds.
    """

    def rounds_of(table: pa.Table) -> pa.Table:
        chan, t, own = arrays(table, "chan", "t", "v")
        v, m = own, np.zeros(len(own), bool)

        def above_noise(level: float) -> np.ndarray:
            limit, counted = level * D.noise_of(v[~m]), ~m & ~np.isnan(v)
            return m | D.hits_along(chan, t, v, counted, limit, sizes) | D.hits_along(t, chan, v, counted, limit, sizes)

        for factor in (step ** (rounds + 1 - i) for i in range(1, rounds + 1)):
            m = above_noise(first * base * factor)
            counted = ~m & ~np.isnan(v)
            m = m | D.outlying(chan, v, counted, k_chan * factor) | D.outlying(t, v, counted, k_time)
            v = own - surface(chan, t, own, ~m, nchan, nsamp)
        return table.append_column("m", pa.array(above_noise(first * base)))

    own = grid.select(*BC, "t", "v")
    own = by_block(own.groupBy(*B).applyInArrow(rounds_of, StructType([*own.schema.fields, StructField("m", BooleanType())])))
    own = D.rank_dilated(own, BC, "t", "m", eta).withColumnRenamed("dilated", "_a")
    own = D.rank_dilated(own, BT, "chan", "m", eta).withColumn("m", F.col("m") | F.col("_a") | F.col("dilated"))
    own = M.kept(own.select(*BC, "t", "v", "m"), "dilated")
    tm = D.rms_outliers(own, "m", BT, k_last).select(*BT, F.col("flag").alias("_o"))
    return M.looked_up(own, tm, "t").select(*BC, "t", (F.col("m") | F.col("_o")).alias("m"))
