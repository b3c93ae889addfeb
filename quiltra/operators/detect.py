"""Detectors of anomalous pixels, channels, times and patterns in grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quiltra.functions.exprs import B, BC, BT, along_t, lower_median, tukey
from quiltra.operators.morphology import kept as stored
from quiltra.operators.morphology import looked_up
from quiltra.operators.runs import in_runs
from quiltra.operators.stats import channel_spread, large_quantiles, noise
from quiltra.sources.grids import by_block


def _sorted(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, start, size) of lists: each sorted, without nulls, one after another."""
    size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    flat = values.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    series = np.repeat(np.arange(len(size)), size)[there]
    v = flat.to_numpy(zero_copy_only=False)[there].astype(float)
    size = np.bincount(series, minlength=len(size))
    return v[np.lexsort((v, series))], np.cumsum(size) - size, size


def clip_rounds(v: np.ndarray, start: np.ndarray, size: np.ndarray, k: float, rounds: int = 15, kind: str = "lower", floor_zero: bool = False, rate: float = 1e-4):
    """Rounds of iterative clipping of sorted series that lie one after another in v.

    Values are cut by size, so the kept ones are always a slice lo..hi of the series. A series leaves the rounds if less
    than 3 values are left, their deviation about the median vanishes, median and deviation have settled, or none is cut.
    Each round yields (lo, hi, series still there, their medians, their deviations), lo and hi of all series after its cut.
    """
    lo, hi = start.copy(), start + size - 1
    old_med, old_rms = np.zeros(len(size)), np.zeros(len(size))
    at = np.arange(len(size))
    for turn in range(rounds):
        at = at[hi[at] - lo[at] >= 2]
        if not len(at):
            return
        a, b = lo[at], hi[at]
        n = b - a + 1
        first = np.cumsum(n) - n
        kept = v[np.repeat(a - first, n) + np.arange(n.sum())]
        med = v[(a + b) // 2] if kind == "lower" else (v[(a + b) // 2] + v[(a + b + 1) // 2]) / 2
        rms = np.sqrt(np.add.reduceat((kept - np.repeat(med, n)) ** 2, first) / n)
        low, high = med - k * rms, med + k * rms
        low = np.maximum(low, 0.0) if floor_zero else low
        below = np.add.reduceat((kept < np.repeat(low, n)).astype(np.int64), first)
        above = np.add.reduceat((kept > np.repeat(high, n)).astype(np.int64), first)
        settled = (turn > 0) & (np.abs(med - old_med[at]) < 1e-6) & (np.abs(rms - old_rms[at]) / np.maximum(old_rms[at], 1e-12) < rate)
        stop = (rms <= 1e-12) | settled
        lo[at], hi[at] = np.where(stop, a, a + below), np.where(stop, b, b - above)
        old_med[at], old_rms[at] = med, rms
        yield lo, hi, at, med, rms
        at = at[~stop & (below + above > 0)]


def clip_limits(k: float, rounds: int, kind: str, floor_zero: bool, rate: float):
    """Column function: the smallest and largest value that clipping keeps of an array; none kept, an empty interval."""

    @F.arrow_udf("struct<least:double,most:double>")
    def limits(values: pa.Array) -> pa.Array:
        v, start, size = _sorted(values)
        lo, hi = start, start + size - 1
        for lo, hi, *_ in clip_rounds(v, start, size, k, rounds, kind, floor_zero, rate):
            pass
        some = hi >= lo
        least, most = np.full(len(size), np.inf), np.full(len(size), -np.inf)
        least[some], most[some] = v[lo[some]], v[hi[some]]
        return pa.StructArray.from_arrays([pa.array(least), pa.array(most)], ["least", "most"])

    return limits


def outside(rows: DataFrame, keys: list[str], value: str, out: str, k: float, rounds: int = 15, kind: str = "lower", floor_zero: bool = False, rate: float = 1e-4) -> DataFrame:
    """rows with ``out``: whether the value is outside what clipping keeps of its keys' values; null for a null value.

    One exchange: the rows of the keys are gathered, only their values are handed to the kernel, and the rows unfold again.
    """
    rest = [c for c in rows.columns if c not in keys]
    own = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    own = own.withColumn("_kept", clip_limits(k, rounds, kind, floor_zero, rate)(F.col(f"_rows.{value}")))
    own = own.select(*keys, "_kept", F.inline("_rows"))
    return own.withColumn(out, (F.col(value) < F.col("_kept.least")) | (F.col(value) > F.col("_kept.most"))).drop("_kept")


def clip(grid: DataFrame, k: float, kind: str = "lower") -> DataFrame:
    """Point flags: pixels outside what clipping keeps of their channel."""
    return outside(grid, BC, "v", "m", k, kind=kind)


def clip_trace(grid: DataFrame, k: float) -> DataFrame:
    """Median, deviation and number of values at each round of clipping."""

    @F.arrow_udf("array<struct<round:int,med:double,rms:double,kept:int>>")
    def trace(values: pa.Array) -> pa.Array:
        v, start, size = _sorted(values)
        states = [(at, np.full(len(at), i + 1), med, rms, hi[at] - lo[at] + 1) for i, (lo, hi, at, med, rms) in enumerate(clip_rounds(v, start, size, k))]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
        at, turn, med, rms, kept = (np.concatenate(x) for x in zip(none, *states))
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(size)))]).astype(np.int32)
        columns = [pa.array(turn[order].astype(np.int32)), pa.array(med[order]), pa.array(rms[order]), pa.array(kept[order].astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["round", "med", "rms", "kept"]))

    a = grid.groupBy(*BC).agg(F.collect_list("v").alias("_v"))
    return a.select(*BC, F.inline(trace("_v")))


def clip_channels(channels: DataFrame, k: float, value: str = "std", kind: str = "lower", floor_zero: bool = True) -> DataFrame:
    """Channel flags: channels whose deviation is outside what 30 rounds of clipping keep; the lower limit is at least 0.

    The shorter flows clip about the averaged median, without that limit.
    """
    return outside(channels, B, value, "flag", k, 30, kind, floor_zero, 0.01)


def mean_outliers(channels: DataFrame, k: float, among: str | None = None, centre: str = "median") -> DataFrame:
    """Channel flags: means outside centre +- k deviations of the block's channels (those not flagged in ``among``; three at least)."""
    own = channels.filter(~F.col(among)) if among else channels
    mid = lower_median("mean") if centre == "median" else F.avg("mean")
    s = own.groupBy(*B).agg(mid.alias("_mid"), F.stddev_pop("mean").alias("_dev"), F.count("mean").alias("_n"))
    out = channels.join(s, B, "left")
    far = F.coalesce((F.col("_n") >= 3) & (F.abs(F.col("mean") - F.col("_mid")) > k * F.col("_dev")), F.lit(False))
    return out.withColumn("flag", far & ~F.col(among) if among else far).drop("_mid", "_dev", "_n")


def tukey_channels(channels: DataFrame, q: float, always: bool = False) -> DataFrame:
    """Channel flags: deviations outside the quartiles by q times their distance; none where the quartiles are equal, unless ``always``."""
    s = channels.groupBy(*B).agg(F.percentile("std", 0.25).alias("_a"), F.percentile("std", 0.75).alias("_b"))
    return channels.join(s, B).withColumn("flag", ((F.col("_b") > F.col("_a")) | F.lit(always)) & tukey(F.col("_a"), F.col("_b"), F.col("std"), q)).drop("_a", "_b")


def lagged(rows: DataFrame, keys: list[str], at: str, value: str, k: int) -> Column:
    """value less the one k places before (after, if negative), the ends repeated."""
    w = Window.partitionBy(*keys).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lag(value, k).over(w), F.first(value).over(whole)) if k > 0 else F.coalesce(F.lead(value, -k).over(w), F.last(value).over(whole))
    return F.col(value) - other


def one_sided(rows: DataFrame, keys: list[str], value: str, thr: float) -> DataFrame:
    """Flags of values whose distance above the median exceeds thr normalised quartile ranges."""
    s = rows.groupBy(*keys).agg(*[F.percentile(value, p).alias(f"_q{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    return rows.join(s, keys).withColumn("flag", F.col(value) - F.col("_q1") > thr * F.greatest((F.col("_q2") - F.col("_q0")) / 1.349, F.lit(1e-12))).drop("_q0", "_q1", "_q2")


def lags_for(radius: int) -> list[int]:
    out, lag = [], 1
    while lag <= radius:
        out.append(lag)
        lag = max(lag + 1, int(1.5 * lag))
    return out


#: Cells of the series that IQRM looks at together.
CELLS = 1 << 20


def outvoted(series: np.ndarray, place: np.ndarray, value: np.ndarray, lags: list[int], size: int, thr: float) -> tuple[np.ndarray, np.ndarray]:
    """The (series, place) that IQRM flags in several series at once; lags of either sign.

    A value is compared with the one a lag before it, the places 0 and size - 1 repeated; where that place has no value there
    is no comparison.
    """
    base = min(place.min(), 0)
    width, n = max(place.max(), size - 1) - base + 1, series.max() + 1
    cells = np.full((n, width), np.nan)
    cells[series, place - base] = value
    votes = []
    for lag in lags:
        voter = np.clip(np.arange(width) + base - lag, 0, size - 1) - base
        d = cells - cells[:, voter]
        ordered = np.sort(d, axis=1)  # missing ones last
        last = np.maximum(np.count_nonzero(~np.isnan(d), axis=1) - 1, 0)

        def share(p: float) -> np.ndarray:
            low = (p * last).astype(np.int64)
            a, b = (np.take_along_axis(ordered, i[:, None], 1) for i in (low, np.minimum(low + 1, last)))
            return a + (p * last - low)[:, None] * (b - a)

        own, chosen = np.nonzero(d - share(0.5) > thr * np.maximum((share(0.75) - share(0.25)) / 1.349, 1e-12))
        votes.append((own * width + voter[chosen]) * width + chosen)
    votes = np.unique(np.concatenate(votes))
    voter, chosen = votes // width, votes // width // width * width + votes % width
    cast, got = np.bincount(voter, minlength=n * width), np.bincount(chosen, minlength=n * width)
    found = np.unique(chosen[cast[voter] < got[chosen]])
    return found // width, found % width + base


def iqrm(rows: DataFrame, keys: list[str], at: str, value: str, size: int, radius: int, thr: float = 3.0, ignore: list[int] = ()) -> DataFrame:
    """Flags by votes: an outlier at some lag gets a vote from the place it is compared with; a place is flagged if one of its
    voters cast fewer votes than the place received. Ignored places and missing values take no part; ignored ones are flagged.

    One exchange brings a series together, a channel of a block or the channels of one, whose length is that of a block. The
    lags, quartiles and votes of many series are array operations over Arrow columns, which give back the places found.
    """
    lags, left_out = [s * k for k in lags_for(radius) for s in (1, -1)], list(ignore)

    @F.arrow_udf("array<long>")
    def judged(places: pa.Array, values: pa.Array) -> pa.Array:
        count = pc.list_value_length(places).to_numpy(zero_copy_only=False)
        place, v = (x.flatten().cast(t) for x, t in ((places, pa.int64()), (values, pa.float64())))
        there = place.is_valid().to_numpy(zero_copy_only=False)
        place, v = place.fill_null(0).to_numpy(), v.to_numpy(zero_copy_only=False)
        kept = there & ~np.isnan(v) & ~np.isin(place, left_out)
        series, place, v = np.repeat(np.arange(len(count)), count)[kept], place[kept], v[kept]
        none = np.zeros(0, np.int64)
        found, step = [(none, none)], max(1, CELLS // max(size, 1))
        for k in range(0, len(count), step):
            a, b = np.searchsorted(series, (k, k + step))
            if a < b:
                own, hit = outvoted(series[a:b] - k, place[a:b], v[a:b], lags, size, thr)
                found.append((own + k, hit))
        own, hit = (np.concatenate(x) for x in zip(*found))
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(count)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(hit, pa.int64()))

    rest = [c for c in rows.columns if c not in keys]
    own = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    own = own.withColumn("_found", judged(F.col(f"_rows.{at}"), F.col(f"_rows.{value}"))).select(*keys, "_found", F.inline("_rows"))
    flag = F.array_contains("_found", F.col(at).cast("long"))
    return own.select(*rows.columns, (flag | F.col(at).isin(left_out) if left_out else flag).alias("flag"))


def iqrm_or_tukey(grid: DataFrame, nchan: int, nsamp: int) -> DataFrame:
    """Pixel flags: all of a channel whose deviation is flagged, else the pixels that IQRM flags along its time."""
    std = grid.groupBy(*BC).agg(F.stddev_pop("v").alias("std"))
    flags = tukey_channels(std, 1.5, always=True).withColumnRenamed("flag", "_t").join(iqrm(std, B, "chan", "std", nchan, max(1, nchan // 10)).select(*BC, F.col("flag").alias("_i")), BC).select(*BC, (F.col("_t") | F.col("_i")).alias("_c"))
    pixels = iqrm(by_block(grid), BC, "t", "v", nsamp, max(1, nsamp // 10))
    return looked_up(pixels, flags, "chan").withColumn("m", F.col("_c") | F.col("flag")).drop("_c", "flag")


def tukey_time(grid: DataFrame, q: float = 3.0, zapped: list[int] = ()) -> DataFrame:
    """Pixel flags by the quartiles of the channel; its rows are gathered with them, so nothing is joined."""
    rest = [c for c in grid.columns if c not in BC]
    own = grid.groupBy(*BC).agg(F.percentile("v", 0.25).alias("_a"), F.percentile("v", 0.75).alias("_b"), F.collect_list(F.struct(*rest)).alias("_rows"))
    return own.select(*BC, "_a", "_b", F.inline("_rows")).withColumn("m", tukey(F.col("_a"), F.col("_b"), F.col("v"), q) | F.col("chan").isin(list(zapped))).drop("_a", "_b")


def residual_tukey(grid: DataFrame, q: float = 3.0) -> DataFrame:
    """Flags and replacements of residuals about the channel's median: baseline plus the residuals' median over their number."""
    r = grid.join(grid.groupBy(*BC).agg(F.percentile("v", 0.5).alias("base")), BC).withColumn("r", F.col("v") - F.col("base"))
    s = r.groupBy(*BC).agg(F.percentile("r", 0.25).alias("_a"), F.percentile("r", 0.75).alias("_b"), F.percentile("r", 0.5).alias("_m"), F.count("*").alias("_n"))
    out = r.join(s, BC).withColumn("m", tukey(F.col("_a"), F.col("_b"), F.col("r"), q))
    return out.withColumn("v", F.when(F.col("m"), F.col("base") + F.col("_m") / F.col("_n")).otherwise(F.col("v"))).select(*BC, "t", "v", "m")


def profile_mask(cube: DataFrame, bins: int, q: float = 2.0, zapped: list[int] = ()) -> DataFrame:
    """Flags of (subint, chan): deviation, range or first Fourier amplitude outside the quartiles of all kept profiles."""
    angle = 2 * 3.141592653589793 * F.col("bin") / bins
    wave = F.sqrt(F.pow(F.sum(F.col("v") * F.cos(angle)), 2) + F.pow(F.sum(F.col("v") * F.sin(angle)), 2))
    spread = F.max("v") - F.min("v")
    f = cube.groupBy("subint", "chan").agg(F.stddev_pop("v").alias("std"), spread.alias("ptp"), wave.alias("lfamp"))
    f = stored(f, "profiles")
    kept = f.filter(~F.col("chan").isin(list(zapped))) if zapped else f
    names = ["std", "ptp", "lfamp"]
    # All profiles are one group of each feature.
    long = kept.unpivot(["subint", "chan"], names, "what", "x")
    quartiles = large_quantiles(long, ["what"], "x", [0.25, 0.75])
    s = quartiles.agg(*[F.max(F.when(F.col("what") == n, F.col(f"q{i}"))).alias(f"{n}{i}") for n in names for i in (0, 1)])
    flag = F.col("chan").isin(list(zapped)) if zapped else F.lit(False)
    for n in names:
        flag = flag | tukey(F.col(f"{n}0"), F.col(f"{n}1"), F.col(n), q)
    return f.crossJoin(F.broadcast(s)).select("subint", "chan", *names, flag.alias("flag"))


def phase_spikes(cube: DataFrame, q: float = 4.0, zapped: list[int] = ()) -> DataFrame:
    """Flags of (subint, bin): the channels' sum of profiles less their median, against the quartiles along subints."""
    kept = cube.filter(~F.col("chan").isin(list(zapped))) if zapped else cube
    base = kept.groupBy("subint", "chan").agg(F.percentile("v", 0.5).alias("base"))
    total = kept.join(base, ["subint", "chan"]).groupBy("subint", "bin").agg(F.sum(F.col("v") - F.col("base")).alias("total"))
    total = stored(total, "totals")
    s = large_quantiles(total, ["bin"], "total", [0.25, 0.5, 0.75]).withColumnsRenamed({"q0": "_a", "q1": "med", "q2": "_b"})
    return total.join(F.broadcast(s), "bin").select("subint", "bin", "total", "med", tukey(F.col("_a"), F.col("_b"), F.col("total"), q).alias("flag"))


def without_spikes(cube: DataFrame, flags: DataFrame, zapped: list[int] = ()) -> DataFrame:
    """Flagged places get the profile's median plus the place's median over the number of channels; zapped channels stay as they are and don't count."""
    valid = ~F.col("chan").isin(list(zapped)) if zapped else F.lit(True)
    n = cube.filter(valid).groupBy("subint", "bin").agg(F.count("*").alias("_n"))
    base = cube.groupBy("subint", "chan").agg(F.percentile("v", 0.5).alias("_base"))
    own = cube.join(base, ["subint", "chan"]).join(flags.join(n, ["subint", "bin"]).select("subint", "bin", "flag", "med", "_n"), ["subint", "bin"], "left")
    return own.select("subint", "chan", "bin", F.when(F.col("flag") & valid, F.col("_base") + F.col("med") / F.col("_n")).otherwise(F.col("v")).alias("v"))


def bad_bins(flags: DataFrame) -> DataFrame:
    return flags.filter("flag").groupBy("subint").agg(F.array_sort(F.collect_list("bin")).alias("bins"))


def window_hits(rows: DataFrame, keys: list[str], at: str, value: Column, mask: Column, first: Column, sizes: int) -> DataFrame:
    """SumThreshold: whether some full window of 1, 2, 4, ... places has a mean of |value| over unmasked ones above its limit.

    ``first`` is the limit of a single place: a constant, or a column of each row's group.
    """
    import math

    w = Window.partitionBy(*keys).orderBy(at)
    for m in range(1, sizes + 1):
        size, limit = 2 ** (m - 1), first / 1.5 ** math.log2(m)
        ahead = w.rowsBetween(0, size - 1)
        hit = (F.count("*").over(ahead) == size) & F.coalesce(F.avg(F.when(~mask, F.abs(value))).over(ahead) > limit, F.lit(False))
        rows = rows.withColumn(f"_h{m}", hit)
    for m in range(1, sizes + 1):
        back = w.rowsBetween(-(2 ** (m - 1) - 1), 0)
        rows = rows.withColumn(f"_g{m}", F.max(f"_h{m}").over(back))
    return rows.withColumn("_hit", F.greatest(*[F.col(f"_g{m}") for m in range(1, sizes + 1)]) if sizes > 1 else F.col("_g1")).drop(*[f"_{c}{m}" for c in "hg" for m in range(1, sizes + 1)])


def sum_threshold(rows: DataFrame, keys: list[str], at: str, first: float | Column, sizes: int, value: str = "v", mask: str | None = None) -> DataFrame:
    m = F.col(mask) if mask else F.lit(False)
    return window_hits(rows, keys, at, F.col(value), m, F.lit(first) if isinstance(first, (int, float)) else first, sizes).withColumnRenamed("_hit", "hit")


def hits_along(key: np.ndarray, at: np.ndarray, v: np.ndarray, counted: np.ndarray, first: float, sizes: int) -> np.ndarray:
    """The hits of ``window_hits`` in series given as arrays, one key each: windows slide over all series at once."""
    order = np.lexsort((at, key))
    key, n = key[order], counted[order].astype(np.int64)
    x = np.where(counted, np.abs(v), 0.0)[order]
    hit = np.zeros(len(key), bool)
    for m in range(1, sizes + 1):
        size, limit = 2 ** (m - 1), first / 1.5 ** np.log2(m)
        k = len(key) - size + 1
        if k < 1:
            break
        count = sum(n[i : i + k] for i in range(size))
        mean = sum(x[i : i + k] for i in range(size)) / np.maximum(count, 1)
        over = (key[:k] == key[size - 1 :]) & (count > 0) & ((mean > limit) | np.isnan(mean) & ~np.isnan(limit))
        for i in range(size):
            hit[i : i + k] |= over
    out = np.zeros(len(key), bool)
    out[order] = hit
    return out


def noise_of(v: np.ndarray, bins: int = 50) -> float:
    """The deviation of ``stats.noise`` for the values of one block, 0 without any; missing ones lie in the last bin."""
    known = v[~np.isnan(v)]
    if not len(known):
        return 0.0
    lo, width = known.min(), (known.max() - known.min()) / bins
    place = np.nan_to_num(np.floor((v - lo) / width), nan=bins - 1) if width > 0 else np.zeros(len(v))
    n, centre = np.bincount(np.minimum(bins - 1, place).astype(np.int64), minlength=bins), lo + (np.arange(bins) + 0.5) * width
    mu = (centre * n).sum() / n.sum()
    return float(np.sqrt((n * (centre - mu) ** 2).sum() / n.sum()))


def outlying(key: np.ndarray, v: np.ndarray, counted: np.ndarray, k: float) -> np.ndarray:
    """The flags of ``rms_outliers`` for the pixels of one block, each with that of its key."""
    place, own = np.unique(key, return_inverse=True)
    n = np.bincount(own, counted, len(place))
    rms = np.sqrt(np.bincount(own, np.where(counted, v * v, 0.0), len(place)) / np.maximum(n, 1))
    return (rms > rms.mean() + k * rms.std())[own]


def smoothed(pixels: DataFrame, mask: str, sigma: float = 7.5, taps: int = 40) -> DataFrame:
    """Gaussian mean along time of unmasked values, at offsets -taps/2 .. taps/2 - 1, as column ``smooth``; v where none is left.

    Each value is sent to the places that it has a weight in; a place sums them.
    """
    spread = F.transform(F.sequence(F.lit(-(taps // 2)), F.lit(taps - taps // 2 - 1)), lambda o: F.struct(o.alias("o"), F.exp(-o * o / (2 * sigma * sigma)).alias("w")))
    sent = pixels.filter(~F.col(mask)).select(*BC, "t", "v", F.explode(spread).alias("x")).select(*BC, (F.col("t") - F.col("x.o")).cast("int").alias("t"), "v", "x.w")
    s = sent.groupBy(*BC, "t").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("smooth"))
    return pixels.join(s, [*BC, "t"], "left").withColumn("smooth", F.coalesce("smooth", "v"))


def sum_threshold_2d(pixels: DataFrame, mask: str, k: float, sizes: int) -> DataFrame:
    """SumThreshold along both axes of the residual about a smooth surface, in units of the values' deviation in the block.

    The limit of a single pixel is k times the noise of the block's unmasked residual. Masked pixels take no part in the
    surface and the noise; windows hold all pixels.
    """
    dev = pixels.groupBy(*B).agg(F.stddev_pop("v").alias("_dev"))
    own = smoothed(pixels, mask).join(dev, B).withColumn("r", (F.col("v") - F.col("smooth")) / (F.col("_dev") + 1e-6)).drop("_dev", "smooth")
    level = noise(own.filter(~F.col(mask)).select(*BC, "t", F.col("r").alias("v"))).select(*B, (k * F.col("sigma")).alias("_first"))
    own = own.join(level, B, "left").withColumn("_first", F.coalesce("_first", F.lit(0.0)))
    own = sum_threshold(own, BC, "t", F.col("_first"), sizes, "r").withColumnRenamed("hit", "_along_t")
    return sum_threshold(own, BT, "chan", F.col("_first"), sizes, "r").withColumn("m", F.col("hit") | F.col("_along_t")).drop("hit", "_along_t", "r", "_first")


def vertical(pixels: DataFrame, excluded: str, k: float = 4.0, least: int = 3) -> DataFrame:
    """Flags of times whose mean over kept pixels stands k deviations above the block's, in runs of at least ``least``."""
    t = pixels.groupBy(*BT).agg(F.coalesce(F.avg(F.when(~F.col(excluded), F.col("v"))), F.lit(0.0)).alias("mean"))
    s = t.groupBy(*B).agg(F.avg("mean").alias("_m"), F.stddev_pop("mean").alias("_d"))
    hot = t.join(s, B).withColumn("_hot", F.col("mean") > F.col("_m") + k * F.col("_d")).drop("_m", "_d")
    return in_runs(hot, B, "t", "_hot", least, "flag").drop("_hot")


def vertical_robust(pixels: DataFrame, point: str, k: float = 4.0, ratio: float = 0.05, flag: str | None = None) -> DataFrame:
    """Flags of times whose median stands k scaled median distances above the positive medians' median, with enough points.

    Pixels of flagged channels take part neither in the medians nor in the share of points; a time without others has the
    median 0. Two positive medians are needed in a block.
    """
    good = ~F.col(flag) if flag else F.lit(True)
    t = pixels.groupBy(*BT).agg(F.coalesce(F.percentile(F.when(good, F.col("v")), 0.5), F.lit(0.0)).alias("med"), F.coalesce(F.avg(F.when(good, F.col(point).cast("double"))), F.lit(0.0)).alias("ratio"))
    up = t.filter("med > 0")
    mid = up.groupBy(*B).agg(F.percentile("med", 0.5).alias("_m"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    far = up.join(mid, B).groupBy(*B).agg(F.first("_m").alias("_m"), (F.percentile(F.abs(F.col("med") - F.col("_m")), 0.5) * 1.4826).alias("_d"))
    return t.join(far, B, "left").withColumn("flag", F.coalesce((F.col("med") > F.col("_m") + k * F.col("_d")) & (F.col("ratio") > ratio), F.lit(False))).drop("_m", "_d")


def anchored_runs(cells: np.ndarray, eps: float, rho: float, share: float, least: int) -> list[tuple[int, int]]:
    """The runs (first, last) of alike columns of one block as [channels, times], NaN where a cell is missing.

    Going up in time, a column like the one before it is an anchor: its run takes the columns on both sides up to the first
    that isn't like the anchor itself, and the next anchor is looked for after the run's end.
    """
    n = cells.shape[1]

    def alike(a: int, b: int) -> bool:
        d = np.abs(cells[:, a] - cells[:, b])
        both = ~np.isnan(d)
        if not both.any():
            return False
        size = (np.abs(cells[both, a]) + np.abs(cells[both, b])).mean() / 2
        return d[both].mean() <= min(eps, rho * size) and (d[both] <= eps).mean() >= share

    out, t = [], 1
    while t < n:
        if not alike(t, t - 1):
            t += 1
            continue
        first, last = t - 1, t
        while last + 1 < n and alike(last + 1, t):
            last += 1
        while first > 0 and alike(first - 1, t):
            first -= 1
        if last - first + 1 >= least:
            out.append((first, last))
        t = last + 1
    return out


def repeated_columns(grid: DataFrame, eps: float, rho: float, share: float, least: int) -> DataFrame:
    """Runs (first, last, n) of times that look like the run's anchor: mean difference at most min(eps, rho times the mean size),
    and at least ``share`` of the channels within eps; channels in which either time is missing don't count.

    Anchors are times like the one before them. Most blocks have none and end there; a block that has some is brought
    together for the walk from anchor to anchor, in as many comparisons as it has times, or three a time at most.
    """
    grid = by_block(grid.select(*BC, "t", "v"))
    own = grid.withColumns({"p": F.lag("v").over(along_t()), "_b": F.lag("t").over(along_t())}).filter(F.col("_b") == F.col("t") - 1)
    d = F.abs(F.col("v") - F.col("p"))
    s = own.groupBy(*BT).agg(F.avg(d).alias("d"), F.avg((F.abs("v") + F.abs("p")) / 2).alias("size"), F.avg((d <= eps).cast("double")).alias("near"))
    some = s.filter((F.col("d") <= F.least(F.lit(eps), rho * F.col("size")) + 1e-12) & (F.col("near") >= share - 1e-12)).select(*B).distinct()

    def walk(table: pa.Table) -> pa.Table:
        chan, t = table["chan"].to_numpy(), table["t"].to_numpy()
        cells = np.full((chan.max() - chan.min() + 1, t.max() - t.min() + 1), np.nan)
        cells[chan - chan.min(), t - t.min()] = table["v"].to_numpy()
        found = np.array(anchored_runs(cells, eps, rho, share, least), np.int64).reshape(-1, 2)
        first, last = found.T + int(t.min())
        keys = {c: pa.repeat(table[c][0], len(found)) for c in B}
        return pa.table({**keys, "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()), "n": pa.array(last - first + 1, pa.int64())})

    schema = StructType([*[grid.schema[c] for c in B], StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("n", LongType())])
    return grid.join(some, B, "left_semi").groupBy(*B).applyInArrow(walk, schema)


def packed_times(points: DataFrame, mask: str) -> DataFrame:
    """(BC, words): a channel's flagged times as bits of 64-bit words, from time 0 on; channels without flags have no row."""
    words = points.filter(F.col(mask)).groupBy(*BC, F.floor(F.col("t") / 64).cast("int").alias("_w"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, t % 64))").alias("_bits"))
    held = words.groupBy(*BC).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_m"))
    every = F.sequence(F.lit(0), F.array_max(F.map_keys("_m")))
    return held.select(*BC, F.transform(every, lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("long"))).alias("words"))


def _earlier(words: Column, by: Column) -> Column:
    """Bits moved ``by`` times down (up, if negative), within the words there are."""
    at = lambda k: F.coalesce(F.get(words, k), F.lit(0).cast("long"))
    q, r = F.floor(by / 64).cast("int"), F.pmod(by, F.lit(64)).cast("int")
    low = lambda k: F.call_function("shiftrightunsigned", at(k + q), r)
    high = lambda k: F.when(r > 0, F.call_function("shiftleft", at(k + q + 1), 64 - r)).otherwise(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda k: low(k).bitwiseOR(high(k)))


def _both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))


def periodic(points: DataFrame, mask: str, shortest: int, longest: int, pairs: int, share: float) -> DataFrame:
    """(BC, period, pairs, members): the best period of each channel's flagged points, most pairs a period apart, then the larger
    share, then the shorter period; ``members`` are the packed times of both points of its pairs.

    A channel is one row of packed times, and its pairs at a period are the ones of the words and the same words moved down.
    The shortest period is 2, and at least two pairs are asked for.
    """
    own = packed_times(points, mask).withColumn("_n", _ones(F.col("words"))).filter(F.col("_n") >= max(2, pairs))
    at = own.select("*", F.explode(F.sequence(F.lit(max(2, shortest)), F.lit(longest))).alias("period"))
    s = at.withColumn("_p", _both(F.col("words"), _earlier(F.col("words"), F.col("period")))).withColumn("pairs", _ones(F.col("_p")))
    good = s.filter((F.col("pairs") >= max(2, pairs)) & (F.col("pairs") >= share * F.col("_n")))
    # All periods of a channel share its number of points, so most pairs is also the largest share.
    best = good.groupBy(*BC).agg(F.max(F.struct("pairs", (-F.col("period")).alias("_less"), "_p")).alias("_b"))
    best = best.select(*BC, (-F.col("_b._less")).alias("period"), F.col("_b.pairs").alias("pairs"), F.col("_b._p").alias("_p"))
    members = F.zip_with("_p", _earlier(F.col("_p"), -F.col("period")), lambda x, y: x.bitwiseOR(y))
    return best.select(*BC, "period", "pairs", members.alias("members"))


def periodic_points(points: DataFrame, mask: str, shortest: int, longest: int, pairs: int, share: float) -> DataFrame:
    """points with ``m_periodic``: whether a pixel belongs to a pair at its channel's best period."""
    found = periodic(points, mask, shortest, longest, pairs, share).select(*BC, "members")
    word = F.coalesce(F.get("members", F.floor(F.col("t") / 64).cast("int")), F.lit(0).cast("long"))
    bit = F.call_function("shiftrightunsigned", word, (F.col("t") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return points.join(found, BC, "left").withColumn("m_periodic", bit == 1).drop("members")


DELAY = 4148.808


def pulses(channels: DataFrame, freq: str, dm: float, period: float, t0: float, width: int, tbin: float, nsamp: int, reference: str = "max", rounding: str = "floor", inclusive: bool = False, within: tuple[float, float] | None = None) -> DataFrame:
    """Pixels (chan, t) of a dispersed pulse train: arrivals are exploded to samples, so that pixels join by equality.

    ``within`` keeps channels of these frequencies; the reference frequency is that of all channels.
    """
    ref = (F.max(freq) if reference == "max" else F.min_by(freq, "chan")).over(Window.partitionBy(*B))
    d = channels.withColumn("_ref", ref).withColumn("_d", DELAY * dm * (F.pow(F.col(freq), -2) - F.pow("_ref", -2)))
    d = d.withColumn("_first", F.floor((-F.max("_d").over(Window.partitionBy(*B)) - t0) / period).cast("int"))
    d = d.filter(F.col(freq).between(*within)) if within else d
    k = F.sequence(F.col("_first"), (F.ceil(F.lit((nsamp * tbin - t0) / period)) + 1).cast("int"))
    at = (t0 + F.col("k") * period + F.col("_d")) / tbin
    mid = F.floor(at) if rounding == "floor" else F.round(at)
    own = d.select(*BC, "_d", F.explode(k).alias("k")).select(*BC, mid.cast("int").alias("_c"))
    first = F.col("_c") - width // 2
    last = first + width - (0 if inclusive else 1)
    cells = own.filter((first <= nsamp - 1) & (last >= 0)).select(*BC, F.explode(F.sequence(F.greatest(F.lit(0), first), F.least(F.lit(nsamp - 1), last))).alias("t"))
    return cells.distinct()


def cancelled(pixels: DataFrame, point: str, share: float = 0.3) -> DataFrame:
    """(chan, cancel): channels with so many flagged points that their channel flag is withdrawn."""
    return pixels.groupBy(*BC).agg((F.avg(F.col(point).cast("double")) > share).alias("cancel"))


def channel_kinds(channels: DataFrame) -> DataFrame:
    """Kind of each run of flagged channels against the mean of all channel means: bright, dark or complex.

    Runs of one or two channels go by their mean, longer ones are bright or dark if all their channels are; what is within
    1e-5 of the mean of all is neither.
    """
    mid = channels.groupBy(*B).agg(F.avg("mean").alias("_mid"))
    own = channels.join(mid, B).withColumn("_island", F.col("chan") - F.row_number().over(Window.partitionBy(*B, "flag").orderBy("chan"))).filter("flag")
    above, below = F.bool_and(F.col("mean") > F.col("_mid") + 1e-5), F.bool_and(F.col("mean") < F.col("_mid") - 1e-5)
    r = own.groupBy(*B, "_island").agg(
        F.min("chan").alias("first"), F.max("chan").alias("last"), F.count("*").alias("n"),
        F.avg("mean").alias("m"), F.first("_mid").alias("_mid"), above.alias("up"), below.alias("down"),
    )
    short = F.col("n") <= 2
    own_mean = F.when(F.col("m") > F.col("_mid") + 1e-5, "bright").when(F.col("m") < F.col("_mid") - 1e-5, "dark").otherwise("complex")
    kind = F.when(short, own_mean).when(F.col("up"), "bright").when(F.col("down"), "dark").otherwise("complex")
    return r.select(*B, "first", "last", "n", kind.alias("kind"))


def widened(channels: DataFrame, flag: str, by: int = 1) -> DataFrame:
    return channels.withColumn(flag, F.max(flag).over(Window.partitionBy(*B).orderBy("chan").rowsBetween(-by, by)))


def rms_outliers(pixels: DataFrame, mask: str, keys: list[str], k: float) -> DataFrame:
    """Flags of channels or times (by keys) whose RMS over unmasked pixels stands k deviations above the mean RMS."""
    r = pixels.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(F.when(~F.col(mask), F.col("v") * F.col("v")))), F.lit(0.0)).alias("rms"))
    s = r.groupBy(*B).agg(F.avg("rms").alias("_m"), F.stddev_pop("rms").alias("_d"))
    return r.join(s, B).withColumn("flag", F.col("rms") > F.col("_m") + k * F.col("_d")).drop("_m", "_d")


def rank_dilated(rows: DataFrame, keys: list[str], at: str, flag: str, eta: float = 0.2) -> DataFrame:
    """Flags x if some interval that holds x is flagged by a share of at least 1 - eta (scale-invariant rank operator)."""
    w = Window.partitionBy(*keys).orderBy(at)
    sums = rows.withColumn("_s", F.sum(F.col(flag).cast("double") - (1 - eta)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("_p", F.coalesce(F.lag("_s").over(w), F.lit(0.0)))
    low, high = F.min("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("_s").over(w.rowsBetween(0, Window.unboundedFollowing))
    return sums.withColumn("dilated", high - low >= -1e-9).drop("_s", "_p")


def simple_flow(grid: DataFrame, k_in: float = 6.0, k_out: float = 3.0) -> DataFrame:
    """Points by clipping with the averaged median; channels by clipped means or deviations, widened by one."""
    points = clip(grid, k_in, "avg")
    ch = channel_spread(points, "m")
    a = clip_channels(ch, k_out, "std", "avg", False).withColumnRenamed("flag", "_a")
    flags = clip_channels(a, k_out, "mean", "avg", False).withColumn("flag", F.col("_a") | F.col("flag")).select(*BC, "flag")
    return points.join(widened(flags, "flag"), BC).withColumnRenamed("flag", "m_horiz").withColumnRenamed("m", "m_point")
