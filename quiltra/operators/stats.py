"""Exact statistics of grids, along either axis and by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, BT, lower_median


def moments(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation."""
    return grid.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def bounds(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def medians(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median and averaged median."""
    return grid.groupBy(*keys).agg(lower_median("v").alias("lower"), F.percentile("v", 0.5).alias("middle"))


def quantiles(grid: DataFrame, keys: list[str], *shares: float) -> DataFrame:
    """Interpolated quantiles q0, q1, ... of the values that aren't NaN."""
    own = grid.filter(~F.isnan("v"))
    return own.groupBy(*keys).agg(*[F.percentile("v", s).alias(f"q{i}") for i, s in enumerate(shares)])


#: Bins of a round of ``large_quantiles``, and the values of an interval that one task may sort.
BINS, SORTED = 1024, 1 << 20


def large_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], sorted_rows: int = SORTED) -> DataFrame:
    """(keys, q0, q1, ...): interpolated quantiles, also of groups that no task can hold; nulls and NaN are left out.

    Each wanted rank lies in an interval of values, at first from the least to the largest. A round counts an interval's values
    in BINS bins and goes on with the bin that holds the rank, until an interval is one value or has few enough to be sorted.
    Each round reads the rows anew, so computed values are to be stored first: sums may differ in their last digit.
    """
    own = rows.select(*keys, F.lit(0).alias("_all"), F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    by = [*keys, "_all"]
    ends = own.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in shares]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    sizes = ends.select(*by, F.col("_n").alias("_all_n"))
    wanted = ends.withColumns({"_rank": F.explode(ranks), "_before": F.lit(0).cast("long")})

    def held(rows: DataFrame) -> DataFrame:
        from quiltra.operators.morphology import kept

        return kept(rows, "ranks")

    within = [*by, "_lo", "_hi", "_before", "_n"]
    open_, done = held(wanted), None
    while True:
        found = open_.filter("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v"))
        done = found if done is None else done.unionByName(found)
        open_ = open_.filter("_lo < _hi")
        if not open_.filter(F.col("_n") > sorted_rows).limit(1).count():
            break
        spans = open_.select(*within).distinct()
        inside = own.join(F.broadcast(spans), by).filter("_x between _lo and _hi")
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("_x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / BINS)))
        counts = inside.groupBy(*within, bin_.alias("_bin")).agg(F.count("*").alias("_k"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        # At most BINS rows for each interval.
        start = F.col("_before") + F.sum("_k").over(Window.partitionBy(*within).orderBy("_bin")) - F.col("_k")
        counts = counts.withColumn("_start", start)
        hit = open_.join(counts, within).filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_k")))
        open_ = held(hit.select(*by, F.col("_k").alias("_n"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_rank", F.col("_start").alias("_before")))
    inside = own.join(F.broadcast(open_.select(*within).distinct()), by).filter("_x between _lo and _hi")
    numbered = inside.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*within).orderBy("_x")) - 1)
    done = done.unionByName(numbered.join(open_.select(*within, "_rank"), [*within, "_rank"]).select(*by, "_rank", F.col("_x").alias("_v")))
    at = done.distinct().groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m")).join(sizes, by)

    def interpolated(p: float):
        x = F.lit(float(p)) * (F.col("_all_n") - 1)
        low, high = (F.element_at("_m", f(x).cast("long")) for f in (F.floor, F.ceil))
        return low + (x - F.floor(x)) * (high - low)

    return at.select(*keys, *[interpolated(p).alias(f"q{i}") for i, p in enumerate(shares)])


def with_medians(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(grid.groupBy(*keys).agg(lower_median("v").alias("med")), keys)


def mad(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median of distances from the lower median, scaled to a normal deviation."""
    far = with_medians(grid, keys).withColumn("far", F.abs(F.col("v") - F.col("med")))
    return far.groupBy(*keys).agg((lower_median("far") * 1.4826).alias("mad"))


def rms_about_median(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median, and the deviation about it out of the variance and the mean's distance from it: one pass, no join."""
    s = grid.groupBy(*keys).agg(lower_median("v").alias("med"), F.avg("v").alias("_m"), F.var_pop("v").alias("_d"))
    return s.select(*keys, "med", F.sqrt(F.col("_d") + F.pow(F.col("_m") - F.col("med"), 2)).alias("rms"))


def profiles(pixels: DataFrame, mask: str) -> DataFrame:
    """Means and deviations of unmasked values by channel and by time in one pass; 0 where too few are left."""
    good = F.when(~F.col(mask), F.col("v"))
    out = pixels.groupingSets([[*map(F.col, BC)], [*map(F.col, BT)]], *[F.col(c) for c in (*BC, "t")])
    return out.agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("mean"), F.when(F.count(good) > 1, F.stddev_pop(good)).otherwise(0.0).alias("std"))


def channel_spread(pixels: DataFrame, mask: str) -> DataFrame:
    """Mean and deviation of a channel's unmasked values, of all its values if one or none is left."""
    good = F.when(~F.col(mask), F.col("v"))
    few = F.count(good) <= 1
    return pixels.groupBy(*BC).agg(F.when(few, F.avg("v")).otherwise(F.avg(good)).alias("mean"), F.when(few, F.stddev_pop("v")).otherwise(F.stddev_pop(good)).alias("std"))


def spread_report(grid: DataFrame) -> DataFrame:
    """Distribution of the channels' deviations in each block: median, median distance, range and the lines at -5..5 of it."""
    std = grid.groupBy(*BC).agg(F.stddev_pop("v").alias("v"))
    far = with_medians(std, B).withColumn("far", F.abs(F.col("v") - F.col("med")))
    one = far.groupBy(*B).agg(F.first("med").alias("med"), lower_median("far").alias("far"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return one.select("*", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("k")).withColumn("line", F.col("med") + F.col("k") * F.col("far"))


def bin_of(v: Column, lo: Column, width: Column, bins: int) -> Column:
    """Number of the equal-width bin; the last edge is inside."""
    return F.when(width > 0, F.least(F.lit(bins - 1), F.floor((v - lo) / width))).otherwise(F.lit(0)).cast("int")


def histogram(grid: DataFrame, bins: int, keys: list[str] = B) -> DataFrame:
    """Counts, density and centre of the non-empty bins between a group's smallest and largest value."""
    s = grid.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    own = grid.join(s, keys).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    own = own.withColumn("bin", bin_of(F.col("v"), F.col("lo"), F.col("width"), bins))
    out = own.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("total").alias("total"))
    return out.select(*keys, "bin", "n", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("centre"), (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def fixed_histogram(grid: DataFrame, lo: float, hi: float, bins: int, keys: list[str] = B) -> DataFrame:
    """Counts in bins of a fixed range, both ends inside; values beyond it are left out."""
    own = grid.filter(F.col("v").between(lo, hi))
    return own.groupBy(*keys, bin_of(F.col("v"), F.lit(lo), F.lit((hi - lo) / bins), bins).alias("bin")).agg(F.count("*").alias("n"))


def byte_histogram(grid: DataFrame, keys: list[str] = B) -> DataFrame:
    """Counts of values rounded half up and clamped to 0..255."""
    return grid.groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v") + 0.5))).cast("int").alias("level")).agg(F.count("*").alias("n"))


def noise(grid: DataFrame, keys: list[str] = B, bins: int = 50) -> DataFrame:
    """Centre and deviation out of the weighted moments of a density histogram."""
    h = histogram(grid, bins, keys)
    one = h.groupBy(*keys).agg((F.sum(F.col("centre") * F.col("n")) / F.sum("n")).alias("mu"))
    return h.join(one, keys).groupBy(*keys).agg(F.first("mu").alias("mu"), F.sqrt(F.sum(F.col("n") * F.pow(F.col("centre") - F.col("mu"), 2)) / F.sum("n")).alias("sigma"))


def split_histogram(pixels: DataFrame, mask: str, bins: int) -> DataFrame:
    """Counts of kept and flagged values in shared bins."""
    s = pixels.groupBy(*B).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    own = pixels.join(s, B)
    b = bin_of(F.col("v"), F.col("lo"), (F.col("hi") - F.col("lo")) / bins, bins)
    return own.groupBy(*B, b.alias("bin")).agg(F.count_if(~F.col(mask)).alias("kept"), F.count_if(F.col(mask)).alias("flagged"))


def class_shares(labels: DataFrame) -> DataFrame:
    """Pixels and per cent of each class in a block."""
    n = labels.groupBy(*B, "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*B)))


def flag_shares(pixels: DataFrame, mask: str) -> DataFrame:
    """Flagged share of each block, of each source and of all."""
    return pixels.rollup(*B).agg(F.count("*").alias("n"), F.avg(F.col(mask).cast("double")).alias("share"))


def timing_summary(rows: DataFrame, stage: str, secs: str) -> DataFrame:
    """Number, total, mean, median, range and deviation by stage; a stage may have any number of rows."""
    own = rows.select(F.col(stage).alias("stage"), F.col(secs).alias("secs"))
    sums = own.groupBy("stage").agg(
        F.count("*").alias("n"), F.sum("secs").alias("total"), F.avg("secs").alias("mean"), F.min("secs").alias("least"), F.max("secs").alias("most"), F.stddev_pop("secs").alias("std"),
    )
    return sums.join(large_quantiles(own, ["stage"], "secs", [0.5]).withColumnRenamed("q0", "median"), "stage", "left")


def class_weights(counts: DataFrame, classes: list[int], smoothing: str = "sqrt", floor: float = 0.1, median_cap: float = 3.0, ratio_cap: float = 1000.0, power: float = 0.6) -> DataFrame:
    """(label, weight) of all classes from (label, n): inverse frequencies, smoothed, floored, capped and scaled to a mean of 1.

    A class without pixels gets the floor. The caps are median_cap times the median, and ratio_cap times the least weight.
    """
    every = Window.partitionBy(F.lit(0))  # one row for each class
    named = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("label"))
    own = named.join(counts.select(F.col("label").cast("int").alias("label"), "n"), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = F.when(F.col("n") > 0, F.sum("n").over(every) / (F.col("n") * len(classes))).otherwise(0.0)
    w = {"sqrt": F.sqrt(w + 1e-12), "log": F.log1p(w), "pow": F.pow(w + 1e-12, F.lit(power)), "none": w}[smoothing]
    out = own.withColumn("w", w).withColumn("w", F.greatest("w", F.lit(floor)))
    out = out.withColumn("_most", median_cap * F.percentile("w", 0.5).over(every)).withColumn("w", F.least("w", "_most"))
    out = out.withColumn("w", F.least("w", ratio_cap * F.min("w").over(every)))
    return out.select("label", (F.col("w") / F.avg("w").over(every)).alias("weight"))


def sample_weights(labels: DataFrame, keys: list[str], pulsar: float = 3.0, point: float = 2.0) -> DataFrame:
    """Weight of a sample by the rarest class it holds."""
    s = labels.groupBy(*keys).agg(F.bool_or(F.col("label") == 8).alias("p"), F.bool_or(F.col("label") == 6).alias("q"))
    return s.select(*keys, F.when(F.col("p"), pulsar).when(F.col("q"), point).otherwise(1.0).alias("weight"))


def display_range(grid: DataFrame, keys: list[str], k: float) -> DataFrame:
    m = moments(grid, keys)
    return m.select(*keys, (F.col("mean") - k * F.col("std")).alias("low"), (F.col("mean") + k * F.col("std")).alias("high"))


def panel_limits(pixels: DataFrame, k: float) -> DataFrame:
    """Median, and limits k deviations about it, of the four profiles of a block: mean and deviation along each axis."""
    by_c = pixels.groupBy(*BC).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).select(*B, F.lit("channel").alias("axis"), "mean", "std")
    by_t = pixels.groupBy(*BT).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).select(*B, F.lit("time").alias("axis"), "mean", "std")
    rows = by_c.unionByName(by_t).unpivot([*B, "axis"], ["mean", "std"], "what", "x")
    s = rows.groupBy(*B, "axis", "what").agg(F.percentile("x", 0.5).alias("med"), F.stddev_pop("x").alias("dev"))
    return s.select(*B, "axis", "what", "med", (F.col("med") - k * F.col("dev")).alias("low"), (F.col("med") + k * F.col("dev")).alias("high"))


def band_profile(pixels: DataFrame, mask: str, lo: int, hi: int) -> DataFrame:
    """Mean over time of a band of channels, with and without masked values."""
    own = pixels.filter(F.col("chan").between(lo, hi))
    return own.groupBy(*BT).agg(F.avg("v").alias("all_mean"), F.coalesce(F.avg(F.when(~F.col(mask), F.col("v"))), F.lit(0.0)).alias("clean_mean"), F.stddev_pop("v").alias("all_std"))
