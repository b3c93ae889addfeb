"""Queries of the statistics."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, BT, rounded
from quiltra.operators import stats
from quiltra.sources import grids

from .base import query

def emb(spark, sf):
    return grids.embedding_grid(spark, sf)


def masked(spark, sf):
    return emb(spark, sf).withColumn("m", F.abs("v") > 0.25)


@query("a01_mean_std", "WITH {EMB} SELECT source, block, chan, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM g GROUP BY ALL")
def _(spark, sf):
    return stats.moments(emb(spark, sf), BC).select(*BC, *rounded("mean", "std"))


@query("a02_bounds", "WITH {EMB} SELECT source, block, chan, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM g GROUP BY ALL")
def _(spark, sf):
    return stats.bounds(emb(spark, sf), BC).select(*BC, *rounded("lo", "hi"))


@query("a03_a04_medians", "WITH {EMB} SELECT source, block, chan, round(quantile_disc(v, 0.5), 6) AS lower, round(quantile_cont(v, 0.5), 6) AS middle FROM g GROUP BY ALL")
def _(spark, sf):
    return stats.medians(emb(spark, sf), BC).select(*BC, *rounded("lower", "middle"))


@query("a05_a06_quantiles", "WITH {LINE} SELECT source, block, chan, round(quantile_cont(v, 0.25), 6) AS q0, round(quantile_cont(v, 0.75), 6) AS q1, round(quantile_cont(v, 0.9), 6) AS q2 FROM g WHERE NOT isnan(v) GROUP BY ALL")
def _(spark, sf):
    return stats.quantiles(grids.lineitem_grid(spark, sf), BC, 0.25, 0.75, 0.9).select(*BC, *rounded("q0", "q1", "q2"))


@query("a07_mad", "WITH {EMB}, m AS (SELECT source, block, chan, quantile_disc(v, 0.5) AS med FROM g GROUP BY ALL) SELECT source, block, chan, round(quantile_disc(abs(v - med), 0.5) * 1.4826, 6) AS mad FROM g JOIN m USING (source, block, chan) GROUP BY ALL")
def _(spark, sf):
    return stats.mad(emb(spark, sf), BC).select(*BC, *rounded("mad"))


@query("a08_rms_about_median", "WITH {EMB}, m AS (SELECT source, block, chan, quantile_disc(v, 0.5) AS med FROM g GROUP BY ALL) SELECT source, block, chan, round(any_value(med), 6) AS med, round(sqrt(avg((v - med) ** 2)), 6) AS rms FROM g JOIN m USING (source, block, chan) GROUP BY ALL")
def _(spark, sf):
    return stats.rms_about_median(emb(spark, sf), BC).select(*BC, *rounded("med", "rms"))


PROFILE = "round(coalesce(avg(v) FILTER (abs(v) <= 0.25), 0), 6) AS mean, round(CASE WHEN count(*) FILTER (abs(v) <= 0.25) > 1 THEN stddev_pop(v) FILTER (abs(v) <= 0.25) ELSE 0 END, 6) AS std"


@query("a09_a10_profiles", "WITH {EMB} SELECT source, block, chan, t, " + PROFILE + " FROM g GROUP BY GROUPING SETS ((source, block, chan), (source, block, t))")
def _(spark, sf):
    return stats.profiles(masked(spark, sf), "m").select(*BC, "t", *rounded("mean", "std"))


@query("a11_a12_channel_spread", "WITH {EMB} SELECT source, block, chan, round(CASE WHEN count(*) FILTER (abs(v) <= 0.25) <= 1 THEN avg(v) ELSE avg(v) FILTER (abs(v) <= 0.25) END, 6) AS mean, round(CASE WHEN count(*) FILTER (abs(v) <= 0.25) <= 1 THEN stddev_pop(v) ELSE stddev_pop(v) FILTER (abs(v) <= 0.25) END, 6) AS std FROM g GROUP BY ALL")
def _(spark, sf):
    return stats.channel_spread(masked(spark, sf), "m").select(*BC, *rounded("mean", "std"))


@query("a13_spread_report", """WITH {EMB}, s AS (SELECT source, block, chan, stddev_pop(v) AS v FROM g GROUP BY ALL), m AS (SELECT source, block, quantile_disc(v, 0.5) AS med FROM s GROUP BY ALL),
f AS (SELECT source, block, any_value(med) AS med, quantile_disc(abs(v - med), 0.5) AS far, min(v) AS lo, max(v) AS hi FROM s JOIN m USING (source, block) GROUP BY ALL)
SELECT source, block, round(med, 6) AS med, round(far, 6) AS far, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(k AS INTEGER) AS k, round(med + k * far, 6) AS line FROM f, range(-5, 6) AS r(k)""")
def _(spark, sf):
    return stats.spread_report(emb(spark, sf)).select(*B, "k", *rounded("med", "far", "lo", "hi", "line"))


HIST = "s AS (SELECT source, block, min(v) AS lo, max(v) AS hi, count(*) AS total FROM g GROUP BY ALL), b AS (SELECT source, block, lo, (hi - lo) / 40 AS width, total, CAST(least(39, floor((v - lo) / ((hi - lo) / 40))) AS INTEGER) AS bin FROM g JOIN s USING (source, block))"


@query("a14_histogram", "WITH {EMB}, " + HIST + " SELECT source, block, bin, count(*) AS n, round(any_value(lo + (bin + 0.5) * width), 6) AS centre, round(count(*) / any_value(total * width), 6) AS density FROM b GROUP BY source, block, bin")
def _(spark, sf):
    return stats.histogram(emb(spark, sf), 40).select(*B, "bin", "n", *rounded("centre", "density"))


@query("a15_fixed_histogram", "WITH {EVT} SELECT source, block, CAST(least(63, floor(v / 2.0)) AS INTEGER) AS bin, count(*) AS n FROM g WHERE v BETWEEN 0 AND 128 GROUP BY ALL")
def _(spark, sf):
    return stats.fixed_histogram(grids.event_grid(spark, sf), 0.0, 128.0, 64)


@query("a16_byte_histogram", "WITH {EVT} SELECT source, block, CAST(greatest(0, least(255, floor(v + 0.5))) AS INTEGER) AS level, count(*) AS n FROM g GROUP BY ALL")
def _(spark, sf):
    return stats.byte_histogram(grids.event_grid(spark, sf))


@query("a17_noise", "WITH {EMB}, " + HIST.replace("40", "50").replace("39", "49") + ", h AS (SELECT source, block, any_value(lo + (bin + 0.5) * width) AS c, count(*) AS n FROM b GROUP BY source, block, bin), m AS (SELECT source, block, sum(c * n) / sum(n) AS mu FROM h GROUP BY ALL) SELECT source, block, round(any_value(mu), 6) AS mu, round(sqrt(sum(n * (c - mu) ** 2) / sum(n)), 6) AS sigma FROM h JOIN m USING (source, block) GROUP BY source, block")
def _(spark, sf):
    return stats.noise(emb(spark, sf)).select(*B, *rounded("mu", "sigma"))


@query("a18_split_histogram", "WITH {EMB}, s AS (SELECT source, block, min(v) AS lo, max(v) AS hi FROM g GROUP BY ALL) SELECT source, block, CAST(least(29, floor((v - lo) / ((hi - lo) / 30))) AS INTEGER) AS bin, count(*) FILTER (abs(v) <= 0.25) AS kept, count(*) FILTER (abs(v) > 0.25) AS flagged FROM g JOIN s USING (source, block) GROUP BY ALL")
def _(spark, sf):
    return stats.split_histogram(masked(spark, sf), "m", 30)


LABEL = "CASE WHEN abs(v) > 0.25 THEN 6 WHEN chan % 16 = 3 THEN 1 WHEN t % 25 = 7 THEN 2 ELSE 0 END"


def labelled(spark, sf):
    return emb(spark, sf).withColumn("label", F.expr(LABEL))


@query("a19_class_shares", f"WITH {{EMB}}, l AS (SELECT source, block, {LABEL} AS label FROM g), c AS (SELECT source, block, label, count(*) AS n FROM l GROUP BY ALL) SELECT source, block, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY source, block), 6) AS share FROM c")
def _(spark, sf):
    return stats.class_shares(labelled(spark, sf)).select(*B, "label", "n", *rounded("share"))


@query("a20_flag_shares", "WITH {EMB} SELECT source, block, count(*) AS n, round(avg(CASE WHEN abs(v) > 0.25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM g GROUP BY ROLLUP (source, block)")
def _(spark, sf):
    return stats.flag_shares(masked(spark, sf), "m").select(*B, "n", *rounded("share"))


@query("a21_timing_summary", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL")
def _(spark, sf):
    return stats.timing_summary(grids.table(spark, sf, "events"), "event_type", "value").select("stage", "n", *rounded("total", digits=4), *rounded("mean", "median", "least", "most", "std"))


@query("a22_class_weights", f"""WITH {{EMB}}, c AS (SELECT {LABEL} AS label, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT label, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2, 6, 7, 8]) AS label) LEFT JOIN c USING (label)),
w AS (SELECT label, greatest(sqrt(CASE WHEN n > 0 THEN sum(n) OVER () / (n * 6) ELSE 0 END + 1e-12), 0.1) AS w FROM k),
m AS (SELECT label, least(w, 3.0 * (SELECT quantile_cont(w, 0.5) FROM w)) AS w FROM w),
r AS (SELECT label, least(w, 1000.0 * (SELECT min(w) FROM m)) AS w FROM m)
SELECT label, round(w / avg(w) OVER (), 6) AS weight FROM r""")
def _(spark, sf):
    return stats.class_weights(labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n")), [0, 1, 2, 6, 7, 8]).select("label", *rounded("weight"))


@query("a23_sample_weights", f"WITH {{EMB}}, l AS (SELECT block, t, {LABEL} AS label FROM g) SELECT block, t, CASE WHEN bool_or(label = 8) THEN 3.0 WHEN bool_or(label = 6) THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM l GROUP BY ALL")
def _(spark, sf):
    return stats.sample_weights(labelled(spark, sf), ["block", "t"])


@query("a24_display_range", "WITH {EMB} SELECT source, block, round(avg(v) - 3 * stddev_pop(v), 6) AS low, round(avg(v) + 3 * stddev_pop(v), 6) AS high FROM g GROUP BY ALL")
def _(spark, sf):
    return stats.display_range(emb(spark, sf), B, 3.0).select(*B, *rounded("low", "high"))


@query("a25_panel_limits", """WITH {EMB}, p AS (SELECT source, block, 'channel' AS axis, avg(v) AS mean, stddev_pop(v) AS std FROM g GROUP BY source, block, chan UNION ALL SELECT source, block, 'time', avg(v), stddev_pop(v) FROM g GROUP BY source, block, t),
u AS (SELECT source, block, axis, 'mean' AS what, mean AS x FROM p UNION ALL SELECT source, block, axis, 'std', std FROM p) SELECT source, block, axis, what, round(quantile_cont(x, 0.5), 6) AS med, round(quantile_cont(x, 0.5) - 2 * stddev_pop(x), 6) AS low, round(quantile_cont(x, 0.5) + 2 * stddev_pop(x), 6) AS high FROM u GROUP BY ALL""")
def _(spark, sf):
    return stats.panel_limits(emb(spark, sf), 2.0).select(*B, "axis", "what", *rounded("med", "low", "high"))


@query("a26_block_median_rms", "WITH {EMB}, m AS (SELECT source, block, quantile_disc(v, 0.5) AS med FROM g GROUP BY ALL) SELECT source, block, round(any_value(med), 6) AS med, round(sqrt(avg((v - med) ** 2)), 6) AS rms FROM g JOIN m USING (source, block) GROUP BY ALL")
def _(spark, sf):
    return stats.rms_about_median(emb(spark, sf), B).select(*B, *rounded("med", "rms"))


@query("a27_band_profile", "WITH {EMB} SELECT source, block, t, round(avg(v), 6) AS all_mean, round(coalesce(avg(v) FILTER (abs(v) <= 0.25), 0), 6) AS clean_mean, round(stddev_pop(v), 6) AS all_std FROM g WHERE chan BETWEEN 10 AND 30 GROUP BY ALL")
def _(spark, sf):
    return stats.band_profile(masked(spark, sf), "m", 10, 30).select(*BT, *rounded("all_mean", "clean_mean", "all_std"))
