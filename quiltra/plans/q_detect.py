"""Queries of the detectors."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, BT, rounded
from quiltra.operators import detect as D
from quiltra.operators import runs as W
from quiltra.sources import grids

from .base import query

C, T, S = "source, block, chan", "source, block, t", "source, block"
emb = grids.embedding_grid
line = grids.lineitem_grid


def points(spark, sf):
    return emb(spark, sf).withColumn("m", F.abs("v") > 0.25)


def clip_sql(name: str, rows: str, keys: str, k: float, rounds: int = 15, kind: str = "lower", floor: bool = False, rate: float = 1e-4) -> str:
    """Recursive tables that clip sorted lists: {name}(keys, a) holds the kept values."""
    med = "a[(len(a) - 1) // 2 + 1]" if kind == "lower" else "(a[(len(a) - 1) // 2 + 1] + a[len(a) // 2 + 1]) / 2"
    low = f"greatest(m - {k} * s, 0)" if floor else f"m - {k} * s"
    return f"""{name}_r AS (SELECT {keys}, 0 AS n, list_sort(list(v)) AS a, CAST(0 AS DOUBLE) AS med, CAST(0 AS DOUBLE) AS rms, false AS done FROM {rows} GROUP BY {keys}
UNION ALL SELECT {keys}, n + 1, CASE WHEN stop THEN a ELSE b END, m, s, stop OR len(b) = len(a) FROM (SELECT *, list_filter(a, lambda x: x >= {low} AND x <= m + {k} * s) AS b, s <= 1e-12 OR (n > 0 AND abs(m - med) < 1e-6 AND abs(s - rms) / greatest(rms, 1e-12) < {rate}) AS stop
FROM (SELECT *, sqrt(list_avg(list_transform(a, lambda x: (x - m) * (x - m)))) AS s FROM (SELECT *, {med} AS m FROM {name}_r WHERE NOT done AND n < {rounds} AND len(a) >= 3)))),
{name} AS (SELECT {keys}, arg_max(a, n) AS a FROM {name}_r GROUP BY {keys})"""


@query("grid_flag_fraction", "WITH RECURSIVE {EMB}, " + clip_sql("c", "g", "source, block, chan", 2.5) + " SELECT source, chan, count(*) AS n, round(avg(CASE WHEN v < a[1] OR v > a[len(a)] THEN 1.0 ELSE 0.0 END), 6) AS share FROM g JOIN c USING (source, block, chan) GROUP BY source, chan")
def _(spark, sf):
    return D.clip(emb(spark, sf), 2.5).groupBy("source", "chan").agg(F.count("*").alias("n"), F.round(F.avg(F.col("m").cast("double")), 6).alias("share"))


@query("d01_clip", "WITH RECURSIVE {EMB}, " + clip_sql("c", "g", "source, block, chan", 2.0) + " SELECT source, block, chan, t, v < a[1] OR v > a[len(a)] AS m FROM g JOIN c USING (source, block, chan)")
def _(spark, sf):
    return D.clip(emb(spark, sf), 2.0).select(*BC, "t", "m")


@query("d02_clip_averaged", "WITH RECURSIVE {LINE}, " + clip_sql("c", "g", "source, block, chan", 2.0, kind="avg") + " SELECT source, block, chan, t, v < a[1] OR v > a[len(a)] AS m FROM g JOIN c USING (source, block, chan)")
def _(spark, sf):
    return D.clip(line(spark, sf), 2.0, "avg").select(*BC, "t", "m")


SPREAD = "ch AS (SELECT source, block, chan, avg(v) AS mean, stddev_pop(v) AS std FROM g GROUP BY ALL)"


def spread(grid):
    return grid.groupBy(*BC).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


@query("d03_clip_channels", "WITH RECURSIVE {LINE}, " + SPREAD + ", x AS (SELECT source, block, chan, std AS v FROM ch), " + clip_sql("c", "x", "source, block", 1.5, 30, floor=True, rate=0.01) + " SELECT source, block, chan, std < a[1] OR std > a[len(a)] AS flag FROM ch JOIN c USING (source, block)")
def _(spark, sf):
    return D.clip_channels(spread(line(spark, sf)), 1.5).select(*BC, "flag")


FLAGGED = "f AS (SELECT source, block, chan, avg(v) AS mean, count(*) FILTER (abs(v) > 0.25) > 4 AS flag FROM g GROUP BY ALL), i AS (SELECT *, chan - row_number() OVER (PARTITION BY source, block, flag ORDER BY chan) AS island FROM f)"


def flagged_channels(spark, sf):
    return points(spark, sf).groupBy(*BC).agg(F.avg("v").alias("mean"), (F.count_if("m") > 4).alias("flag"))


@query("w01_d04_runs_not_isolated", "WITH {EMB}, " + FLAGGED + ", r AS (SELECT source, block, min(chan) AS first, max(chan) AS last, count(*) AS n FROM i WHERE flag GROUP BY source, block, island), l AS (SELECT *, first - lag(last) OVER w AS a, lead(first) OVER w - last AS b FROM r WINDOW w AS (PARTITION BY source, block ORDER BY first)) SELECT source, block, first, last, n FROM l WHERE n > 2 OR coalesce(a <= 2, false) OR coalesce(b <= 2, false)")
def _(spark, sf):
    return W.without_isolated(flagged_channels(spark, sf), B, "chan", "flag")


@query("d05_d06_mean_outliers", "WITH {EMB}, " + SPREAD + ", s AS (SELECT source, block, quantile_disc(mean, 0.5) FILTER (chan % 9 <> 4) AS mid, stddev_pop(mean) FILTER (chan % 9 <> 4) AS dev, avg(mean) AS m2, stddev_pop(mean) AS d2 FROM ch GROUP BY ALL) SELECT source, block, chan, chan % 9 <> 4 AND abs(mean - mid) > 1.2 * dev AS among, abs(mean - m2) > 1.5 * d2 AS fallback FROM ch JOIN s USING (source, block)")
def _(spark, sf):
    ch = spread(emb(spark, sf)).withColumn("old", F.col("chan") % 9 == 4)
    a = D.mean_outliers(ch, 1.2, "old").withColumnRenamed("flag", "among")
    return D.mean_outliers(a, 1.5, centre="mean").select(*BC, "among", F.col("flag").alias("fallback"))


@query("d07_tukey_channels", "WITH {EMB}, " + SPREAD + ", s AS (SELECT source, block, quantile_cont(std, 0.25) AS a, quantile_cont(std, 0.75) AS b FROM ch GROUP BY ALL) SELECT source, block, chan, b > a AND (std < a - 0.7 * (b - a) OR std > b + 0.7 * (b - a)) AS flag FROM ch JOIN s USING (source, block)")
def _(spark, sf):
    return D.tukey_channels(spread(emb(spark, sf)), 0.7).select(*BC, "flag")


@query("d08_d09_w05_lagged_one_sided", "WITH {LINE}, d AS (SELECT *, v - coalesce(lag(v, 2) OVER w, first_value(v) OVER w) AS back, v - coalesce(lead(v, 3) OVER w, last_value(v) OVER (PARTITION BY source, block, chan ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ahead FROM g WINDOW w AS (PARTITION BY source, block, chan ORDER BY t)), s AS (SELECT source, block, chan, quantile_cont(back, 0.25) AS a, quantile_cont(back, 0.5) AS m, quantile_cont(back, 0.75) AS b FROM d GROUP BY ALL) SELECT source, block, chan, t, round(back, 7) AS back, round(ahead, 7) AS ahead, back - m > 1.5 * greatest((b - a) / 1.349, 1e-12) AS flag FROM d JOIN s USING (source, block, chan)")
def _(spark, sf):
    g = line(spark, sf)
    g = g.withColumns({"back": D.lagged(g, BC, "t", "v", 2), "ahead": D.lagged(g, BC, "t", "v", -3)})
    return D.one_sided(g, BC, "back", 1.5).select(*BC, "t", *rounded("back", "ahead", digits=7), "flag")


def iqrm_sql(rows: str, keys: str, at: str, value: str, size: int, radius: int, thr: float, name: str) -> str:
    lags = ", ".join(str(s * k) for k in D.lags_for(radius) for s in (1, -1))
    return f"""{name}_x AS (SELECT {keys}, {at}, {value} AS v FROM {rows}), {name}_l AS (SELECT unnest([{lags}]) AS lag), {name}_d AS (SELECT {keys.replace('source', 'p.source').replace('block', 'p.block').replace('chan', 'p.chan') if 'chan' in keys else keys.replace('source', 'p.source').replace('block', 'p.block')}, p.{at}, lag, p.v - q.v AS d, greatest(0, least({size - 1}, p.{at} - lag)) AS voter FROM {name}_x p, {name}_l JOIN {name}_x q ON {' AND '.join(f'q.{k.strip()} = p.{k.strip()}' for k in keys.split(','))} AND q.{at} = greatest(0, least({size - 1}, p.{at} - lag))),
{name}_s AS (SELECT {keys}, lag, quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.75) AS b FROM {name}_d GROUP BY ALL), {name}_e AS (SELECT DISTINCT {keys}, voter, {at} FROM {name}_d JOIN {name}_s USING ({keys}, lag) WHERE d - m > {thr} * greatest((b - a) / 1.349, 1e-12)),
{name}_c AS (SELECT {keys}, voter, count(*) AS n FROM {name}_e GROUP BY ALL), {name}_g AS (SELECT {keys}, {at}, count(*) AS n FROM {name}_e GROUP BY ALL),
{name} AS (SELECT DISTINCT {keys}, {at} FROM {name}_e JOIN {name}_c c USING ({keys}, voter) JOIN {name}_g h USING ({keys}, {at}) WHERE c.n < h.n)"""


@query("d10_iqrm", "WITH {LINE}, " + iqrm_sql("g", "source, block, chan", "t", "v", 83, 8, 1.5, "q") + " SELECT source, block, chan, t, q.t IS NOT NULL AS flag FROM g LEFT JOIN q USING (source, block, chan, t)")
def _(spark, sf):
    return D.iqrm(line(spark, sf), BC, "t", "v", 83, 8, 1.5).select(*BC, "t", "flag")


@query("d11_iqrm_or_tukey", "WITH {EMB}, " + SPREAD + ", s AS (SELECT source, block, quantile_cont(std, 0.25) AS a, quantile_cont(std, 0.75) AS b FROM ch GROUP BY ALL), " + iqrm_sql("ch", "source, block", "chan", "std", 64, 6, 3.0, "k") + ", " + iqrm_sql("g", "source, block, chan", "t", "v", 100, 10, 3.0, "q") + " SELECT source, block, g.chan, g.t, std < a - 1.5 * (b - a) OR std > b + 1.5 * (b - a) OR k.chan IS NOT NULL OR q.t IS NOT NULL AS m FROM g JOIN ch USING (source, block, chan) JOIN s USING (source, block) LEFT JOIN k USING (source, block, chan) LEFT JOIN q USING (source, block, chan, t)")
def _(spark, sf):
    return D.iqrm_or_tukey(emb(spark, sf), 64, 100).select(*BC, "t", "m")


@query("d12_tukey_time", "WITH {LINE}, s AS (SELECT source, block, chan, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM g GROUP BY ALL) SELECT source, block, chan, t, v < a - 1 * (b - a) OR v > b + 1 * (b - a) OR chan IN (4, 9) AS m FROM g JOIN s USING (source, block, chan)")
def _(spark, sf):
    return D.tukey_time(line(spark, sf), 1.0, [4, 9]).select(*BC, "t", "m")


@query("d13_residual_tukey", "WITH {LINE}, m AS (SELECT source, block, chan, quantile_cont(v, 0.5) AS base FROM g GROUP BY ALL), r AS (SELECT g.*, base, v - base AS r FROM g JOIN m USING (source, block, chan)), s AS (SELECT source, block, chan, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.75) AS b, quantile_cont(r, 0.5) AS q, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT *, r < a - 1 * (b - a) OR r > b + 1 * (b - a) AS m FROM r JOIN s USING (source, block, chan)) SELECT source, block, chan, t, m, round(CASE WHEN m THEN base + q / n ELSE v END, 7) AS v FROM x")
def _(spark, sf):
    return D.residual_tukey(line(spark, sf), 1.0).select(*BC, "t", "m", *rounded("v", digits=7))


def cube(spark, sf):
    li = grids.table(spark, sf, "lineitem")
    return li.groupBy(F.year("l_shipdate").cast("int").alias("subint"), (F.col("l_suppkey") % 32).cast("int").alias("chan"), (F.month("l_shipdate") - 1).cast("int").alias("bin")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 100).alias("v"))


CUBE = "cube AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS subint, CAST(l_suppkey % 32 AS INTEGER) AS chan, CAST(month(l_shipdate) - 1 AS INTEGER) AS bin, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS v FROM lineitem GROUP BY ALL)"


@query("d14_profile_mask", "WITH " + CUBE + ", f AS (SELECT subint, chan, stddev_pop(v) AS std, max(v) - min(v) AS ptp, sqrt(sum(v * cos(2 * pi() * bin / 12)) ** 2 + sum(v * sin(2 * pi() * bin / 12)) ** 2) AS lfamp FROM cube GROUP BY ALL), s AS (SELECT quantile_cont(std, 0.25) AS a, quantile_cont(std, 0.75) AS b, quantile_cont(ptp, 0.25) AS c, quantile_cont(ptp, 0.75) AS d, quantile_cont(lfamp, 0.25) AS e, quantile_cont(lfamp, 0.75) AS h FROM f WHERE chan <> 5) SELECT subint, chan, chan = 5 OR std < a - 2 * (b - a) OR std > b + 2 * (b - a) OR ptp < c - 2 * (d - c) OR ptp > d + 2 * (d - c) OR lfamp < e - 2 * (h - e) OR lfamp > h + 2 * (h - e) AS flag FROM f, s")
def _(spark, sf):
    return D.profile_mask(cube(spark, sf), 12, 2.0, [5]).select("subint", "chan", "flag")


SPIKE = CUBE + ", b AS (SELECT subint, chan, quantile_cont(v, 0.5) AS base FROM cube GROUP BY ALL), tot AS (SELECT subint, bin, sum(v - base) AS total, count(*) AS n FROM cube JOIN b USING (subint, chan) GROUP BY ALL), s AS (SELECT bin, quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.5) AS med, quantile_cont(total, 0.75) AS c FROM tot GROUP BY ALL), fl AS (SELECT subint, bin, total, med, n, total < a - 0.5 * (c - a) OR total > c + 0.5 * (c - a) AS flag FROM tot JOIN s USING (bin))"


@query("d15_phase_spikes", "WITH " + SPIKE + " SELECT subint, bin, round(total, 2) AS total, flag FROM fl")
def _(spark, sf):
    return D.phase_spikes(cube(spark, sf), 0.5).select("subint", "bin", F.round("total", 2).alias("total"), "flag")


@query("d16_without_spikes", "WITH " + SPIKE.replace("total, count(*) AS n FROM cube JOIN b USING (subint, chan) GROUP", "total, count(*) AS n FROM cube JOIN b USING (subint, chan) WHERE chan NOT IN (4, 9) GROUP")
       + " SELECT subint, chan, bin, round(CASE WHEN flag AND chan NOT IN (4, 9) THEN base + med / n ELSE v END, 8) AS v FROM cube JOIN b USING (subint, chan) LEFT JOIN fl USING (subint, bin)")
def _(spark, sf):
    c = cube(spark, sf)
    return D.without_spikes(c, D.phase_spikes(c, 0.5, [4, 9]), [4, 9]).select("subint", "chan", "bin", F.round("v", 8).alias("v"))


@query("d17_bad_bins", "WITH " + SPIKE + " SELECT subint, array_to_string(list_sort(list(bin)), ',') AS bins FROM fl WHERE flag GROUP BY subint")
def _(spark, sf):
    return D.bad_bins(D.phase_spikes(cube(spark, sf), 0.5)).select("subint", F.array_join("bins", ",").alias("bins"))


def threshold_sql(rows: str, keys: str, at: str, value: str, mask: str, first: float | str, sizes: int, name: str) -> str:
    """{name}: rows with ``hit``; ``first`` is the limit of one place, a number or a column's expression."""
    import math

    limit = lambda m: f"({first}) / {1.5 ** math.log2(m)!r}" if isinstance(first, str) else repr(first / 1.5 ** math.log2(m))

    hits = ", ".join(f"count(*) OVER (PARTITION BY {keys} ORDER BY {at} ROWS BETWEEN CURRENT ROW AND {2 ** (m - 1) - 1} FOLLOWING) = {2 ** (m - 1)} AND coalesce(avg(CASE WHEN NOT ({mask}) THEN abs({value}) END) OVER (PARTITION BY {keys} ORDER BY {at} ROWS BETWEEN CURRENT ROW AND {2 ** (m - 1) - 1} FOLLOWING) > {limit(m)}, false) AS h{m}" for m in range(1, sizes + 1))
    back = " OR ".join(f"bool_or(h{m}) OVER (PARTITION BY {keys} ORDER BY {at} ROWS BETWEEN {2 ** (m - 1) - 1} PRECEDING AND CURRENT ROW)" for m in range(1, sizes + 1))
    return f"{name}_h AS (SELECT *, {hits} FROM {rows}), {name} AS (SELECT *, {back} AS hit FROM {name}_h)"


@query("d18_w02_sum_threshold", "WITH {EMB}, " + threshold_sql("g", "source, block, chan", "t", "v", "abs(v) > 0.45", 0.3, 4, "x") + " SELECT source, block, chan, t, hit FROM x")
def _(spark, sf):
    g = grids.by_block(emb(spark, sf)).withColumn("m", F.abs("v") > 0.45)
    return D.sum_threshold(g, BC, "t", 0.3, 4, mask="m").select(*BC, "t", "hit")


def smooth_sql(rows: str, mask: str) -> str:
    """Tables ws (residual about the masked Gaussian mean along time) and wr (in units of the values' deviation in the block)."""
    return f"""
wk AS (
  SELECT {C}, CAST(t - o AS INTEGER) AS t, sum(v * exp(-o * o / 112.5)) / sum(exp(-o * o / 112.5)) AS s
  FROM {rows}, range(-20, 20) x(o) WHERE NOT ({mask}) GROUP BY {C}, t - o),
ws AS (SELECT a.*, a.v - coalesce(s, a.v) AS r0 FROM {rows} a LEFT JOIN wk b USING ({C}, t)),
wr AS (SELECT *, r0 / (stddev_pop(v) OVER (PARTITION BY {S}) + 1e-6) AS r FROM ws)"""


def noise_sql(rows: str, value: str, where: str, name: str) -> str:
    """{name}(source, block, sigma): deviation out of the weighted moments of a histogram of 50 bins."""
    return f"""
{name}_b AS (SELECT {S}, min({value}) AS lo, (max({value}) - min({value})) / 50 AS w FROM {rows} WHERE {where} GROUP BY ALL),
{name}_i AS (
  SELECT {S}, lo, w, CASE WHEN w > 0 THEN least(49, floor(({value} - lo) / w)) ELSE 0 END AS bin, count(*) AS n
  FROM {rows} JOIN {name}_b USING ({S}) WHERE {where} GROUP BY ALL),
{name}_h AS (SELECT {S}, lo + (bin + 0.5) * w AS x, n FROM {name}_i),
{name}_m AS (SELECT {S}, sum(x * n) / sum(n) AS mu FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {S}, sqrt(sum(n * (x - mu) ** 2) / sum(n)) AS sigma FROM {name}_h JOIN {name}_m USING ({S}) GROUP BY ALL)"""


#: Blocks of unlike noise: the values of odd ones are cubed.
UNLIKE = f"u AS (SELECT {C}, t, CASE WHEN block % 2 = 1 THEN v * v * v ELSE v END AS v FROM g)"


@query("d19_w04_sum_threshold_2d", f"""WITH {{EMB}}, {UNLIKE}, {smooth_sql("u", "abs(v) > 0.3")}, {noise_sql("wr", "r", "NOT (abs(v) > 0.3)", "wn")},
wj AS (SELECT * FROM wr JOIN wn USING ({S})), {threshold_sql("wj", C, "t", "r", "false", "2.0 * sigma", 4, "wx")},
wy AS (SELECT {C}, t, r, sigma, hit AS along FROM wx), {threshold_sql("wy", T, "chan", "r", "false", "2.0 * sigma", 4, "wz")}
SELECT {C}, t, hit OR along AS m FROM wz""")
def _(spark, sf):
    g = emb(spark, sf).withColumn("v", F.when(F.col("block") % 2 == 1, F.col("v") * F.col("v") * F.col("v")).otherwise(F.col("v")))
    return D.sum_threshold_2d(g.withColumn("m0", F.abs("v") > 0.3), "m0", 2.0, 4).select(*BC, "t", "m")


@query("d20_dual_threshold", "WITH {EMB}, " + SPREAD + ", " + threshold_sql("ch", "source, block", "chan", "mean", "false", 0.02, 3, "a") + ", " + threshold_sql("ch", "source, block", "chan", "std", "false", 0.13, 3, "b") + " SELECT source, block, a.chan, a.hit OR b.hit AS flag FROM a JOIN b USING (source, block, chan)")
def _(spark, sf):
    ch = spread(emb(spark, sf))
    a = D.sum_threshold(ch, B, "chan", 0.02, 3, "mean").withColumnRenamed("hit", "_a")
    return D.sum_threshold(a, B, "chan", 0.13, 3, "std").select(*BC, (F.col("_a") | F.col("hit")).alias("flag"))


@query("d21_vertical", "WITH {EMB}, tm AS (SELECT source, block, t, coalesce(avg(v) FILTER (abs(v) <= 0.25), 0) AS mean FROM g GROUP BY ALL), h AS (SELECT *, mean > avg(mean) OVER (PARTITION BY source, block) + 0.8 * stddev_pop(mean) OVER (PARTITION BY source, block) AS hot FROM tm), i AS (SELECT *, t - row_number() OVER (PARTITION BY source, block, hot ORDER BY t) AS island FROM h) SELECT source, block, t, hot AND count(*) OVER (PARTITION BY source, block, hot, island) >= 2 AS flag FROM i")
def _(spark, sf):
    return D.vertical(points(spark, sf), "m", 0.8, 2).select(*BT, "flag")


@query("d22_vertical_robust", f"""WITH {{EMB}},
tm AS (
  SELECT {T}, quantile_cont(v, 0.5) FILTER (chan % 5 <> 2) AS med, avg(CASE WHEN abs(v) > 0.25 THEN 1.0 ELSE 0.0 END) FILTER (chan % 5 <> 2) AS ratio
  FROM g GROUP BY ALL),
m AS (SELECT {S}, quantile_cont(med, 0.5) AS mid FROM tm WHERE med > 0 GROUP BY ALL HAVING count(*) > 1),
f AS (SELECT {S}, any_value(mid) AS mid, quantile_cont(abs(med - mid), 0.5) * 1.4826 AS dev FROM tm JOIN m USING ({S}) WHERE med > 0 GROUP BY ALL)
SELECT {T}, coalesce(med > mid + 1 * dev AND ratio > 0.02, false) AS flag FROM tm LEFT JOIN f USING ({S})""")
def _(spark, sf):
    own = points(spark, sf).withColumn("bad", F.col("chan") % 5 == 2)
    return D.vertical_robust(own, "m", 1.0, 0.02, "bad").select(*BT, "flag")


def repeated(rows: str, eps: float, rho: float, share: float, least: int) -> str:
    """rr: the runs of alike times of ``rows``. ra has each anchor's run, rw walks from an anchor to the first behind its run."""
    return f"""
rq AS (
  SELECT a.source, a.block, a.t AS a, b.t AS b, avg(abs(a.v - b.v)) AS d, avg((abs(a.v) + abs(b.v)) / 2) AS size,
    avg(CASE WHEN abs(a.v - b.v) <= {eps!r} THEN 1.0 ELSE 0.0 END) AS near
  FROM {rows} a JOIN {rows} b ON a.source = b.source AND a.block = b.block AND a.chan = b.chan AND a.t <> b.t GROUP BY ALL),
rl AS (SELECT {S}, a, b FROM rq WHERE d <= least({eps!r}, {rho!r} * size) AND near >= {share!r}),
rt AS (SELECT DISTINCT {T} FROM {rows}),
ra AS (
  SELECT l.source, l.block, l.a, coalesce(max(CASE WHEN rt.t < l.a AND o.b IS NULL THEN rt.t END), min(rt.t) - 1) + 1 AS first,
    coalesce(min(CASE WHEN rt.t > l.a AND o.b IS NULL THEN rt.t END), max(rt.t) + 1) - 1 AS last
  FROM rl l JOIN rt ON rt.source = l.source AND rt.block = l.block
  LEFT JOIN rl o ON o.source = l.source AND o.block = l.block AND o.a = l.a AND o.b = rt.t WHERE l.b = l.a - 1 AND rt.t <> l.a GROUP BY ALL),
rn AS (
  SELECT r.source, r.block, r.a, r.first, r.last, min(n.a) AS next
  FROM ra r LEFT JOIN ra n ON n.source = r.source AND n.block = r.block AND n.a > r.last GROUP BY ALL),
rw AS (
  SELECT {S}, min(a) AS at FROM ra GROUP BY ALL
  UNION ALL SELECT w.source, w.block, n.next FROM rw w JOIN rn n ON n.source = w.source AND n.block = w.block AND n.a = w.at WHERE n.next IS NOT NULL),
rr AS (
  SELECT n.source, n.block, n.first, n.last FROM rw w JOIN rn n ON n.source = w.source AND n.block = w.block AND n.a = w.at
  WHERE n.last - n.first + 1 >= {least})"""


#: A grid whose first 40 times drift, with a stretch of equal times.
DRIFT = f"""
dg AS (
  SELECT {C}, t, CASE WHEN t < 40 THEN f + 0.009 * t WHEN t BETWEEN 50 AND 70 THEN f ELSE v END AS v
  FROM g JOIN (SELECT {C}, v AS f FROM g WHERE t = 0) USING ({C}))"""


def drifting(spark, sf):
    g = emb(spark, sf)
    own = g.join(g.filter("t = 0").select(*BC, F.col("v").alias("f")), BC)
    return own.withColumn("v", F.when(F.col("t") < 40, F.col("f") + 0.009 * F.col("t")).when(F.col("t").between(50, 70), F.col("f")).otherwise(F.col("v"))).drop("f")


@query("d23_repeated_columns", f"WITH RECURSIVE {{EMB}}, {DRIFT}, {repeated('dg', 0.02, 5.0, 0.98, 4)} SELECT {S}, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(last - first + 1 AS BIGINT) AS n FROM rr")
def _(spark, sf):
    return D.repeated_columns(drifting(spark, sf), 0.02, 5.0, 0.98, 4)


PERIODS = f"""
p AS (SELECT {C}, t FROM g WHERE abs(v) > 0.15), n AS (SELECT {C}, count(*) AS n FROM p GROUP BY ALL),
m AS (
  SELECT a.source, a.block, a.chan, b.t - a.t AS period, count(*) AS pairs
  FROM p a JOIN p b ON a.source = b.source AND a.block = b.block AND a.chan = b.chan AND b.t - a.t BETWEEN 3 AND 20 GROUP BY ALL),
k AS (
  SELECT *, row_number() OVER (PARTITION BY {C} ORDER BY pairs DESC, pairs / n DESC, period) AS k
  FROM m JOIN n USING ({C}) WHERE pairs >= 4 AND pairs >= 0.2 * n)"""


@query("d25_j10_w09_periodic", f"WITH {{EMB}}, {PERIODS} SELECT {C}, period, pairs FROM k WHERE k = 1")
def _(spark, sf):
    return D.periodic(emb(spark, sf).withColumn("m", F.abs("v") > 0.15), "m", 3, 20, 4, 0.2).select(*BC, "period", "pairs")


@query("d25_periodic_points", f"""WITH {{EMB}}, {PERIODS},
q AS (SELECT {C}, t, t + period AS ahead, t - period AS back FROM p JOIN k USING ({C}) WHERE k = 1),
b AS (SELECT q.* FROM q SEMI JOIN p ON p.source = q.source AND p.block = q.block AND p.chan = q.chan AND (p.t = q.ahead OR p.t = q.back))
SELECT g.source, g.block, g.chan, g.t, b.t IS NOT NULL AS m_periodic FROM g LEFT JOIN b USING ({C}, t)""")
def _(spark, sf):
    return D.periodic_points(emb(spark, sf).withColumn("m", F.abs("v") > 0.15), "m", 3, 20, 4, 0.2).select(*BC, "t", "m_periodic")


PULSE = "f AS (SELECT DISTINCT source, block, chan, 1000.0 + chan * 5 AS freq FROM g), d AS (SELECT *, 4148.808 * {dm} * (freq ** -2 - (max(freq) OVER (PARTITION BY source, block)) ** -2) AS d FROM f), k AS (SELECT *, max(d) OVER (PARTITION BY source, block) AS md FROM d), a AS (SELECT source, block, chan, CAST(floor(({t0} + k * {p} + d) / 0.01) AS INTEGER) AS c FROM k, range(-20, 40) r(k) WHERE k BETWEEN floor((-md - {t0}) / {p}) AND ceil((100 * 0.01 - {t0}) / {p}) + 1), px AS (SELECT DISTINCT source, block, chan, CAST(c - {h} + i AS INTEGER) AS t FROM a, range(0, {w}) r(i) WHERE c - {h} + i BETWEEN 0 AND 99)"


@query("d26_j09_pulses", "WITH {EMB}, " + PULSE.format(dm=30, t0=0.05, p=0.25, h=2, w=4) + " SELECT source, block, chan, t FROM px")
def _(spark, sf):
    f = emb(spark, sf).select(*BC).distinct().withColumn("freq", 1000.0 + F.col("chan") * 5)
    return D.pulses(f, "freq", 30.0, 0.25, 0.05, 4, 0.01, 100)


@query("d27_pulses_inclusive", "WITH {EMB}, f AS (SELECT DISTINCT source, block, chan, 1000.0 + chan * 5 AS freq FROM g), d AS (SELECT *, 4148.808 * 30 * (freq ** -2 - 1000.0 ** -2) AS d FROM f), k AS (SELECT *, max(d) OVER (PARTITION BY source, block) AS md FROM d), a AS (SELECT source, block, chan, CAST(round((0.05 + k * 0.25 + d) / 0.01) AS INTEGER) AS c FROM k, range(-20, 40) r(k) WHERE k BETWEEN floor((-md - 0.05) / 0.25) AND ceil((100 * 0.01 - 0.05) / 0.25) + 1) SELECT DISTINCT source, block, chan, CAST(c - 2 + i AS INTEGER) AS t FROM a, range(0, 5) r(i) WHERE c - 2 + i BETWEEN 0 AND 99")
def _(spark, sf):
    f = emb(spark, sf).select(*BC).distinct().withColumn("freq", 1000.0 + F.col("chan") * 5)
    return D.pulses(f, "freq", 30.0, 0.25, 0.05, 4, 0.01, 100, "first", "round", True)


@query("d28_interpulse", "WITH {EMB}, x AS (WITH " + PULSE.format(dm=30, t0=0.05, p=0.25, h=2, w=4) + " SELECT * FROM px), y AS (WITH " + PULSE.format(dm=30, t0=0.175, p=0.25, h=1, w=2) + " SELECT * FROM px) SELECT source, block, chan, t FROM x UNION SELECT source, block, chan, t FROM y")
def _(spark, sf):
    f = emb(spark, sf).select(*BC).distinct().withColumn("freq", 1000.0 + F.col("chan") * 5)
    return D.pulses(f, "freq", 30.0, 0.25, 0.05, 4, 0.01, 100).unionByName(D.pulses(f, "freq", 30.0, 0.25, 0.05 + 0.25 / 2, 2, 0.01, 100)).distinct()


@query("d29_cancelled", "WITH {EMB} SELECT source, block, chan, avg(CASE WHEN abs(v) > 0.15 THEN 1.0 ELSE 0.0 END) > 0.25 AS cancel FROM g GROUP BY ALL")
def _(spark, sf):
    return D.cancelled(emb(spark, sf).withColumn("m", F.abs("v") > 0.15), "m", 0.25)


@query("d30_channel_kinds", "WITH {EMB}, " + FLAGGED + ", m AS (SELECT source, block, avg(mean) AS mid FROM f GROUP BY ALL) SELECT source, block, min(chan) AS first, max(chan) AS last, count(*) AS n, CASE WHEN count(*) <= 2 THEN CASE WHEN avg(mean) > any_value(mid) + 1e-5 THEN 'bright' WHEN avg(mean) < any_value(mid) - 1e-5 THEN 'dark' ELSE 'complex' END WHEN bool_and(mean > mid + 1e-5) THEN 'bright' WHEN bool_and(mean < mid - 1e-5) THEN 'dark' ELSE 'complex' END AS kind FROM i JOIN m USING (source, block) WHERE flag GROUP BY source, block, island")
def _(spark, sf):
    return D.channel_kinds(flagged_channels(spark, sf))


SIMPLE = "WITH RECURSIVE {EMB}, " + clip_sql("c", "g", "source, block, chan", 2.5, kind="avg") + """, pt AS (SELECT source, block, chan, t, v, v < a[1] OR v > a[len(a)] AS m_point FROM g JOIN c USING (source, block, chan)),
ch AS (SELECT source, block, chan, CASE WHEN count(*) FILTER (NOT m_point) <= 1 THEN avg(v) ELSE avg(v) FILTER (NOT m_point) END AS mean, CASE WHEN count(*) FILTER (NOT m_point) <= 1 THEN stddev_pop(v) ELSE stddev_pop(v) FILTER (NOT m_point) END AS std FROM pt GROUP BY ALL), xs AS (SELECT source, block, chan, std AS v FROM ch), xm AS (SELECT source, block, chan, mean AS v FROM ch), """ + clip_sql("cs", "xs", "source, block", 2.0, 30, kind="avg", rate=0.01) + ", " + clip_sql("cm", "xm", "source, block", 2.0, 30, kind="avg", rate=0.01) + """,
fl AS (SELECT source, block, chan, std < cs.a[1] OR std > cs.a[len(cs.a)] OR mean < cm.a[1] OR mean > cm.a[len(cm.a)] AS flag FROM ch JOIN cs USING (source, block) JOIN cm USING (source, block)),
wd AS (SELECT source, block, chan, bool_or(flag) OVER (PARTITION BY source, block ORDER BY chan ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m_horiz FROM fl) SELECT source, block, chan, t, m_point, m_horiz FROM pt JOIN wd USING (source, block, chan)"""


@query("d31_m17_simple_flow", SIMPLE)
def _(spark, sf):
    return D.simple_flow(emb(spark, sf), 2.5, 2.0).select(*BC, "t", "m_point", "m_horiz")


@query("d34_rms_outliers", "WITH {EMB}, r AS (SELECT source, block, chan, coalesce(sqrt(avg(v * v) FILTER (abs(v) <= 0.25)), 0) AS rms FROM g GROUP BY ALL) SELECT source, block, chan, rms > avg(rms) OVER (PARTITION BY source, block) + 1.5 * stddev_pop(rms) OVER (PARTITION BY source, block) AS flag FROM r")
def _(spark, sf):
    return D.rms_outliers(points(spark, sf), "m", BC, 1.5).select(*BC, "flag")


@query("d36_rank_dilated", "WITH {EMB}, s AS (SELECT source, block, chan, t, sum(CASE WHEN abs(v) > 0.12 THEN 0.2 ELSE -0.8 END) OVER (PARTITION BY source, block, chan ORDER BY t) AS s FROM g), p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY source, block, chan ORDER BY t), 0) AS p FROM s) SELECT source, block, chan, t, max(s) OVER (PARTITION BY source, block, chan ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - min(p) OVER (PARTITION BY source, block, chan ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= -1e-9 AS dilated FROM p")
def _(spark, sf):
    return D.rank_dilated(emb(spark, sf).withColumn("m", F.abs("v") > 0.12), BC, "t", "m").select(*BC, "t", "dilated")


@query("d38_clip_trace", "WITH RECURSIVE {EMB}, " + clip_sql("c", "g", "source, block, chan", 2.0) + " SELECT source, block, chan, n AS round, round(med, 6) AS med, round(rms, 6) AS rms, CAST(len(a) AS INTEGER) AS kept FROM c_r WHERE n > 0")
def _(spark, sf):
    return D.clip_trace(emb(spark, sf), 2.0).select(*BC, "round", *rounded("med", "rms"), "kept")
