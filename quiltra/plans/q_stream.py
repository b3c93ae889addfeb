"""Queries of the streams; each runs the stream to its end and returns what it wrote."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import BC, rounded
from quiltra.operators import detect as D
from quiltra.sources.sinks import new_path
from quiltra.streaming import streams as S

from .base import query


def pixels(batch):
    e = batch.select("vec_id", F.posexplode("embedding").alias("chan", "v"))
    return e.select(F.lit("emb").alias("source"), F.floor(F.col("vec_id") / 100).cast("long").alias("block"), F.col("chan").cast("int").alias("chan"), (F.col("vec_id") % 100).cast("int").alias("t"), F.col("v").cast("double").alias("v"))


def detected(grid):
    return D.tukey_time(grid, 1.5).select(*BC, "t", "m")


@query("t01_t03_stream_blocks", "WITH {EMB}, s AS (SELECT source, block, chan, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM g GROUP BY ALL) SELECT source, block, chan, t, v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS m FROM g JOIN s USING (source, block, chan)")
def _(spark, sf):
    return S.by_block(S.source(spark, sf, "embeddings"), pixels, detected, new_path(spark, "flags"), 100 * 64)


@query("t02_stream_bins", "WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM events), b AS (SELECT date_trunc('hour', ts) AS start, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY ALL) SELECT start, mean, n FROM b WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)")
def _(spark, sf):
    e = S.source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.appended(S.binned(e, "ts", "value", "1 hour", "10 minutes"), new_path(spark, "bins")).select("start", *rounded("mean"), "n")


@query("t04_stream_timings", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY ALL")
def _(spark, sf):
    out = S.running(S.source(spark, sf, "events"), ["event_type"], "value", new_path(spark, "timings"))
    return out.select("event_type", "n", *rounded("total", "least", "most", digits=4))
