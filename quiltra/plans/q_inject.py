"""Queries of labelled signal injection."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import BC
from quiltra.operators import inject as G
from quiltra.sources import grids

from .base import draw_sql, query


def blank(spark, sf):
    return grids.embedding_grid(spark, sf).withColumn("label", F.lit(0))


def shown(df):
    return df.select(*BC, "t", F.round("v", 6).alias("v"), "label")


def added_sql(cells: str, keys: str, code: int) -> str:
    return f"a AS (SELECT {keys}, sum(s) AS s, bool_or(l) AS l FROM ({cells}) GROUP BY {keys}) SELECT g.source, g.block, g.chan, g.t, round(v + coalesce(s, 0), 6) AS v, CASE WHEN coalesce(l, false) THEN {code} ELSE 0 END AS label FROM g LEFT JOIN a USING ({keys})"


def seeds_sql(n: int, nchan: int, nsamp: int, seed: int, keys=("source", "block")) -> str:
    k = (*keys, "i")
    return f"b AS (SELECT DISTINCT source, block FROM g), i AS (SELECT source, block, i FROM b, range(0, {n}) r(i)), s AS (SELECT source, block, i, {draw_sql(seed, *k)} % {nchan} AS c, {draw_sql(seed + 1, *k)} % {nsamp} AS x, {draw_sql(seed + 2, *k)} / 4294967296.0 AS u FROM i)"


@query("g01_pulse_train", "WITH {EMB}, f AS (SELECT *, t * 0.01 - 0.05 - 4148.808 * 30 * ((1000.0 + chan * 5) ** -2 - 1315.0 ** -2) AS p FROM g), d AS (SELECT *, (p - floor(p / 0.25) * 0.25) AS ph FROM f), e AS (SELECT *, least(ph, 0.25 - ph) AS far FROM d) SELECT source, block, chan, t, round(v + 0.5 * exp(-far * far / (2 * 0.01 * 0.01)), 6) AS v, CASE WHEN far < 0.025 THEN 8 ELSE 0 END AS label FROM e")
def _(spark, sf):
    return shown(G.pulse_train(blank(spark, sf), 1000.0 + F.col("chan") * 5, 1315.0, 30.0, 0.25, 0.05, 0.01, 0.5, 0.01))


@query("g02_band", f"WITH {{EMB}}, f AS (SELECT *, exp(-((chan - 20.5) * (chan - 20.5)) / (2 * 9.0)) AS p, {draw_sql(1, 'source', 'block', 't')} / 4294967296.0 < 0.6 AS lit FROM g) SELECT source, block, chan, t, round(CASE WHEN lit THEN v + 0.3 * p ELSE v END, 6) AS v, CASE WHEN lit AND p > 0.05 THEN 1 ELSE 0 END AS label FROM f")
def _(spark, sf):
    return shown(G.band(blank(spark, sf), 20.5, 3.0, 0.3, duty=0.6))


@query("g03_periodic_band", "WITH {EMB} SELECT source, block, chan, t, round(CASE WHEN chan BETWEEN 30 AND 34 AND t % 10 < 4.0 THEN v + 0.4 ELSE v END, 6) AS v, CASE WHEN chan BETWEEN 30 AND 34 AND t % 10 < 4.0 THEN 1 ELSE 0 END AS label FROM g")
def _(spark, sf):
    return shown(G.periodic_band(blank(spark, sf), 30, 34, 10, 0.4, 0.4))


CLUSTER = "SELECT source, block, c + k AS chan, x + m AS t, 0.5 AS s, true AS l FROM s, range(0, 7) p(k), range(0, 3) q(m) WHERE k <= floor(u * 3) * 2 AND m <= floor((u * 9) % 3)"


@query("g04_clusters", "WITH {EMB}, " + seeds_sql(12, 64, 100, 30) + ", " + added_sql(CLUSTER, "source, block, chan, t", 6))
def _(spark, sf):
    return shown(G.clusters(blank(spark, sf), 12, 64, 100, 0.5, 30, 2))


@query("g05_blobs", "WITH {EMB}, " + seeds_sql(4, 64, 100, 40) + ", " + added_sql("SELECT source, block, c + k AS chan, x + m AS t, 0.8 * exp(-(k * k / (2 * 4.0) + m * m / (2 * 9.0))) AS s, exp(-(k * k / (2 * 4.0) + m * m / (2 * 9.0))) > 0.05 AS l FROM s, range(-6, 7) p(k), range(-9, 10) q(m)", "source, block, chan, t", 7))
def _(spark, sf):
    return shown(G.blobs(blank(spark, sf), 4, 64, 100, 0.8, 2.0, 3.0, 40))


@query("g06_bursts", "WITH {EMB}, " + seeds_sql(3, 64, 100, 50) + ", " + added_sql(f"SELECT source, block, c + k AS chan, x + m AS t, CASE WHEN {draw_sql(55, 'source', 'block', 'i', 'k', 'm')} / 4294967296.0 < 0.7 THEN 0.6 ELSE 0.0 END AS s, true AS l FROM s, range(0, 8) p(k), range(0, 12) q(m)", "source, block, chan, t", 7))
def _(spark, sf):
    return shown(G.bursts(blank(spark, sf), 3, 8, 12, 64, 100, 0.6, 0.7, 50))


@query("g07_impulses", "WITH {EMB}, " + seeds_sql(4, 1, 100, 60) + ", " + added_sql("SELECT DISTINCT source, block, x + k AS t, 0.4 AS s, true AS l FROM s, range(0, 2) p(k)", "source, block, t", 2))
def _(spark, sf):
    return shown(G.impulses(blank(spark, sf), 4, 100, 0.4, 2, 60))


@query("g08_consistent_clusters", "WITH {EMB}, " + seeds_sql(6, 64, 100, 70, ("source",)) + ", " + added_sql(CLUSTER.replace("* 2 AND", "* 1 AND"), "source, block, chan, t", 6))
def _(spark, sf):
    return shown(G.clusters(blank(spark, sf), 6, 64, 100, 0.5, 70, per_source=True))
