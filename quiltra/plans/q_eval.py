"""Queries of evaluation and scoring."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import BC, rounded
from quiltra.operators import evaluate as E
from quiltra.operators import substitute as X
from quiltra.sources import grids

from .base import draw_sql, query
from .q_masks import by_class_sql

emb = grids.embedding_grid
TRUTH = "CASE WHEN v > 0.2 THEN 5 WHEN v > 0.14 THEN 3 WHEN chan % 16 = 2 THEN 1 WHEN t % 25 = 4 THEN 2 ELSE 0 END"
PRED = "CASE WHEN v > 0.22 THEN 5 WHEN v > 0.12 THEN 3 WHEN chan % 16 = 2 AND t % 7 > 0 THEN 1 WHEN t % 25 = 4 THEN 2 WHEN v < -0.3 THEN 4 ELSE 0 END"
PAIRS = f"q AS (SELECT source, block, chan, t, v, {TRUTH} AS truth, {PRED} AS pred FROM g)"
CELLS = "c AS (SELECT CAST(a AS INTEGER) AS truth, CAST(b AS INTEGER) AS pred FROM range(0, 6) x(a), range(0, 6) y(b)), m AS (SELECT c.truth, c.pred, count(q.v) AS n FROM c LEFT JOIN q ON c.truth = q.truth AND c.pred = q.pred GROUP BY ALL)"


def metric_sql(eps: float = 0.0) -> str:
    r = lambda a, b: f"({a} + {eps}) / ({b} + {eps})" if eps else f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"
    return f"k AS (SELECT CAST(i AS INTEGER) AS label, (SELECT sum(n) FROM m WHERE truth = i) AS t, (SELECT sum(n) FROM m WHERE pred = i) AS p, (SELECT sum(n) FROM m WHERE truth = i AND pred = i) AS tp FROM range(0, 6) r(i)), s AS (SELECT label, CAST(tp AS BIGINT) AS tp, {r('tp', '(t + p - tp)')} AS iou, {r('tp', 'p')} AS precision, {r('tp', 't')} AS recall, {r('2 * tp', '(t + p)')} AS f1 FROM k)"


def pairs(spark, sf):
    return emb(spark, sf).withColumns({"truth": F.expr(TRUTH), "pred": F.expr(PRED)})


@query("e01_confusion", "WITH {EMB}, " + PAIRS + ", " + CELLS + " SELECT truth, pred, n FROM m")
def _(spark, sf):
    return E.confusion(pairs(spark, sf))


METHODS = ["first", "second", "absent"]


@query("e14_method_metrics", "WITH {EMB}, " + PAIRS + ", w AS (SELECT 'first' AS method, truth, pred FROM q UNION ALL SELECT 'second', truth, CASE WHEN pred = 3 THEN 0 ELSE pred END FROM q), i AS (SELECT method, CAST(label AS INTEGER) AS label, (SELECT count(*) FROM w WHERE w.method = x.method AND truth = label) AS t, (SELECT count(*) FROM w WHERE w.method = x.method AND pred = label) AS p, (SELECT count(*) FROM w WHERE w.method = x.method AND truth = label AND pred = label) AS tp FROM (SELECT DISTINCT method FROM w) x, range(0, 6) r(label)) SELECT method, 'evaluated' AS status, label, CAST(tp AS BIGINT) AS tp, round(CASE WHEN t + p - tp > 0 THEN tp / (t + p - tp) ELSE 0 END, 6) AS iou, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN tp / t ELSE 0 END, 6) AS recall, round(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END, 6) AS f1 FROM i UNION ALL SELECT 'absent', 'skipped', NULL, NULL, NULL, NULL, NULL, NULL")
def _(spark, sf):
    own = pairs(spark, sf)
    both = own.withColumn("method", F.lit("first")).unionByName(own.withColumns({"method": F.lit("second"), "pred": F.when(F.col("pred") == 3, 0).otherwise(F.col("pred"))}))
    return E.method_metrics(both, METHODS).select("method", "status", "label", "tp", *rounded("iou", "precision", "recall", "f1"))


@query("e15_confusion_ignoring", "WITH {EMB}, " + PAIRS.replace("q AS", "q0 AS") + ", q AS (SELECT * REPLACE (CASE WHEN t % 13 = 0 THEN 255 ELSE truth END AS truth) FROM q0), " + CELLS + " SELECT truth, pred, n FROM m")
def _(spark, sf):
    own = pairs(spark, sf).withColumn("truth", F.when(F.col("t") % 13 == 0, 255).otherwise(F.col("truth")))
    return E.confusion(own, ignore=255)


@query("e02_class_metrics", "WITH {EMB}, " + PAIRS + ", " + CELLS + ", " + metric_sql() + " SELECT label, tp, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def _(spark, sf):
    return E.class_metrics(E.confusion(pairs(spark, sf))).select("label", "tp", *rounded("iou", "precision", "recall", "f1"))


@query("e03_smoothed_metrics", "WITH {EMB}, " + PAIRS + ", " + CELLS + ", " + metric_sql(1e-9) + " SELECT label, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def _(spark, sf):
    return E.class_metrics(E.confusion(pairs(spark, sf)), eps=1e-9).select("label", *rounded("iou", "precision", "recall", "f1"))


@query("e04_averages", "WITH {EMB}, " + PAIRS + ", " + CELLS + ", " + metric_sql() + " SELECT round(avg(f1), 6) AS macro_f1, round(avg(iou), 6) AS macro_iou, round(avg(f1) FILTER (label > 0), 6) AS fg_f1, round(avg(iou) FILTER (label > 0), 6) AS fg_iou, (SELECT round(sum(n) FILTER (truth = pred) / sum(n), 6) FROM m) AS micro_f1, (SELECT round(sum(n) FILTER (truth = pred) / (2 * sum(n) - sum(n) FILTER (truth = pred)), 6) FROM m) AS micro_iou FROM s")
def _(spark, sf):
    m = E.confusion(pairs(spark, sf))
    return E.averages(E.class_metrics(m)).crossJoin(F.broadcast(E.micro(m))).select(*rounded("macro_f1", "macro_iou", "fg_f1", "fg_iou", "micro_f1", "micro_iou"))


BIN = "b AS (SELECT block, CASE WHEN truth <> 0 THEN 1 ELSE 0 END AS a, CASE WHEN pred <> 0 THEN 1 ELSE 0 END AS b FROM q WHERE truth <> 5 AND pred <> 5), c AS (SELECT block, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM b GROUP BY ROLLUP (block))"


@query("e05_e06_binary", "WITH {EMB}, " + PAIRS + ", " + BIN + " SELECT block, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(spark, sf):
    return E.binary_metrics(E.flattened(pairs(spark, sf)), ["block"]).select("block", "tp", "fp", "fn", "tn", *rounded("accuracy", "precision", "recall", "f1"))


@query("e07_preservation", "WITH {EMB}, " + PAIRS + " SELECT block, count(*) AS n, round(avg(CASE WHEN pred IN (0, 5) THEN 1.0 ELSE 0.0 END), 6) AS kept FROM q WHERE truth = 5 GROUP BY block")
def _(spark, sf):
    return E.preservation(pairs(spark, sf), ["block"]).select("block", "n", *rounded("kept"))


BOOT = f"""
d AS (SELECT block * 100 + t AS vec, avg(v) AS d FROM g GROUP BY ALL),
o AS (SELECT row_number() OVER (ORDER BY {draw_sql(1, 'vec')}, vec) - 1 AS no, d FROM d),
c AS (
    SELECT draw, (({draw_sql(1, 'draw', 'no')} * (SELECT count(*) FROM o)) >> 32) >> 5 AS cell, count(*) AS k
    FROM o, range(0, 200) x(draw)
    GROUP BY ALL
),
p AS (SELECT draw, cell, unnest(range(0, k)) AS i FROM c),
s AS (SELECT no >> 5 AS cell, count(*) AS size FROM o GROUP BY ALL),
q AS (SELECT draw, (cell << 5) + (({draw_sql(2, 'draw', 'cell', 'i')} * size) >> 32) AS no FROM p JOIN s USING (cell)),
m AS (SELECT draw, avg(d) AS m FROM q JOIN o USING (no) GROUP BY draw)
"""


@query(
    "e08_bootstrap",
    "WITH {EMB}, " + BOOT + """
SELECT round((SELECT avg(d) FROM d), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high
FROM m""",
)
def _(spark, sf):
    d = emb(spark, sf).groupBy((F.col("block") * 100 + F.col("t")).alias("vec")).agg(F.avg("v").alias("d"))
    return E.bootstrap(d, "vec", "d", 200, 1, cell_bits=5).select(*rounded("mean", "low", "high"))


@query("e09_row_shares", "WITH {EMB}, " + PAIRS + ", " + CELLS + " SELECT truth, pred, n, round(CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN n / sum(n) OVER (PARTITION BY truth) ELSE 0 END, 6) AS share FROM m")
def _(spark, sf):
    return E.row_shares(E.confusion(pairs(spark, sf))).select("truth", "pred", "n", *rounded("share"))


@query("e10_sample_scores", "WITH {EMB}, " + PAIRS + ", h AS (SELECT DISTINCT block, truth AS label FROM q UNION SELECT block, pred FROM q), i AS (SELECT h.block, label, (SELECT count(*) FROM q WHERE q.block = h.block AND truth = label AND pred = label) / (SELECT count(*) FROM q WHERE q.block = h.block AND (truth = label OR pred = label)) AS iou FROM h), a AS (SELECT block, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM q GROUP BY block) SELECT block, round(any_value(accuracy), 6) AS accuracy, round(avg(iou), 6) AS miou, round(avg(iou) FILTER (label > 0), 6) AS fg_miou FROM i JOIN a USING (block) GROUP BY block")
def _(spark, sf):
    return E.sample_scores(pairs(spark, sf), ["block"]).select("block", *rounded("accuracy", "miou", "fg_miou"))


@query("e11_ignored_labels", "SELECT l_linenumber AS truth, count(*) AS n FROM (SELECT least(l_linenumber, 5) AS l_linenumber FROM lineitem WHERE l_linenumber <> 7) GROUP BY ALL")
def _(spark, sf):
    li = E.clamped(grids.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("truth")), "truth", 5, ignore=7)
    return li.groupBy("truth").agg(F.count("*").alias("n"))


@query("e12_j04_statuses", "SELECT CASE WHEN d.doc_id % 17 = 0 THEN 'no_index' WHEN l.doc_id IS NULL THEN 'missing_gt' WHEN d.doc_id % 5 <> l.doc_id % 4 THEN 'size_mismatch' WHEN toxic = 1 THEN 'ignored' ELSE 'success' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def _(spark, sf):
    d = grids.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("n"))
    t = grids.table(spark, sf, "labels").select(F.col("doc_id").alias("block_id"), (F.col("doc_id") % 4).alias("n"), (F.col("toxic") == 1).alias("skip"))
    return E.statuses(d, t, "doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("doc_id"))).groupBy("status").agg(F.count("*").alias("n"))


SOFT = "sc AS (SELECT source, block, chan, t, truth AS label, [exp(-abs(v)), exp(v), exp(-v), abs(v), v * v, 1.0] AS raw FROM q), p AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM sc)"


def soft(spark, sf):
    raw = F.array(F.exp(-F.abs("v")), F.exp("v"), F.exp(-F.col("v")), F.abs("v"), F.col("v") * F.col("v"), F.lit(1.0))
    own = pairs(spark, sf).withColumn("raw", raw)
    return own.withColumn("p", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b))).withColumn("label", F.col("truth"))


@query("e13_tversky", "WITH {EMB}, " + PAIRS + ", " + SOFT + ", u AS (SELECT label, unnest(p) AS p, unnest(range(0, 6)) AS k FROM p), s AS (SELECT CAST(k AS INTEGER) AS label, sum(p * CASE WHEN label = k THEN 1 ELSE 0 END) AS tp, sum(p * CASE WHEN label = k THEN 0 ELSE 1 END) AS fp, sum((1 - p) * CASE WHEN label = k THEN 1 ELSE 0 END) AS fn FROM u GROUP BY k), i AS (SELECT label, (tp + 1e-6) / (tp + 0.4 * fp + 0.6 * fn + 1e-6) AS ix FROM s) SELECT label, round(ix, 6) AS index, round((1 - ix) ** 0.5, 6) AS focal FROM i")
def _(spark, sf):
    return E.tversky(soft(spark, sf), 6).select("label", *rounded("index", "focal"))


@query("i01_i02_argmax", "WITH {EMB}, " + PAIRS + ", " + SOFT + ", w AS (SELECT *, list_transform(raw, lambda x, i: x * [1.0, 1.15, 1.0, 1.25, 1.0, 1.0][i]) AS wr FROM sc) SELECT source, block, chan, t, CAST(list_position(raw, list_max(raw)) - 1 AS INTEGER) AS plain, CAST(list_position(wr, list_max(wr)) - 1 AS INTEGER) AS weighed FROM w")
def _(spark, sf):
    return soft(spark, sf).select(*BC, "t", E.argmax(F.col("raw")).alias("plain"), E.argmax(E.with_priors(F.col("raw"), [1.0, 1.15, 1.0, 1.25, 1.0, 1.0])).alias("weighed"))


def three_levels(x):
    """A stand-in for a trained model: scores of [n, T] values for low, middle and high."""
    import numpy as np

    return np.stack([1 - x, np.full_like(x, 0.55), x], axis=-1)


NORM = "s AS (SELECT source, block, avg(v) AS m, stddev_pop(v) AS s FROM g GROUP BY ALL), n AS (SELECT source, block, chan, t, greatest(0, least(1, (v - (m - 3 * s)) / (6 * s))) AS x FROM g JOIN s USING (source, block))"


LEVELS = "CASE WHEN 1 - x >= 0.55 AND 1 - x >= x THEN 0 WHEN 0.55 >= x THEN 1 ELSE 2 END"


@query("i03_scored_blocks", "WITH {EMB}, " + NORM + f" SELECT source, block, chan, t, {LEVELS} AS label FROM n")
def _(spark, sf):
    return E.labelled(emb(spark, sf), three_levels, 3).select(*BC, "t", "label")


@query("i06_scoring_variants", "WITH {EMB}, r AS (SELECT source, block, chan, t, 2.0 * v + 1.0 AS v FROM g), s AS (SELECT source, block, avg(v) AS m, stddev_pop(v) AS s FROM r GROUP BY ALL), n AS (SELECT source, block, chan, t, greatest(0, least(1, (v - (m - 2 * s)) / (4 * s))) AS x FROM r JOIN s USING (source, block)) SELECT source, block, chan, t, CASE WHEN 1 - x >= 0.55 * 1.2 AND 1 - x >= x THEN 0 ELSE 1 END AS label FROM n")
def _(spark, sf):
    return E.labelled(emb(spark, sf), three_levels, 3, k=2.0, priors=[1.0, 1.2, 1.0], scale=2.0, offset=1.0, flipped=64, classwise=False).select(*BC, "t", "label")


@query("i04_scored_and_cleaned", "WITH {EMB}, " + NORM + f", y AS (SELECT source, block, chan, t, v, CASE WHEN {LEVELS} = 1 THEN 0 ELSE 3 END AS label FROM g JOIN n USING (source, block, chan, t)), " + by_class_sql() + " SELECT source, block, chan, t, v, label FROM z")
def _(spark, sf):
    g = emb(spark, sf)
    label = E.labelled(g, three_levels, 3).select(*BC, "t", F.when(F.col("label") == 1, 0).otherwise(3).alias("label"))
    return X.by_class(g.join(label, [*BC, "t"]), "label").select(*BC, "t", "v", "label")


@query("i05_softmax", "WITH {EMB}, " + PAIRS + ", " + SOFT + ", x AS (SELECT *, list_transform(raw, lambda x: exp(x - list_max(raw))) AS e FROM sc) SELECT source, block, chan, t, round(e[1] / list_sum(e), 6) AS first, round(e[6] / list_sum(e), 6) AS last FROM x")
def _(spark, sf):
    s = soft(spark, sf).withColumn("sm", E.softmax(F.col("raw")))
    return s.select(*BC, "t", F.round(F.element_at("sm", 1), 6).alias("first"), F.round(F.element_at("sm", 6), 6).alias("last"))
