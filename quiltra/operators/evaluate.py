"""Evaluation of labels against truth, and scoring of pixels from class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltra.functions.exprs import BC, draw
from quiltra.operators.curate import by_draw
from quiltra.operators.morphology import kept
from quiltra.operators.substitute import normalised
from quiltra.sources import grids

K = 6


def confusion(pairs: DataFrame, keys: list[str] = (), classes: int = K, ignore: int | None = None) -> DataFrame:
    """(keys, truth, pred, n) of all class pairs, empty ones too; labels outside the classes are left out."""
    own = pairs.filter(F.col("truth").between(0, classes - 1) & F.col("pred").between(0, classes - 1))
    own = own.filter(F.col("truth") != ignore) if ignore is not None else own
    n = own.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"))
    code = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    all_ = n.select(*keys).distinct() if keys else pairs.sparkSession.range(1).select()
    full = all_.select(*keys, code.alias("truth")).select("*", code.alias("pred"))
    return full.join(n.select(*keys, F.col("truth").cast("int").alias("truth"), F.col("pred").cast("int").alias("pred"), "n"), [*keys, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def clamped(pairs: DataFrame, label: str, most: int, ignore: int = 255) -> DataFrame:
    """Labels above ``most`` become it; rows with the label ``ignore`` go."""
    return pairs.filter(F.col(label) != ignore).withColumn(label, F.least(F.col(label), F.lit(most)))


def method_metrics(pairs: DataFrame, methods: list[str], classes: int = K, ignore: int | None = None) -> DataFrame:
    """(method, status, label, tp, iou, precision, recall, f1): class metrics of each method; one without pairs is skipped."""
    own = class_metrics(confusion(pairs.filter(F.col("method").isin(methods)), ["method"], classes, ignore), ["method"]).withColumn("status", F.lit("evaluated"))
    named = pairs.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    missing = named.join(own.select("method").distinct(), "method", "left_anti").withColumn("status", F.lit("skipped"))
    return own.unionByName(missing, allowMissingColumns=True).select("method", "status", "label", "tp", "iou", "precision", "recall", "f1")


def ratio(a: Column, b: Column, eps: float) -> Column:
    return (a + eps) / (b + eps) if eps else F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(matrix: DataFrame, keys: list[str] = (), eps: float = 0.0) -> DataFrame:
    """IoU, precision, recall and F1 of each class; 0 where undefined, or smoothed by eps."""
    truth = matrix.groupBy(*keys, F.col("truth").alias("label")).agg(F.sum("n").alias("_t"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = matrix.groupBy(*keys, F.col("pred").alias("label")).agg(F.sum("n").alias("_p"))
    own = truth.join(pred, [*keys, "label"])
    tp, t, p = F.col("tp"), F.col("_t"), F.col("_p")
    return own.select(*keys, "label", "tp", ratio(tp, t + p - tp, eps).alias("iou"), ratio(tp, p, eps).alias("precision"), ratio(tp, t, eps).alias("recall"), ratio(2 * tp, t + p, eps).alias("f1"))


def averages(metrics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Macro and foreground-macro F1 and IoU."""
    fg = F.col("label") > 0
    return metrics.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), F.avg("iou").alias("macro_iou"), F.avg(F.when(fg, F.col("f1"))).alias("fg_f1"), F.avg(F.when(fg, F.col("iou"))).alias("fg_iou"))


def micro(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    same = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return matrix.groupBy(*keys).agg((same / F.sum("n")).alias("micro_f1"), (same / (2 * F.sum("n") - same)).alias("micro_iou"))


def flattened(pairs: DataFrame, pulsar: int = 5) -> DataFrame:
    """Two-class pairs without pixels that are pulsar on either side; all else but background is positive."""
    own = pairs.filter((F.col("truth") != pulsar) & (F.col("pred") != pulsar))
    return own.withColumns({"truth": (F.col("truth") != 0).cast("int"), "pred": (F.col("pred") != 0).cast("int")})


def binary_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and scores of two-class pairs, for each group and in total."""
    at = lambda a, b: F.count_if((F.col("truth") == a) & (F.col("pred") == b))
    c = pairs.rollup(*keys).agg(at(1, 1).alias("tp"), at(0, 1).alias("fp"), at(1, 0).alias("fn"), at(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn, 0).alias("accuracy"), ratio(tp, tp + fp, 0).alias("precision"), ratio(tp, tp + fn, 0).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 0).alias("f1"))


def preservation(pairs: DataFrame, keys: list[str], pulsar: int = 5, two_class: bool = False) -> DataFrame:
    """Share of true pulsar pixels that are predicted background (or pulsar, unless the method has two classes)."""
    kept = F.col("pred").isin([0] if two_class else [0, pulsar])
    own = pairs.filter(F.col("truth") == pulsar)
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(kept.cast("double")).alias("kept"))


def bootstrap(deltas: DataFrame, name: str, delta: str, draws: int = 2000, seed: int = 1, level: float = 0.95, cell_bits: int = 10) -> DataFrame:
    """(mean, low, high): mean of paired differences with the quantile interval of the means of resamples.

    A resample has as many rows as there are, drawn with replacement. Rows are numbered in a drawn order and packed into cells
    of 2 ** cell_bits. Each pick first chooses a number, and only how often it falls into each cell is counted; then a cell
    draws that many of its own rows. So no pick is a row of a shuffle, and a task holds the rows of one cell. Null differences
    are left out; without any the three are null.
    """
    spark = deltas.sparkSession
    own = deltas.select(F.col(name).alias("_name"), F.col(delta).cast("double").alias("_d")).filter("_d is not null")
    numbered = by_draw(own, [], "_name", seed).select((F.col("_rank") - 1).alias("_no"), "_d")
    cells = numbered.groupBy(F.shiftright("_no", cell_bits).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("_no", "_d"))).alias("_s"))
    cells = kept(cells.select("cell", F.transform("_s", lambda x: x["_d"]).alias("_a")), "cells")
    n = cells.agg(F.sum(F.size("_a"))).first()[0] or 0
    share = lambda u, size: F.shiftright(u * size, 32)
    picks = spark.range(n).select(F.col("id").alias("pick"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    times = picks.groupBy("draw", F.shiftright(share(draw(seed, "draw", "pick"), F.lit(n).cast("long")), cell_bits).alias("cell")).agg(F.count("*").alias("_k"))
    drawn = lambda i: F.element_at("_a", (share(draw(seed + 1, "draw", "cell", i), F.size("_a").cast("long")) + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), F.lit(0.0), lambda a, i: a + drawn(i))
    means = times.join(cells, "cell").select("draw", total.alias("_t")).groupBy("draw").agg((F.sum("_t") / n).alias("_m"))
    s = means.agg(F.percentile("_m", (1 - level) / 2).alias("low"), F.percentile("_m", (1 + level) / 2).alias("high"))
    return own.agg(F.avg("_d").alias("mean")).crossJoin(s)


def row_shares(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys, "truth"))
    return matrix.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def sample_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, mean IoU and foreground mean IoU of each sample, over the classes that it holds."""
    m = class_metrics(confusion(pairs, keys), keys)
    held = pairs.select(*keys, F.col("truth").cast("int").alias("label")).union(pairs.select(*keys, F.col("pred").cast("int"))).distinct()
    own = m.join(held, [*keys, "label"])
    acc = pairs.groupBy(*keys).agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))
    return acc.join(own.groupBy(*keys).agg(F.avg("iou").alias("miou"), F.avg(F.when(F.col("label") > 0, F.col("iou"))).alias("fg_miou")), keys)


def statuses(preds: DataFrame, truths: DataFrame, name: str, index: Column) -> DataFrame:
    """What becomes of each prediction: no_index, missing_gt, size_mismatch, ignored or success."""
    own = preds.withColumn("_ix", index).join(truths.withColumnsRenamed({"n": "_n", "skip": "_skip"}), F.col("_ix") == F.col("block_id"), "left")
    status = F.when(F.col("_ix").isNull(), "no_index").when(F.col("block_id").isNull(), "missing_gt").when(F.col("n") != F.col("_n"), "size_mismatch").when(F.col("_skip"), "ignored").otherwise("success")
    return own.select(name, status.alias("status"))


def tversky(scores: DataFrame, classes: int, alpha: float = 0.4, beta: float = 0.6, gamma: float = 2.0, smooth: float = 0.0, ignore: int = 255) -> DataFrame:
    """Tversky index of each class from soft scores (array p, label), and its focal loss."""
    own = scores.filter(F.col("label") != ignore).select("label", F.posexplode("p").alias("k", "p"))
    y = F.when(F.col("label") == F.col("k"), 1 - smooth).otherwise(0.0) + smooth / classes
    s = own.withColumn("y", y).groupBy("k").agg(F.sum(F.col("p") * F.col("y")).alias("tp"), F.sum(F.col("p") * (1 - F.col("y"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("y")).alias("fn"))
    index = (F.col("tp") + 1e-6) / (F.col("tp") + alpha * F.col("fp") + beta * F.col("fn") + 1e-6)
    return s.select(F.col("k").alias("label"), index.alias("index"), F.pow(1 - index, F.lit(1 / gamma)).alias("focal"))


def argmax(scores: Column) -> Column:
    """Class of the largest score, the first on ties; one score alone is compared with .5."""
    return F.when(F.size(scores) == 1, (F.element_at(scores, 1) > 0.5).cast("int")).otherwise((F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def with_priors(scores: Column, priors: list[float]) -> Column:
    return F.zip_with(scores, F.array(*map(F.lit, priors)), lambda a, b: a * b)


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def scored_blocks(series: DataFrame, model, classes: int) -> DataFrame:
    """(source, block, chan, t, scores): a model function of a numpy array [n, T] to [n, T, classes], called once for all
    packed rows of one length in a batch."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            v = batch["v"]
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            ends, sizes = ends - ends[0], np.diff(ends)
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                got = np.ascontiguousarray(model(flat[ends[at][:, None] + np.arange(n)]), dtype=np.float64).reshape(-1)
                keys = batch.select(["source", "block", "chan"]).take(pa.array(np.repeat(at, n)))
                scores = pa.ListArray.from_arrays(np.arange(len(at) * n + 1, dtype=np.int32) * classes, pa.array(got))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.tile(np.arange(n, dtype=np.int32), len(at))), scores], ["source", "block", "chan", "t", "scores"])

    return series.select("source", "block", "chan", "v").mapInArrow(run, "source string, block long, chan int, t int, scores array<double>")


def labelled(grid: DataFrame, model, classes: int, k: float = 3.0, priors: list[float] | None = None, scale: float = 1.0, offset: float = 0.0, flipped: int | None = None, classwise: bool = True) -> DataFrame:
    """(BC, t, label) of a grid by a model, in its variants.

    Values are scaled and shifted first (raw samples), flipped along ``flipped`` channels before and after scoring if given, and
    normalised by ``k`` deviations. Scores are weighed by ``priors`` if there are any. Without ``classwise`` labels are 0 and 1.
    """
    own = grid.withColumn("v", F.col("v") * scale + offset)
    turned = lambda df: df.withColumn("chan", (flipped - 1 - F.col("chan")).cast("int")) if flipped else df
    scored = scored_blocks(grids.packed(turned(normalised(own, k))), model, classes)
    scores = with_priors(F.col("scores"), priors) if priors else F.col("scores")
    label = argmax(scores)
    return turned(scored.select(*BC, "t", (label if classwise else (label > 0).cast("int")).alias("label")))
