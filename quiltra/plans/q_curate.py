"""Queries of joins, windows, set operations and dataset curation; documents stand for images, labels for masks."""

from pyspark.sql import functions as F

from quiltra.operators import curate as C
from quiltra.sources import grids

from .base import draw_sql, query
from .q_sources import SAMPLES, samples


def masks(spark, sf):
    return grids.table(spark, sf, "labels").select("doc_id", "quality", "toxic")


@query("j01_j06_paired", f"WITH {SAMPLES} SELECT dataset, split, smp.doc_id, name, quality, toxic FROM smp JOIN labels USING (doc_id)")
def _(spark, sf):
    return C.paired(samples(spark, sf), masks(spark, sf), ["doc_id"]).select("dataset", "split", "doc_id", "name", "quality", "toxic")


@query("j02_lenient_pairs", f"WITH {SAMPLES} SELECT doc_id, name FROM smp WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return C.strictly_paired(samples(spark, sf), masks(spark, sf), ["doc_id"], lenient=True).select("doc_id", "name")


@query("j03_u03_mismatches", "SELECT coalesce(d.doc_id, l.doc_id + 100000) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM documents d FULL JOIN (SELECT doc_id - CASE WHEN doc_id % 50 = 0 THEN 100000 ELSE 0 END AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def _(spark, sf):
    odd = masks(spark, sf).withColumn("doc_id", F.col("doc_id") - F.when(F.col("doc_id") % 50 == 0, 100000).otherwise(0))
    out = C.mismatches(samples(spark, sf), odd, ["doc_id"])
    return out.withColumn("doc_id", F.when(F.col("side") == "extra", F.col("doc_id") + 100000).otherwise(F.col("doc_id")))


@query("j05_w08_u02_common_blocks", f"WITH {SAMPLES}, s AS (SELECT doc_id % 41 AS b, name, split FROM smp), a AS (SELECT b, min(name) AS train FROM s WHERE split = 'train' GROUP BY ALL), v AS (SELECT b, min(name) AS val FROM s WHERE split = 'val' GROUP BY ALL), l AS (SELECT DISTINCT doc_id % 41 AS b FROM labels WHERE toxic = 1) SELECT b, train, val FROM a JOIN v USING (b) JOIN l USING (b)")
def _(spark, sf):
    s = samples(spark, sf).withColumn("b", F.col("doc_id") % 41)
    a = C.first_by(s.filter("split = 'train'"), ["b"], "name").select("b", F.col("name").alias("train"))
    v = C.first_by(s.filter("split = 'val'"), ["b"], "name").select("b", F.col("name").alias("val"))
    return a.join(v, "b").join(masks(spark, sf).filter("toxic = 1").select((F.col("doc_id") % 41).alias("b")).distinct(), "b")


@query("j07_pixel_pairs", "WITH {EMB}, u AS (SELECT block, chan, t, v > 0.1 AS truth, NULL AS pred FROM g UNION ALL SELECT block, chan, t, NULL, v > 0.2 FROM g) SELECT block, chan, t, bool_or(truth) AS truth, bool_or(pred) AS pred FROM u GROUP BY ALL")
def _(spark, sf):
    g = grids.by_block(grids.embedding_grid(spark, sf))
    a, b = g.select("source", "block", "chan", "t", (F.col("v") > 0.1).alias("truth")), g.select("source", "block", "chan", "t", (F.col("v") > 0.2).alias("pred"))
    return a.join(b, ["source", "block", "chan", "t"]).select("block", "chan", "t", "truth", "pred")


@query("j11_first_candidate", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN name || '_a' WHEN doc_id % 2 = 0 THEN name || '_b' ELSE name END AS path FROM smp")
def _(spark, sf):
    s = samples(spark, sf)
    files = s.select(F.when(F.col("doc_id") % 3 == 0, F.concat("name", F.lit("_a"))).alias("path")).filter("path is not null").union(s.filter("doc_id % 2 = 0").select(F.concat("name", F.lit("_b")))).union(s.select("name"))
    return C.first_candidate(s, F.array(F.concat("name", F.lit("_a")), F.concat("name", F.lit("_b")), F.col("name")), files, "doc_id")


@query("c01_w06_every_nth", f"WITH {SAMPLES} SELECT dataset, name, CASE WHEN (row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM smp")
def _(spark, sf):
    return C.every_nth(samples(spark, sf), ["dataset"], "doc_id", 0.2).select("dataset", "name", "split")


@query("c02_random_split", f"WITH {SAMPLES} SELECT dataset, name, CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY {draw_sql(7, 'name')}, name) <= 10 THEN 'val' ELSE 'train' END AS split FROM smp")
def _(spark, sf):
    return C.random_split(samples(spark, sf), ["dataset"], "name", 10, 7).select("dataset", "name", "split")


ALLOC = "cap AS (SELECT dataset, factor, count(*) AS space FROM smp GROUP BY ALL), tg AS (SELECT *, CASE factor WHEN 1 THEN 300 WHEN 2 THEN 60 WHEN 4 THEN 40 ELSE 30 END AS target FROM cap), ev AS (SELECT *, least(space, target // count(*) OVER (PARTITION BY factor)) AS ev FROM tg), le AS (SELECT *, space - ev AS free, target - sum(ev) OVER (PARTITION BY factor) AS lft FROM ev), tk AS (SELECT *, CAST(ev + greatest(0, least(free, lft - (sum(free) OVER (PARTITION BY factor ORDER BY free DESC, dataset ROWS UNBOUNDED PRECEDING) - free))) AS BIGINT) AS take FROM le)"


@query("c03_c04_l03_allocated", f"WITH {SAMPLES}, {ALLOC} SELECT dataset, factor, space, take, CAST(target - sum(take) OVER (PARTITION BY factor) AS BIGINT) AS short, least(space, take // 4) AS val FROM tk")
def _(spark, sf):
    cap = samples(spark, sf).groupBy("dataset", "factor").agg(F.count("*").alias("space"))
    target = F.when(F.col("factor") == 1, 300).when(F.col("factor") == 2, 60).when(F.col("factor") == 4, 40).otherwise(30)
    return C.allocated(cap, ["factor"], "dataset", "space", target).select("dataset", "factor", "space", "take", "short", F.least("space", F.floor(F.col("take") / 4)).alias("val"))


SHUF = f"sh AS (SELECT *, 'cover' || (doc_id % 7) AS cover FROM smp), ns AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cover ORDER BY {draw_sql(3, 'name')}, name) <= count(*) FILTER (split = 'train') OVER (PARTITION BY cover) THEN 'train' ELSE 'val' END AS new_split FROM sh)"


@query("c05_c06_reshuffled", f"WITH {SAMPLES}, {SHUF} SELECT name, 'MOVED ' || split || '->' || new_split AS change FROM ns WHERE split <> new_split")
def _(spark, sf):
    s = samples(spark, sf).withColumn("cover", F.concat(F.lit("cover"), F.col("doc_id") % 7))
    return C.changes(C.reshuffled(s, "cover", "name", 3)).select("name", "change")


@query("c07_c08_w07_sampled", f"WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY {draw_sql(5, 'name')}, name) AS k FROM smp) SELECT dataset, split, name FROM k WHERE k <= CASE WHEN split = 'train' THEN 12 ELSE 3 END")
def _(spark, sf):
    return C.sampled(samples(spark, sf), ["dataset", "split"], "name", F.when(F.col("split") == "train", 12).otherwise(3), 5).select("dataset", "split", "name")


@query("c09_conflicts", f"WITH {SAMPLES}, pl AS (SELECT 'n' || (doc_id % 700) AS name FROM smp) SELECT DISTINCT name, 'exists' AS why FROM pl WHERE name IN (SELECT 'n' || doc_id FROM labels) UNION ALL SELECT name, 'repeated' FROM pl GROUP BY name HAVING count(*) > 1")
def _(spark, sf):
    planned = samples(spark, sf).select(F.concat(F.lit("n"), F.col("doc_id") % 700).alias("name"))
    return C.conflicts(planned, masks(spark, sf).select(F.concat(F.lit("n"), "doc_id").alias("name")), "name")


@query("c10_u01_merge_summary", f"WITH {SAMPLES}, u AS (SELECT dataset, split, factor FROM smp UNION ALL SELECT 'extra', 'train', CAST(quality AS INTEGER) FROM labels) SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(DISTINCT factor) AS factors FROM u GROUP BY ALL")
def _(spark, sf):
    u = samples(spark, sf).select("dataset", "split", "factor").unionByName(masks(spark, sf).select(F.lit("extra").alias("dataset"), F.lit("train").alias("split"), F.col("quality").alias("factor")))
    return u.groupBy("dataset").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"), F.countDistinct("factor").alias("factors"))


@query("c11_trimmed", f"WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset = 'src7' ORDER BY {draw_sql(9, 'name')}, name) AS k FROM smp) SELECT name, dataset FROM k WHERE dataset <> 'src7' OR k <= 10")
def _(spark, sf):
    return C.trimmed(samples(spark, sf), F.col("dataset") == "src7", "name", 10, 9).select("name", "dataset")


@query("c12_weighted_draws", f"WITH w AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 3.0 WHEN quality = 0 THEN 2.0 ELSE 1.0 END AS w, {draw_sql(4, 'doc_id')} AS o FROM labels), r AS (SELECT doc_id, sum(w) OVER (ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS hi, w, sum(w) OVER () AS al FROM w), d AS (SELECT id, ({draw_sql(4, 'id')} + 0.5) / 4294967296.0 AS u FROM range(0, 500) x(id)) SELECT id, doc_id FROM d JOIN r ON u * al >= hi - w AND u * al < hi")
def _(spark, sf):
    w = masks(spark, sf).withColumn("w", F.when(F.col("toxic") == 1, 3.0).when(F.col("quality") == 0, 2.0).otherwise(1.0))
    return C.weighted_draws(w, "doc_id", "w", 500, 4)


@query("c13_named", "SELECT 'doc' || i AS name, i IN (SELECT doc_id FROM labels) AS found FROM (SELECT doc_id AS i FROM documents)")
def _(spark, sf):
    wanted = grids.table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"))
    return C.named(masks(spark, sf).select(F.concat(F.lit("doc"), "doc_id").alias("name")), wanted, "name")


U = [f"({draw_sql(11 + i, 'source', 'block')}) / 4294967296.0 AS u{i}" for i in range(6)]


@query("c14_augmented", "WITH {EMB}, u AS (SELECT *, " + ", ".join(U) + f", ({draw_sql(20, 'source', 'block', 'chan', 't')}) / 4294967296.0 AS nz FROM g), a AS (SELECT source, block, CASE WHEN u0 < 0.5 THEN 63 - chan ELSE chan END AS chan, CASE WHEN u1 < 0.5 THEN 99 - t ELSE t END AS t, v * (0.8 + 0.4 * u2) + 0.2 * (u3 - 0.5) + 0.01 * (nz - 0.5) AS v, floor(u4 * 56) AS c0, floor(u5 * 92) AS t0 FROM u) SELECT source, block, chan, t, round(CASE WHEN chan BETWEEN c0 AND c0 + 7 AND t BETWEEN t0 AND t0 + 7 THEN 0 ELSE v END, 6) AS v FROM a")
def _(spark, sf):
    return C.augmented(grids.embedding_grid(spark, sf), 64, 100, 11).withColumn("v", F.round("v", 6))


@query("l01_l02_first_blocks", f"WITH {SAMPLES} SELECT name FROM smp ORDER BY doc_id LIMIT 25")
def _(spark, sf):
    from quiltra.operators.predicates import numeric_key

    return samples(spark, sf).orderBy(numeric_key(F.col("name"))).limit(25).select("name")


@query("u04_deduplicated", f"WITH {SAMPLES}, k AS (SELECT dataset, doc_id % 7 AS cover, name, row_number() OVER (PARTITION BY dataset, doc_id % 7 ORDER BY doc_id) AS k FROM smp) SELECT dataset, cover, name FROM k WHERE k = 1")
def _(spark, sf):
    s = samples(spark, sf).withColumn("cover", F.col("doc_id") % 7)
    return C.first_by(s, ["dataset", "cover"], "doc_id").select("dataset", "cover", "name")
