"""Queries of sources, sinks, resampling and predicates."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, rounded
from quiltra.operators import predicates as P
from quiltra.operators import resample as R
from quiltra.sources import grids, sinks

from .base import draw_sql, query

emb = grids.embedding_grid


def samples(spark, sf):
    """Documents as images: dataset, name with downsampling factor, split."""
    d = grids.table(spark, sf, "documents")
    f = F.element_at(F.create_map(*[F.lit(x) for kv in {"en": 1, "de": 2, "fr": 4, "es": 8}.items() for x in kv]), F.col("lang"))
    name = F.concat(F.col("source"), F.lit("_cover"), F.col("doc_id") % 7, F.lit("_block"), F.col("doc_id"))
    return d.select(F.col("source").alias("dataset"), F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"), "doc_id", name.alias("name"), f.alias("factor"))


SAMPLES = "smp AS (SELECT source AS dataset, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, doc_id, source || '_cover' || (doc_id % 7) || '_block' || doc_id AS name, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 4 WHEN 'es' THEN 8 END AS factor FROM documents)"

QUANT = "s AS (SELECT source, block, chan, min(v) AS lo, max(v) AS hi FROM g GROUP BY ALL), q AS (SELECT source, block, chan, t, v, CAST(floor((v - CASE WHEN hi > lo THEN lo ELSE hi END) / CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 1 END + 0.5) AS INTEGER) AS raw, CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 1 END AS scl, CASE WHEN hi > lo THEN lo ELSE hi END AS offs FROM g JOIN s USING (source, block, chan))"


@query("s01_scan", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def _(spark, sf):
    return grids.table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("s02_scan_range", "SELECT vec_id, len(embedding) AS n FROM embeddings WHERE vec_id BETWEEN (SELECT count(*) // 4 FROM embeddings) AND (SELECT 3 * count(*) // 4 FROM embeddings)")
def _(spark, sf):
    e = grids.table(spark, sf, "embeddings")
    n = e.count()
    return e.filter(F.col("vec_id").between(n // 4, 3 * n // 4)).select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("s03_grouped_blocks", "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS subint, CAST(floor(vec_id / 48.0) AS BIGINT) AS new_block FROM embeddings, n WHERE floor(vec_id / 48.0) < floor(n / 48.0)")
def _(spark, sf):
    return grids.grouped_blocks(grids.table(spark, sf, "embeddings").select(F.col("vec_id").alias("subint")), 48)


@query("s04_s14_s20_geometry", """WITH m AS (SELECT source, count(*) AS naxis2, sum(n_chars) AS n_bytes FROM documents GROUP BY ALL) SELECT source, naxis2, CAST(floor(2.5 / (64 * 0.000049152)) AS INTEGER) AS blocks_per_read, naxis2 * 64 AS total, CAST(ceil(naxis2 * 64 / 1000.0) AS BIGINT) AS chunks,
CAST(floor(n_bytes / (8 / 8) / 64) AS BIGINT) AS byte_samples FROM m""")
def _(spark, sf):
    m = grids.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("naxis2"), F.sum("n_chars").alias("n_bytes"))
    return m.select("source", "naxis2", F.floor(F.lit(2.5) / (64 * 0.000049152)).cast("int").alias("blocks_per_read"), (F.col("naxis2") * 64).alias("total"), F.ceil(F.col("naxis2") * 64 / 1000).alias("chunks"), F.floor(F.col("n_bytes") / 64).alias("byte_samples"))


@query("s05_s07_quantise_round_trip", "WITH {EMB}, " + QUANT + " SELECT source, block, chan, t, raw, round(raw * scl + offs, 6) AS v FROM q")
def _(spark, sf):
    q = grids.quantised(emb(spark, sf))
    return q.select(*BC, "t", "raw", F.round(F.col("raw") * F.col("scl") + F.col("offs"), 6).alias("v"))


@query("s06_subint_samples", "WITH {EMB}, " + QUANT + " SELECT source, block, chan, t, round(raw * scl + offs, 6) AS v FROM q")
def _(spark, sf):
    return grids.samples_of(grids.subints(grids.quantised(emb(spark, sf)), 20), 64).select(*BC, "t", *rounded("v"))


@query("s08_quantise_block", "WITH {EMB}, s AS (SELECT source, block, min(v) AS lo, max(v) AS hi FROM g GROUP BY ALL) SELECT source, block, chan, t, CAST(greatest(0, least(255, floor((v - lo) / CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 1 END))) AS INTEGER) AS raw FROM g JOIN s USING (source, block)")
def _(spark, sf):
    return grids.quantised_block(emb(spark, sf)).select(*BC, "t", "raw")


@query("s09_s10_block_sink", "WITH {EMB} SELECT source, block, count(*) AS n, round(sum(CASE WHEN block = 1 THEN v + 1 ELSE v END), 4) AS total FROM g GROUP BY ALL")
def _(spark, sf):
    path = sinks.new_path(spark, "blocks")
    sinks.by_block(emb(spark, sf), path)
    back = sinks.by_block(emb(spark, sf).filter("block = 1").withColumn("v", F.col("v") + 1), path, overwrite=True, confirmed=sinks.CONFIRMATION)
    return back.select("source", F.col("block").cast("long").alias("block"), "v").groupBy(*B).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("s11_label_sink", "WITH {EMB} SELECT 'emb_block' || block AS name, CAST(CASE WHEN abs(v) > 0.3 THEN 6 ELSE 1 END AS INTEGER) AS label, count(*) AS n FROM g WHERE abs(v) > 0.3 OR chan = 5 GROUP BY ALL")
def _(spark, sf):
    labels = emb(spark, sf).withColumn("label", F.when(F.abs("v") > 0.3, 6).when(F.col("chan") == 5, 1).otherwise(0))
    return sinks.label_masks(labels, sinks.new_path(spark, "masks")).groupBy("name", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query("s12_frequency_axis", "WITH {EMB} SELECT DISTINCT chan, round(1382.0 - 200.0 + (chan + 0.5) * (400.0 / 64), 6) AS freq FROM g")
def _(spark, sf):
    return emb(spark, sf).select("chan").distinct().select("chan", F.round(grids.frequency(1382.0, -400.0, 64, F.col("chan")), 6).alias("freq"))


@query("s13_source_name", "SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(source || '_beam' || (doc_id % 3) || '_x.fits', '\\.[^.]*$', ''), '_'), 1, 2), '_') AS source FROM documents")
def _(spark, sf):
    d = grids.table(spark, sf, "documents")
    return d.select("doc_id", grids.source_name(F.concat(F.lit("/data/run/"), "source", F.lit("_beam"), F.col("doc_id") % 3, F.lit("_x.fits"))).alias("source"))


@query("s15_run_summary", "WITH {EMB} SELECT count(DISTINCT block) AS blocks, count(DISTINCT chan) AS nchan, max(t) + 1 AS nsamp, count(*) AS pixels, count(*) FILTER (abs(v) > 0.25) AS flagged, (SELECT count(*) % 48 FROM embeddings) AS tail_rows, CAST(3 AS DOUBLE) AS k_in, CAST(2.5 AS DOUBLE) AS k_out FROM g")
def _(spark, sf):
    pixels = emb(spark, sf).withColumn("m", F.abs("v") > 0.25)
    return sinks.run_summary(grids.table(spark, sf, "embeddings"), 48, pixels, "m", {"k_in": 3.0, "k_out": 2.5}, sinks.new_path(spark, "summary"))


@query("s23_file_lists", f"WITH {SAMPLES} SELECT 'before' AS list, name FROM smp WHERE split = 'train' UNION ALL SELECT 'after', name FROM smp WHERE split = 'val'")
def _(spark, sf):
    s = samples(spark, sf)
    return sinks.file_lists(s.filter("split = 'train'"), s.filter("split = 'val'"), "name", sinks.new_path(spark, "lists"))


@query("s16_manifest", f"WITH {SAMPLES} SELECT dataset, split, count(*) AS n FROM smp GROUP BY ALL")
def _(spark, sf):
    return sinks.json_lines(samples(spark, sf).select("dataset", "split", "name"), sinks.new_path(spark, "manifest")).groupBy("dataset", "split").agg(F.count("*").alias("n"))


@query("s17_metric_csv", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def _(spark, sf):
    m = grids.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return sinks.csv(m, sinks.new_path(spark, "metrics"))


TAG = "'val_' || CASE user_id % 4 WHEN 0 THEN 'iou' WHEN 1 THEN 'precision' WHEN 2 THEN 'recall' ELSE 'f1' END || '_cls_' || (event_id % 3) || '_' || event_type"


@query("s18_metric_log", f"""WITH m AS (SELECT {TAG} AS tag, event_id AS step, value FROM events), l AS (SELECT tag, arg_max(value, step) AS value FROM m GROUP BY ALL), x AS (SELECT regexp_extract(tag, '_cls_\\d+_(.*)$', 1) AS class, regexp_extract(tag, '^val_([a-z0-9]+)_', 1) AS metric, regexp_extract(tag, '_cls_(\\d+)_', 1) AS cls, value FROM l)
SELECT class, cls, round(max(value) FILTER (metric = 'iou'), 3) AS iou, round(max(value) FILTER (metric = 'precision'), 3) AS pre, round(max(value) FILTER (metric = 'recall'), 3) AS rec, round(max(value) FILTER (metric = 'f1'), 3) AS f1 FROM x GROUP BY ALL""")
def _(spark, sf):
    kind = F.when(F.col("user_id") % 4 == 0, "iou").when(F.col("user_id") % 4 == 1, "precision").when(F.col("user_id") % 4 == 2, "recall").otherwise("f1")
    log = grids.table(spark, sf, "events").select(F.concat(F.lit("val_"), kind, F.lit("_cls_"), F.col("event_id") % 3, F.lit("_"), "event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    last = log.groupBy("tag").agg(F.max_by("value", "step").alias("value"))
    parts = last.select(F.regexp_extract("tag", r"_cls_\d+_(.*)$", 1).alias("class"), F.regexp_extract("tag", r"^val_([a-z0-9]+)_", 1).alias("metric"), F.regexp_extract("tag", r"_cls_(\d+)_", 1).alias("cls"), "value")
    wide = parts.groupBy("class", "cls").pivot("metric", ["iou", "precision", "recall", "f1"]).agg(F.max("value"))
    return wide.select("class", "cls", *[F.round(a, 3).alias(b) for a, b in (("iou", "iou"), ("precision", "pre"), ("recall", "rec"), ("f1", "f1"))])


@query("s19_split_counts", f"WITH {SAMPLES} SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM smp GROUP BY ALL")
def _(spark, sf):
    return samples(spark, sf).groupBy("dataset").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))


@query("s21_newest_file")
def _(spark, sf):
    return sinks.newest(spark, f"{sf}/events.parquet")


@query("s22_commit_plan", f"WITH {SAMPLES} SELECT name, 'new_' || name AS target, dataset, split, doc_id, factor FROM smp")
def _(spark, sf):
    s = samples(spark, sf)
    plan = s.select("name", F.concat(F.lit("new_"), "name").alias("target"))
    return sinks.committed(plan, s, s.select(F.col("name").alias("target")), sinks.new_path(spark, "commit")).select("name", "target", "dataset", "split", "doc_id", "factor")


@query("r01_r03_time_mean", "WITH {EMB} SELECT source, block, chan, CAST(t // 7 AS INTEGER) AS t, round(avg(v), 6) AS v FROM g WHERE t < 98 GROUP BY source, block, chan, t // 7")
def _(spark, sf):
    return R.block_mean(emb(spark, sf), 1, 7, nsamp=100).select(*BC, "t", *rounded("v"))


@query("r02_block_mean", "WITH {EMB} SELECT source, block, CAST(chan // 4 AS INTEGER) AS chan, CAST(t // 5 AS INTEGER) AS t, round(avg(v), 6) AS v FROM g GROUP BY source, block, chan // 4, t // 5")
def _(spark, sf):
    return R.strict_block_mean(emb(spark, sf), 4, 5, 64, 100).select(*BC, "t", *rounded("v"))


@query("r04_nearest", "WITH {EMB}, c AS (SELECT source, block, CAST(chan // 4 AS INTEGER) AS chan, CAST(t // 5 AS INTEGER) AS t, round(avg(v), 6) AS v FROM g GROUP BY source, block, chan // 4, t // 5) SELECT source, block, CAST(i AS INTEGER) AS chan, CAST(j AS INTEGER) AS t, v FROM c, range(0, 40) a(i), range(0, 50) b(j) WHERE chan = i * 16 // 40 AND t = j * 20 // 50")
def _(spark, sf):
    return R.nearest(R.block_mean(emb(spark, sf), 4, 5), (16, 20), (40, 50), "v").select(*BC, "t", *rounded("v"))


@query("r05_r06_transpose_flip", "WITH {EMB} SELECT source, block, t AS chan, 63 - chan AS t, v FROM g")
def _(spark, sf):
    return R.transposed(R.flipped(emb(spark, sf), 64)).select(*B, "chan", "t", "v")


@query("r07_stitch", "WITH {EMB}, w AS (SELECT source, block // 2 AS wide FROM g GROUP BY ALL HAVING count(DISTINCT block) = 2) SELECT g.source, CAST(block // 2 AS BIGINT) AS block, chan, CAST(t + (block % 2) * 100 AS INTEGER) AS t, v FROM g JOIN w ON g.source = w.source AND block // 2 = wide")
def _(spark, sf):
    return grids.stitched(emb(spark, sf), 2, 100)


PLACE = "greatest(0.0, least({s} - 1.0, ({i} + 0.5) * {s} / {d} - 0.5))"


@query("r08_bilinear", "WITH {EMB}, c AS (SELECT source, block, CAST(chan // 8 AS INTEGER) AS chan, CAST(t // 10 AS INTEGER) AS t, avg(v) AS v FROM g GROUP BY source, block, chan // 8, t // 10), x AS (SELECT source, block, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, v * greatest(0.0, 1 - abs(" + PLACE.format(s=8, d=12, i="i") + " - chan)) * greatest(0.0, 1 - abs(" + PLACE.format(s=10, d=25, i="j") + " - t)) AS v FROM c, range(0, 12) a(i), range(0, 25) b(j)) SELECT source, block, i AS chan, j AS t, round(sum(v), 6) AS v FROM x GROUP BY ALL")
def _(spark, sf):
    return R.bilinear(R.block_mean(emb(spark, sf), 8, 10), (8, 10), (12, 25)).select(*BC, "t", *rounded("v"))


@query("r09_focus_crop", f"WITH {{EMB}}, l AS (SELECT *, CASE WHEN abs(v) > 0.35 THEN 6 ELSE 0 END AS label FROM g), r AS (SELECT *, {draw_sql(1, 'source', 'block', 'chan', 't')} AS r FROM l WHERE label = 6), p AS (SELECT source, block, chan AS pc, t AS pt FROM (SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY r, chan, t) AS k FROM r) WHERE k = 1), b AS (SELECT DISTINCT source, block FROM g), u AS (SELECT *, {draw_sql(2, 'source', 'block')} AS u, {draw_sql(3, 'source', 'block')} AS w FROM b LEFT JOIN p USING (source, block)), c AS (SELECT source, block, greatest(0, least(48, CASE WHEN pc IS NOT NULL AND u % 1000 < 700 THEN pc - 8 ELSE u % 49 END)) AS c0, greatest(0, least(68, CASE WHEN pc IS NOT NULL AND u % 1000 < 700 THEN pt - 16 ELSE w % 69 END)) AS t0 FROM u) SELECT source, block, CAST(chan - c0 AS INTEGER) AS chan, CAST(t - t0 AS INTEGER) AS t, label FROM l JOIN c USING (source, block) WHERE chan BETWEEN c0 AND c0 + 15 AND t BETWEEN t0 AND t0 + 31")
def _(spark, sf):
    labels = emb(spark, sf).withColumn("label", F.when(F.abs("v") > 0.35, 6).otherwise(0))
    return R.focus_crop(labels, 16, 32, 64, 100, 6, 0.7).select(*BC, "t", "label")


@query("r10_tiles", "WITH {EMB}, s AS (SELECT unnest([0, 20, 40, 60, 70]) AS tile), x AS (SELECT g.*, tile, avg(v) OVER (PARTITION BY source, block, chan, tile) AS m FROM g JOIN s ON t >= tile AND t < tile + 30) SELECT source, block, chan, t, round(avg(v - m), 6) AS v FROM x GROUP BY ALL")
def _(spark, sf):
    from pyspark.sql import Window

    own = R.tiles(emb(spark, sf), 100, 30, 20)
    own = own.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*BC, "tile")))
    return R.merged_tiles(own, "v").select(*BC, "t", *rounded("v"))


@query("r11_pad", "WITH {EVT}, c AS (SELECT 'evt' AS source, CAST(0 AS BIGINT) AS block, CAST(i AS INTEGER) AS chan, CAST(j AS INTEGER) AS t FROM range(0, 16) a(i), range(0, 720) b(j)) SELECT c.source, c.block, c.chan, c.t, coalesce(v, 0) AS v FROM c LEFT JOIN g USING (source, block, chan, t)")
def _(spark, sf):
    return R.padded(grids.event_grid(spark, sf), 16, 720).select(*BC, "t", "v")


@query("r12_pack_unpack", "WITH {EMB} SELECT source, block, chan, t, v FROM g")
def _(spark, sf):
    return grids.unpacked(grids.packed(emb(spark, sf)))


@query("p01_p02_p06_channel_masks", "WITH {EMB} SELECT source, block, chan, t, abs(v) > 0.2 AND chan IN (3, 7, 70) AS listed, abs(v) > 0.2 AND chan BETWEEN 60 AND 63 AS ranged, abs(v) > 0.2 OR chan IN (1, 2) AS zapped FROM g")
def _(spark, sf):
    g = emb(spark, sf).withColumn("m", F.abs("v") > 0.2)
    return g.select(*BC, "t", P.only_channels("m", [3, 7, 70]).alias("listed"), P.only_range("m", 60, 99, 64).alias("ranged"), (F.col("m") | F.col("chan").isin(1, 2)).alias("zapped"))


@query("p03_p04_frequency", "WITH {EMB}, f AS (SELECT DISTINCT source, block, chan, 1000.0 + chan * 2.5 AS freq FROM g) SELECT source, block, arg_min(chan, abs(freq - 1076.3)) AS chan FROM f WHERE freq BETWEEN 1010 AND 1150 GROUP BY ALL")
def _(spark, sf):
    f = emb(spark, sf).select(*BC).distinct().withColumn("freq", 1000.0 + F.col("chan") * 2.5).filter(F.col("freq").between(1010, 1150))
    return P.closest_channel(f, "freq", 1076.3)


@query("p05_p13_label_filters", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 3) THEN l_linenumber ELSE 0 END AS shown FROM lineitem WHERE l_linenumber IN (0, 1, 2, 6, 7, 8)")
def _(spark, sf):
    li = grids.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return li.filter(P.valid("l_linenumber")).select("l_orderkey", "l_linenumber", P.shown("l_linenumber", "1, 3").alias("shown"))


@query("p07_p12_names", f"""WITH {SAMPLES}, n AS (SELECT doc_id, name || CASE WHEN doc_id % 3 = 0 THEN '_Downsamp' || factor ELSE '' END AS name FROM smp) SELECT doc_id, CAST(nullif(regexp_extract(name, 'block(\\d+)', 1), '') AS INTEGER) AS block_id, CAST(nullif(regexp_extract(name || '.png', 'block(\\d+)\\.png$', 1), '') AS INTEGER) AS anchored,
coalesce(CAST(nullif(regexp_extract(name, '_Downsamp(\\d+)$', 1), '') AS INTEGER), 1) AS factor, regexp_replace(name, '_Downsamp\\d+$', '') AS base, regexp_replace(name, '_block\\d+$', '') AS cover, coalesce(CAST(nullif(regexp_extract(name, '(?:block|mask_merged_)(\\d+)', 1), '') AS BIGINT), 0) AS key, starts_with(name, 'src1') OR starts_with(name, 'src2') AS protected FROM n""")
def _(spark, sf):
    n = samples(spark, sf).select("doc_id", F.concat("name", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_Downsamp"), "factor")).otherwise("")).alias("name"))
    c = F.col("name")
    return n.select("doc_id", P.block_id(c).alias("block_id"), P.block_id(F.concat(c, F.lit(".png")), True).alias("anchored"), P.factor(c).alias("factor"), P.base_name(c).alias("base"), P.cover_name(c).alias("cover"), P.numeric_key(c).alias("key"), P.protected(c, ["src1", "src2"]).alias("protected"))


@query("p11_name_style", f"WITH {SAMPLES} SELECT name FROM smp WHERE name LIKE 'src1\\_%' ESCAPE '\\'")
def _(spark, sf):
    return P.chosen_style(samples(spark, sf).select("name"), "name", ["none%", "src1\\_%", "src%"])
