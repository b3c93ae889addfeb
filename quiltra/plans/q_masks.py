"""Queries of mask algebra, components, substitution and whole flows."""

from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC, rounded
from quiltra.operators import flows
from quiltra.operators import morphology as M
from quiltra.operators import substitute as X
from quiltra.sources import grids

from . import flow_sql
from .base import draw_sql, query

emb = grids.embedding_grid


def points(spark, sf, limit=0.2):
    return grids.by_block(emb(spark, sf)).withColumn("m", F.abs("v") > limit)


def box_sql(value: str, h: int, w: int, how: str, name: str, rows: str, keep: str = "") -> str:
    """Tables {name}_t and {name}: ``how`` of value over h x w boxes."""
    return f"""{name}_t AS (SELECT source, block, chan, t{keep}, {how}({value}) OVER (PARTITION BY source, block, chan ORDER BY t ROWS BETWEEN {(w - 1) // 2} PRECEDING AND {w // 2} FOLLOWING) AS x FROM {rows}),
{name} AS (SELECT source, block, chan, t{keep}, {how}(x) OVER (PARTITION BY source, block, t ORDER BY chan ROWS BETWEEN {(h - 1) // 2} PRECEDING AND {h // 2} FOLLOWING) AS x FROM {name}_t)"""


MASKS = "p AS (SELECT *, abs(v) > 0.2 AS m, CASE WHEN abs(v) > 0.2 THEN 1 ELSE 0 END AS i FROM g)"


@query("m01_m03_m04_m15_labels", "WITH {EMB}, p AS (SELECT source, block, chan, t, t % 9 = 0 AS m_vert, abs(v) > 0.25 AS m_point, false AS m_periodic, chan BETWEEN 10 AND 12 AND t < 30 AS m_block, (chan + t) % 17 = 0 AS m_pulse, chan % 20 = 5 AS m_horiz FROM g), l AS (SELECT *, CASE WHEN m_horiz THEN 1 WHEN m_pulse THEN 8 WHEN m_block THEN 7 WHEN m_point THEN 6 WHEN m_vert THEN 2 ELSE 0 END AS full_label FROM p) SELECT source, block, chan, t, m_vert OR m_point OR m_block OR m_pulse OR m_horiz AS m_global, full_label, CASE WHEN m_pulse THEN 5 WHEN m_block THEN 4 WHEN m_point THEN 3 WHEN m_horiz THEN 1 WHEN m_vert THEN 2 ELSE 0 END AS short_label, CASE full_label WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 8 THEN 5 ELSE full_label END AS code FROM l")
def _(spark, sf):
    p = emb(spark, sf).withColumns({"m_vert": F.col("t") % 9 == 0, "m_point": F.abs("v") > 0.25, "m_periodic": F.lit(False), "m_block": F.col("chan").between(10, 12) & (F.col("t") < 30), "m_pulse": (F.col("chan") + F.col("t")) % 17 == 0, "m_horiz": F.col("chan") % 20 == 5})
    p = p.withColumns({"full_label": M.labels_by_priority(M.FULL_ORDER), "short_label": M.labels_by_priority(M.SIMPLE_ORDER)})
    return p.select(*BC, "t", (F.col("m_vert") | F.col("m_point") | F.col("m_block") | F.col("m_pulse") | F.col("m_horiz")).alias("m_global"), "full_label", "short_label", M.mapped("full_label", M.CONTIGUOUS).alias("code"))


@query("m02_merge_last_wins", "WITH {EMB} SELECT source, block, chan, t, greatest(CASE WHEN abs(v) > 0.1 THEN 1 ELSE 0 END, CASE WHEN chan % 7 = 0 THEN 2 ELSE 0 END, CASE WHEN t % 11 = 0 THEN 3 ELSE 0 END) AS label FROM g")
def _(spark, sf):
    masks = [F.abs("v") > 0.1, F.col("chan") % 7 == 0, F.col("t") % 11 == 0]
    return emb(spark, sf).select(*BC, "t", M.merged(masks).alias("label"))


@query("m05_j08_expand_channels", "WITH {EMB}, f AS (SELECT source, block, chan, max(v) > 0.4 AS flag FROM g GROUP BY ALL) SELECT source, block, chan, t, flag FROM g JOIN f USING (source, block, chan)")
def _(spark, sf):
    g = emb(spark, sf)
    return M.expanded(g, g.groupBy(*BC).agg((F.max("v") > 0.4).alias("flag")), BC).select(*BC, "t", "flag")


@query("m06_w03_without_lonely", "WITH {EMB}, " + MASKS + ", " + box_sql("i", 3, 3, "sum", "n", "p", ", m") + " SELECT source, block, chan, t, m AND x > 1 AS m FROM n")
def _(spark, sf):
    return M.without_lonely(points(spark, sf), "m").select(*BC, "t", "m")


@query("m07_dilated_diamond", "WITH {EMB}, " + MASKS + ", d AS (SELECT DISTINCT source, block, chan + a AS chan, t + b AS t FROM p, range(-2, 3) x(a), range(-2, 3) y(b) WHERE m AND abs(a) + abs(b) <= 2) SELECT source, block, chan, t, d.t IS NOT NULL AS m FROM p LEFT JOIN d USING (source, block, chan, t)")
def _(spark, sf):
    return M.dilated_diamond(points(spark, sf), "m", 2).select(*BC, "t", "m")


@query("m08_closed", "WITH {EMB}, " + MASKS + ", " + box_sql("i", 3, 5, "max", "a", "p") + ", " + box_sql("x", 3, 5, "min", "b", "a") + " SELECT source, block, chan, t, x = 1 AS m FROM b")
def _(spark, sf):
    return M.closed(points(spark, sf), "m", 3, 5).select(*BC, "t", "m")


@query("m09_voted", "WITH {EMB}, " + MASKS + ", o AS (SELECT *, 1 AS k FROM p), " + box_sql("i", 3, 3, "sum", "a", "o", ", m, k") + ", " + box_sql("k", 3, 3, "sum", "b", "o") + " SELECT source, block, chan, t, CASE WHEN a.x / b.x >= 0.5 THEN true WHEN a.x / b.x < 0.2 THEN false ELSE m END AS m FROM a JOIN b USING (source, block, chan, t)")
def _(spark, sf):
    return M.voted(points(spark, sf), "m", 3, 0.5, 0.2).select(*BC, "t", "m")


@query("m10_cleaned_points", "WITH {EMB}, " + MASKS + ", " + box_sql("i", 3, 3, "sum", "a", "p", ", m") + ", q AS (SELECT source, block, chan, t, CASE WHEN m AND x > 2 THEN 1 ELSE 0 END AS i FROM a), " + box_sql("i", 3, 3, "max", "b", "q") + ", " + box_sql("x", 3, 3, "sum", "c", "b") + ", r AS (SELECT source, block, chan, t, CASE WHEN x >= 5 THEN 1 ELSE 0 END AS i FROM c), " + box_sql("i", 3, 3, "max", "d", "r") + " SELECT source, block, chan, t, x = 1 AS m FROM d")
def _(spark, sf):
    return M.cleaned_points(points(spark, sf), "m").select(*BC, "t", "m")


def comp_sql(rows: str) -> str:
    """Recursive tables of the 8-connected components of the cells in ``rows``: p (cells with id), l (id, comp) and bx (boxes)."""
    return f"""p AS (SELECT source, block, chan, t, block * 100000 + chan * 1000 + t AS id FROM {rows}), o AS (SELECT CAST(da * 1000 + db AS BIGINT) AS o FROM range(-1, 2) x(da), range(-1, 2) y(db)),
e AS (SELECT a.id AS a, b.id AS b FROM (SELECT id, id + o AS near FROM p, o) a JOIN p b ON a.near = b.id), r AS (SELECT id, id AS comp FROM p UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(comp) AS comp FROM r GROUP BY id),
bx AS (SELECT comp, min(chan) AS c0, max(chan) AS c1, min(t) AS t0, max(t) AS t1, count(*) AS area, max(chan) - min(chan) + 1 AS h, max(t) - min(t) + 1 AS w FROM p JOIN l USING (id) GROUP BY comp)"""


COMP = "WITH RECURSIVE {EMB}, p AS (SELECT source, block, chan, t, block * 100000 + chan * 1000 + t AS id FROM g WHERE abs(v) > 0.2), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.source = b.source AND a.block = b.block AND abs(a.chan - b.chan) <= 1 AND abs(a.t - b.t) <= 1), r AS (SELECT id, id AS comp FROM p UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(comp) AS comp FROM r GROUP BY id)"


@query("m11_components", COMP + " SELECT source, block, min(chan) AS c0, max(chan) AS c1, min(t) AS t0, max(t) AS t1, count(*) AS area FROM p JOIN l USING (id) GROUP BY source, block, comp")
def _(spark, sf):
    return M.boxes(M.components(points(spark, sf), "m")).select(*B, "c0", "c1", "t0", "t1", "area")


@query("m12_repaired_lines", "WITH {EMB}, l AS (SELECT source, block, chan, t, CASE WHEN v > 0.15 THEN 1 WHEN v < -0.2 THEN 3 ELSE 0 END AS label FROM g), a AS (SELECT *, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source, block, chan ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM l), b AS (SELECT *, min(x) OVER (PARTITION BY source, block, chan ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS y FROM a) SELECT source, block, chan, t, CASE WHEN label = 0 AND y = 1 THEN 1 ELSE label END AS label FROM b")
def _(spark, sf):
    own = emb(spark, sf).withColumn("label", F.when(F.col("v") > 0.15, 1).when(F.col("v") < -0.2, 3).otherwise(0))
    return M.repaired_lines(own, "label", 7).select(*BC, "t", "label")


def _coded(spark, sf):
    return emb(spark, sf).withColumn("label", F.when(F.col("v") > 0.18, 3).when(F.col("v") < -0.25, 2).when(F.col("chan") == 9, 1).otherwise(0))


CODED = "y AS (SELECT *, CASE WHEN v > 0.18 THEN 3 WHEN v < -0.25 THEN 2 WHEN chan = 9 THEN 1 ELSE 0 END AS label FROM g)"


def to_blocks_sql(classes: str, verdict: str, label: str) -> str:
    """SQL of y with labels by the verdict on the component, closed over 3 x 3, that a pixel lies in."""
    closed = "yi AS (SELECT *, CASE WHEN label IN (" + classes + ") THEN 1 ELSE 0 END AS i FROM y), " + box_sql("i", 3, 3, "max", "ya", "yi") + ", " + box_sql("x", 3, 3, "min", "yb", "ya")
    return "WITH RECURSIVE {EMB}, " + CODED + ", " + closed + ", yc AS (SELECT * FROM yb WHERE x = 1), " + comp_sql("yc") + f", j AS (SELECT source, block, chan, t, {verdict} AS k FROM p JOIN l USING (id) JOIN bx USING (comp)) SELECT source, block, chan, t, {label} AS label FROM y LEFT JOIN j USING (source, block, chan, t)"


@query("m13_points_to_blocks", to_blocks_sql("3, 4", "CASE WHEN area > 12 AND h >= 3 AND w >= 3 AND w / h > 0.2 AND w / h < 5 THEN 1 ELSE 0 END", "CASE WHEN k = 1 AND label IN (0, 3) THEN 4 WHEN k = 0 AND label = 0 THEN 3 ELSE label END"))
def _(spark, sf):
    return M.points_to_blocks(_coded(spark, sf), "label", 3, 12, 3).select(*BC, "t", "label")


@query("m14_points_to_blocks_main", to_blocks_sql("2, 3, 4", "CASE WHEN area < 0.45 * h * w AND w > 10 THEN 3 WHEN (area > 800 AND w >= 20 AND h >= 20 AND w / h > 0.25 AND w / h < 4) OR (area > 1500 AND w / h > 0.2 AND w / h < 5) THEN 4 WHEN area < 400 THEN 3 END", "CASE WHEN k = 4 AND label IN (0, 2, 3) THEN 4 WHEN k = 3 THEN 3 ELSE label END"))
def _(spark, sf):
    return M.points_to_blocks_main(_coded(spark, sf), "label", 3).select(*BC, "t", "label")


@query("m16_binary", "WITH {EMB} SELECT source, block, chan, t, CASE WHEN v > 0.2 THEN 1 ELSE 0 END AS label FROM g")
def _(spark, sf):
    return M.binary(emb(spark, sf).withColumn("label", F.when(F.col("v") > 0.2, 255).otherwise(0)), "label").select(*BC, "t", "label")


SPARSE = "b0 AS (SELECT source, block, chan, t, abs(v) > 0.42 AS m FROM g)"


def blocks_sql(shape: str) -> str:
    within = "EXISTS (SELECT 1 FROM bl WHERE bl.source = b0.source AND bl.block = b0.block AND b0.chan BETWEEN c0 AND c1 AND b0.t BETWEEN t0 AND t1)"
    return f"WITH RECURSIVE {{EMB}}, {SPARSE}, {flow_sql.blocks('b0', 150, shape, 7)} SELECT source, block, chan, t, {within} AS m_block FROM b0"


@query("d24_blocks", blocks_sql("diamond"))
def _(spark, sf):
    return M.blocks(emb(spark, sf).withColumn("m", F.abs("v") > 0.42), "m", area=150, diamond=7).select(*BC, "t", "m_block")


@query("d24_blocks_square", blocks_sql("square"))
def _(spark, sf):
    return M.blocks(emb(spark, sf).withColumn("m", F.abs("v") > 0.42), "m", 15, 15, 150).select(*BC, "t", "m_block")


@query("m07_diamond_of_seven", f"WITH {{EMB}}, {SPARSE}, {flow_sql.grown('b0', 'diamond', 7, 'd')} SELECT source, block, b0.chan, b0.t, d.t IS NOT NULL AS m FROM b0 LEFT JOIN d USING (source, block, chan, t)")
def _(spark, sf):
    return M.dilated_diamond(emb(spark, sf).withColumn("m", F.abs("v") > 0.42), "m", 7).select(*BC, "t", "m")


DRAW = draw_sql(1, "source", "block", "chan", "t")


@query("x01_x02_in_channel", f"WITH {{EMB}}, {MASKS}, s AS (SELECT source, block, chan, list(v ORDER BY t) FILTER (NOT m) AS own FROM p GROUP BY ALL) SELECT source, block, chan, t, CASE WHEN m AND len(own) > 0 THEN own[{DRAW} % len(own) + 1] ELSE v END AS v FROM p JOIN s USING (source, block, chan)")
def _(spark, sf):
    return X.in_channel(points(spark, sf), "m").select(*BC, "t", "v")


@query("x03_across_channels", f"WITH {{EMB}}, p AS (SELECT *, abs(v) > 0.2 AS m, chan % 8 = 3 AS f FROM g), s AS (SELECT source, block, t, list(v ORDER BY chan) FILTER (NOT m AND NOT f) AS own FROM p GROUP BY ALL) SELECT source, block, chan, t, CASE WHEN f THEN coalesce(own[{DRAW} % len(own) + 1], 0.0) ELSE v END AS v FROM p JOIN s USING (source, block, t)")
def _(spark, sf):
    return X.across_channels(points(spark, sf).withColumn("f", F.col("chan") % 8 == 3), "f", "m").select(*BC, "t", "v")


CLASSES = "y AS (SELECT *, CASE WHEN v > 0.2 THEN 5 WHEN chan % 16 = 2 THEN 1 WHEN v < -0.2 THEN 3 ELSE 0 END AS label FROM g)"


def by_class_sql(aware: bool = True) -> str:
    """Tables that clean y (source, block, chan, t, v, label) along time, then along channels, into z."""
    wanted, kept = ("(label <> 5 OR lined)", "label <> 5") if aware else ("true", "true")
    return f"""yc AS (SELECT source, block, chan, bool_or(label = 1) AS lined, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) > 0.05 AS enough, list(v ORDER BY t) FILTER (label = 0) AS own FROM y GROUP BY ALL),
y1 AS (SELECT source, block, chan, t, label, v AS old, CASE WHEN label <> 0 AND {wanted} AND enough AND len(own) > 0 THEN own[{draw_sql(1, 'source', 'block', 'chan', 't')} % len(own) + 1] ELSE v END AS v FROM y JOIN yc USING (source, block, chan)),
yt AS (SELECT source, block, t, list(v ORDER BY chan) FILTER (label = 0) AS own FROM y1 GROUP BY ALL),
z AS (SELECT source, block, chan, t, label, CASE WHEN label <> 0 AND abs(v - old) < 1e-7 AND {kept} AND len(own) > 0 THEN own[{draw_sql(2, 'source', 'block', 'chan', 't')} % len(own) + 1] ELSE v END AS v FROM y1 JOIN yt USING (source, block, t))"""


def _classes(spark, sf):
    return emb(spark, sf).withColumn("label", F.when(F.col("v") > 0.2, 5).when(F.col("chan") % 16 == 2, 1).when(F.col("v") < -0.2, 3).otherwise(0))


@query("x04_class_aware", f"WITH {{EMB}}, {CLASSES}, {by_class_sql()} SELECT source, block, chan, t, v FROM z")
def _(spark, sf):
    return X.by_class(_classes(spark, sf), "label").select(*BC, "t", "v")


@query("x05_class_blind", f"WITH {{EMB}}, {CLASSES}, {by_class_sql(False)} SELECT source, block, chan, t, v FROM z")
def _(spark, sf):
    return X.by_class(_classes(spark, sf), "label", aware=False).select(*BC, "t", "v")


@query("x06_without_baseline", "WITH {EMB}, m AS (SELECT source, block, chan, quantile_disc(v, 0.5) AS med FROM g GROUP BY ALL) SELECT source, block, chan, t, round(v - med, 6) AS v FROM g JOIN m USING (source, block, chan)")
def _(spark, sf):
    return X.without_baseline(emb(spark, sf)).select(*BC, "t", *rounded("v"))


@query("x07_normalised", "WITH {EMB}, s AS (SELECT source, block, avg(v) AS m, stddev_pop(v) AS s FROM g GROUP BY ALL) SELECT source, block, chan, t, round(CASE WHEN s <= 1e-6 THEN 0.5 ELSE greatest(0, least(1, (v - (m - 3 * s)) / (6 * s))) END, 6) AS v FROM g JOIN s USING (source, block)")
def _(spark, sf):
    return X.normalised(emb(spark, sf)).select(*BC, "t", *rounded("v"))


@query("x08_standardised", "WITH {EMB}, s AS (SELECT source, block, avg(v) AS m, stddev_pop(v) AS s FROM g GROUP BY ALL) SELECT source, block, chan, t, round(CASE WHEN s <= 1e-6 THEN 0 ELSE (v - m) / (3 * s) END, 6) AS v FROM g JOIN s USING (source, block)")
def _(spark, sf):
    return X.standardised(emb(spark, sf), 3.0).select(*BC, "t", *rounded("v"))


@query("x09_pulses_to_median", "WITH {EMB}, s AS (SELECT source, block, quantile_cont(v, 0.5) AS m FROM g GROUP BY ALL) SELECT source, block, chan, t, CASE WHEN (chan + t) % 17 = 0 THEN round(m, 6) ELSE round(v, 6) END AS v FROM g JOIN s USING (source, block)")
def _(spark, sf):
    return X.pulses_to_median(emb(spark, sf).withColumn("m", (F.col("chan") + F.col("t")) % 17 == 0), "m").select(*BC, "t", *rounded("v"))


def _pulse(spark, sf):
    f = emb(spark, sf).select(*BC).distinct().withColumn("freq", 1000.0 + F.col("chan") * 5)
    return flows.pulse_pixels(f, "freq", flows.PulseTrain(30.0, 0.25, 0.05, 2, 0.01, 100))


def _full(spark, sf, detector):
    out = flows.full_flow(emb(spark, sf), 64, 100, 2.5, 2.0, detector=detector, area=20, pulse=_pulse(spark, sf))
    masks = [f"m_{k}" for k in "point horiz vert block pulse bright dark complex global".split()]
    return out.select(*BC, "t", *masks, "label", *rounded("final_med", "final_rms"))


@query("d32_full_flow", flow_sql.full(flow_sql.SIGMA))
def _(spark, sf):
    return _full(spark, sf, "sigma")


@query("d32_iqrm_flow", flow_sql.full(flow_sql.IQRM))
def _(spark, sf):
    return _full(spark, sf, "iqrm")


@query("d32_tukey_flow", flow_sql.full(flow_sql.TUKEY))
def _(spark, sf):
    return _full(spark, sf, "tukey")


@query("d33_short_flow", flow_sql.SHORT)
def _(spark, sf):
    pulse = _pulse(spark, sf)
    return flows.short_flow(emb(spark, sf), pulse, 2.5, 2.0, area=20).select(*BC, "t", "label")


MASKED = "h AS (SELECT *, abs(v) > 0.3 AS m FROM g)"


@query("d35_low_pass_residual", f"WITH {{EMB}}, {MASKED}, {flow_sql.low_pass('h', 'm')}, r AS ({flow_sql.residual('h')}) SELECT source, block, chan, t, round(v, 6) AS v FROM r")
def _(spark, sf):
    own = emb(spark, sf).withColumn("m", F.abs("v") > 0.3)
    return flows.low_pass_residual(own, 64, 100, mask="m").select(*BC, "t", *rounded("v"))


@query("d37_strategy", flow_sql.strategy(1.0))
def _(spark, sf):
    return flows.strategy(emb(spark, sf), 64, 100, 1.0)
