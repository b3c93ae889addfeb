"""SQL of the whole labelling flows, step by step, for DuckDB. Each function returns common table expressions."""

from .base import draw_sql
from .q_detect import C, PULSE, S, T, clip_sql, iqrm_sql, noise_sql, repeated, threshold_sql

DRAW = {seed: draw_sql(seed, "source", "block", "chan", "t") for seed in (1, 2)}


def box(value: str, h: int, w: int, how: str, name: str, rows: str, keep: str = "") -> str:
    along = f"{how}({value}) OVER (PARTITION BY {C} ORDER BY t ROWS BETWEEN {(w - 1) // 2} PRECEDING AND {w // 2} FOLLOWING)"
    across = f"{how}(x) OVER (PARTITION BY {T} ORDER BY chan ROWS BETWEEN {(h - 1) // 2} PRECEDING AND {h // 2} FOLLOWING)"
    return f"{name}_t AS (SELECT {C}, t{keep}, {along} AS x FROM {rows}), {name} AS (SELECT {C}, t{keep}, {across} AS x FROM {name}_t)"


def boxes(rows: str, name: str) -> str:
    """{name}: boxes of the 8-connected components of the cells in ``rows``; labels fall until none changes."""
    return f"""
{name}_p AS (SELECT {C}, t, block * 100000 + chan * 1000 + t AS id FROM {rows}),
{name}_e AS (
  SELECT x.id AS a, y.id AS b
  FROM (SELECT id, id + da * 1000 + db AS near FROM {name}_p, range(-1, 2) i(da), range(-1, 2) j(db)) x JOIN {name}_p y ON x.near = y.id),
{name}_l(id, comp) USING KEY (id) AS (
  SELECT id, id FROM {name}_p
  UNION SELECT e.b, min(l.comp) FROM {name}_l l JOIN {name}_e e ON e.a = l.id JOIN recurring.{name}_l o ON o.id = e.b
  WHERE l.comp < o.comp GROUP BY e.b),
{name} AS (
  SELECT source, block, min(chan) AS c0, max(chan) AS c1, min(t) AS t0, max(t) AS t1, count(*) AS area,
    max(chan) - min(chan) + 1 AS h, max(t) - min(t) + 1 AS w
  FROM {name}_p JOIN {name}_l USING (id) GROUP BY source, block, comp)"""


def grown(points: str, shape: str, radius: int, name: str) -> str:
    """{name}: the cells of 64 x 100 within a diamond or a square about the points m of ``points``."""
    inside = f"abs(da) + abs(db) <= {radius}" if shape == "diamond" else "true"
    return f"""
{name} AS (
  SELECT DISTINCT source, block, CAST(chan + da AS INTEGER) AS chan, CAST(t + db AS INTEGER) AS t
  FROM {points}, range({-radius}, {radius + 1}) i(da), range({-radius}, {radius + 1}) j(db)
  WHERE m AND {inside} AND chan + da BETWEEN 0 AND 63 AND t + db BETWEEN 0 AND 99)"""


def blocks(points: str, area: int, shape: str, radius: int, name: str = "bl") -> str:
    """{name}: boxes of large, full components of the points m of ``points``, grown first."""
    cells = grown(points, shape, radius, f"{name}_c")
    return f"{cells}, {boxes(f'{name}_c', f'{name}_x')}, {name} AS (SELECT * FROM {name}_x WHERE area >= {area} AND area >= 0.5 * h * w AND w / h BETWEEN 0.2 AND 5)"


IN_BLOCK = "EXISTS (SELECT 1 FROM bl WHERE bl.source = {0}.source AND bl.block = {0}.block AND {0}.chan BETWEEN c0 AND c1 AND {0}.t BETWEEN t0 AND t1)"
IN_REPEATED = "EXISTS (SELECT 1 FROM rr WHERE rr.source = {0}.source AND rr.block = {0}.block AND {0}.t BETWEEN first AND last)"


def replaced(rows: str, name: str) -> str:
    """{name}_c (own, cancel by channel) and {name}: points m of ``rows`` by clean ones of their channel."""
    return f"""
{name}_c AS (SELECT {C}, list(v ORDER BY t) FILTER (NOT m) AS own, avg(CASE WHEN m THEN 1.0 ELSE 0.0 END) > 0.3 AS cancel FROM {rows} GROUP BY ALL),
{name} AS (SELECT {C}, t, m, CASE WHEN m AND len(own) > 0 THEN own[{DRAW[1]} % len(own) + 1] ELSE v END AS v FROM {rows} JOIN {name}_c USING ({C}))"""


#: ch: deviation, mean of the clean values, and mean of all if none is clean, of each channel of w1.
CHANNELS = f"""
ch AS (
  SELECT {C}, CASE WHEN count(*) FILTER (NOT m) <= 1 THEN stddev_pop(v) ELSE stddev_pop(v) FILTER (NOT m) END AS std,
    avg(v) FILTER (NOT m) AS mean, coalesce(avg(v) FILTER (NOT m), avg(v)) AS mall
  FROM w1 GROUP BY ALL),
xs AS (SELECT {C}, std AS v FROM ch)"""

#: hx: pixels of w1 with the mask h of the detector.
SIGMA = f"""{CHANNELS}, {clip_sql("cs", "xs", S, 2.0, 30, floor=True, rate=0.01)},
ca AS (SELECT {C}, mean, mall, std < a[1] OR std > a[len(a)] AS fa FROM ch JOIN cs USING ({S})),
ci AS (SELECT *, chan - row_number() OVER (PARTITION BY {S}, fa ORDER BY chan) AS island FROM ca),
cr AS (SELECT source, block, min(chan) AS f, max(chan) AS l, count(*) AS n FROM ci WHERE fa GROUP BY source, block, island),
cn AS (SELECT *, f - lag(l) OVER w AS a, lead(f) OVER w - l AS b FROM cr WINDOW w AS (PARTITION BY {S} ORDER BY f)),
ck AS (SELECT * FROM cn WHERE n > 2 OR coalesce(a <= 2, false) OR coalesce(b <= 2, false)),
cb AS (SELECT {C}, mean, mall, EXISTS (SELECT 1 FROM ck WHERE ck.source = ca.source AND ck.block = ca.block AND ca.chan BETWEEN f AND l) AS fs FROM ca),
cm AS (
  SELECT {S}, quantile_disc(mean, 0.5) FILTER (NOT fs) AS mid, stddev_pop(mean) FILTER (NOT fs) AS dev, count(mean) FILTER (NOT fs) AS n,
    avg(mall) AS m2, stddev_pop(mall) AS d2
  FROM cb GROUP BY ALL),
cf AS (
  SELECT {C}, fs OR coalesce(NOT fs AND n >= 3 AND abs(mean - mid) > 3 * dev, false) OR abs(mall - m2) > 2.0 * d2 AS h FROM cb JOIN cm USING ({S})),
hx AS (SELECT {C}, t, m, v, h FROM w1 JOIN cf USING ({C}))"""

IQRM = f"""
cd AS (SELECT {C}, stddev_pop(v) AS std FROM w1 GROUP BY ALL),
cq AS (SELECT {S}, quantile_cont(std, 0.25) AS a, quantile_cont(std, 0.75) AS b FROM cd GROUP BY ALL),
{iqrm_sql("cd", S, "chan", "std", 64, 6, 3.0, "ik")}, {iqrm_sql("w1", C, "t", "v", 100, 10, 3.0, "iq")},
hx AS (
  SELECT source, block, w1.chan, w1.t, m, v, std < a - 1.5 * (b - a) OR std > b + 1.5 * (b - a) OR ik.chan IS NOT NULL OR iq.t IS NOT NULL AS h
  FROM w1 JOIN cd USING ({C}) JOIN cq USING ({S}) LEFT JOIN ik USING (source, block, chan) LEFT JOIN iq USING (source, block, chan, t))"""

TUKEY = f"""
cq AS (SELECT {C}, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM w1 GROUP BY ALL),
hx AS (SELECT {C}, t, m, v, v < a - 3 * (b - a) OR v > b + 3 * (b - a) AS h FROM w1 JOIN cq USING ({C}))"""


def full(detector: str) -> str:
    return f"""WITH RECURSIVE {{EMB}}, {clip_sql("c", "g", C, 2.5)},
p0 AS (SELECT {C}, t, v, CASE WHEN v < a[1] OR v > a[len(a)] THEN 1 ELSE 0 END AS i FROM g JOIN c USING ({C})), {box("i", 3, 3, "sum", "p1", "p0", ", v, i")},
p2 AS (SELECT {C}, t, v, i = 1 AND x > 1 AS m FROM p1), {grown("p2", "diamond", 1, "p3")},
p AS (SELECT p2.source, p2.block, p2.chan, p2.t, v, p3.t IS NOT NULL AS m FROM p2 LEFT JOIN p3 USING ({C}, t)), {replaced("p", "w1")}, {detector},
hc AS (SELECT {C}, bool_or(h) AND NOT any_value(cancel) AS fc FROM hx JOIN w1_c USING ({C}) GROUP BY ALL),
w2 AS (SELECT {C}, t, m, fc, h AND NOT cancel AS m_horiz, v FROM hx JOIN hc USING ({C}) JOIN w1_c USING ({C})),
tl AS (SELECT {T}, list(v ORDER BY chan) FILTER (NOT fc AND NOT m) AS own FROM w2 GROUP BY ALL),
w3 AS MATERIALIZED (SELECT {C}, t, m_horiz, m OR m_horiz AS x, CASE WHEN fc THEN coalesce(own[{DRAW[2]} % len(own) + 1], 0.0) ELSE v END AS v FROM w2 JOIN tl USING ({T})),
tm AS (SELECT {T}, coalesce(avg(v) FILTER (NOT x), 0) AS mean FROM w3 GROUP BY ALL),
tv AS (SELECT {T}, mean > avg(mean) OVER b + 4 * stddev_pop(mean) OVER b AS fv FROM tm WINDOW b AS (PARTITION BY {S})),
{repeated("w3", 1e-6, 0.02, 0.98, 16)}, {blocks("p", 20, "diamond", 7)}, {PULSE.format(dm=30, t0=0.05, p=0.25, h=1, w=2)},
gm AS (SELECT {C}, avg(v) AS mean FROM g GROUP BY ALL),
gf AS (SELECT {C}, mean, fc, avg(mean) OVER (PARTITION BY {S}) AS mid, chan - row_number() OVER (PARTITION BY {S}, fc ORDER BY chan) AS island FROM gm JOIN hc USING ({C})),
gk AS (
  SELECT {S}, min(chan) AS c0, max(chan) AS c1,
    CASE WHEN count(*) <= 2 THEN CASE WHEN avg(mean) > any_value(mid) + 1e-5 THEN 'bright' WHEN avg(mean) < any_value(mid) - 1e-5 THEN 'dark' ELSE 'complex' END
    WHEN bool_and(mean > mid + 1e-5) THEN 'bright' WHEN bool_and(mean < mid - 1e-5) THEN 'dark' ELSE 'complex' END AS kind
  FROM gf WHERE fc GROUP BY {S}, island),
o AS (
  SELECT {C}, t, p.v, p.m AS m_point, m_horiz, fv OR {IN_REPEATED.format("p")} AS m_vert, {IN_BLOCK.format("p")} AS m_block,
    EXISTS (SELECT 1 FROM px WHERE px.source = p.source AND px.block = p.block AND px.chan = p.chan AND px.t = p.t) AS m_pulse,
    coalesce((SELECT max(kind) FROM gk WHERE gk.source = p.source AND gk.block = p.block AND p.chan BETWEEN c0 AND c1), '') AS kind
  FROM p JOIN w2 USING ({C}, t) JOIN tv USING ({T})),
s1 AS (SELECT {S}, quantile_disc(v, 0.5) AS med FROM g GROUP BY ALL),
s2 AS (SELECT {S}, any_value(med) AS med, sqrt(avg((v - med) ** 2)) AS rms FROM g JOIN s1 USING ({S}) GROUP BY ALL)
SELECT {C}, t, m_point, m_horiz, m_vert, m_block, m_pulse, kind = 'bright' AS m_bright, kind = 'dark' AS m_dark, kind = 'complex' AS m_complex,
  m_point OR m_horiz OR m_vert OR m_block OR kind <> '' AS m_global,
  CASE WHEN m_horiz THEN 1 WHEN m_pulse THEN 8 WHEN m_block THEN 7 WHEN m_point THEN 6 WHEN m_vert THEN 2 ELSE 0 END AS label,
  round(med, 6) AS final_med, round(rms, 6) AS final_rms
FROM o JOIN s2 USING ({S})"""


SHORT = f"""WITH RECURSIVE {{EMB}}, {PULSE.format(dm=30, t0=0.05, p=0.25, h=1, w=2)},
md AS (SELECT {S}, quantile_cont(v, 0.5) AS med FROM g GROUP BY ALL), pp AS (SELECT {C}, t, true AS hit FROM px),
q0 AS (SELECT {C}, t, coalesce(hit, false) AS pulse, CASE WHEN hit THEN med ELSE v END AS v FROM g JOIN md USING ({S}) LEFT JOIN pp USING ({C}, t)),
{clip_sql("c", "q0", C, 2.5, kind="avg")},
p AS (SELECT {C}, t, pulse, v, v < c.a[1] OR v > c.a[len(c.a)] AS m FROM q0 JOIN c USING ({C})), {replaced("p", "w1")}, {CHANNELS},
{clip_sql("cs", "xs", S, 2.0, 30, kind="avg", rate=0.01)},
hz AS (SELECT {C}, (std < cs.a[1] OR std > cs.a[len(cs.a)]) AND NOT cancel AS m_horiz FROM ch JOIN cs USING ({S}) JOIN w1_c USING ({C})),
tm AS (
  SELECT {T}, coalesce(quantile_cont(v, 0.5) FILTER (NOT m_horiz), 0) AS med, coalesce(avg(CASE WHEN m THEN 1.0 ELSE 0.0 END) FILTER (NOT m_horiz), 0) AS ratio
  FROM w1 JOIN hz USING ({C}) GROUP BY ALL),
tq AS (SELECT {S}, quantile_cont(med, 0.5) AS mid FROM tm WHERE med > 0 GROUP BY ALL HAVING count(*) > 1),
tf AS (SELECT {S}, any_value(mid) AS mid, quantile_cont(abs(med - mid), 0.5) * 1.4826 AS dev FROM tm JOIN tq USING ({S}) WHERE med > 0 GROUP BY ALL),
tv AS (SELECT {T}, coalesce(med > mid + 4 * dev AND ratio > 0.05, false) AS fv FROM tm LEFT JOIN tf USING ({S})),
{repeated("w1", 1e-5, 0.01, 0.98, 2)},
bi AS (SELECT {C}, t, CASE WHEN m THEN 1 ELSE 0 END AS i FROM p), {box("i", 7, 7, "max", "bd", "bi")}, bc AS (SELECT * FROM bd WHERE x = 1), {boxes("bc", "bx")},
bl AS (SELECT * FROM bx WHERE area >= 20 AND area >= 0.5 * h * w AND w / h BETWEEN 0.2 AND 5), {box("i", 3, 3, "sum", "n1", "bi", ", i")},
n2 AS (SELECT {C}, t, CASE WHEN i = 1 AND x > 2 THEN 1 ELSE 0 END AS i FROM n1), {box("i", 3, 3, "max", "n3", "n2")}, {box("x", 3, 3, "sum", "n4", "n3")},
n5 AS (SELECT {C}, t, CASE WHEN x >= 5 THEN 1 ELSE 0 END AS i FROM n4), {box("i", 3, 3, "max", "n6", "n5")}
SELECT {C}, t, CASE WHEN pulse THEN 5 WHEN {IN_BLOCK.format("p")} THEN 4 WHEN x = 1 THEN 3 WHEN m_horiz THEN 1 WHEN fv OR {IN_REPEATED.format("p")} THEN 2 ELSE 0 END AS label
FROM p JOIN n6 USING ({C}, t) JOIN hz USING ({C}) JOIN tv USING ({T})"""


def low_pass(rows: str, mask: str, i: int = 0) -> str:
    """sc{i}(source, block, chan, t, s, w): sums of weighted 3 x 3 means of the unmasked v of ``rows`` (64 x 100), and of weights."""
    return f"""
sm{i} AS (
  SELECT source, block, CAST(chan // 3 AS INTEGER) AS chan, CAST(t // 3 AS INTEGER) AS t, avg(v) AS v FROM {rows} WHERE NOT ({mask})
  GROUP BY source, block, chan // 3, t // 3),
st{i} AS (
  SELECT {C}, CAST(t - o AS INTEGER) AS t, sum(v * exp(-o * o / 50.0)) AS s, sum(exp(-o * o / 50.0)) AS w
  FROM sm{i}, range(-15, 16) r(o) WHERE t - o BETWEEN 0 AND 33 GROUP BY {C}, t - o),
sc{i} AS (
  SELECT source, block, CAST(chan - o AS INTEGER) AS chan, t, sum(s * exp(-o * o / 12.5)) AS s, sum(w * exp(-o * o / 12.5)) AS w
  FROM st{i}, range(-10, 11) r(o) WHERE chan - o BETWEEN 0 AND 21 GROUP BY source, block, chan - o, t)"""


def residual(rows: str, i: int = 0, v: str = "v", keep: str = "") -> str:
    return f"""
SELECT a.source, a.block, a.chan, a.t, a.{v} - coalesce(b.s / b.w, 0) AS v{keep}
FROM {rows} a LEFT JOIN sc{i} b ON b.source = a.source AND b.block = a.block AND b.chan = a.chan // 3 AND b.t = a.t // 3"""


def thresholds(i: int, rows: str, level: float) -> str:
    """k{i}: ``rows`` (v, v0, m) with the hits of SumThreshold along both axes in m; limits are level times the noise."""
    limit = f"{level!r} * sigma"
    return f"""{noise_sql(rows, "v", "NOT m", f"n{i}")},
j{i} AS (SELECT * FROM {rows} JOIN n{i} USING ({S})), {threshold_sql(f"j{i}", C, "t", "v", "m", limit, 4, f"d{i}")},
e{i} AS (SELECT {C}, t, v, v0, m, sigma, hit AS along FROM d{i}), {threshold_sql(f"e{i}", T, "chan", "v", "m", limit, 4, f"f{i}")},
k{i} AS (SELECT {C}, t, v, v0, m OR hit OR along AS m FROM f{i})"""


def outliers(rows: str, keys: str, k: float, name: str) -> str:
    return f"""
{name} AS (
  SELECT {keys}, rms > avg(rms) OVER (PARTITION BY {S}) + {k!r} * stddev_pop(rms) OVER (PARTITION BY {S}) AS {name}_f
  FROM (SELECT {keys}, coalesce(sqrt(avg(v * v) FILTER (NOT m)), 0) AS rms FROM {rows} GROUP BY ALL))"""


def flattened(i: int, k: float) -> str:
    """l{i}: k{i} with outlying channels and times flagged, v the original values less their smooth surface."""
    return f"""{outliers(f"k{i}", C, k, f"oc{i}")}, {outliers(f"k{i}", T, 3.5, f"ot{i}")},
q{i} AS (SELECT {C}, t, v0 AS v, v0, m OR oc{i}_f OR ot{i}_f AS m FROM k{i} JOIN oc{i} USING ({C}) JOIN ot{i} USING ({T})),
{low_pass(f"q{i}", "m", i)}, l{i} AS ({residual(f"q{i}", i, "v0", ", v0, m")})"""


def dilated(keys: str, at: str, name: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY {at}"
    return f"""
{name}_s AS (SELECT *, sum(CASE WHEN m THEN 1.0 ELSE 0.0 END - 0.8) OVER ({w} ROWS UNBOUNDED PRECEDING) AS s FROM k2),
{name}_p AS (SELECT *, coalesce(lag(s) OVER ({w}), 0) AS p FROM {name}_s),
{name} AS (
  SELECT {C}, t, max(s) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - min(p) OVER ({w} ROWS UNBOUNDED PRECEDING) >= -1e-9 AS {name}
  FROM {name}_p)"""


def strategy(first: float) -> str:
    return f"""WITH {{EMB}}, g0 AS (SELECT {C}, t, v, v AS v0, false AS m FROM g),
{thresholds(0, "g0", first * 4)}, {flattened(0, 6.0)}, {thresholds(1, "l0", first * 2)}, {flattened(1, 3.0)}, {thresholds(2, "l1", first)},
{dilated(C, "t", "da")}, {dilated(T, "chan", "db")},
u AS (SELECT {C}, t, v0 AS v, m OR da OR db AS m FROM k2 JOIN da USING ({C}, t) JOIN db USING ({C}, t)), {outliers("u", T, 4.0, "last")}
SELECT {C}, t, m OR last_f AS m FROM u JOIN last USING ({T})"""
