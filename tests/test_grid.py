"""Row-level checks of the kernels on small random grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltra.functions.exprs import BC
from quiltra.operators import curate, detect, evaluate, flows, inject, morphology, resample, substitute


def grid(spark, values, block=0):
    rows = [("x", block, c, t, float(values[c, t])) for c in range(values.shape[0]) for t in range(values.shape[1])]
    return spark.createDataFrame(rows, "source string, block long, chan int, t int, v double")


def clipped(v, k, rounds=15):
    kept, med0, rms0 = np.sort(v), 0.0, 0.0
    for i in range(rounds):
        if len(kept) < 3:
            break
        med = kept[(len(kept) - 1) // 2]
        rms = np.sqrt(np.mean((kept - med) ** 2))
        if rms <= 1e-12 or (i and abs(med - med0) < 1e-6 and abs(rms - rms0) / max(rms0, 1e-12) < 1e-4):
            break
        new = kept[(kept >= med - k * rms) & (kept <= med + k * rms)]
        if len(new) == len(kept):
            break
        kept, med0, rms0 = new, med, rms
    return (v < kept[0]) | (v > kept[-1])


def test_clip_follows_the_rules(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_t(2, size=(12, 40))
    v[5] = 1.0
    got = {(r.chan, r.t): r.m for r in detect.clip(grid(spark, v), 2.0).collect()}
    for c in range(12):
        want = clipped(v[c], 2.0)
        assert [got[c, t] for t in range(40)] == want.tolist()


def test_clip_of_few_or_equal_values_flags_none(spark):
    assert detect.clip(grid(spark, np.array([[1.0, 99.0]])), 1.0).filter("m").count() == 0
    assert detect.clip(grid(spark, np.ones((2, 9))), 1.0).filter("m").count() == 0


def test_sum_threshold_flags_whole_windows(spark):
    v = np.zeros((1, 12))
    v[0, 4:8] = 1.0
    got = detect.sum_threshold(grid(spark, v), BC, "t", 1.2, 3).orderBy("t").collect()
    limit = {1: 1.2, 2: 1.2 / 1.5, 4: 1.2 / 1.5**np.log2(3)}
    want = np.zeros(12, bool)
    for size, x in limit.items():
        for i in range(12 - size + 1):
            if v[0, i : i + size].mean() > x:
                want[i : i + size] = True
    assert [r.hit for r in got] == want.tolist()


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(1)
    m = rng.random((14, 30)) < 0.3
    df = grid(spark, m.astype(float)).withColumn("m", F.col("v") > 0)
    got = sorted((r.c0, r.c1, r.t0, r.t1, r.area) for r in morphology.boxes(morphology.components(df, "m")).collect())
    seen, want = np.zeros_like(m), []
    for a, b in zip(*np.nonzero(m)):
        if seen[a, b]:
            continue
        todo, cells = [(a, b)], []
        seen[a, b] = True
        while todo:
            x, y = todo.pop()
            cells.append((x, y))
            for i in range(max(0, x - 1), min(14, x + 2)):
                for j in range(max(0, y - 1), min(30, y + 2)):
                    if m[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        todo.append((i, j))
        xs, ys = zip(*cells)
        want.append((min(xs), max(xs), min(ys), max(ys), len(cells)))
    assert got == sorted(want)


def test_diamond_of_radius_zero_changes_nothing(spark):
    df = grid(spark, np.eye(6)).withColumn("m", F.col("v") > 0)
    assert morphology.dilated_diamond(df, "m", 0).filter("m <> (v > 0)").count() == 0
    assert morphology.dilated_diamond(df, "m", 1).filter("m").count() == 16


def test_substitution_takes_clean_values_of_the_row(spark):
    v = np.arange(30.0).reshape(3, 10)
    df = grid(spark, v).withColumn("m", (F.col("t") % 3 == 0) | (F.col("chan") == 2))
    for r in substitute.in_channel(df, "m").collect():
        if r.chan == 2 or r.t % 3:
            assert r.v == v[r.chan, r.t]
        else:
            assert r.v in [x for t, x in enumerate(v[r.chan]) if t % 3]


def test_injected_points_are_found(spark):
    rng = np.random.default_rng(5)
    df = grid(spark, rng.normal(0, 0.1, (16, 60))).withColumn("label", F.lit(0))
    own = detect.clip(inject.clusters(df, 5, 16, 60, 5.0, 3), 4.0)
    pairs = own.select((F.col("label") > 0).cast("int").alias("truth"), F.col("m").cast("int").alias("pred"))
    m = {r.label: r for r in evaluate.class_metrics(evaluate.confusion(pairs, classes=2)).collect()}
    assert m[1].recall == 1.0 and m[1].precision > 0.9


def test_tiles_cover_and_end_at_the_border():
    assert resample.tile_starts(100, 30, 20) == [0, 20, 40, 60, 70]
    assert resample.tile_starts(20, 30, 10) == [0]


def test_strict_rules_raise(spark):
    with pytest.raises(ValueError):
        resample.strict_block_mean(grid(spark, np.ones((5, 4))), 2, 2, 5, 4)
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(1,)], "i int")
    with pytest.raises(ValueError):
        curate.strictly_paired(a, b, ["i"])


def test_allocation_meets_the_target_and_the_space(spark):
    cap = spark.createDataFrame([("g", "a", 3), ("g", "b", 50), ("g", "c", 20)], "k string, n string, space int")
    got = {r.n: r for r in curate.allocated(cap, ["k"], "n", "space", F.lit(40)).collect()}
    assert sum(r["take"] for r in got.values()) == 40 and got["a"]["take"] == 3 and got["a"].short == 0


def test_blocks_that_come_in_pieces_are_detected_whole(spark, tmp_path):
    from quiltra.sources.sinks import new_path
    from quiltra.streaming import streams

    rng = np.random.default_rng(2)
    rows = [("x", b, c, t, float(v)) for b in range(4) for c in range(4) for t, v in enumerate(rng.normal(size=50)) if b < 3 or t < 30]
    whole = spark.createDataFrame(rows, "source string, block long, chan int, t int, v double")
    path = str(tmp_path / "in" / "grid.parquet")
    for part in ("block < 1 or (block = 1 and t < 20)", "block = 2 and t < 20", "block = 3 or (block > 0 and t >= 20)"):
        whole.filter(part).coalesce(1).write.mode("append").parquet(path)
    flags = new_path(spark, "flags")
    detected = lambda g: detect.tukey_time(g, 1.5)
    got = streams.by_block(streams.source(spark, str(tmp_path / "in"), "grid"), lambda b: b, detected, flags, 200)
    key = lambda df: sorted((r.block, r.chan, r.t, r.m) for r in df.collect())
    assert key(got) == key(detected(whole)) and sorted(got.columns) == sorted(detected(whole).columns)
    places = spark.read.option("basePath", flags).parquet(f"{flags}/batch=*").groupBy("block").agg(F.collect_set("batch").alias("b")).collect()
    assert all(len(r.b) == 1 for r in places)  # one output of each block
    assert {r.block for r in places if r.b == ["last"]} == {3}  # only the block that never got whole


def test_stream_without_rows_gives_no_rows(spark, tmp_path):
    from quiltra.sources.sinks import new_path
    from quiltra.streaming import streams

    empty = spark.createDataFrame([], "source string, block long, chan int, t int, v double")
    empty.write.parquet(str(tmp_path / "in" / "grid.parquet"))
    got = streams.by_block(streams.source(spark, str(tmp_path / "in"), "grid"), lambda b: b, lambda g: detect.tukey_time(g, 1.5), new_path(spark, "flags"), 200)
    assert got.count() == 0 and "m" in got.columns


def test_clip_of_odd_series(spark):
    """Nulls stay null and don't count, short, constant and NaN series lose nothing, other columns come along."""
    series = [[1.0, 2.0], [3.0] * 6, [None, None, None], [None, 1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 50.0], [float("nan"), 1.0, 2.0, 3.0]]
    rows = [("x", 0, c, t, v, f"{c}-{t}") for c, s in enumerate(series) for t, v in enumerate(s)]
    own = spark.createDataFrame(rows, "source string, block long, chan int, t int, v double, note string")
    out = detect.clip(own, 2.0)
    got = {(r.chan, r.t): r for r in out.collect()}
    assert len(got) == len(rows) and all(r.note == f"{c}-{t}" for (c, t), r in got.items())
    for c in (0, 1, 4):
        assert not any(got[c, t].m for t in range(len(series[c])))
    assert [got[2, t].m for t in range(3)] == [None] * 3
    assert [got[3, t].m for t in range(8)] == [None] + [False] * 6 + [True]
    assert detect.clip(own.limit(0), 2.0).count() == 0 and detect.clip_trace(own.limit(0), 2.0).count() == 0
    rounds = {r["round"]: r for r in detect.clip_trace(own.filter("chan = 3"), 2.0).collect()}
    assert rounds[1].kept == 6 and rounds[1].med == 1.0 and set(rounds) >= {1, 2}


def test_stored_blocks_are_replaced_only_when_confirmed(spark):
    from quiltra.sources import sinks

    g = grid(spark, np.ones((2, 3)))
    path = sinks.new_path(spark, "blocks")
    sinks.by_block(g, path)
    with pytest.raises(ValueError):
        sinks.by_block(g.withColumn("v", F.lit(2.0)), path, overwrite=True)
    assert spark.read.parquet(path).filter("v <> 1").count() == 0
    assert sinks.by_block(g.withColumn("v", F.lit(2.0)), path, overwrite=True, confirmed=sinks.CONFIRMATION).filter("v <> 2").count() == 0


def test_ranks_run_on_through_the_cells(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    got = curate.by_draw(rows, ["k"], "name", 5).toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g["_rank"]) == list(range(1, 1001))


def test_flow_takes_pulses_and_leaves_out_what_is_turned_off(spark):
    rng = np.random.default_rng(4)
    g = grid(spark, rng.normal(size=(16, 60)))
    channels = g.select(*BC).distinct().withColumn("freq", 1000.0 + F.col("chan") * 5)
    train = flows.PulseTrain(30.0, 0.25, 0.05, 4, 0.01, 60, inter_width=2)
    pulse = flows.pulse_pixels(channels, "freq", train)
    out = flows.full_flow(g, 16, 60, 2.5, 2.0, area=20, pulse=pulse, with_blocks=False, with_vertical=False, periods=(2, 20, 2, 0.1))
    rows = out.collect()
    hit = {(r.chan, r.t) for r in pulse.collect()}
    assert len(hit) > 16 and all(r.m_pulse == ((r.chan, r.t) in hit) for r in rows)
    assert not any(r.m_block or r.m_vert for r in rows) and all(not r.m_periodic or r.m_point for r in rows)
    assert all(r.label == (1 if r.m_horiz else 8 if r.m_pulse else 6 if r.m_point or r.m_periodic else 0) for r in rows)
    every = np.array([r.v for r in rows])
    med = np.sort(every)[(len(every) - 1) // 2]
    assert abs(rows[0].final_med - med) < 1e-9 and abs(rows[0].final_rms - np.sqrt(np.mean((every - med) ** 2))) < 1e-9


def test_quantiles_of_large_groups_by_refinement(spark, monkeypatch):
    from quiltra.operators import stats

    rng = np.random.default_rng(6)
    values = {"a": rng.normal(size=900), "b": np.round(rng.normal(size=700), 1), "c": np.full(500, 2.5), "d": rng.normal(size=1) * 1e9, "e": np.concatenate([rng.random(400), [1e12]])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", float("nan")), ("b", None), ("f", None)], "k string, x double")
    monkeypatch.setattr(stats, "BINS", 8)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    for most in (1, 20, 10_000):
        got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in stats.large_quantiles(rows, ["k"], "x", shares, most).collect()}
        assert set(got) == set(values) and all(np.allclose(got[k], np.quantile(v, shares)) for k, v in values.items())


def test_runs_of_repeated_times_hang_on_their_anchor(spark):
    eps = 0.01
    v = np.tile(np.arange(1.0, 6.0)[:, None], (1, 60))
    v[:, :40] += 0.9 * eps * np.arange(40)
    v[:, 40:] += np.random.default_rng(1).normal(size=(5, 20))
    v[:, 50:55] = v[:, [50]]
    found = lambda least: sorted((r["first"], r["last"]) for r in detect.repeated_columns(grid(spark, v), eps, 1.0, 0.98, least).collect())
    # Every third time is an anchor, alike to its neighbours alone.
    assert found(3) == [(k, k + 2) for k in range(0, 38, 2)] + [(50, 54)] and found(16) == []


def test_members_of_periodic_pairs(spark):
    m = np.zeros((3, 200), bool)
    m[0, 5:190:13] = True
    m[0, [20, 77]] = True
    m[1, ::2] = True
    m[2, [3, 66, 130]] = True
    got = detect.periodic_points(grid(spark, m.astype(float)).withColumn("m", F.col("v") > 0), "m", 3, 70, 3, 0.3).collect()
    have = {c: sorted(r.t for r in got if r.chan == c and r.m_periodic) for c in range(3)}
    assert have[0] == list(range(5, 190, 13)) and have[1] == list(range(0, 200, 2)) and have[2] == []


def test_diamonds_by_running_distances(spark):
    rng = np.random.default_rng(9)
    m = rng.random((20, 33)) < 0.02
    for radius in (1, 3, 7):
        got = {(r.chan, r.t): r.m for r in morphology.dilated_diamond(grid(spark, m.astype(float)).withColumn("m", F.col("v") > 0), "m", radius).collect()}
        flags = np.argwhere(m)
        assert all(got[c, t] == (np.abs(flags - [c, t]).sum(1).min() <= radius) for c in range(20) for t in range(33))


def test_points_next_to_missing_times_dont_touch(spark):
    m = np.zeros((9, 30))
    m[3:5, 9:11] = m[3:5, 12:14] = 1
    full = grid(spark, m).withColumn("m", F.col("v") > 0)
    key = lambda df: {(r.chan, r.t): r.m for r in df.collect() if r.t != 11}
    assert key(morphology.cleaned_points(full.filter("t <> 11"), "m")) == key(morphology.cleaned_points(full, "m"))


def test_bootstrap_draws_as_many_rows_as_there_are(spark):
    d = np.random.default_rng(8).exponential(size=150)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)] + [(900, None)], "name long, d double")
    got = evaluate.bootstrap(rows, "name", "d", 400, 3, cell_bits=4).first()
    means = np.random.default_rng(1).choice(d, (4000, 150)).mean(1)
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(got["mean"] - d.mean()) < 1e-9 and abs(got["low"] - low) < 0.04 and abs(got["high"] - high) < 0.04
    # With equal differences every resample has the same mean only if it has as many rows as there are.
    same = evaluate.bootstrap(rows.filter("d is not null").withColumn("d", F.lit(2.0)), "name", "d", 50, 1, cell_bits=3).first()
    assert (same["mean"], same["low"], same["high"]) == (2.0, 2.0, 2.0)
    assert list(evaluate.bootstrap(rows.filter("d > 1e9"), "name", "d", 5).first()) == [None, None, None]


def test_samples_of_a_short_last_row_keep_their_times(spark):
    from quiltra.sources import grids

    own = grid(spark, np.random.default_rng(2).normal(size=(3, 11)))
    q = grids.quantised(own)
    got = {(r.chan, r.t): r.v for r in grids.samples_of(grids.subints(q, 4), 3).collect()}
    assert got == {(r.chan, r.t): r.v for r in grids.dequantised(q).collect()}


def test_bilinear_growth_of_a_short_block_has_all_cells(spark):
    v = np.random.default_rng(2).normal(size=(4, 6))
    short = grid(spark, v).filter("t < 3")
    whole = grid(spark, np.where(np.arange(6) < 3, v, 0.0))
    grown = lambda g: {(r.chan, r.t): r.v for r in resample.bilinear(g, (4, 6), (8, 15)).collect()}
    got, want = grown(short), grown(whole)
    assert len(got) == 8 * 15 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def votes(v, size, lags, thr):
    """The flagged places of one series {place: value}, by the rules."""
    edges = set()
    for lag in lags:
        voter = {t: min(max(t - lag, 0), size - 1) for t in v}
        d = {t: v[t] - v[voter[t]] for t in v if voter[t] in v}
        if d:
            a, m, b = np.quantile(list(d.values()), [0.25, 0.5, 0.75])
            edges |= {(voter[t], t) for t, x in d.items() if x - m > thr * max((b - a) / 1.349, 1e-12)}
    cast, got = ({t: sum(e[i] == t for e in edges) for t in v} for i in (0, 1))
    return {t for j, t in edges if cast[j] < got[t]}


def test_iqrm_compares_by_place(spark):
    v = np.random.default_rng(4).standard_t(2, size=(9, 40))
    lost = lambda c, t: (c % 3 == 1 and t > 21) or (c % 3 == 2 and (t * 7 + c) % 5 == 0)
    rows = [("x", 0, c, t, float(v[c, t])) for c in range(9) for t in range(40) if not lost(c, t)]
    own = spark.createDataFrame(rows, "source string, block long, chan int, t int, v double")
    want = {(c, t) for c in range(9) for t in votes({r[3]: r[4] for r in rows if r[2] == c}, 40, [s * k for k in detect.lags_for(6) for s in (1, -1)], 1.5)}
    got = detect.iqrm(own, BC, "t", "v", 40, 6, 1.5).collect()
    assert len(got) == len(rows) and {(r.chan, r.t) for r in got if r.flag} == want and want


def test_components_take_one_exchange_and_no_rounds(spark):
    """A spiral and a comb, whose labels travel far, in two blocks; jobs don't follow the length of a component."""
    spiral = np.zeros((41, 41))
    for k in range(0, 20, 2):
        spiral[k, max(k - 1, 0) : 41 - k] = spiral[40 - k, k : 41 - k] = 1
        spiral[k : 41 - k, 40 - k] = 1
        spiral[k + 2 : 41 - k, k] = 1
    comb = np.zeros((41, 41))
    comb[:, ::2] = comb[40] = 1
    own = grid(spark, spiral).unionByName(grid(spark, comb, 1)).withColumn("m", F.col("v") > 0)
    spark.sparkContext.setJobGroup("components", "components")
    parts = morphology.components(own, "m")
    spark.sparkContext.setJobGroup("", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    got = morphology.boxes(parts).orderBy("block").collect()
    assert [(r.c0, r.c1, r.t0, r.t1, r.area) for r in got] == [(0, 40, 0, 40, int(x.sum())) for x in (spiral, comb)]


def test_quartiles_and_draws_gather_rows_without_a_join(spark):
    own = grid(spark, np.random.default_rng(1).normal(size=(5, 30))).withColumn("m", F.abs("v") > 1)
    for got in (detect.tukey_time(own), substitute.in_channel(own, "m"), substitute.across_channels(own.withColumn("f", F.col("chan") == 2), "f", "m")):
        assert "Join" not in got._jdf.queryExecution().toString() and got.count() == 150


def test_blocks_are_the_boxes_of_components(spark):
    own = grid(spark, np.random.default_rng(7).random((30, 44)) < 0.06).withColumn("m", F.col("v") > 0)
    flags = lambda df: {(r.chan, r.t): r.m_block for r in df.collect()}
    boxes = morphology.shaped(morphology.boxes(morphology.components(morphology.dilated_box(own, "m", 2, 3), "m")), 30, 0.5, 0.2, 5.0)
    want = flags(morphology.inside(own, boxes, "m_block"))
    got = morphology.blocks(own, "m", 2, 3, 30)
    assert flags(got) == want and set(want.values()) == {True, False} and "Join" not in got._jdf.queryExecution().toString()


def test_facts_of_a_block_meet_pixels_without_sorting_them(spark):
    own = grid(spark, np.zeros((6, 9))).unionByName(grid(spark, np.zeros((6, 9)), 1))
    times = spark.createDataFrame([("x", 0, 3, True), ("x", 1, 8, True)], "source string, block long, t int, hot boolean")
    kinds = spark.createDataFrame([("x", 1, 2, "dark", 7)], "source string, block long, chan int, kind string, n int")
    got = morphology.looked_up(morphology.looked_up(own, times, "t"), kinds, "chan")
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and got.columns == [*own.columns, "hot", "kind", "n"] and got.count() == 108
    assert {(r.block, r.t) for r in got.filter("hot").collect()} == {(0, 3), (1, 8)}
    assert {(r.block, r.chan, r.n) for r in got.filter("kind = 'dark'").collect()} == {(1, 2, 7)}


@pytest.mark.parametrize("name", ["sigma", "iqrm", "tukey"])
def test_full_flow_stores_its_pixels_twice(spark, name, monkeypatch):
    stored, kept = [], morphology.kept
    monkeypatch.setattr(morphology, "kept", lambda df, to: stored.append(to) or kept(df, to))
    v = np.random.default_rng(5).normal(size=(16, 60))
    v[:, 20], v[3], v[8:12, 30:40] = v[:, 20] + 9, v[3] * 4, 6
    out = flows.full_flow(grid(spark, v), 16, 60, 2.5, 2.0, detector=name, area=20)
    rows = out.collect()
    assert stored == ["points", "work"] and len(rows) == 960 and len({(r.chan, r.t) for r in rows}) == 960
    med = np.sort(v.ravel())[479]
    assert {(round(r.final_med, 9), round(r.final_rms, 9)) for r in rows} == {(round(med, 9), round(np.sqrt(np.mean((v - med) ** 2)), 9))}
    assert all(r.v == v[r.chan, r.t] for r in rows) and any(r.m_block for r in rows)


def test_a_blocks_thresholds_noise_and_outliers_are_those_of_the_columns(spark):
    """Arrays of one block against the operators on rows, with places and values missing."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(9, 40))
    v[4], v[:, 17] = v[4] * 3, v[:, 17] * 4
    own = grid(spark, v).withColumn("_h", F.abs(F.hash("chan", "t"))).filter("_h % 7 > 0")
    own = own.withColumns({"m": F.col("_h") % 5 == 0, "v": F.when(F.col("_h") % 11 > 0, F.col("v"))}).drop("_h").localCheckpoint()
    rows = own.orderBy("chan", "t").collect()
    chan, t, m = (np.array([r[c] for r in rows]) for c in ("chan", "t", "m"))
    x = np.array([np.nan if r.v is None else r.v for r in rows])
    counted = ~m & ~np.isnan(x)
    sigma = detect.noise(own.filter("not m")).first().sigma
    assert abs(detect.noise_of(x[~m]) - sigma) < 1e-9
    for key, keys, at, places in ((chan, BC, "t", t), (t, ["source", "block", "t"], "chan", chan)):
        hits = {(r.chan, r.t) for r in detect.sum_threshold(own, keys, at, 1.4, 4, mask="m").filter("hit").collect()}
        got = detect.hits_along(key, places, x, counted, 1.4, 4)
        assert {(a, b) for a, b in zip(chan[got], t[got])} == hits and 0 < len(hits) < len(rows)
        far = {r[keys[-1]] for r in detect.rms_outliers(own, "m", keys, 1.5).filter("flag").collect()}
        assert set(key[detect.outlying(key, x, counted, 1.5)].tolist()) == far and far


def test_strategy_gathers_a_block_once_for_its_rounds(spark, monkeypatch):
    stored, kept = [], morphology.kept
    monkeypatch.setattr(morphology, "kept", lambda df, to: stored.append(to) or kept(df, to))
    v = np.random.default_rng(2).normal(size=(12, 50))
    v[:, 20], v[7] = v[:, 20] + 30, v[7] + 40
    got = {(r.chan, r.t): r.m for r in flows.strategy(grid(spark, v), 12, 50).collect()}
    assert stored == ["dilated"] and len(got) == 600
    assert all(got[c, 20] for c in range(12)) and all(got[7, t] for t in range(50)) and sum(got.values()) < 300
