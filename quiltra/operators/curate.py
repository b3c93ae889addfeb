"""Dataset curation: pairing, splits, samples, plans. Choices are seeded hashes, so they don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltra.functions.exprs import draw


def paired(images: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    return images.join(masks, on)


def strictly_paired(images: DataFrame, masks: DataFrame, on: list[str], lenient: bool = False) -> DataFrame:
    """Images with a mask; without ``lenient`` an image that has none is an error."""
    if not lenient and images.join(masks, on, "left_anti").limit(1).count():
        raise ValueError("an image has no mask")
    return images.join(masks, on, "left_semi")


def mismatches(images: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """Keys on one side only, as missing (no mask) or extra (no image)."""
    a, b = images.select(*on).distinct().withColumn("_i", F.lit(True)), masks.select(*on).distinct().withColumn("_m", F.lit(True))
    out = a.join(b, on, "full_outer").filter(F.col("_i").isNull() | F.col("_m").isNull())
    return out.select(*on, F.when(F.col("_m").isNull(), "missing").otherwise("extra").alias("side"))


def first_by(rows: DataFrame, keys: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


#: Cells that the order of a group is cut into; each is ranked on its own.
CELLS = 1024


def ranked(rows: DataFrame, keys: list[str], cell: Column, *order: Column | str) -> DataFrame:
    """rows with ``_rank``, the place from 1 on in the order of their keys.

    ``cell`` is a number that never falls along the order. Rows are ranked within (keys, cell), so that a large group is
    spread over tasks; the small table of cells gives the rows in the cells before.
    """
    own = rows.withColumn("_cell", cell)
    counts = own.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in [*keys, "_cell"]]
    met = own.withColumn("_within", within).alias("_r").join(before.alias("_b"), same)
    return met.select("_r.*", (F.col("_within") + F.col("_before")).alias("_rank")).drop("_cell", "_within")


def by_draw(rows: DataFrame, keys: list[str], name: str, seed: int) -> DataFrame:
    """``ranked`` by seeded draws, then name."""
    return ranked(rows, keys, F.floor(draw(seed, name) * CELLS / 4294967296), draw(seed, name), name)


def every_nth(rows: DataFrame, keys: list[str], order: str, ratio: float) -> DataFrame:
    """Column split: every int(1/ratio)-th row of each group in the order of a number is validation."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    span = max(1, (ends["hi"] or 0) - (ends["lo"] or 0))
    at = ranked(rows, keys, F.floor((F.col(order) - F.lit(ends["lo"] or 0)) * (CELLS / span)), order)
    return at.withColumn("split", F.when((F.col("_rank") - 1) % int(1 / ratio) == 0, "val").otherwise("train")).drop("_rank")


def random_split(rows: DataFrame, keys: list[str], name: str, k: int, seed: int) -> DataFrame:
    """Column split: k rows of each group, by the order of seeded draws, are validation."""
    return by_draw(rows, keys, name, seed).withColumn("split", F.when(F.col("_rank") <= k, "val").otherwise("train")).drop("_rank")


def sampled(rows: DataFrame, keys: list[str], name: str, k: Column | int, seed: int) -> DataFrame:
    """k rows of each group without replacement, by the order of seeded draws."""
    return by_draw(rows, keys, name, seed).filter(F.col("_rank") <= k).drop("_rank")


def allocated(capacity: DataFrame, keys: list[str], name: str, space: str, target: Column) -> DataFrame:
    """(..., take): an even share of the target up to the space, the rest to the largest free spaces first."""
    every = Window.partitionBy(*keys)
    even = F.least(F.col(space), F.floor(F.col("_target") / F.count("*").over(every)))
    own = capacity.withColumn("_target", target).withColumn("_even", even).withColumn("_free", F.col(space) - F.col("_even")).withColumn("_left", F.col("_target") - F.sum("_even").over(every))
    before = F.sum("_free").over(every.orderBy(F.desc("_free"), name).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_free")
    more = F.greatest(F.lit(0), F.least(F.col("_free"), F.col("_left") - before))
    own = own.withColumn("take", (F.col("_even") + more).cast("long"))
    return own.withColumn("short", (F.col("_target") - F.sum("take").over(every)).cast("long")).drop("_target", "_even", "_free", "_left")


def reshuffled(rows: DataFrame, cover: str, name: str, seed: int) -> DataFrame:
    """Column new_split: within a cover, as many training rows as before, chosen anew by seeded draws."""
    n = rows.groupBy(cover).agg(F.count_if(F.col("split") == "train").alias("_n"))
    own = by_draw(rows, [cover], name, seed).join(n, cover)
    return own.withColumn("new_split", F.when(F.col("_rank") <= F.col("_n"), "train").otherwise("val")).drop("_rank", "_n")


def changes(rows: DataFrame) -> DataFrame:
    moved = rows.filter(F.col("split") != F.col("new_split"))
    return moved.withColumn("change", F.concat(F.lit("MOVED "), "split", F.lit("->"), "new_split"))


def conflicts(planned: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """Names that the target has already, and names that come from several sources."""
    there = planned.select(name).distinct().join(existing.select(name).distinct(), name, "left_semi").withColumn("why", F.lit("exists"))
    twice = planned.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1").select(name, F.lit("repeated").alias("why"))
    return there.unionByName(twice)


def trimmed(rows: DataFrame, group: Column, name: str, k: int, seed: int) -> DataFrame:
    """All rows of other groups, and k of the group."""
    own = rows.withColumn("_g", group)
    gone = own.filter("_g").join(sampled(own.filter("_g"), ["_g"], name, k, seed).select(name), name, "left_anti").select(name)
    return rows.join(gone, name, "left_anti")


def weighted_draws(rows: DataFrame, name: str, weight: str, n: int, seed: int) -> DataFrame:
    """n rows with replacement, in proportion to weight: draws fall into intervals of the running weight.

    The running sum goes by draws of the names: within cells of them, and over the small table of cells. Its range is cut
    into four steps for each row; a row lies in the steps that its interval touches, a draw in one, and they meet by step.
    """
    order = draw(seed, name)
    own = rows.select(name, F.col(weight).cast("double").alias("_w")).withColumns({"_o": order, "_cell": F.floor(order * CELLS / 4294967296)})
    every = Window.orderBy("_cell")  # one row for each cell
    cells = own.groupBy("_cell").agg(F.sum("_w").alias("_t"), F.count("*").alias("_n"))
    cells = cells.select("_cell", (F.sum("_t").over(every) - F.col("_t")).alias("_from"))
    total = own.agg(F.sum("_w").alias("_all"), (F.count("*") * 4).alias("_steps"))
    run = F.sum("_w").over(Window.partitionBy("_cell").orderBy("_o", name).rowsBetween(Window.unboundedPreceding, 0))
    spans = own.withColumn("_run", run).join(cells, "_cell").crossJoin(F.broadcast(total)).withColumn("_hi", F.col("_from") + F.col("_run")).withColumn("_lo", F.col("_hi") - F.col("_w"))
    step = lambda x: F.floor(x / F.col("_all") * F.col("_steps"))
    spans = spans.select(name, "_lo", "_hi", F.explode(F.sequence(step(F.col("_lo")), step(F.col("_hi")))).alias("_step"))
    draws = rows.sparkSession.range(n).crossJoin(F.broadcast(total)).withColumn("_x", (draw(seed, "id") + 0.5) / 4294967296.0 * F.col("_all"))
    return draws.select("id", "_x", step(F.col("_x")).alias("_step")).join(spans, "_step").filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))).select("id", name)


def named(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Wanted names with a note of whether they exist."""
    return wanted.join(rows.select(name).distinct().withColumn("_f", F.lit(True)), name, "left").select(name, F.coalesce("_f", F.lit(False)).alias("found"))


def first_candidate(rows: DataFrame, candidates: Column, files: DataFrame, key: str) -> DataFrame:
    """The first of each row's ordered candidate names that exists."""
    own = rows.select(key, F.posexplode(candidates).alias("_rank", "path"))
    return own.join(files, "path").groupBy(key).agg(F.min_by("path", "_rank").alias("path"))


def augmented(grid: DataFrame, nchan: int, nsamp: int, seed: int, noise: float = 0.01, hole: int = 8) -> DataFrame:
    """Flips, brightness, contrast, noise and a dropped rectangle, drawn for each block."""
    b = ["source", "block"]
    own = grid.withColumns({f"_u{i}": draw(seed + i, *b) / 4294967296.0 for i in range(6)})
    chan = F.when(F.col("_u0") < 0.5, nchan - 1 - F.col("chan")).otherwise(F.col("chan"))
    t = F.when(F.col("_u1") < 0.5, nsamp - 1 - F.col("t")).otherwise(F.col("t"))
    v = F.col("v") * (0.8 + 0.4 * F.col("_u2")) + 0.2 * (F.col("_u3") - 0.5) + noise * (draw(seed + 9, *b, "chan", "t") / 4294967296.0 - 0.5)
    c0, t0 = F.floor(F.col("_u4") * (nchan - hole)), F.floor(F.col("_u5") * (nsamp - hole))
    dropped = chan.between(c0, c0 + hole - 1) & t.between(t0, t0 + hole - 1)
    return own.select(*b, chan.cast("int").alias("chan"), t.cast("int").alias("t"), F.when(dropped, 0.0).otherwise(v).alias("v"), *[c for c in grid.columns if c not in (*b, "chan", "t", "v")])
