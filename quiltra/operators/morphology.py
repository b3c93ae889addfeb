"""Mask algebra, neighbourhood windows and connected components on grids. Windows need complete grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quiltra.functions.exprs import B, BC, along_c, along_t
from quiltra.operators.runs import runs


def labels_by_priority(order: list[tuple[str, int]]) -> Column:
    """Class code of the last mask in the list that is set, 0 if none."""
    out = F.coalesce(*[F.when(F.col(m), code) for m, code in reversed(order)], F.lit(0))
    return out.cast("int")


# Class codes and priorities of the two labelling flows, lowest first.
FULL_ORDER = [("m_vert", 2), ("m_point", 6), ("m_periodic", 6), ("m_block", 7), ("m_pulse", 8), ("m_horiz", 1)]
SIMPLE_ORDER = [("m_vert", 2), ("m_horiz", 1), ("m_point", 3), ("m_block", 4), ("m_pulse", 5)]
#: Class codes to contiguous codes.
CONTIGUOUS = {0: 0, 1: 1, 2: 2, 6: 3, 7: 4, 8: 5}


def merged(masks: list[Column]) -> Column:
    """The number, from 1 on, of the last mask that holds; 0 if none does."""
    return F.greatest(*[F.when(m, i + 1).otherwise(0) for i, m in enumerate(masks)])


def expanded(grid: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel with the flags of its channel (or time, by keys)."""
    return grid.join(flags, keys)


def looked_up(grid: DataFrame, facts: DataFrame, at: str) -> DataFrame:
    """Each pixel with the facts (B, at, ...) of its channel or time, null without any; a place has one row of them.

    The facts of a block travel as one row and meet its pixels by block, so that facts of channels, of times and of blocks one
    after another need one exchange of the pixels and no sort.
    """
    names = [c for c in facts.columns if c not in (*B, at)]
    held = facts.groupBy(*B).agg(F.map_from_entries(F.collect_list(F.struct(at, F.struct(*names)))).alias("_facts"))
    own = grid.join(held.hint("shuffle_hash"), B, "left").withColumn("_fact", F.try_element_at("_facts", F.col(at)))
    return own.select(*grid.columns, *[F.col(f"_fact.{c}").alias(c) for c in names])


def mapped(label: str, codes: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col(label).cast("int"))


def box(grid: DataFrame, value: str, height: int, width: int, how=F.sum, out: str | None = None) -> DataFrame:
    """how over a height x width box around each pixel, clipped at the borders: first along time, then along channels."""
    t, c = along_t().rowsBetween(-((width - 1) // 2), width // 2), along_c().rowsBetween(-((height - 1) // 2), height // 2)
    return grid.withColumn("_w", how(value).over(t)).withColumn(out or value, how("_w").over(c)).drop("_w")


def whole_blocks(grid: DataFrame, mask: str, change: Callable[[np.ndarray], np.ndarray], **more: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """grid with its mask changed block by block: ``change`` takes and gives a block's mask as a [channels, times] array of 0 and 1.

    ``more`` are masks added by name, each out of the changed one. One exchange brings a block together, however many boxes
    the changes look through; missing cells are 0.
    """

    def run(table: pa.Table) -> pa.Table:
        chan, t = (place - place.min() for place in (table[c].to_numpy() for c in ("chan", "t")))
        cells = np.zeros((chan.max() + 1, t.max() + 1), np.int16)
        cells[chan, t] = pc.fill_null(table[mask], False).to_numpy()
        new = (change(cells) > 0).astype(np.int16)
        table = table.set_column(table.schema.get_field_index(mask), mask, pa.array(new[chan, t] > 0))
        for name, f in more.items():
            table = table.append_column(name, pa.array(f(new)[chan, t] > 0))
        return table

    fields = [StructField(f.name, BooleanType()) if f.name == mask else f for f in grid.schema.fields]
    return grid.groupBy(*B).applyInArrow(run, StructType(fields + [StructField(name, BooleanType()) for name in more]))


def around(cells: np.ndarray, height: int, width: int, how: np.ufunc = np.add) -> np.ndarray:
    """how (a sum or a maximum) over the height x width box around each cell, clipped at the borders."""
    for axis, size in enumerate((height, width)):
        padded = np.pad(cells, [((size - 1) // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)])
        n = cells.shape[axis]
        parts = [np.take(padded, range(k, k + n), axis) for k in range(size)]
        cells = how.reduce(parts)
    return cells


def without_lonely(grid: DataFrame, mask: str, n: int = 3) -> DataFrame:
    """Flags that are alone in their n x n neighbourhood go, all at once."""
    own = box(grid.withColumn("_n", F.col(mask).cast("int")), "_n", n, n)
    return own.withColumn(mask, F.col(mask) & (F.col("_n") > 1)).drop("_n")


def near(cells: np.ndarray, radius: int) -> np.ndarray:
    """Cells within ``radius`` steps of a set one: the least distance along time, then along channels, each by running minima."""
    far = np.where(cells > 0, 0, sum(cells.shape) + radius + 1)
    for axis in (1, 0):
        at = np.arange(cells.shape[axis])
        at = at if axis else at[:, None]
        before = np.minimum.accumulate(far - at, axis) + at
        after = np.flip(np.minimum.accumulate(np.flip(far + at, axis), axis), axis) - at
        far = np.minimum(before, after)
    return far <= radius


def dilated_diamond(grid: DataFrame, mask: str, radius: int) -> DataFrame:
    """Flags within ``radius`` steps of a flag, at a cost that doesn't grow with the radius."""
    return whole_blocks(grid, mask, lambda cells: near(cells, radius))


def joined_points(grid: DataFrame, mask: str, radius: int, **more: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Flags that are alone in their 3 x 3 neighbourhood go, then the others grow by a diamond; ``more`` masks out of these."""
    return whole_blocks(grid, mask, lambda cells: near(cells * (around(cells, 3, 3) > 1), radius), **more)


def dilated_box(grid: DataFrame, mask: str, height: int, width: int) -> DataFrame:
    return box(grid, mask, height, width, F.max)


def closed(grid: DataFrame, mask: str, height: int, width: int) -> DataFrame:
    return box(box(grid, mask, height, width, F.max), mask, height, width, F.min)


def voted(grid: DataFrame, mask: str, n: int, up: float, down: float) -> DataFrame:
    """1 where the share of flags in the n x n box reaches ``up``, 0 where it is below ``down``, else unchanged. An even n changes nothing."""
    if n % 2 == 0:
        return grid
    own = box(grid.withColumns({"_n": F.col(mask).cast("int"), "_k": F.lit(1)}), "_n", n, n)
    own = box(own, "_k", n, n).withColumn("_r", F.col("_n") / F.col("_k"))
    return own.withColumn(mask, F.when(F.col("_r") >= up, True).when(F.col("_r") < down, False).otherwise(F.col(mask))).drop("_n", "_k", "_r")


def cleaned_points(grid: DataFrame, mask: str) -> DataFrame:
    """Flags with at most one neighbour go; then dilation, median and dilation over 3 x 3."""

    def change(cells: np.ndarray) -> np.ndarray:
        cells = around(cells * (around(cells, 3, 3) > 2), 3, 3, np.maximum)
        return around((around(cells, 3, 3) >= 5).astype(np.int16), 3, 3, np.maximum)

    return whole_blocks(grid, mask, change)


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0 .. n - 1 that each is connected with by the links a - b."""
    root = np.arange(n)
    while True:
        own, other = root[a], root[b]
        apart = own != other
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(own, other)[apart], np.minimum(own, other)[apart])
        while (root[root] != root).any():
            root = root[root]


def touching(chan: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of runs of neighbouring channels that touch, corners included; runs by channel and time."""
    width = last.max() - first.min() + 3
    row, above = chan * width - first.min(), (chan + 1) * width - first.min()
    low, high = np.searchsorted(row + last, above + first - 1), np.searchsorted(row + first, above + last + 1, "right")
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(chan)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def components(grid: DataFrame, mask: str) -> DataFrame:
    """Runs (source, block, chan, first, last, n, comp) of the 8-connected components, numbered within their block.

    One exchange brings the runs of a block together, of which there are at most half as many as pixels; pixels don't travel
    beyond it, and no round of labels goes through the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chan", "ascending"), ("first", "ascending")])
        chan, first, last = (table[c].to_numpy().astype(np.int64) for c in ("chan", "first", "last"))
        return table.append_column("comp", pa.array(linked(len(chan), *touching(chan, first, last))))

    r = runs(grid, BC, "t", mask)
    return r.groupBy(*B).applyInArrow(run, StructType([*r.schema.fields, StructField("comp", LongType())]))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage where several branches or rounds read the same rows."""
    from quiltra.sources.sinks import new_path

    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxes(parts: DataFrame) -> DataFrame:
    """(comp, c0, c1, t0, t1, area) of each component."""
    return parts.groupBy(*B, "comp").agg(F.min("chan").alias("c0"), F.max("chan").alias("c1"), F.min("first").alias("t0"), F.max("last").alias("t1"), F.sum("n").alias("area"))


def shaped(b: DataFrame, area: int, fill: float, low: float, high: float, side: int = 0) -> DataFrame:
    """Boxes of components that are large, full and not too long."""
    h, w = F.col("c1") - F.col("c0") + 1, F.col("t1") - F.col("t0") + 1
    return b.filter((F.col("area") >= area) & (F.col("area") >= fill * h * w) & (w / h).between(low, high) & (h >= side) & (w >= side))


def inside(grid: DataFrame, b: DataFrame, out: str) -> DataFrame:
    """grid with ``out``: whether the pixel lies in some box. Boxes are exploded by channel, then bounded in time."""
    rows = b.select(*B, F.explode(F.sequence("c0", "c1")).alias("chan"), "t0", "t1")
    spans = rows.groupBy(*BC).agg(F.collect_set(F.struct("t0", "t1")).alias("_s"))
    own = grid.join(spans, BC, "left")
    return own.withColumn(out, F.coalesce(F.exists("_s", lambda s: (s["t0"] <= F.col("t")) & (F.col("t") <= s["t1"])), F.lit(False))).drop("_s")


def boxed_components(height: int = 1, width: int = 1, area: int = 5000, fill: float = 0.5, low: float = 0.2, high: float = 5.0, diamond: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Change of a block's mask to the boxes of its large, full components, dilated by height x width or by a diamond of that radius."""

    def boxed(cells: np.ndarray) -> np.ndarray:
        grown = (near(cells, diamond) if diamond else around(cells, height, width, np.maximum)) > 0
        edges = np.diff(np.pad(grown, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (chan, first), last = np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1
        out = np.zeros_like(cells)
        if len(chan):
            _, comp = np.unique(linked(len(chan), *touching(chan, first, last)), return_inverse=True)
            least = [np.full(comp.max() + 1, grown.size) for _ in range(4)]
            for x, y in zip(least, (chan, -chan, first, -last)):
                np.minimum.at(x, comp, y)
            c0, c1, t0, t1 = least[0], -least[1], least[2], -least[3]
            n, h, w = np.bincount(comp, weights=last - first + 1), c1 - c0 + 1, t1 - t0 + 1
            for i in np.flatnonzero((n >= area) & (n >= fill * h * w) & (w / h >= low) & (w / h <= high)):
                out[c0[i] : c1[i] + 1, t0[i] : t1[i] + 1] = 1
        return out

    return boxed


def blocks(grid: DataFrame, mask: str, height: int = 1, width: int = 1, area: int = 5000, fill: float = 0.5, low: float = 0.2, high: float = 5.0, diamond: int = 0) -> DataFrame:
    """Block flags: ``boxed_components`` of the mask."""
    return whole_blocks(grid.withColumn("m_block", F.col(mask)), "m_block", boxed_components(height, width, area, fill, low, high, diamond))


def repaired_lines(grid: DataFrame, label: str, taps: int, code: int = 1) -> DataFrame:
    """Class ``code`` closed along time over ``taps``; only background is filled."""
    own = grid.withColumn("_m", F.col(label) == code)
    half = taps // 2
    own = own.withColumn("_m", F.max("_m").over(along_t().rowsBetween(-half, half))).withColumn("_m", F.min("_m").over(along_t().rowsBetween(-half, half)))
    return own.withColumn(label, F.when((F.col(label) == 0) & F.col("_m"), code).otherwise(F.col(label))).drop("_m")


def points_to_blocks(grid: DataFrame, label: str, k: int, area: int = 400, side: int = 25, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Classes 3 and 4, closed by k x k: components that are large enough become 4 where they cover 0 or 3; the background
    inside of the others becomes 3."""
    own = closed(grid.withColumn("_m", F.col(label).isin(3, 4)), "_m", k, k)
    parts = components(own, "_m")
    b = boxes(parts)
    h, w = F.col("c1") - F.col("c0") + 1, F.col("t1") - F.col("t0") + 1
    b = b.withColumn("_big", (F.col("area") > area) & (h >= side) & (w >= side) & (w / h > low) & (w / h < high))
    cells = parts.join(b.select(*B, "comp", "_big"), [*B, "comp"]).select(*BC, "_big", F.explode(F.sequence("first", "last")).alias("t"))
    own = own.join(cells, [*BC, "t"], "left")
    new = F.when(F.col("_big") & F.col(label).isin(0, 3), 4).when(~F.col("_big") & (F.col(label) == 0), 3).otherwise(F.col(label))
    return own.withColumn(label, F.coalesce(new, F.col(label))).drop("_m", "_big")


def points_to_blocks_main(grid: DataFrame, label: str, k: int) -> DataFrame:
    """The same for classes 2, 3 and 4 by fill, size and aspect of the component's box: thin and small components become 3
    with all that they hold, large ones become 4 where they cover 0, 2 or 3. The closing takes at most 31 x 31."""
    k = max(1, min(k, 31))
    own = closed(grid.withColumn("_m", F.col(label).isin(2, 3, 4)), "_m", k, k)
    parts = components(own, "_m")
    b = boxes(parts)
    h, w = F.col("c1") - F.col("c0") + 1, F.col("t1") - F.col("t0") + 1
    side, ratio = max(20, 2 * k), w / h
    thin = (F.col("area") < 0.45 * h * w) & (w > max(10, 2 * k))
    big = ((F.col("area") > 800) & (w >= side) & (h >= side) & (ratio > 0.25) & (ratio < 4.0)) | ((F.col("area") > 1500) & (ratio > 0.2) & (ratio < 5))
    b = b.withColumn("_to", F.when(thin, 3).when(big, 4).when(F.col("area") < 400, 3))
    cells = parts.join(b.select(*B, "comp", "_to"), [*B, "comp"]).select(*BC, "_to", F.explode(F.sequence("first", "last")).alias("t"))
    own = own.join(cells, [*BC, "t"], "left")
    new = F.when((F.col("_to") == 4) & F.col(label).isin(0, 2, 3), 4).when(F.col("_to") == 3, 3).otherwise(F.col(label))
    return own.withColumn(label, F.coalesce(new, F.col(label))).drop("_m", "_to")


def binary(grid: DataFrame, label: str) -> DataFrame:
    """0/255 masks as 0/1: by the block's largest value."""
    top = F.max(label).over(Window.partitionBy(*B))
    return grid.withColumn(label, F.when(top > 1, (F.col(label) > 127).cast("int")).otherwise(F.col(label)))
