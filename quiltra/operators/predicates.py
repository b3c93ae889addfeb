"""Projections, filters and name rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltra.functions.exprs import B


def only_channels(mask: str, chans: list[int]) -> Column:
    return F.when(F.col("chan").isin(chans), F.col(mask)).otherwise(False)


def only_range(mask: str, lo: int, hi: int, nchan: int) -> Column:
    return F.when(F.col("chan").between(max(0, lo), min(nchan - 1, hi)), F.col(mask)).otherwise(False)


def closest_channel(grid: DataFrame, freq: str, wanted: float) -> DataFrame:
    """The channel nearest to a frequency, the first on ties."""
    return grid.groupBy(*B).agg(F.min_by("chan", F.struct(F.abs(F.col(freq) - wanted), F.col("chan"))).alias("chan"))


def shown(label: str, classes: str) -> Column:
    """Labels of a list like "1,3"; others become 0."""
    return F.when(F.array_contains(F.transform(F.split(F.lit(classes), ","), lambda x: F.trim(x).cast("int")), F.col(label).cast("int")), F.col(label)).otherwise(0)


def block_id(name: Column, anchored: bool = False) -> Column:
    got = F.regexp_extract(name, r"block(\d+)\.png$" if anchored else r"block(\d+)", 1)
    return F.when(got != "", got).cast("int")


def factor(name: Column) -> Column:
    """Downsampling factor at the end of a name, 1 if none."""
    got = F.regexp_extract(name, r"_Downsamp(\d+)$", 1)
    return F.coalesce(F.when(got != "", got).cast("int"), F.lit(1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"_Downsamp\d+$", "")


def cover_name(name: Column) -> Column:
    return F.regexp_replace(name, r"_block\d+$", "")


def numeric_key(name: Column) -> Column:
    got = F.regexp_extract(name, r"(?:block|mask_merged_)(\d+)", 1)
    return F.coalesce(F.when(got != "", got).cast("long"), F.lit(0))


def chosen_style(names: DataFrame, name: str, styles: list[str]) -> DataFrame:
    """The names of the first style (a LIKE pattern) that any name has."""
    has = names.agg(*[F.max(F.col(name).like(s)).alias(f"s{i}") for i, s in enumerate(styles)])
    first = F.coalesce(*[F.when(F.col(f"s{i}"), F.lit(i)) for i in range(len(styles))])
    match = F.coalesce(*[F.when(F.col("_style") == i, F.col(name).like(s)) for i, s in enumerate(styles)])
    return names.crossJoin(F.broadcast(has.select(first.alias("_style")))).filter(match).drop("_style")


def protected(name: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def valid(*labels: str, allowed=(0, 1, 2, 6, 7, 8)) -> Column:
    out = F.lit(True)
    for c in labels:
        out = out & F.col(c).isin(list(allowed))
    return out
