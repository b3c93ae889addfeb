"""Runs of consecutive flags: gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], at: str, flag: str) -> DataFrame:
    """(keys, first, last, n) of the runs of consecutive flagged places along ``at``."""
    own = rows.filter(F.col(flag)).withColumn("_island", F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    return own.groupBy(*keys, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_island")


def in_runs(rows: DataFrame, keys: list[str], at: str, flag: str, least: int, out: str) -> DataFrame:
    """rows with ``out``: whether the place is flagged and its run has at least ``least`` places."""
    own = rows.withColumn("_island", F.col(at) - F.count_if(F.col(flag)).over(Window.partitionBy(*keys).orderBy(at)))
    run = Window.partitionBy(*keys, flag, "_island")
    return own.withColumn(out, F.col(flag) & (F.count("*").over(run) >= least)).drop("_island")


def without_isolated(channels: DataFrame, keys: list[str], at: str, flag: str, longest: int = 2, gap: int = 2) -> DataFrame:
    """(keys, first, last, n) of the runs that stay: longer ones, and short ones with a flag within ``gap`` on either side."""
    own = runs(channels, keys, at, flag)
    w = Window.partitionBy(*keys).orderBy("first")
    before = F.coalesce(F.col("first") - F.lag("last").over(w) <= gap, F.lit(False))
    after = F.coalesce(F.lead("first").over(w) - F.col("last") <= gap, F.lit(False))
    return own.withColumn("_near", before | after).filter((F.col("n") > longest) | F.col("_near")).drop("_near")
