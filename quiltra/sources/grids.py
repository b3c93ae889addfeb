"""Pixel grids (source, block, chan, t, v) from tables, and their packed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltra.functions.exprs import B, BC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_grid(spark: SparkSession, sf_dir: str, block: int = 100) -> DataFrame:
    """Vectors as spectra: one channel for each element, ``block`` vectors in a block."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("chan", "v"))
    place = F.floor(F.col("vec_id") / block).cast("long").alias("block"), (F.col("vec_id") % block).cast("int").alias("t")
    return e.select(F.lit("emb").alias("source"), place[0], F.col("chan").cast("int").alias("chan"), place[1], F.col("v").cast("double").alias("v"))


def lineitem_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by supplier group and month; summed in whole cents, so that the order of rows doesn't matter."""
    li = table(spark, sf_dir, "lineitem")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    g = li.groupBy((F.col("l_suppkey") % 32).cast("int").alias("chan"), month.alias("t")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 100).alias("v"))
    return g.select(F.lit("line").alias("source"), F.lit(0).cast("long").alias("block"), "chan", "t", "v")


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by user group and hour; cells without events are missing."""
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("int")
    g = e.groupBy((F.col("user_id") % 16).cast("int").alias("chan"), hour.alias("t")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 100).alias("v"))
    return g.select(F.lit("evt").alias("source"), F.lit(0).cast("long").alias("block"), "chan", "t", "v")


def by_block(grid: DataFrame) -> DataFrame:
    """One exchange by block, which windows along either axis then reuse."""
    return grid.repartition(*B)


def packed(grid: DataFrame, value: str = "v") -> DataFrame:
    """(source, block, chan, v array in time order)."""
    return grid.groupBy(*BC).agg(F.array_sort(F.collect_list(F.struct("t", value))).alias("_s")).select(*BC, F.transform("_s", lambda x: x[value]).alias(value))


def unpacked(series: DataFrame, value: str = "v") -> DataFrame:
    return series.select(*BC, F.posexplode(value).alias("t", value))


def filled(grid: DataFrame, chans: int, times: int, value: float = 0.0) -> DataFrame:
    """Every cell of chans x times of each block; missing ones get ``value``. The block's cells are generated, not joined to all."""
    cells = grid.select(*B).distinct().select(*B, F.explode(F.sequence(F.lit(0), F.lit(chans - 1))).alias("chan")).select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t"))
    return cells.join(grid, [*BC, "t"], "left").withColumn("v", F.coalesce("v", F.lit(value)))


# Sub-integrations: rows of quantised samples.


def quantised(grid: DataFrame) -> DataFrame:
    """Eight-bit samples of each channel: scale = range / 255, or 1 with offset max where the range is 0; rounded half up."""
    s = grid.groupBy(*BC).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    s = s.select(*BC, F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0).alias("scl"), F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("hi")).alias("offs"))
    raw = F.floor((F.col("v") - F.col("offs")) / F.col("scl") + 0.5).cast("int")
    return grid.join(s, BC).select(*BC, "t", raw.alias("raw"), "scl", "offs")


def quantised_block(grid: DataFrame) -> DataFrame:
    """Eight-bit samples with one scale for the block, cut towards zero and clipped to 0..255."""
    s = grid.groupBy(*B).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0)
    raw = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") - F.col("lo")) / step))).cast("int")
    return grid.join(s, B).select(*BC, "t", raw.alias("raw"), step.alias("scl"), F.col("lo").alias("offs"))


def dequantised(samples: DataFrame) -> DataFrame:
    return samples.select(*BC, "t", (F.col("raw") * F.col("scl") + F.col("offs")).alias("v"))


def subints(samples: DataFrame, nsblk: int) -> DataFrame:
    """One row for nsblk times: data in time-major order, with each channel's scale and offset. The last row may have fewer."""
    own = samples.withColumn("subint", F.floor(F.col("t") / nsblk).cast("long"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("t", "chan", "raw"))), lambda x: x["raw"]).alias("data")
    scales = F.array_sort(F.collect_set(F.struct("chan", "scl", "offs")))
    out = own.groupBy(*B, "subint").agg(data, scales.alias("s"))
    return out.select(*B, "subint", F.lit(nsblk).alias("nsblk"), "data", F.transform("s", lambda x: x["scl"]).alias("dat_scl"), F.transform("s", lambda x: x["offs"]).alias("dat_offs"))


def samples_of(rows: DataFrame, nchan: int, npol: int = 1, pol: int = 0) -> DataFrame:
    """Samples of one polarisation of (nsblk, npol, nchan) rows, dequantised with the row's own scales.

    A row begins nsblk times after the one before it, also where it has fewer times itself.
    """
    flat = rows.select(*B, "subint", "nsblk", "dat_scl", "dat_offs", F.posexplode("data").alias("pos", "raw"))
    chan = F.col("pos") % nchan
    own = flat.filter(F.floor(F.col("pos") / nchan) % npol == pol)
    t = (F.col("subint") * F.col("nsblk") + F.floor(F.col("pos") / (npol * nchan))).cast("int")
    v = F.col("raw") * F.element_at("dat_scl", chan + 1) + F.element_at("dat_offs", chan + 1)
    return own.select(*B, chan.cast("int").alias("chan"), t.alias("t"), v.alias("v"))


def grouped_blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """Blocks of consecutive rows by ``subint``; the rows after the last whole block go."""
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).filter(F.floor(F.col("subint") / per_block) < F.floor(F.col("n") / per_block)).withColumn("new_block", F.floor(F.col("subint") / per_block).cast("long")).drop("n")


def frequency(centre: float, width: float, nchan: int, chan: Column) -> Column:
    """Middle of a channel. Frequencies rise with the channel, also where the width is negative: such bands are turned round."""
    return F.lit(centre) - abs(width) / 2 + (chan + 0.5) * (abs(width) / nchan)


def stitched(grid: DataFrame, k: int, nsamp: int) -> DataFrame:
    """k blocks in a row as one; groups that lack a block go."""
    own = grid.withColumns({"wide": F.floor(F.col("block") / k).cast("long"), "wide_t": (F.col("t") + (F.col("block") % k) * nsamp).cast("int")})
    whole = own.groupBy("source", "wide").agg(F.countDistinct("block").alias("k")).filter(F.col("k") == k).select("source", "wide")
    return own.join(whole, ["source", "wide"], "left_semi").select("source", F.col("wide").alias("block"), "chan", F.col("wide_t").alias("t"), "v")


def source_name(path: Column) -> Column:
    """Base name without extension, its first two parts between underscores."""
    return F.concat_ws("_", F.slice(F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_"), 1, 2))
