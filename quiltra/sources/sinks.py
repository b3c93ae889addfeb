"""Sinks of grids, masks, manifests and metrics. All write through Spark and return what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # A folder of this machine serves local masters only, whose tasks run here.
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="quiltra-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What a caller must say to have stored blocks replaced.
CONFIRMATION = "replace the stored blocks"


def by_block(grid: DataFrame, path: str, overwrite: bool = False, confirmed: str = "") -> DataFrame:
    """One folder for each source and block; fails if the path exists, unless only the given blocks are to be replaced.

    Blocks are replaced in place only if ``confirmed`` is the sentence CONFIRMATION.
    """
    spark = grid.sparkSession
    writer = grid.repartition("source", "block").write.partitionBy("source", "block")
    if overwrite and confirmed != CONFIRMATION:
        raise ValueError(f"stored blocks are replaced only if confirmed is {CONFIRMATION!r}")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def label_masks(labels: DataFrame, path: str) -> DataFrame:
    """Class masks, one folder for each class, named {source}_block{i}."""
    named = labels.filter("label <> 0").withColumn("name", F.concat("source", F.lit("_block"), F.col("block")))
    named.write.partitionBy("label").mode("errorifexists").parquet(path)
    return labels.sparkSession.read.parquet(path)


def json_lines(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("errorifexists").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def csv(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("errorifexists").csv(path, header=True)
    return rows.sparkSession.read.schema(rows.schema).csv(path, header=True)


def run_summary(rows: DataFrame, per_block: int, pixels: DataFrame, mask: str, limits: dict[str, float], path: str) -> DataFrame:
    """One row of a run, as JSON: geometry, rows of ``rows`` after the last whole block, pixels and flagged ones, thresholds."""
    tail = rows.agg((F.count("*") % per_block).alias("tail_rows"))
    one = pixels.agg(F.countDistinct("source", "block").alias("blocks"), F.countDistinct("chan").alias("nchan"), (F.max("t") + 1).alias("nsamp"), F.count("*").alias("pixels"), F.count_if(mask).alias("flagged"))
    return json_lines(one.crossJoin(tail).withColumns({k: F.lit(float(v)) for k, v in limits.items()}), path)


def file_lists(before: DataFrame, after: DataFrame, name: str, folder: str) -> DataFrame:
    """The names before and after a change as text files in order; returns (list, name) as read back."""
    parts = [lines(rows, name, name, f"{folder}/{which}").select(F.lit(which).alias("list"), F.col("value").alias(name)) for which, rows in (("before", before), ("after", after))]
    return parts[0].unionByName(parts[1])


def lines(rows: DataFrame, column: str, order: str, path: str) -> DataFrame:
    rows.orderBy(order).select(column).write.mode("errorifexists").text(path)
    return rows.sparkSession.read.text(path)


def committed(plan: DataFrame, sources: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """Writes a plan's rows (name) with their data if all sources exist and no target does."""
    if plan.join(sources, "name", "left_anti").limit(1).count():
        raise ValueError("a planned source is missing")
    if plan.join(existing, plan["target"] == existing["target"], "left_semi").limit(1).count():
        raise ValueError("a planned target exists")
    plan.join(sources, "name").write.mode("errorifexists").parquet(path)
    return plan.sparkSession.read.parquet(path)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The file changed last, by Spark's own file metadata."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
