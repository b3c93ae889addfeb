"""Structured Streaming forms: block-wise detection, time-binned means, one output for each block, running timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltra.functions.exprs import B
from quiltra.sources.sinks import new_path


def source(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A file-source stream over one table of a folder."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name}.parquet*")


def run(stream: DataFrame, handle, checkpoint: str) -> None:
    """All that is there, batch by batch, with handle(batch, number)."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def by_block(stream: DataFrame, to_grid, detect, path: str, cells: int) -> DataFrame:
    """detect on whole blocks of ``cells`` pixels, whose rows may come in several batches.

    A batch's pixels, to_grid(batch), join those that the batch before left over. Blocks that are whole are detected and
    written to the batch's own folder; the others are left over for the next batch. So each pixel is kept until its block is
    whole and read once more for each batch in between, and a block has one output. What is left when the stream has no more
    is detected as it is. Leftovers alternate between two folders, and a batch overwrites only its own, so one that is run
    again gives the same. Each pixel is expected once.
    """
    spark = stream.sparkSession
    held = new_path(spark, "pixels")
    nothing = to_grid(spark.createDataFrame([], stream.schema))
    last: list[int] = []

    def left(number: int) -> DataFrame:
        return spark.read.schema(nothing.schema).parquet(f"{held}/{number % 2}")

    def put(grid: DataFrame, name: str) -> None:
        detect(grid).write.mode("overwrite").parquet(f"{path}/batch={name}")

    def handle(batch: DataFrame, number: int) -> None:
        grid = to_grid(batch)
        grid = grid.unionByName(left(number - 1)) if number else grid
        counted = grid.withColumn("_n", F.count("*").over(Window.partitionBy(*B))).persist()
        try:
            put(counted.filter(F.col("_n") >= cells).drop("_n"), str(number))
            counted.filter(F.col("_n") < cells).drop("_n").write.mode("overwrite").parquet(f"{held}/{number % 2}")
        finally:
            counted.unpersist()
        last[:] = [number]

    run(stream, handle, new_path(spark, "stream"))
    put(left(last[0]) if last else nothing, "last")
    return spark.read.schema(detect(nothing).schema).parquet(path).drop("batch")


def binned(events: DataFrame, ts: str, value: str, width: str, late: str) -> DataFrame:
    """Mean and count of each time bin, final once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean", "n")


def appended(stream: DataFrame, path: str) -> DataFrame:
    """A stream's final rows as a table."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def running(stream: DataFrame, keys: list[str], value: str, path: str) -> DataFrame:
    """Running count, total, least and most by keys, in update mode; the last update of each key."""
    spark = stream.sparkSession
    s = stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    q = s.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("n", "total", "least", "most"), "batch").alias("x"))
    return last.select(*keys, "x.n", "x.total", "x.least", "x.most")
