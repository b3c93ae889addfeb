"""Size-balanced sharding by sampled splitters.

Rows are ordered by a key that puts equal texts side by side and spreads the rest evenly: the high bits hash the text,
the low bits hash the id. A size-weighted sample of keys gives quantile splitters; rows are range-partitioned between
them into fine ranges, whose exact sizes are then counted. Ranges that hold over twice their share are subdivided by
splitters drawn from a denser sample of their own rows. Shard borders are cut on the exact running sum of sizes.

Defined results: a null text counts as no bytes (size 16, crc 0); equal keys are ordered by doc_id, then size and crc,
so repeated rows are all placed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
ROW_BYTES = 16
#: Fine ranges: one for about so many rows, within these bounds; both the splitters and the table of ranges stay this small.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 2_000, 640, 10_240
#: Keys drawn for each fine range, in expectation.
OVERSAMPLE = 16


def shard_key() -> Column:
    """36 bits of the text's hash, then 24 bits of the id's hash."""
    text, own = F.md5(F.coalesce("text", F.lit(""))), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.concat(F.substring(text, 1, 9), F.substring(own, 1, 6)), 16, 10).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return base.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), shard_key().alias("key"))


def drawn(rows: DataFrame, step: float, salt: int) -> np.ndarray:
    """Keys drawn with probability size/step, at most 1; the draw is a hash, so a rerun gives the same sample."""
    chance = (F.shiftright(F.xxhash64("doc_id", "size", F.lit(salt)), 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))
    got = rows.filter(chance < F.col("size") / F.lit(step)).select("key").toArrow()
    return np.sort(got["key"].to_numpy())


def quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    """Distinct splitters between equal parts of the sorted sample."""
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) and parts > 1 else keys[:0]


def with_range(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    cuts = splitters.astype(np.int64)

    def find(batches):
        for batch in batches:
            at = np.searchsorted(cuts, batch["key"].to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "range"])

    return rows.mapInArrow(find, "doc_id long, size long, text_crc32 long, key long, range int")


def splitters_for(rows: DataFrame, n_rows: int, n_bytes: int) -> np.ndarray:
    """Size-weighted quantile splitters; overfull ranges get splitters of their own."""
    parts = int(np.clip(n_rows // ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES))
    cuts = quantiles(drawn(rows, max(1.0, n_bytes / (parts * OVERSAMPLE)), 0), parts)
    sizes = {r["range"]: r["size"] for r in with_range(rows, cuts).groupBy("range").agg(F.sum("size").alias("size")).collect()}
    share = n_bytes / parts
    full = sorted(r for r, size in sizes.items() if size > 2 * share)
    if full:
        inside = with_range(rows, cuts).filter(F.col("range").isin(full)).drop("range")
        more = drawn(inside, max(1.0, sum(sizes[r] for r in full) / (parts * OVERSAMPLE)), 1)
        at = np.searchsorted(cuts, more, side="right")
        for r in full:
            own = more[at == r]
            cuts = np.union1d(cuts, quantiles(own, int(np.ceil(sizes[r] / share))))
    return cuts


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near-equal size, slots gapless from 0 in each shard."""
    rows = keyed(docs, id_col, text_col)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    placed = common.stored(with_range(rows, splitters_for(rows, total["n"], total["bytes"])), "sharding")
    # One row for each fine range: at most twice MOST_RANGES.
    spans = placed.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", (F.sum("bytes").over(Window.orderBy("range")) - F.col("bytes")).alias("bytes_before"))
    own = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    before = F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    shard = F.least(F.lit(n - 1), F.floor(before * n / F.lit(max(1, total["bytes"])))).cast("int")
    cut = placed.join(F.broadcast(spans), "range").withColumn("shard", shard).withColumn("rank", F.row_number().over(own))
    # A range may end one shard and begin the next: slots run on from the rows of the shard's earlier ranges.
    runs = cut.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    runs = runs.select("shard", "range", "first", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("rows_before"))
    slot = (F.col("rows_before") + F.col("rank") - F.col("first")).cast("long")
    return cut.join(F.broadcast(runs), ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, n: int = SHARDS) -> None:
    """Whole documents into one folder for each shard, in slot order within a file."""
    placed = shards(docs, n).select(F.col("doc_id").alias("_doc"), "shard", "slot", F.col("text_crc32").alias("_crc"))
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    placed = placed.withColumn("_copy", F.row_number().over(Window.partitionBy("_doc", "_crc").orderBy("shard", "slot")))
    numbered = docs.withColumn("_crc", crc).withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_crc").orderBy("text")))
    joined = numbered.join(placed, (F.col("doc_id") == F.col("_doc")) & (numbered["_crc"] == placed["_crc"]) & (numbered["_copy"] == placed["_copy"]))
    joined.drop("_doc", "_crc", "_copy").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal size."""
    placed = shards(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rows in DuckDB, on the running sum over all rows; the checksum's table is built from its rule.
OP6_SQL = """
WITH r AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT doc_id, text, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 9) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6) AS BIGINT) AS key FROM documents),
c AS (SELECT doc_id, size, key, CAST(xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, size - 15), lambda i: CAST('0x' || hex(array_slice(b, i, i)) AS BIGINT))), lambda c, x: xor(steps[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))) AS BIGINT) AS text_crc32 FROM d, r),
s AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least(39, floor(before * 40 / total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
