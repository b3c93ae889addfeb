"""Shared helpers: table access, scratch folders, hashing and word splitting inside tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that extra columns of any name can't clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``texts`` with all columns of the row, as they are, in the struct _row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*docs.columns).alias("_row"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the cluster (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # A folder of this machine serves local masters only, whose tasks run here.
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quiltra-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stored with a number of its own for each row, and the name of that column, which no other has.

    It carries rows through operators that know doc_id alone.
    """
    name = "_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows by their column ``bucket`` (numbers from 0 on), each partition with as many buckets as any other, give or take one.

    Sorted by bucket, then ``order``. Spark deals rows by a hash; each partition's buckets carry a number that falls to it.
    """
    parts = partitions(rows.sparkSession)
    number = {r["part"]: r["id"] for r in rows.sparkSession.range(24 * parts, numPartitions=1).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("part")).collect()}
    slots = F.split(F.lit(",".join(str(number.get(p, p)) for p in range(parts))), ",").cast("array<int>")
    slot = F.element_at(slots, F.col("bucket") % parts + 1)
    return rows.withColumn("slot", slot).repartition(parts, "slot").sortWithinPartitions("bucket", *order).drop("slot")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(place, text) of each row, and (place, doc_id) where they differ.

    A place is a number of its own for each row, in the order of doc_id, null last, then of the text. It is doc_id
    itself where no id is null or repeated, which a count by id tells.
    """
    own = texts(docs)
    if not own.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        return own.withColumnRenamed("doc_id", "place"), None
    order = [F.col("doc_id").asc_nulls_last(), "text"]
    ordered = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    numbered = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "placed")
    return numbered.select("place", "text"), numbered.select("place", "doc_id")


def with_ids(out: DataFrame, ids: DataFrame | None) -> DataFrame:
    """out with doc_id in place of its column place."""
    if ids is None:
        return out.withColumnRenamed("place", "doc_id")
    return out.join(ids, "place").select("doc_id", *[c for c in out.columns if c != "place"])


def raw(column: pa.Array) -> list:
    """The column's values as bytes (strings as UTF-8), None for null."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and where each row begins and ends in them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, cuts - cuts[0]


def sliced(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 21):
    """The batch in slices of about ``limit`` bytes of text, so that arrays over single bytes stay small."""
    if not batch.num_rows:
        return
    ends = flat(batch[text])[1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: A random number for each byte value at each place of a word's first 64 bytes.
_PLACED = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64))


def word_table(data: np.ndarray, cuts: np.ndarray, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space of several texts in one byte array.

    Returns their 64-bit hashes, first bytes and ends, and for each text (and the end) the number of words before it.
    Arrays over single bytes hold about ``piece`` of them, however long a text is: it is taken up to a white space.
    """
    n = len(data)
    if n <= 2 * piece:
        return _words(data, cuts)
    bounds = [0]
    while bounds[-1] < n:
        at = min(n, bounds[-1] + piece)
        ends = cuts[np.searchsorted(cuts, at) :]
        stop = int(ends[0]) if len(ends) else n
        while at < stop:  # the next white space, or the text's end
            found = np.flatnonzero(_IS_SPACE[data[at : min(stop, at + 4096)]])
            if len(found):
                at += int(found[0])
                break
            at = min(stop, at + 4096)
        bounds.append(at)
    parts = [(a, *_words(data[a:b], np.unique(np.clip(cuts, a, b)) - a)) for a, b in zip(bounds, bounds[1:])]
    hashes, starts, ends = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + p[0] for p in parts]), np.concatenate([p[3] + p[0] for p in parts])
    return hashes, starts, ends, np.searchsorted(starts, cuts)


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = cuts[:-1][cuts[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, cuts)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, before
    lead = starts[0]
    place = np.arange(lead, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    part = _PLACED[data[lead:].astype(np.int64) + ((place & 63) << 8)]
    if place.max() >= 64:
        part = part * (2 * (place >> 6).astype(np.uint64) + np.uint64(1))
    part[~inside[lead:]] = 0
    total = np.add.reduceat(part, starts - lead)
    length = np.add.reduceat(inside[lead:].astype(np.int64), starts - lead)
    return mix(total + length.astype(np.uint64)), starts, starts + length, before


_STEP = np.uint64(0xF1357AEA2E62A9C5)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every run of ``width`` values."""
    n = len(values) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(width if n > 0 else 0):
        out = out * _STEP + values[j : j + n]
    return mix(out)


def thin(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(values.astype(np.int64), prepend=0).astype("<i8").tobytes())


def thick(data: bytes) -> np.ndarray:
    """The numbers of ``thin``."""
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8"))
