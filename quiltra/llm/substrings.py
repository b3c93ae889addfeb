"""Substring dedup by difference-cover anchors: repeated windows of words, all but the first occurrence removed.

1. Anchors: in each text, runs of ANCHOR words are hashed at cover positions only, the places p with p mod PERIOD in
   COVER. Every difference modulo PERIOD is one of two cover residues, so two equal windows of WINDOW words share an anchor
   that lies at the same place in both: it starts at one of their first PERIOD words, and ANCHOR = WINDOW - PERIOD + 1.
2. Anchors that occur once are dropped: rows meet by hash. What a task sees repeated it marks at once and sends a single
   row of that hash on, so the rows of a hash are at most the tasks' number, not the number of copies. Places travel many
   to a row, in buckets of the hash, which are judged one at a time.
3. The places of repeated anchors go back to their texts, and extend there: all windows around them are candidates. They
   meet by the hash of their words, with the same pre-aggregation, and all but the smallest (doc_id, start) are removed.

Defined results: null and empty texts have no words; texts shorter than a window keep all words; of rows with equal ids the
one with the smaller text is earlier (rows that are wholly equal in any order), and null ids come last; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Places that a task gathers before it looks for repeats among them.
FLUSH = 1_500_000
#: A bucket is for about so many bytes of text, with BUCKETS for each shuffle partition at least; one is in memory at a time.
BUCKET_BYTES, BUCKETS = 8 << 20, 2

#: Texts that are unpacked at a time.
PIECE_ROWS = 64

#: Kinds of a place: to be judged with the others of its key; settled; stands for settled ones.
OPEN, SETTLED, STANDS = 0, 1, 2


def is_cover(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def settled(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, keep_first: bool) -> tuple[np.ndarray, ...]:
    """Rows (key, doc_id, start, kind) after a look for repeats among them.

    Without keep_first all repeats of a key are settled, and one more row stands for them; with it the smallest place of a
    key stays open and the others are settled. Settled rows get keys that spread them evenly.
    """
    order = np.lexsort((starts, docs, keys)) if keep_first else np.argsort(keys, kind="stable")
    keys, docs, starts = keys[order], docs[order], starts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    last = np.ones(len(keys), bool)
    last[:-1] = first[1:]
    known = ~first if keep_first else ~(first & last)
    own = common.mix(docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + starts.astype(np.uint64))
    kind = np.where(known, SETTLED, OPEN).astype(np.int8)
    out_keys = np.where(known, own, keys)
    if keep_first:
        return out_keys, docs, starts, kind
    more = np.flatnonzero(first & ~last)
    return np.concatenate([out_keys, keys[more]]), np.concatenate([docs, docs[more]]), np.concatenate([starts, starts[more]]), np.concatenate([kind, np.full(len(more), STANDS, np.int8)])


#: Many places in one row: documents, their numbers of places, starts, and keys and kinds where there are any.
PACKED = "bucket int, docs binary, counts binary, starts binary, keys binary, kinds binary"


def bucket_count(texts: DataFrame) -> int:
    """The number of buckets for these texts, from their bytes."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BUCKETS * common.partitions(texts.sparkSession), total // BUCKET_BYTES)


def packed(buckets: np.ndarray, docs: np.ndarray, starts: np.ndarray, keys: np.ndarray | None = None, kinds: np.ndarray | None = None):
    """Record batches of one row for each bucket."""
    order = np.lexsort((starts, docs, buckets))
    buckets, docs, starts = buckets[order], docs[order], starts[order]
    keys, kinds = (x if x is None else x[order] for x in (keys, kinds))
    cuts = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)) if len(buckets) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        own, n = np.unique(docs[a:b], return_counts=True)
        row = {"bucket": pa.array([buckets[a]], pa.int32()), "docs": common.thin(own), "counts": common.thin(n), "starts": common.thin(starts[a:b])}
        row |= {"keys": b"" if keys is None else keys[a:b].astype("<u8").tobytes(), "kinds": b"" if kinds is None else common.thin(kinds[a:b])}
        yield pa.RecordBatch.from_pydict({k: v if k == "bucket" else pa.array([v], pa.binary()) for k, v in row.items()})


def unpacked(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(docs, starts, keys, kinds) of packed rows."""
    cat = lambda name: np.concatenate([common.thick(r[name]) for r in rows])
    return np.repeat(cat("docs"), cat("counts")), cat("starts"), np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows]), cat("kinds")


def flushed(pieces):
    """Tuples of arrays, joined up to FLUSH places at a time."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= FLUSH:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def gathered(pieces, keep_first: bool, buckets: int):
    """Packed rows of (keys, docs, starts) arrays by bucket of the key, after a look for repeats in each FLUSH of them."""
    for piece in flushed(pieces):
        keys, docs, starts, kinds = settled(*piece, keep_first)
        yield from packed((keys % np.uint64(buckets)).astype(np.int32), docs, starts, keys, kinds)


def by_bucket(batches):
    """Lists of rows (dicts) of one bucket each, from batches sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if rows:
                    yield rows
                bucket, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield rows


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (common.mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors of every whole text."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def pieces(batches):
        for batch in batches:
            for part in common.sliced(batch):
                hashes, _, _, before = common.word_table(*common.flat(part["text"]))
                n = np.diff(before)
                owner = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(hashes)) - before[owner]
                at = np.flatnonzero(cover[place % PERIOD] & (place + ANCHOR <= n[owner]) & (n[owner] >= WINDOW))
                if len(at):
                    yield common.windows(hashes, ANCHOR)[at], part["doc_id"].to_numpy()[owner[at]], place[at]

    return docs.mapInArrow(lambda batches: gathered(pieces(batches), False, buckets), PACKED)


def judged(rows: DataFrame, keep_first: bool, buckets: int) -> DataFrame:
    """Packed places, by bucket of their document: settled ones, and open ones that share their key with another place
    (with keep_first: that aren't the smallest place of their key)."""

    def judge(batches):
        for own in by_bucket(batches):
            docs, starts, keys, kinds = unpacked(own)
            order = np.lexsort((starts, docs, kinds == SETTLED, keys))
            docs, starts, keys, kinds = docs[order], starts[order], keys[order], kinds[order]
            same = keys[1:] == keys[:-1]
            if keep_first:
                # A settled place has a key of its own, so the first of a key is its smallest open place.
                first = np.append(True, ~same)
                heads = np.flatnonzero(first)[np.cumsum(first) - 1]
                found = (kinds == SETTLED) | (docs != docs[heads]) | (starts != starts[heads])
            else:
                found = (kinds == SETTLED) | ((kinds == OPEN) & (np.append(same, False) | np.append(False, same)))
            yield docs[found], starts[found]

    def run(batches):
        for docs, starts in flushed(judge(batches)):
            yield from packed(doc_bucket(docs, buckets), docs, starts)

    return common.dealt(rows).mapInArrow(run, PACKED)


def with_places(texts: DataFrame, places: DataFrame, schema: str, handle, buckets: int, index=None, columns: list[str] = ("docs", "counts", "starts")) -> DataFrame:
    """What ``handle`` yields for an iterator of (documents, texts, starts by document), texts of a bucket with their places.

    Texts travel compressed; a bucket's places come first and stay in memory while its texts stream by.
    """
    make, columns = index or Places, list(columns)

    def squeeze(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            docs = batch["doc_id"].to_numpy()
            data = pa.array([press(t) for t in common.raw(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_pydict({"bucket": doc_bucket(docs, buckets), "rank": pa.array(np.ones(len(docs), np.int8)), "doc_id": docs, "data": data} | {c: pa.nulls(len(docs), pa.binary()) for c in columns})

    def pieces(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        bucket, starts, known = None, None, []
        for batch in batches:
            rank, names = batch["rank"].to_numpy(), batch["bucket"].to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (rank[1:] != rank[:-1]))), len(rank)) if len(rank) else []
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if names[a] != bucket:
                    bucket, known, starts = names[a], [], None
                if rank[a] == 0:
                    known += part.select(columns).to_pylist()
                    continue
                if starts is None:
                    starts = make(known)
                    known = []
                for at in range(0, part.num_rows, PIECE_ROWS):
                    some = part.slice(at, PIECE_ROWS)
                    docs = some["doc_id"].to_numpy()
                    yield docs, [unpress(x) for x in some["data"].to_pylist()], [starts.of(d) for d in docs.tolist()]

    squeezed = texts.mapInArrow(squeeze, ", ".join(["bucket int, rank byte, doc_id long, data binary", *(f"{c} binary" for c in columns)]))
    own = places.select("bucket", F.lit(0).cast("byte").alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("data"), *columns)
    return common.dealt(squeezed.unionByName(own), "rank").mapInArrow(lambda batches: handle(pieces(batches)), schema)


class Places:
    """Sorted starts by document, out of packed rows."""

    def __init__(self, rows: list[dict]) -> None:
        docs = np.zeros(0, np.int64)
        self.starts = docs
        if rows:
            cat = lambda name: np.concatenate([common.thick(r[name]) for r in rows])
            docs, self.starts = np.repeat(cat("docs"), cat("counts")), cat("starts")
            order = np.lexsort((self.starts, docs))
            docs, self.starts = docs[order], self.starts[order]
        self.docs, at = np.unique(docs, return_index=True)
        self.cuts = np.append(at, len(docs))

    def of(self, doc: int) -> np.ndarray:
        k = int(np.searchsorted(self.docs, doc))
        return self.starts[self.cuts[k] : self.cuts[k + 1]] if k < len(self.docs) and self.docs[k] == doc else self.starts[:0]


def candidates(texts: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """Packed windows around repeated anchors: those that start at most PERIOD - 1 words before one, within the text."""

    def windows(pieces):
        for docs, data, starts in pieces:
            some = [i for i, s in enumerate(starts) if len(s)]
            for at in range(0, len(some), 32):
                yield from around(docs, data, starts, some[at : at + 32])

    def around(docs, data, starts, some):
        joined = np.frombuffer(b" ".join(data[i] for i in some), np.uint8)
        cuts = np.concatenate([[0], np.cumsum([len(data[i]) + 1 for i in some])])
        cuts[-1] -= 1
        hashes, _, _, before = common.word_table(joined, cuts)
        n = np.diff(before)
        at = np.concatenate([starts[i] for i in some])
        owner = np.repeat(np.arange(len(some)), [len(starts[i]) for i in some])
        low = before[owner] + np.maximum(0, at - PERIOD + 1)
        high = before[owner] + np.minimum(at, n[owner] - WINDOW)
        step = np.zeros(len(hashes) + 2, np.int64)
        fine = (high >= low) & (at + ANCHOR <= n[owner])
        np.add.at(step, low[fine], 1)
        np.add.at(step, high[fine] + 1, -1)
        found = np.flatnonzero(np.cumsum(step) > 0)
        if len(found):
            doc = np.searchsorted(before, found, side="right") - 1
            yield common.windows(hashes, WINDOW)[found], docs[np.array(some)[doc]], (found - before[doc]).astype(np.int64)

    return with_places(texts, places, PACKED, lambda pieces: gathered(windows(pieces), True, buckets), buckets)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined by single spaces."""
    own, ids = common.placed(docs)
    own = own.withColumnRenamed("place", "doc_id")
    buckets = bucket_count(own)
    drop = judged(candidates(own, judged(anchors(own, buckets), False, buckets), buckets), True, buckets)

    def cut(pieces):
        for docs, data, starts in pieces:
            texts, n_words, removed = [], [], []
            for text, at in zip(data, starts):
                words = text.split()
                n = len(words)
                at = at[at + WINDOW <= n]
                if len(at):
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + WINDOW, -1)
                    gone = np.cumsum(step)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                texts.append(b" ".join(words))
                n_words.append(n)
                removed.append(n - len(words))
            yield pa.RecordBatch.from_pydict({"place": docs, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return common.with_ids(with_places(own, drop, "place long, n_words long, n_removed long, text string", cut, buckets), ids)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 20 words that start earlier elsewhere."""
    return deduplicated(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows in DuckDB: every window as a list of words, its first place, and the words covered by later ones.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS text, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
