"""Token-id output in patched frame-of-reference blocks, written as files of segments and read back.

Documents are range-partitioned by id. Each task encodes its documents in order and writes segments of whole documents.
A segment's payload is one self-contained byte string:

    "PFOR", ids in a block (u16), documents (u32), blocks (u32), ids (u64)
    documents x (id i64, ids with the end id u32, its highest bit set if the document has no id), blocks x start of the
    block (u32), blocks
    block: minimum (u32), width (u8), exceptions (u8), packed low bits (16 bytes for each bit of width),
           exceptions x position (u8), exceptions x high bits (u32)

A block holds 128 ids less their minimum. The width is the bit length at the PERCENTILE of the block; longer values keep
their low bits in place and their high bits in the exception list. Value 4*i+l sits in lane l of four 32-bit lanes.

Defined results: a null or empty text is the end id alone; rows of equal id are ordered by text and all kept; rows without
an id come last, by text, and are all kept; an empty table writes no segment; a very long text is one segment of its own; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 16
NO_ID = 1 << 31
END_ID = 0
#: Distinct parts of texts whose ids a worker remembers.
REMEMBERED = 400_000
SPECIAL = "<|endoftext|>"

#: White space of the vocabulary's split pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as one letter: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


#: Byte to letter, for text whose UTF-8 bytes were read as Latin-1.
AS_LETTERS = {b: byte_letters().get(b, b) for b in range(256)}
SPACE_LETTER = chr(AS_LETTERS[0x20])
#: Latin, Greek and Cyrillic letters, and the ASCII marks but the apostrophe.
PLAIN, MARKS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f", r"!-&(-/:-@\[-`{-~"
#: A part of these, digits and single line feeds, and its pieces by the split pattern: runs of one kind.
WORD = re.compile(f" ?[{PLAIN}{MARKS}0-9\n]+").fullmatch
PIECES = re.compile(f" ?[{PLAIN}]+| ?[0-9]+| ?[{MARKS}]+|\n").findall

HEADER = struct.Struct("<4sHIIQ")


class Remembered(dict):
    """Ids of strings as bytes; an unknown string gets an empty array, to be filled in with the others in ``fresh``.

    Strings of the generation before, ``old``, are still known, and come over when they are asked for.
    """

    def __init__(self, old: dict | None = None) -> None:
        self.fresh: dict[str, bytearray] = {}
        self.old = old or {}

    def __missing__(self, key: str) -> bytes | bytearray:
        got = self.old.get(key)
        if got is None:
            got = self.fresh[key] = bytearray()
        self[key] = got
        return got


class Encoder:
    """Whole texts to ids, with the tokenizers library.

    The vocabulary's split pattern always cuts before a single space that has no other white space beside it. So parts
    between spaces are encoded apart, each distinct one once while it is remembered. Plain words, whose pieces are known, go
    to the library's model at once, other parts through its split pattern. Texts with longer runs of white space, or with the
    name of the special token, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs = re.compile(f"[{SPACE}]{{2}}").search
        self.known = Remembered()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _merged(self, piece: str) -> bytes:
        """The ids of one piece, by the model alone."""
        letters = piece.replace(" ", SPACE_LETTER) if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(AS_LETTERS)
        ids = [x.id for x in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self) -> None:
        """Fills in the new parts: plain words piece by piece, the others in one call."""
        fresh, others, known = self.known.fresh, [], self.known
        for part, held in fresh.items():
            if not WORD(part):
                others.append(part)
                continue
            pieces = PIECES(part)
            if len(pieces) == 1:
                held += self._merged(part)
                continue
            for piece in pieces:
                ids = known.get(piece)  # empty if it is among the new ones
                if not ids:
                    ids = self._merged(piece)
                    if not piece[-1].isalnum():
                        known.setdefault(piece, ids)
                held += ids
        for part, own in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            fresh[part] += struct.pack(f"<{len(own.ids)}I", *own.ids)
        self.known.fresh = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers, without the end id."""
        if len(self.known) > REMEMBERED:
            self.known.old = {}
            self.known = Remembered(self.known)
        get, rows = self.known.__getitem__, []
        for t in texts:
            if self.runs(t) or SPECIAL in t:
                rows.append([self._ids(t).tobytes()])
            else:
                rows.append(list(map(get, t.replace(" ", "\x00 ").split("\x00"))) if "\x00" not in t else [self._ids(t).tobytes()])
        self._learn()
        return [b"".join(r) for r in rows]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: the next tasks of a worker go on with the parts that it remembers."""
    return Encoder(path)


def lanes(width: int):
    """For each of a lane's 32 values: its word, its shift, and whether it runs into the next word."""
    for i in range(32):
        word, shift = divmod(i * width, 32)
        yield i, word, np.uint32(shift), shift + width > 32


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(starts of the blocks, blocks) of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), b""
    values = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).reshape(n, BLOCK).astype(np.uint32)
    base = values.min(1)
    values -= base[:, None]
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    odd_row, odd_at = np.nonzero(bits > width[:, None])
    odd_count = np.bincount(odd_row, minlength=n)
    sizes = 6 + 16 * width.astype(np.int64) + 5 * odd_count
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        low = (values[rows] & np.uint32((1 << int(w)) - 1)).reshape(len(rows), 32, 4)
        words = np.zeros((len(rows), max(1, int(w)), 4), np.uint32)
        for i, word, shift, over in lanes(int(w)) if w else ():
            words[:, word] |= low[:, i] << shift
            if over:
                words[:, word + 1] |= low[:, i] >> (np.uint32(32) - shift)
        head = np.zeros((len(rows), 6 + 16 * int(w)), np.uint8)
        head[:, :4] = base[rows].astype("<u4").view(np.uint8).reshape(-1, 4)
        head[:, 4], head[:, 5] = w, odd_count[rows]
        if w:
            head[:, 6:] = words.astype("<u4").reshape(len(rows), -1).view(np.uint8)
        out[starts[rows][:, None] + np.arange(head.shape[1])] = head
    if len(odd_row):
        first = np.concatenate([[0], np.cumsum(odd_count)])[odd_row]
        rank = np.arange(len(odd_row)) - first
        lists = starts[odd_row] + 6 + 16 * width[odd_row].astype(np.int64)
        out[lists + rank] = odd_at
        high = (values[odd_row, odd_at] >> width[odd_row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(lists + odd_count[odd_row] + 4 * rank)[:, None] + np.arange(4)] = high
    return starts[:-1].astype(np.uint32), out.tobytes()


def unpack(starts: np.ndarray, blocks: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of packed blocks; ``blocks`` are bytes."""
    starts = starts.astype(np.int64)
    n = len(starts)
    values = np.zeros((n, BLOCK), np.uint32)
    if not n:
        return values.reshape(-1)
    base = blocks[starts[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.uint32)
    width, odd_count = blocks[starts + 4], blocks[starts + 5].astype(np.int64)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        words = blocks[starts[rows][:, None] + 6 + np.arange(16 * int(w))].copy().view("<u4").astype(np.uint32).reshape(len(rows), int(w), 4)
        low = np.zeros((len(rows), 32, 4), np.uint32)
        for i, word, shift, over in lanes(int(w)):
            low[:, i] = words[:, word] >> shift
            if over:
                low[:, i] |= words[:, word + 1] << (np.uint32(32) - shift)
        values[rows] = low.reshape(len(rows), BLOCK) & np.uint32((1 << int(w)) - 1)
    row = np.repeat(np.arange(n), odd_count)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(odd_count)])[row]
        lists = starts[row] + 6 + 16 * width[row].astype(np.int64)
        high = blocks[(lists + odd_count[row] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        values[row, blocks[lists + rank]] |= high.astype(np.uint32) << width[row].astype(np.uint32)
    return (values + base[:, None]).reshape(-1)[:n_ids]


def segment(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    starts, blocks = pack(ids)
    table = np.zeros(len(docs), np.dtype([("doc", "<i8"), ("n", "<u4")]))
    table["doc"], table["n"] = [d or 0 for d in docs], [n | NO_ID * (d is None) for d, n in zip(docs, counts)]
    return HEADER.pack(b"PFOR", BLOCK, len(docs), len(starts), len(ids)) + table.tobytes() + starts.astype("<u4").tobytes() + blocks


def read_segment(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(document ids, null where there is none, their numbers of ids, all ids)."""
    magic, block, n_docs, n_blocks, n_ids = HEADER.unpack_from(data)
    if magic != b"PFOR" or block != BLOCK:
        raise ValueError("not a segment of token ids")
    table = np.frombuffer(data, np.dtype([("doc", "<i8"), ("n", "<u4")]), n_docs, HEADER.size)
    at = HEADER.size + table.nbytes
    starts = np.frombuffer(data, "<u4", n_blocks, at)
    docs = pa.array(table["doc"].astype(np.int64), mask=table["n"] >= NO_ID)
    return docs, table["n"].astype(np.int64) & (NO_ID - 1), unpack(starts, np.frombuffer(data, np.uint8, offset=at + starts.nbytes), n_ids)


def one_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, found through the index."""
    _, _, n_docs, n_blocks, n_ids = HEADER.unpack_from(data)
    at = HEADER.size + 12 * n_docs
    start = np.frombuffer(data, "<u4", 1, at + 4 * k)
    return unpack(start, np.frombuffer(data, np.uint8, offset=at + 4 * n_blocks), min(BLOCK, n_ids - BLOCK * k))


SEGMENTS = "part int, segment int, first_doc long, start_in_part long, n_ids long, payload binary"


def segments(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Segments of all documents in ascending order of id; ``start_in_part`` counts the ids before it in its partition."""

    def encode(batches):
        own_encoder, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        names, counts, held, n, start, k = [], [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([k], pa.int32()), "first_doc": pa.array([names[0]], pa.int64()), "start_in_part": [start], "n_ids": [n], "payload": pa.array([segment(names, counts, ids)], pa.binary())})

        for batch in batches:
            for own in common.sliced(batch, limit=1 << 18):
                for doc, ids in zip(own["doc_id"].to_pylist(), own_encoder.encode(own["text"].to_pylist())):
                    names.append(doc)
                    counts.append(len(ids) // 4 + 1)
                    held += (ids, end)
                    n += counts[-1]
                    if n >= SEGMENT_IDS:
                        yield flush()
                        names, counts, held, start, n, k = [], [], [], start + n, 0, k + 1
        if names:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = common.texts(docs).repartitionByRange(parts, by_id).sortWithinPartitions(by_id, "text")
    return ordered.mapInArrow(encode, SEGMENTS)


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The segments, written to the shared folder; their bytes are packed already."""
    return common.stored(segments(docs, tokenizer), "tokens", compression="uncompressed")


def token_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored segments alone.

    Starts need the ids in earlier partitions: a table of one row for each partition, summed in order and broadcast.
    """
    totals = files.groupBy("part").agg(F.min("first_doc").alias("first"), F.sum("n_ids").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy(F.col("first").asc_nulls_last(), "part")) - F.col("ids")).alias("before"))

    def decode(batches):
        for batch in batches:
            for data, before, start in zip(batch["payload"].to_pylist(), batch["before"].to_pylist(), batch["start_in_part"].to_pylist()):
                docs, counts, ids = read_segment(data)
                ends = np.cumsum(counts)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": before + start + ends - counts, "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})

    rows = files.select("part", "start_in_part", "payload").join(F.broadcast(before), "part").select("before", "start_in_part", "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    import public_tokenizers

    return token_index(token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
