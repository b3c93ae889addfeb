"""Matroska audio columns: text bytes kept as 8-bit PCM packets, and packet tables parsed back from the stored bytes.

A payload of whole 576-byte packets is muxed as one PCM track at 8 kHz (a packet lasts 72 ms): SimpleBlocks with
fixed-size, EBML or Xiph lacing, clusters with their own timestamp, and cues that point at the clusters.
``packets`` walks the variable-length EBML elements of any such file and returns one entry for each frame.

Defined results: a null or empty text becomes one packet of padding; equal texts give equal files; every row is
handled by itself, so repeated rows and very long texts need no shuffle; an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

PACKET = 576
RATE = 8000
PACKET_MS = PACKET * 1000 // RATE
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
PAD = b"\xff"

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5
TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, RATE_ID, CHANNELS, BIT_DEPTH = 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


def size_vint(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def signed_vint(n: int) -> bytes:
    width = 1
    while abs(n) >= (1 << (7 * width - 1)) - 1:
        width += 1
    return (n + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")


def laced(frames: list[bytes], lacing: str) -> bytes:
    """The part of a block after its flags."""
    if lacing == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        sizes = [len(f) for f in frames]
        head += size_vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
ABOUT = element(INFO, number(TIMESTAMP_SCALE, 1_000_000)) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, PACKET_MS * 1_000_000)
        + element(AUDIO, element(RATE_ID, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file of the payload's packets; the payload's length is a positive multiple of PACKET."""
    per_block = 1 if lacing == "none" else FRAMES_PER_BLOCK
    flags = 0x80 | LACING[lacing] << 1
    step = PACKET * per_block
    parts, cues, at = [ABOUT], [], len(ABOUT)
    for c in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        start = c // PACKET * PACKET_MS
        body = [number(CLUSTER_TIME, start)]
        for b in range(c, min(len(payload), c + step * BLOCKS_PER_CLUSTER), step):
            piece = payload[b : b + step]
            head = b"\x81" + struct.pack(">hB", b // PACKET * PACKET_MS - start, flags)
            if lacing == "fixed":
                body.append(element(SIMPLE_BLOCK, head + bytes([len(piece) // PACKET - 1]) + piece))
            else:
                body.append(element(SIMPLE_BLOCK, head + laced([piece[i : i + PACKET] for i in range(0, len(piece), PACKET)], lacing)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """(value, position after); the value is -1 for a size of all ones, which means unknown."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no EBML number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << (7 * width)) - 1
        if value == (1 << (7 * width)) - 1:
            value = -1
    return value, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body's start, body's end) of each element; one of unknown size reaches to the end of its parent."""
    while at < end:
        key, at = vint(data, at, True)
        size, at = vint(data, at, False)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {key:#x} ends beyond its parent")
        yield key, at, stop
        at = stop


def frames(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative timestamp and the byte ranges of a block's frames."""
    track, at = vint(data, at, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == LACING["none"]:
        return track, relative, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == LACING["fixed"]:
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == LACING["xiph"]:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            elif i == 0:
                size, at = vint(data, at, False)
            else:
                width = 9 - data[at].bit_length()
                value, at = vint(data, at, True)
                size = sizes[-1] + (value & (1 << (7 * width)) - 1) - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, out


def packets(data: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """The packet table (track, timestamp in ms, offset, size) and the cues (timestamp in ms, offset of the cluster)."""
    table, cues, scale, duration = [], [], 1_000_000, {}
    for key, a, b in elements(data, 0, len(data)):
        if key != SEGMENT:
            continue
        for key2, a2, b2 in elements(data, a, b):
            if key2 == INFO:
                for key3, a3, b3 in elements(data, a2, b2):
                    if key3 == TIMESTAMP_SCALE:
                        scale = int.from_bytes(data[a3:b3], "big")
            elif key2 == TRACKS:
                for _, a3, b3 in elements(data, a2, b2):
                    entry = {k: data[x:y] for k, x, y in elements(data, a3, b3)}
                    duration[int.from_bytes(entry[TRACK_NUMBER], "big")] = int.from_bytes(entry.get(DEFAULT_DURATION, b""), "big") / 1e6
            elif key2 == CLUSTER:
                base = 0
                for key3, a3, b3 in elements(data, a2, b2):
                    if key3 == CLUSTER_TIME:
                        base = int.from_bytes(data[a3:b3], "big")
                    blocks = [(a3, b3)] if key3 == SIMPLE_BLOCK else [(x, y) for k, x, y in elements(data, a3, b3) if k == BLOCK] if key3 == BLOCK_GROUP else []
                    for x, y in blocks:
                        track, relative, found = frames(data, x, y)
                        begin, step = (base + relative) * scale / 1e6, duration.get(track, 0.0)
                        table += [(track, round(begin + i * step), o, n) for i, (o, n) in enumerate(found)]
            elif key2 == CUES:
                for _, a3, b3 in elements(data, a2, b2):
                    time = cluster = 0
                    for key4, a4, b4 in elements(data, a3, b3):
                        if key4 == CUE_TIME:
                            time = int.from_bytes(data[a4:b4], "big")
                        elif key4 == CUE_POSITIONS:
                            cluster = next(int.from_bytes(data[x:y], "big") for k, x, y in elements(data, a4, b4) if k == CUE_CLUSTER)
                    cues.append((round(time * scale / 1e6), a + cluster))
    return table, cues


def parsed(data: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]] | None:
    """``packets`` of a stored file, None if it is malformed: cut off, not of this format, or without a frame."""
    try:
        table, cues = packets(data)
    except (ValueError, IndexError, KeyError, StopIteration, struct.error):
        return None
    return (table, cues) if table and all(0 <= at <= at + n <= len(data) for _, _, at, n in table) else None


def payload_of(data: bytes, table: list[tuple[int, int, int, int]]) -> bytes:
    """The frames' bytes in the order of the table; neighbouring ranges are cut in one piece."""
    parts, start, end = [], None, None
    for _, _, at, n in table:
        if at != end:
            if start is not None:
                parts.append(data[start:end])
            start = at
        end = at + n
    return b"".join([*parts, data[start:end]] if start is not None else parts)


def padded(text: bytes) -> bytes:
    n = max(PACKET, -(-len(text) // PACKET) * PACKET)
    return text + PAD * (n - len(text))


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long"


def to_media(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a Matroska file."""

    def build(batches):
        for batch in batches:
            texts = common.raw(batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([mux(padded(t), lacing) for t in texts], pa.binary())})

    return common.texts(docs).mapInArrow(build, MEDIA)


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each frame of a (doc_id, media) table: doc_id, packet, track, timestamp_ms, offset, size; none for a malformed file."""

    def parse(batches):
        for batch in batches:
            for doc, data in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist()):
                found = np.array((parsed(data or b"") or ([], []))[0], dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(found), pa.int64()), "packet": np.arange(len(found)), "track": found[:, 0], "timestamp_ms": found[:, 1], "offset": found[:, 2], "size": found[:, 3]})

    return media.select("doc_id", "media").mapInArrow(parse, "doc_id long, packet long, track long, timestamp_ms long, offset long, size long")


def features(media: DataFrame) -> DataFrame:
    """Features of each stored file, from its parsed packets alone.

    ``feature`` is mean, root mean square and zero crossings of the samples about 128, and the span of timestamps. A
    malformed file, or null, has no payload and the feature ``malformed``.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for doc, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist()):
                found = parsed(data := data or b"")
                if found is None:
                    rows.append((doc, n, 0, hashlib.sha256(b"").hexdigest(), 0, len(data), hashlib.sha256(data).hexdigest(), "malformed", 0, 0))
                    continue
                table, cues = found
                payload = payload_of(data, table)
                x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
                mean, rms = float(x.mean()), float(np.sqrt(np.mean(np.square(x, dtype=np.int32))))
                turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                feature = f"mean={mean:.4f};rms={rms:.4f};turns={turns};ms={table[-1][1] - table[0][1] + PACKET_MS}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(table), len(cues)))
            names = [f.split()[0] for f in FEATURES.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored Matroska file, read back and described."""
    return features(common.stored(to_media(common.table(spark, sf_dir, "documents")), "media"))
