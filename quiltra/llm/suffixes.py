"""Suffix-array dedup of byte strings: every byte covered by a 200-byte string that starts anywhere else goes.

Suffixes matter by their first LENGTH bytes. All comparisons that decide are of bytes; hashes only rule strings out.

1. Once-only filter. Each 200-byte string has an anchor, the place with the smallest hash of ANCHOR bytes in it.
   Neighbouring strings mostly share it; such a run of strings is a stretch. Equal strings have equal anchors, so
   stretches whose anchor occurs once hold no repeat. Anchor hashes meet by bucket, packed many to a row.
2. Suffix sort. The suffix at the anchor of each stretch that is left, with the bytes before it, goes to the range of its
   leading bytes between splitters, which are drawn from a bounded sample. Each range is sorted by multikey quicksort: by
   successive 8-byte words, of which only tied suffixes read the next. Stretches with equal bytes are repeated as a whole.
   Unlike stretches with one anchor are opened into all their suffixes, sorted likewise, and neighbours compared.
3. Across boundaries. Suffixes that share the anchor of a splitter may lie on both of its sides. They are opened into
   suffixes of their own, which are range-partitioned by all LENGTH bytes between second splitters and sorted there; only
   equal suffixes are never parted. So a frequent passage amid unlike text is split over ranges like any other.

A task that sees equal bytes again settles them there, and sends one row on that stands for them, so what meets under one
key numbers at most the tasks, not the copies. Texts longer than CHUNK are read in overlapping chunks.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH stay whole; each row is a place of its own,
so rows of equal id and text are copies of each other, and null ids are kept; what is cut may leave broken UTF-8, so the
remaining bytes are binary; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, substrings
from .substrings import bucket_count, by_bucket, doc_bucket, flushed

LENGTH = 200
#: Bytes of an anchor, a whole number of 8-byte words; a string has SPAN places for it.
ANCHOR = 104
SPAN = LENGTH - ANCHOR + 1
#: Bytes that are hashed at a time; bytes of stretches, and suffixes, that a task gathers before it sends them on; suffixes
#: of unlike stretches that are sorted at a time (more if one anchor has more).
CHUNK, FLUSH_BYTES, FLUSH_SUFFIXES, OPENED = 1 << 18, 24 << 20, 60_000, 400_000
#: Most ranges between sampled splitters, and stretches drawn for each of them; larger inputs divide each range evenly.
MOST_RANGES, DRAWN = 8_192, 12
OPEN, WHOLE, STANDS = 0, 1, 2
_BASE = 0xD1342543DE82EF95
_BYTES = common.mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """base to the powers 0, 1, ... modulo 2**64, enough for a chunk."""
    if base not in _POWERS:
        table = np.full(2 * CHUNK + 2 * LENGTH, base, np.uint64)
        table[0] = 1
        _POWERS[base] = np.multiply.accumulate(table)
    return _POWERS[base]


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of every ANCHOR bytes."""
    n = len(data) - ANCHOR + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE)[: len(data)], out=sums[1:])
    out = sums[ANCHOR:] - sums[:n]
    out *= powers(pow(_BASE, -1, 1 << 64))[:n]
    return common.mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(rows, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, start, number of strings, anchor less start) of each stretch of the texts in data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    seeds = anchor_hashes(data)
    place = np.uint64((1 << 32) - 1)
    at = (sliding_min(seeds & ~place | np.arange(len(seeds), dtype=np.uint64), SPAN) & place).astype(np.int64)
    fits = np.diff(cuts) >= LENGTH
    edge = np.zeros(len(at) + 1, np.int8)
    edge[cuts[:-1][fits]] += 1
    edge[cuts[1:][fits] - LENGTH + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    starts = np.flatnonzero(first)
    anchors = at[starts]
    return seeds[anchors], starts, np.flatnonzero(last) - starts + 1, anchors - starts


def chunks(batch: pa.RecordBatch):
    """(bytes, cuts, places, bytes before) of texts of about CHUNK bytes in all; longer ones in overlapping chunks."""
    data, cuts = common.flat(batch["text"])
    docs, at = batch["doc_id"].to_numpy(), 0
    while at < len(docs):
        a, b = int(cuts[at]), int(cuts[at + 1])
        if b - a > CHUNK:
            for base in range(0, b - a - LENGTH + 1, CHUNK):
                own = data[a + base : min(b, a + base + CHUNK + LENGTH - 1)]
                yield own, np.array([0, len(own)]), docs[at : at + 1], base
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(cuts, a + CHUNK, side="right")) - 1)
        yield data[a : cuts[stop]], cuts[at : stop + 1] - a, docs[at:stop], 0
        at = stop


def placed_stretches(batch: pa.RecordBatch):
    """(hashes, places, numbers): a number holds a stretch's start, its strings (7 bits) and its anchor's distance (7 bits)."""
    for data, cuts, docs, base in chunks(batch):
        key, start, n, far = stretches(data, cuts)
        if len(key):
            text = np.searchsorted(cuts, start, side="right") - 1
            yield key, docs[text], (start - cuts[text] + base) << 14 | n << 7 | far


def numbers(value: int) -> tuple[int, int, int]:
    return value >> 14, value >> 7 & 127, value & 127


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed numbers of the stretches whose anchor occurs again, by bucket of their place."""
    rows = texts.mapInArrow(lambda batches: substrings.gathered((x for b in batches for x in placed_stretches(b)), False, buckets), substrings.PACKED)
    return substrings.judged(rows, False, buckets)


def rotated(text: bytes, start: int, n: int, far: int) -> bytes:
    """A stretch as the suffix at its anchor, then the bytes before it, then n and far."""
    at = start + far
    return b"".join((text[at : start + n + LENGTH - 1], text[start:at], bytes((n, far))))


def straight(record: bytes) -> tuple[bytes, int, int]:
    """(bytes in their order, n, far) of ``rotated``."""
    n, far = record[-2], record[-1]
    cut = len(record) - 2 - far
    return record[cut:-2] + record[:cut], n, far


class Ranges:
    """Splitters of stretches, by the bytes of their anchors, and of suffixes, by all LENGTH bytes.

    ``fine`` parts of each range of stretches are cut at even steps of the leading word, so one anchor lies in one of them.
    """

    def __init__(self, drawn: list[bytes], parts: int, fine: int = 1) -> None:
        self.fine = fine
        self.anchors = self._cut(sorted(r[:ANCHOR] for r in drawn), parts, ANCHOR)
        known = set(self.anchors.tolist())
        # As numpy drops zeros at the end, so must what is compared with it.
        crossing = [straight(r) for r in drawn if r[:ANCHOR].rstrip(b"\0") in known]
        self.suffixes = self._cut(sorted(s[i : i + LENGTH] for s, n, _ in crossing for i in range(n)), max(1, parts // 2), LENGTH)

    @staticmethod
    def _cut(keys: list[bytes], parts: int, width: int) -> np.ndarray:
        own = sorted({keys[k * len(keys) // parts] for k in range(1, parts)}) if keys else []
        return np.array(own, f"S{width}")

    @property
    def count(self) -> int:
        return (len(self.anchors) + 1) * self.fine + len(self.suffixes) + 1

    def of_stretches(self, records: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The range of each record, and whether it has the anchor of a splitter."""
        own = np.frombuffer(b"".join(r[:ANCHOR] for r in records), f"S{ANCHOR}")
        at = np.searchsorted(self.anchors, own, side="right")
        part = at
        if self.fine > 1:
            words = lambda keys: np.array([int.from_bytes(k.ljust(8, b"\0")[:8], "big") for k in keys.tolist()], np.float64)
            edges = np.concatenate([[0.0], words(self.anchors), [2.0**64]])
            share = (words(own) - edges[at]) / np.maximum(1.0, edges[at + 1] - edges[at])
            part = at * self.fine + np.clip((share * self.fine).astype(np.int64), 0, self.fine - 1)
        return part, np.append(np.zeros(1, f"S{ANCHOR}"), self.anchors)[at] == own if len(self.anchors) else np.zeros(len(own), bool)

    def of_suffixes(self, strings: list[bytes]) -> np.ndarray:
        return (len(self.anchors) + 1) * self.fine + np.searchsorted(self.suffixes, np.frombuffer(b"".join(strings), f"S{LENGTH}"), side="right")


def ranges_of(texts: DataFrame, buckets: int, most: int = MOST_RANGES) -> Ranges:
    """Splitters from a bounded sample of stretches of whole texts; only balance hangs on it."""
    parts = min(buckets, most)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = DRAWN * parts / max(1.0, 2 * total / SPAN)
    docs_rate = min(1.0, 32 * want)
    limit = np.uint64(int(min(1.0, want / docs_rate) * (2.0**64 - 2**12)))
    chance = (F.shiftright(F.xxhash64("doc_id"), 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))

    def draw(batches):
        for batch in batches:
            by_doc = dict(zip(batch["doc_id"].to_pylist(), common.raw(batch["text"])))
            for _, docs, own in placed_stretches(batch):
                keep = common.mix(docs.astype(np.uint64) * np.uint64(_BASE) + own.astype(np.uint64)) < limit
                yield pa.RecordBatch.from_pydict({"record": pa.array([rotated(by_doc[d], *numbers(v)) for d, v in zip(docs[keep].tolist(), own[keep].tolist())], pa.binary())})

    return Ranges(texts.filter(chance <= docs_rate).mapInArrow(draw, "record binary").toArrow()["record"].to_pylist(), parts, -(-buckets // parts))


#: Many rows of one bucket in one: places with the number of their rows, starts, sizes (strings that start side by side), kinds,
#: and the bytes of the rows that are to be judged, one after the other.
PACKED = "bucket int, docs binary, counts binary, starts binary, sizes binary, kinds binary, lengths binary, data binary"


def packed(buckets, docs, starts, sizes, kinds, data=None):
    """Record batches of one row for each bucket; ``data`` has bytes for each row, or is None."""
    import zstandard

    order = np.lexsort((starts, docs, buckets))
    buckets, docs, starts, sizes, kinds = (x[order] for x in (buckets, docs, starts, sizes, kinds))
    cuts = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)) if len(buckets) else np.zeros(1, np.int64)
    press = zstandard.ZstdCompressor(level=1).compress
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        own, n = np.unique(docs[a:b], return_counts=True)
        texts = [data[k] for k in order[a:b].tolist()] if data is not None else []
        cols = [common.thin(own), common.thin(n), common.thin(starts[a:b]), common.thin(sizes[a:b]), common.thin(kinds[a:b])]
        cols += [common.thin(np.fromiter(map(len, texts), np.int64, len(texts))), press(b"".join(texts))] if texts else [b"", b""]
        yield pa.RecordBatch.from_arrays([pa.array([buckets[a]], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["bucket", "docs", "counts", "starts", "sizes", "kinds", "lengths", "data"])


def unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(docs, starts, sizes, kinds) of packed rows."""
    cat = lambda name: np.concatenate([common.thick(r[name]) for r in rows])
    return np.repeat(cat("docs"), cat("counts")), cat("starts"), cat("sizes"), cat("kinds")


def records(texts: DataFrame, found: DataFrame, ranges: Ranges, buckets: int, flush: int = FLUSH_BYTES) -> DataFrame:
    """Packed stretches, and suffixes of those with the anchor of a splitter, by range; settled ones anywhere."""

    def settled(known: dict[bytes, list], bucket: np.ndarray, sizes: list[int]):
        """Rows of distinct bytes with their places: bytes seen once are OPEN; others are settled, and one row STANDS for them."""
        data, docs, starts, size, kinds, at = [], [], [], [], [], []
        for (own, places), n, b in zip(known.items(), sizes, bucket.tolist()):
            again = len(places) > 1
            for doc, start in places if again else ():
                docs.append(doc), starts.append(start), size.append(n), kinds.append(WHOLE), data.append(b""), at.append((doc * 31 + start) % ranges.count)
            docs.append(places[0][0]), starts.append(places[0][1]), size.append(n), kinds.append(STANDS if again else OPEN), data.append(own), at.append(b)
        yield from packed(np.array(at, np.int32), *(np.array(x, np.int64) for x in (docs, starts, size, kinds)), data)

    def handle(pieces):
        stretch, strings, held = {}, {}, 0

        def out_strings():
            yield from settled(strings, ranges.of_suffixes(list(strings)), [1] * len(strings))
            strings.clear()

        def out():
            own = list(stretch)
            bucket, crossing = ranges.of_stretches(own)
            for record in (own[k] for k in np.flatnonzero(crossing).tolist()):
                text, n, _ = straight(record)
                places = stretch.pop(record)
                for i in range(n):
                    strings.setdefault(text[i : i + LENGTH], []).extend((d, s + i) for d, s in places)
                if len(strings) >= FLUSH_SUFFIXES:
                    yield from out_strings()
            yield from settled(stretch, bucket[~crossing], [r[-2] for r in stretch])
            stretch.clear()

        for docs, data, places in pieces:
            for doc, text, own in zip(docs.tolist(), data, places):
                for value in own.tolist():
                    start, n, far = numbers(value)
                    record = rotated(text, start, n, far)
                    got = stretch.get(record)
                    if got is None:
                        stretch[record] = [(doc, start)]
                        held += len(record) + 250
                    else:
                        got.append((doc, start))
                        held += 100
                if held >= flush:
                    yield from out()
                    held = 0
        if stretch:
            yield from out()
        if strings:
            yield from out_strings()

    return substrings.with_places(texts, found, PACKED, handle, buckets)


def multikey(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte strings in ``data``, within their groups, and where each first differs from the one before.

    That is the number of the 8-byte word, -1 for the first of a group, and -2 if it is equal. Multikey quicksort: strings
    are sorted by one word, and only those that tie read the next one; ties that agree on it need no sort.
    data must end with 8 more bytes.
    """
    n = len(starts)
    views = np.lib.stride_tricks.sliding_window_view(data, 8)
    order = np.argsort(groups, kind="stable") if groups is not None else np.arange(n)
    differs = np.full(n, -2, np.int16)
    differs[:1] = -1
    if groups is not None:
        differs[1:][groups[order][1:] != groups[order][:-1]] = -1
    live = np.arange(n)

    def tied(live):
        head = differs[live] != -2
        return live[~(head & np.append(head[1:], True))]

    live = tied(live)
    for word in range(int(lengths.max(initial=0)) // 8 + 2):
        if not len(live):
            break
        own = order[live]
        left = lengths[own] - 8 * word
        value = views[np.where(left > 0, starts[own] + 8 * word, 0)].copy().view(">u8").ravel().astype(np.uint64)
        short = left < 8
        if short.any():
            value[short] &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(left[short], 0)).astype(np.uint64))
            ended = left <= 0
            value[ended] = lengths[own][ended]  # behind its end a string goes on with its length
        group = np.cumsum(differs[live] != -2)
        same = group[1:] == group[:-1]
        odd = same & (value[1:] != value[:-1])
        if odd.any():
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[group[1:][odd]] = True
            part = np.flatnonzero(mixed[group])
            sort = part[np.lexsort((value[part], group[part]))]
            order[live[part]], value[part] = own[sort], value[sort]
            differs[live[1:][same & (value[1:] != value[:-1])]] = word
        live = tied(live)
    return order, differs


def runs_of(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, size) of maximal runs of places side by side."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    first = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(docs) else np.zeros(0, np.int64)
    return docs[first], starts[first], np.diff(np.append(first, len(docs)))


def repeats_in(data: bytes, lengths: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray):
    """Yields (docs, starts, sizes) of repeated strings among the stretches of one range, or among suffixes of LENGTH bytes."""
    at = np.cumsum(lengths) - lengths
    order, differs = multikey(np.frombuffer(data + bytes(8), np.uint8), at, lengths)
    content = np.cumsum(differs != -2) - 1
    copies = np.bincount(content)
    held = np.zeros(len(copies), bool)
    held[content[kinds[order] == STANDS]] = True
    again = (copies > 1) | held
    own = order[again[content]]
    own = own[kinds[own] == OPEN]
    yield docs[own], starts[own], sizes[own]
    if (lengths == LENGTH).all():
        return
    # Unlike stretches with one anchor: one of each content is opened.
    heads = np.flatnonzero(differs != -2)
    anchor = np.cumsum((differs[heads] == -1) | (differs[heads] < ANCHOR // 8)) - 1
    size = np.bincount(anchor)
    unlike = np.flatnonzero(size[anchor] > 1)
    bounds = np.append(np.flatnonzero(np.append(True, anchor[unlike][1:] != anchor[unlike][:-1])), len(unlike)) if len(unlike) else np.zeros(1, np.int64)
    rows = order[heads]
    total, part = 0, []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        own = unlike[a:b]
        part += zip(anchor[own].tolist(), rows[own].tolist(), again[own].tolist())
        total += int(sizes[rows[own]].sum())
        if total >= OPENED:
            yield opened(data, at, lengths, docs, starts, part)
            total, part = 0, []
    if part:
        yield opened(data, at, lengths, docs, starts, part)


def opened(data: bytes, at: np.ndarray, lengths: np.ndarray, docs: np.ndarray, starts: np.ndarray, part: list[tuple[int, int, bool]]):
    """(docs, starts, sizes) of the repeated strings of unlike stretches (anchor, row, whether its strings are known to be repeated)."""
    texts = [straight(data[at[row] : at[row] + lengths[row]]) for _, row, _ in part]
    n = np.array([x[1] for x in texts])
    first = np.cumsum([0] + [len(x[0]) for x in texts])[:-1]
    owner = np.repeat(np.arange(len(texts)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    far = np.array([x[2] for x in texts])
    group = np.array([x[0] for x in part])[owner] * 128 + far[owner] - inner
    order, differs = multikey(np.frombuffer(b"".join(x[0] for x in texts) + bytes(8), np.uint8), first[owner] + inner, np.full(len(owner), LENGTH), group)
    equal = differs == -2
    found = order[equal | np.append(equal[1:], False)]
    found = found[~np.array([x[2] for x in part])[owner[found]]]
    rows = np.array([x[1] for x in part])[owner[found]]
    return runs_of(docs[rows], starts[rows] + inner[found])


def sorted_repeats(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed (place, start, size) of repeated strings, by bucket of their place."""
    import zstandard

    def compare(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for own in by_bucket(batches):
            docs, starts, sizes, kinds = unpacked(own)
            lengths = np.concatenate([common.thick(r["lengths"]) if r["lengths"] else np.zeros(0, np.int64) for r in own])
            data = b"".join(unpress(r["data"]) for r in own if r["data"])
            own.clear()
            known = kinds == WHOLE
            yield docs[known], starts[known], sizes[known]
            judge = np.flatnonzero(~known)
            if len(judge):
                yield from repeats_in(data, lengths[judge], docs[judge], starts[judge], sizes[judge], kinds[judge])

    def run(batches):
        for docs, starts, sizes in flushed(compare(batches)):
            yield from packed(doc_bucket(docs, buckets), docs, starts, sizes, np.full(len(docs), WHOLE))

    return common.dealt(rows).mapInArrow(run, PACKED)


class Spans:
    """Sorted (starts, sizes) by place, out of packed rows."""

    def __init__(self, rows: list[dict]) -> None:
        none = np.zeros(0, np.int64)
        docs, self.starts, self.sizes, _ = unpacked(rows) if rows else (none,) * 4
        order = np.lexsort((self.starts, docs))
        docs, self.starts, self.sizes = docs[order], self.starts[order], self.sizes[order]
        self.docs, at = np.unique(docs, return_index=True)
        self.cuts = np.append(at, len(docs))

    def of(self, doc: int):
        k = int(np.searchsorted(self.docs, doc))
        a, b = (self.cuts[k], self.cuts[k + 1]) if k < len(self.docs) and self.docs[k] == doc else (0, 0)
        return self.starts[a:b], self.sizes[a:b]


def deduplicated(docs: DataFrame, buckets: int | None = None, flush: int = FLUSH_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay. ``buckets`` follows from the bytes if it isn't given."""
    own, ids = common.placed(docs)
    own = own.withColumnRenamed("place", "doc_id")
    buckets = buckets or bucket_count(own)
    found = repeated_anchors(own, buckets)
    places = sorted_repeats(records(own, found, ranges_of(own, buckets, most_ranges), buckets, flush), buckets)

    def cut(pieces):
        for docs, data, spans in pieces:
            rows = []
            for doc, text, (start, size) in zip(docs.tolist(), data, spans):
                gone = np.zeros(len(text) + 1 if len(start) else 1, np.int32)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + size + LENGTH - 1, -1)
                mark = np.cumsum(gone[:-1]) > 0
                n_spans = int(np.count_nonzero(mark[1:] & ~mark[:-1]) + bool(len(mark) and mark[0]))
                kept = np.frombuffer(text, np.uint8)[~mark].tobytes() if n_spans else text
                rows.append((doc, len(text), len(text) - len(kept), n_spans, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], ["place", "n_bytes", "n_removed", "n_spans", "kept"])

    out = substrings.with_places(own, places, "place long, n_bytes long, n_removed long, n_spans long, kept binary", cut, buckets, Spans, ["docs", "counts", "starts", "sizes", "kinds"])
    return common.with_ids(out, ids)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings."""
    return deduplicated(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB: every 200-byte string by its checksum, and the runs that repeated ones cover.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS new FROM r),
k AS (SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 199 AS z FROM k GROUP BY doc_id, k),
g AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) + 1 AS a, a - 1 AS z FROM s UNION ALL SELECT doc_id, max(z) + 1, any_value(n) FROM s JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(hex(b), 2 * a - 1, 2 * (z - a + 1)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) WHERE z >= a GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
