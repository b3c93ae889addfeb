"""Benchmark decontamination with a generalised suffix automaton over the words of normalised test items.

Training words stream through the automaton, which keeps the length of the longest suffix that occurs in some item.
A length of 13 or more covers its words; an item shorter than that must match whole. Words that follow one another in
no item can't be part of a match of two words or more, so only runs of words whose neighbours also stand side by side
in some item are streamed; this changes no length that counts.

Defined results: null or empty texts have no words and are never contaminated; items without words are ignored; equal
items count once each; repeated documents are each judged; a document's hits come from its whole text; an empty item
table gives no hits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: A document is contaminated if hits make up at least 1/COVERAGE of its words.
COVERAGE = 20
#: Text of items in one automaton; more items are handled in further passes over the documents.
BLOCK_BYTES = 1 << 22

#: Lower-cases A-Z and turns every byte that is no part of a word into a space.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


FOLD_TABLE = np.frombuffer(FOLD, np.uint8)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Suffix automaton of several sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the longest string of p followed by word, cut off from q."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, sequence) -> list[int]:
        """At each word, the length of the longest suffix read so far that occurs in some sequence."""
        state = size = 0
        out = []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(word)
            state, size = (to, size + 1) if to is not None else (0, 0)
            out.append(size)
        return out


class Lookup:
    """Positions of known 64-bit hashes, through a table that their low bits point into."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = max(16, int(len(hashes)).bit_length() + 5)
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.there[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
            same = self.sorted[at] == hashes[some]
            out[some[same]] = self.order[at[same]]
        return out


class Index:
    """Automaton, vocabulary and windows of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.automaton = Automaton()
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        self.short: set[int] = set()
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if not ids:
                continue
            self.automaton.add(ids)
            pairs.update(zip(ids, ids[1:]))
            if len(ids) < window:
                self.short.add(len(ids))
            for i in range(max(1, len(ids) - window + 1)):
                self.items[tuple(ids[i : i + window])].add(item)
        self.base = max(1, len(self.number))
        self.least = min([window, *self.short])
        words = list(self.number)
        data = np.frombuffer(b" ".join(words), np.uint8)
        self.words = Lookup(common.word_table(data, np.array([0, len(data)]))[0])
        self.pairs = Lookup(common.mix(np.array([a * self.base + b for a, b in pairs], dtype=np.uint64)))

    def hits(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """For several texts in one array: words before each text, marks of hit words, and the items found by text."""
        hashes, _, _, before = common.word_table(FOLD_TABLE[data], cuts)
        n = len(hashes)
        mark, found = np.zeros(n, dtype=bool), defaultdict(set)
        if n < self.least or not self.items:
            return before, mark, found
        ids = self.words.find(hashes)
        known = ids >= 0
        joined = np.zeros(n, dtype=bool)  # the word and the one before it, in the same text, are neighbours in some item
        both = np.flatnonzero(known[1:] & known[:-1])
        if len(both):
            code = common.mix(ids[both].astype(np.uint64) * np.uint64(self.base) + ids[both + 1].astype(np.uint64))
            joined[both[self.pairs.find(code) >= 0] + 1] = True
        joined[before[:-1][before[:-1] < n]] = False
        starts = np.flatnonzero(known & ~joined)
        ends = np.minimum(np.append(starts[1:], n), np.append(np.flatnonzero(~known), n)[np.searchsorted(np.flatnonzero(~known), starts)])
        for a, b in zip(starts, ends):
            if b - a < self.least:
                continue
            run = ids[a:b].tolist()
            for i, size in enumerate(self.automaton.matches(run)):
                for k in ([self.window] if size >= self.window else []) + [k for k in self.short if k <= size]:
                    own = self.items.get(tuple(run[i - k + 1 : i + 1]))
                    if own:
                        mark[a + i - k + 1 : a + i + 1] = True
                        found[int(np.searchsorted(before, a, side="right")) - 1] |= own
        return before, mark, found


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size, one read at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [(r["item"], bytes(r["text"])) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()]


#: The index of the last block of items that this worker has seen, by the block's name.
_LATEST: dict[str, Index] = {}


def index_of(name: str, items: list[tuple[str, bytes]], window: int) -> Index:
    """The index of a block, built once by each worker and kept for its next tasks."""
    if name not in _LATEST:
        _LATEST.clear()
        _LATEST[name] = Index(items, window)
    return _LATEST[name]


STATE = "doc_id long, text string, n_words long, marks binary, items array<string>"


def scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """Adds the hits of one block of items to (doc_id, text, n_words, marks, items): bit i of marks is word i."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        index = index_of(name, shared.value, window)
        for batch in batches:
            for part in common.sliced(batch):
                before, mark, found = index.hits(*common.flat(part["text"]))
                hit = np.concatenate([[0], np.cumsum(mark)])[before]
                marks, items = [], []
                for k, (old, names) in enumerate(zip(part["marks"].to_pylist(), part["items"].to_pylist())):
                    bits = np.packbits(mark[before[k] : before[k + 1]]).tobytes() if hit[k + 1] > hit[k] else b""
                    if old:
                        bits = np.bitwise_or(np.frombuffer(old, np.uint8), np.frombuffer(bits, np.uint8)).tobytes() if bits else old
                    marks.append(bits)
                    items.append(sorted({*names, *found[k]}) if k in found else names)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "text": part["text"], "n_words": np.diff(before), "marks": pa.array(marks, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))})

    return docs.mapInArrow(run, STATE)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, n_words, marks, items): hit words of every document against all items."""
    out = common.texts(docs).select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("marks"), F.expr("cast(array() as array<string>)").alias("items"))
    for items in item_blocks(benchmark, block_bytes):
        out = scan(out, items, window)
    return out


def report(hits: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""

    def digest(batches):
        for batch in batches:
            n, names = batch["n_words"].to_numpy(), batch["items"].to_pylist()
            hit = np.array([int.from_bytes(m, "big").bit_count() for m in batch["marks"].to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": n, "n_hit": hit, "n_items": pa.array(map(len, names), pa.int64()), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": (hit > 0) & (COVERAGE * hit >= n)})

    return hits.select("doc_id", "n_words", "marks", "items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_hits(hits: DataFrame) -> DataFrame:
    """(doc_id, text): the document's words that are not hit, with the text around them; words hit are cut out."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, marks, n in zip(common.raw(batch["text"]), batch["marks"].to_pylist(), batch["n_words"].to_pylist()):
                if marks:
                    mark = np.unpackbits(np.frombuffer(marks, np.uint8))[:n].astype(bool)
                    inside = np.concatenate([[0], (np.frombuffer(text.translate(FOLD), np.uint8) != 0x20).view(np.int8), [0]])
                    edges = np.diff(inside)
                    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                    keep = np.ones(len(text), dtype=bool)
                    for a, b in zip(starts[mark], ends[mark]):
                        keep[a:b] = False
                    text = np.frombuffer(text, np.uint8)[keep].tobytes()
                out.append(text.decode())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(out, pa.string())})

    return hits.select("doc_id", "text", "marks", "n_words").mapInArrow(cut, "doc_id long, text string")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in every document."""
    return report(contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


#: The same rows in DuckDB: words exploded with positions, windows joined as lists of words.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, list_slice(w, i, i + 12) AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
