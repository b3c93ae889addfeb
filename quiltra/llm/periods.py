"""Runs of words that repeat with a period, found by block convolution.

The words of several texts are numbered, the same number for the same word of one text only, and laid end to end. At each
scale L = 8, 16, 32, ... they are cut into blocks of L words. A run of period q that is long enough holds a whole block that
comes again q words later: with L <= q < 2L its first length - q >= 2q words hold one, and below 8 its first 24 - q >= 17
words hold a block of 8. So every run shows as a block with a zero-mismatch occurrence at a distance in [L, 2L), or in
[1, 16) at the lowest scale.

The mismatch of a block at each distance is the sum of squared differences, taken for all distances at once as sums of
squares less twice a correlation, by number-theoretic transforms of exact integers modulo PRIME. Blocks in which some word
doesn't come again within 2L words can't occur there and need no transform. A zero seeds an extension on both sides that
compares the words themselves; it gives the whole run, and drops a sum that is only a multiple of the prime. Distances are
taken in rising order, and one that is a multiple of the period of a known run around the place is that run's, so each run
is found once, by its smallest period.

Defined results: null and empty texts, and texts of fewer than 24 words, have no run; a text is judged whole, however long,
in one task of its own size; each row is judged alone, so nulls and repeats of doc_id give rows of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: 15 * 2^27 + 1: transforms of up to 2^27 places, so periods up to 2^26. 31 generates its units.
PRIME, ROOT, LARGEST = np.uint64(2013265921), 31, 27
LOWEST = 8
#: Text bytes that are taken at a time, and numbers of one batch of transforms.
SLICE, CELLS = 1 << 21, 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n-1 (n a power of two)."""
    out = np.ones(1, np.uint64)
    while len(out) < n:  # doubles the known ones
        out = np.concatenate([out, out * np.uint64(base) % PRIME])
        base = base * base % int(PRIME)
    return out


class Transform:
    """Number-theoretic transforms of rows of ``size`` numbers (a power of two); the spectrum's order is its own."""

    def __init__(self, size: int) -> None:
        self.size = size
        unit = pow(ROOT, (int(PRIME) - 1) // size, int(PRIME))  # a root of unity of order ``size``
        self.powers, self.inverse = powers(unit, size // 2), powers(pow(unit, -1, int(PRIME)), size // 2)
        self.scale = np.uint64(pow(size, -1, int(PRIME)))

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Decimation in frequency: natural order in, reversed order out."""
        x, n = rows.copy(), self.size
        half = n // 2
        while half:
            v = x.reshape(len(x), -1, 2, half)
            a, b = v[:, :, 0], v[:, :, 1]
            low = a + b
            low -= PRIME * (low >= PRIME)
            high = (a + PRIME - b) * self.powers[:: (n // 2) // half][:half] % PRIME
            v[:, :, 0], v[:, :, 1] = low, high
            half //= 2
        return x

    def backward(self, rows: np.ndarray) -> np.ndarray:
        """Decimation in time: reversed order in, natural order out."""
        x, n = rows.copy(), self.size
        half = 1
        while half < n:
            v = x.reshape(len(x), -1, 2, half)
            a, b = v[:, :, 0].copy(), v[:, :, 1] * self.inverse[:: (n // 2) // half][:half] % PRIME
            low = a + b
            v[:, :, 0] = low - PRIME * (low >= PRIME)
            v[:, :, 1] = (a + PRIME - b) % PRIME
            half *= 2
        return x * self.scale % PRIME


def zero_distances(x: np.ndarray, blocks: np.ndarray, width: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(block's place, distance) where the ``width`` words at a place come again ``first`` .. 2*width - 1 words later.

    x holds numbers below PRIME - 1 (a text has at most 2^30 words) and is followed by enough words that equal none.
    """
    span = 3 * width - 1 - first  # the window of all distances
    size = 1 << (span - 1).bit_length()
    ntt, out = Transform(size), []
    for at in range(0, len(blocks), max(1, CELLS // size)):
        own = blocks[at : at + max(1, CELLS // size)]
        block = np.zeros((len(own), size), np.uint64)
        block[:, :width] = x[own[:, None] + np.arange(width)][:, ::-1]
        window = np.zeros((len(own), size), np.uint64)
        window[:, :span] = x[own[:, None] + np.arange(first, first + span)]
        squares = np.zeros((len(own), span + 1), np.uint64)
        np.cumsum(window[:, :span] * window[:, :span] % PRIME, axis=1, out=squares[:, 1:])
        n = 2 * width - first
        there = (squares[:, width:] - squares[:, :-width])[:, :n] % PRIME
        here = (block * block % PRIME).sum(1) % PRIME
        both = ntt.backward(ntt.forward(block) * ntt.forward(window) % PRIME)[:, width - 1 : width - 1 + n]
        row, d = np.nonzero((here[:, None] + there) % PRIME == both * np.uint64(2) % PRIME)
        out.append((own[row], d + first))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (blocks[:0], blocks[:0])


def reach(x: np.ndarray) -> np.ndarray:
    """For each word the distance to where it comes next, a very large number if it doesn't."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), 1 << 60, np.int64)
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def agreeing(x: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, in the direction of ``step``, equal those d places later."""
    n, size = 0, 64
    while True:
        if step > 0:
            a = min(at + n, len(x) - d)
            b = min(a + size, len(x) - d)
            differ = np.flatnonzero(x[a:b] != x[a + d : b + d])
            full = b - a == size
        else:
            b = at - n + 1
            a = max(0, b - size)
            differ = np.flatnonzero((x[a:b] != x[a + d : b + d])[::-1])
            full = b - a == size
        if len(differ):
            return n + int(differ[0])
        n += b - a
        if not full:
            return n
        size = min(2 * size, 1 << 20)


class Known:
    """The runs found so far, by place: which of them hold a stretch."""

    def __init__(self) -> None:
        # The runs that reach into each cell of 256 places.
        self.cells: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, a: int, b: int, q: int) -> None:
        for cell in range(a >> 8, (b - 1 >> 8) + 1):
            self.cells.setdefault(cell, []).append((a, b, q))

    def holds(self, a: int, b: int, d: int) -> bool:
        """Whether a run whose period divides d holds [a, b)."""
        return any(s <= a and b <= e and d % q == 0 for s, e, q in self.cells.get(a >> 8, ()))

    def covers(self, a: int, b: int, first: int) -> bool:
        """Whether a run of a period below ``first`` holds [a, b)."""
        return any(s <= a and b <= e and q < first for s, e, q in self.cells.get(a >> 8, ()))


def runs_of(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in word numbers; no run has more than ``longest`` words."""
    n = len(x)
    found, known = [], Known()
    far = reach(x)
    padded, width = None, LOWEST
    most = far[: n // width * width].reshape(-1, width).max(1)
    while len(most) and LEAST_PERIODS * (width if width > LOWEST else 1) <= longest and width.bit_length() < LARGEST:
        blocks = np.flatnonzero(most < 2 * width) * width
        first = width if width > LOWEST else 1
        if len(blocks) and found:  # blocks far inside a run of a short period have no others
            blocks = blocks[[not known.covers(b, b + 3 * width, first) for b in blocks.tolist()]]
        if len(blocks):
            if padded is None or len(padded) < n + 3 * width:
                padded = np.concatenate([x.astype(np.uint64), np.full(3 * width, int(PRIME) - 1, np.uint64)])
            place, distance = zero_distances(padded, blocks, width, first)
            for k in np.lexsort((place, distance)).tolist():
                b, d = int(place[k]), int(distance[k])
                if b + d + width > n or known.holds(b, b + d + width, d):
                    continue
                ahead = agreeing(x, b, d, 1)
                if ahead < width:
                    continue  # a multiple of the prime, not zero
                start = b - agreeing(x, b - 1, d, -1)
                length = b + ahead + d - start
                if length >= max(LEAST_WORDS, LEAST_PERIODS * d):
                    known.add(start, start + length, d)
                    found.append((start, length, d))
        most = np.maximum(most[: len(most) // 2 * 2 : 2], most[1::2])
        width *= 2
    return found


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period, exactly; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:  # sorted by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def judged(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The digest columns of one text."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    best = best_of(runs)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(words), runs)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"


def periodic(docs: DataFrame) -> DataFrame:
    """Of every whole text: its runs, the one of greatest exponent, and the text without the repeats of its runs."""

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))]
        for batch in batches:
            for part in common.sliced(batch, limit=SLICE):
                texts, numbers, bounds = [], [], [0]
                for text in common.raw(part["text"]):
                    own: dict[bytes, int] = {}
                    words = text.split()
                    at = bounds[-1]
                    numbers.append(np.fromiter((own.setdefault(w, at + len(own)) for w in words), np.int64, len(words)))
                    texts.append(words)
                    bounds.append(at + len(words))
                x = np.concatenate(numbers)
                found = sorted(runs_of(x, max(map(len, texts))))
                rows, k = [], 0
                for words, a, b in zip(texts, bounds, bounds[1:]):
                    mine = []
                    while k < len(found) and found[k][0] < b:
                        mine.append((found[k][0] - a, *found[k][1:]))
                        k += 1
                    rows.append(judged(words, mine))
                columns = list(zip(*rows))
                arrays = [part["doc_id"]] + [pa.array(list(c), t) for c, t in zip(columns[:-1], types[1:])]
                arrays.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in c] for c in columns[-1]], types[-1]))
                arrays[names.index("collapsed")] = arrays[names.index("collapsed")].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names)

    return common.texts(docs).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a tenth of the ids, by their checksum, the words from a place on repeat with a period.

    Of n words and h = crc32(doc_id), g = h div 10: if h ends in 0, each word i >= a = g mod n becomes the word
    a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = common.texts(docs).withColumn("h", F.when(h % 10 == 0, h))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("w")
    own = own.withColumn("w", F.when(F.col("h").isNotNull(), words)).withColumn("a", F.when(n > 0, g % n))
    own = own.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return own.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", place), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, after the planting of periods."""
    out = periodic(planted(common.table(spark, sf_dir, "documents")))
    return out.select(*[c.split()[0] for c in SCHEMA.split(", ")[:7]], F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: The same rows in DuckDB: equal words at each distance up to a third of the text, islands of them, and of runs that hold
#: each other's stretch the smallest period. The checksum's table is built from its rule.
OP12_SQL = r"""
WITH r AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT doc_id, encode(CAST(doc_id AS VARCHAR)) AS b, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, CAST(xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, octet_length(b) + 1), lambda i: CAST('0x' || hex(array_slice(b, i, i)) AS BIGINT))), lambda c, x: xor(steps[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))) AS BIGINT) AS h FROM d, r),
a AS (SELECT doc_id, w, n, h, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h WHERE n > 0),
o AS (SELECT doc_id, n, unnest(range(n)) AS i, w, h, a, p FROM a),
x AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM o),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 1 + q - min(i) AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
u AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
b AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM u GROUP BY doc_id),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (length * 1000000000000) // q DESC, start, q) = 1),
g AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM u),
k AS (SELECT x.doc_id, sha256(string_agg(word, ' ' ORDER BY x.i)) AS collapsed_sha256 FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(m.start AS BIGINT) AS start, CAST(m.length AS BIGINT) AS length, CAST(m.q AS BIGINT) AS period, CAST(1000 * m.length // m.q AS BIGINT) AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
