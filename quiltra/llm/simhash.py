"""Near copies by SimHash: fingerprints of few differing bits, found by generalised pigeonhole.

1. Each whole text becomes a 64-bit fingerprint of its three-word shingles. Equal fingerprints are one node.
2. The bits are grouped into partitions, correlated bits together. Shares TAU + 1 = u_1 + ... + u_m are dealt to the m
   partitions: two fingerprints of at most TAU differing bits differ in fewer than u_i bits in some partition i, else they
   would differ in TAU + 1. So a fingerprint that looks, in every partition with a share, at all values within u_i - 1 bits
   of its own finds every partner, whatever shares the partner has itself.
3. Each fingerprint deals its shares by dynamic programming on estimated costs: the rows that it sends, and the candidates
   that it expects. Those follow from the histograms of the partitions' pieces (of at most eight bits) and from the exact
   counts of frequent values, so a fingerprint whose value in one partition is common looks elsewhere. The number of
   partitions is that of the lowest expected cost.
4. Every fingerprint is a row of its bucket (partition, value) in each partition, and a visitor in the buckets that it looks
   at. Buckets compare visitors with members by xor and bit count, and return a forest of links: one row for each linked
   fingerprint with its root. Large buckets are cut in blocks, one task for each pair of blocks. Pairs are never rows.
5. Connected components of those forests, by fingerprint, take the smallest doc_id.

Defined results: null and empty texts, and texts without words, have the fingerprint zero, linked like any other; texts of one
or two words have one shingle, all their words; each row is a place of its own, also with null or repeated ids; a component
whose ids are all null has a null id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near import components

WORDS, SEED, BITS, TAU = 3, 42, 64, 3
#: Numbers of partitions to choose from, and the most bits of a piece of a partition that has a histogram.
PARTITIONS, PIECE = (2, 3, 4, 5, 6), 8
#: Values of a partition that hold more than one in so many fingerprints are counted exactly: at most so many for each.
FREQUENT = 256
#: What a row that is sent costs, in comparisons.
ROW_COST = 500.0
#: Rows of a bucket that meet in one task are two blocks of about so many.
BLOCK = 4096
#: Text bytes that are hashed at a time.
SLICE = 1 << 20


def shingle_hashes(data: bytes, piece: int = SLICE):
    """XXH64 of all shingles of a text in lower case, in arrays of those of about ``piece`` bytes."""
    import xxhash

    of, at, carried, some = xxhash.xxh64_intdigest, 0, [], False
    while at < len(data):
        stop = min(len(data), at + piece)
        while stop < len(data) and data[stop] not in common.SPACES:  # up to the next white space
            stop += 1
        words = carried + data[at:stop].lower().split()
        at = stop
        if len(words) < WORDS:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: 1 - WORDS].tolist()][: len(words) - WORDS + 1]
        yield np.array([of(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist())], np.uint64)
        carried, some = words[1 - WORDS :], True
    if carried and not some:
        yield np.array([of(b" ".join(carried), SEED)], np.uint64)


def fingerprint(data: bytes) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(data):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the fingerprint of every whole text, as a signed number."""

    def run(batches):
        for batch in batches:
            for part in common.sliced(batch):
                own = np.array([fingerprint(t) for t in common.raw(part["text"])], np.uint64)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "f": signed(own)})

    return common.texts(docs).mapInArrow(run, "doc_id long, f long")


# --- partitions and their costs


def correlations(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, absolute correlation of each two bits) over all fingerprints; one row of sums for each pair of bits."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch["f"].to_numpy().astype("<i8")
            for at in range(0, len(values), 1 << 16):
                bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits  # whole numbers below 2^24 are exact
                n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": both[i, j].astype(np.int64), "rows": np.full(len(i), n, np.int64)})

    sums = nodes.select("f").mapInArrow(run, "i int, j int, n long, rows long").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    if not sums:
        return 0, np.zeros((BITS, BITS))
    n, both = int(sums[0]["rows"]), np.zeros((BITS, BITS))
    for r in sums:
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    p = np.diag(both) / n
    spread = np.sqrt(p * (1 - p))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    return n, np.nan_to_num(c)


def grouped(correlation: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of near-equal size: each grows from the bit of most correlation by the nearest bits."""
    left, out = set(range(BITS)), []
    for k in range(m):
        rest = sorted(left)
        own = [max(rest, key=lambda b: (correlation[b, rest].sum(), -b))]
        left.remove(own[0])
        while len(own) < BITS // m + (k < BITS % m):
            new = max(sorted(left), key=lambda b: (correlation[b, own].sum(), -b))
            own.append(new)
            left.remove(new)
        out.append(sorted(own))
    return out


def taken(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each value as a number."""
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        out |= (values >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def pieces_of(bits: list[int]) -> list[list[int]]:
    n = -(-len(bits) // PIECE)
    return [list(map(int, p)) for p in np.array_split(np.array(bits), n)]


def histograms(nodes: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[tuple[int, int, int], np.ndarray]:
    """Of each piece (m, partition, piece) the number of fingerprints of each value, at most 2^PIECE; over all fingerprints."""
    pieces = {(m, i, k): p for m, parts in layouts.items() for i, bits in enumerate(parts) for k, p in enumerate(pieces_of(bits))}
    order = list(pieces)

    def run(batches):
        counts = [np.zeros(1 << len(pieces[key]), np.int64) for key in order]
        for batch in batches:
            values = batch["f"].to_numpy().view(np.uint64)
            for c, key in zip(counts, order):
                c += np.bincount(taken(values, pieces[key]).astype(np.int64), minlength=len(c))
        for k, c in enumerate(counts):
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"piece": np.full(len(some), k, np.int32), "value": some.astype(np.int32), "n": c[some]})

    out = {key: np.zeros(1 << len(p), np.int64) for key, p in pieces.items()}
    for r in nodes.select("f").mapInArrow(run, "piece int, value int, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).collect():
        out[order[r["piece"]]][r["value"]] = r["n"]
    return out


def within(counts: np.ndarray) -> np.ndarray:
    """For each value the share of all rows at 0, 1, ... TAU differing bits from it."""
    n, width = max(1, counts.sum()), len(counts).bit_length() - 1
    apart = np.bitwise_count(np.arange(len(counts), dtype=np.uint64)[:, None] ^ np.arange(len(counts), dtype=np.uint64))
    return np.stack([(counts * (apart == r)).sum(1) / n if r <= width else np.zeros(len(counts)) for r in range(TAU + 1)], axis=1)


def joined(shares: list[np.ndarray]) -> np.ndarray:
    """Shares at each distance of several independent pieces together."""
    out = shares[0]
    for other in shares[1:]:
        out = np.stack([sum(out[:, a] * other[:, r - a] for a in range(r + 1)) for r in range(TAU + 1)], axis=1)
    return out


def probes(width: int) -> np.ndarray:
    """Rows that are sent to look within 0 .. TAU bits."""
    return np.cumsum([math.comb(width, r) for r in range(TAU + 1)]).astype(float)


def dealt_shares(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, cost): of costs (rows, partitions, shares 1 .. TAU + 1) the cheapest way to deal TAU + 1, for each row."""
    n, m, most = costs.shape
    total = np.full((n, most + 1), np.inf)
    total[:, 0] = 0
    chosen = np.zeros((m, n, most + 1), np.int8)
    for i in range(m):
        new = total.copy()
        for u in range(1, most + 1):
            for s in range(u, most + 1):
                c = total[:, s - u] + costs[:, i, u - 1]
                better = c < new[:, s]
                new[better, s] = c[better]
                chosen[i, better, s] = u
        total = new
    shares, s = np.zeros((n, m), np.int8), np.full(n, most)
    for i in range(m - 1, -1, -1):
        shares[:, i] = chosen[i, np.arange(n), s]
        s = s - shares[:, i]
    return shares, total[:, most]


class Plan:
    """The partitions, and what looking in each of them costs."""

    def __init__(self, n: int, layout: list[list[int]], counts: list[list[np.ndarray]]) -> None:
        self.n, self.layout = n, layout
        self.pieces = [pieces_of(bits) for bits in layout]
        self.tables = [[within(c) for c in own] for own in counts]
        self.sent = np.stack([probes(len(bits)) for bits in layout])
        self.frequent: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(layout)

    def mean_cost(self, counts: list[list[np.ndarray]]) -> float:
        """The expected cost of one fingerprint if all had the same shares."""
        mean = [[(t * (c / max(1, c.sum()))[:, None]).sum(0)[None] for t, c in zip(ts, cs)] for ts, cs in zip(self.tables, counts)]
        found = np.stack([np.cumsum(joined(m)[0]) * self.n for m in mean])
        return len(self.layout) * ROW_COST + float(dealt_shares((found + self.sent * ROW_COST)[None])[1][0])

    def shares(self, values: np.ndarray) -> np.ndarray:
        """The shares of each fingerprint, by partition."""
        costs = np.empty((len(values), len(self.layout), TAU + 1))
        for i, bits in enumerate(self.layout):
            at = [t[taken(values, p).astype(np.int64)] for t, p in zip(self.tables[i], self.pieces[i])]
            expected = np.cumsum(joined(at), axis=1) * self.n
            common_values, times = self.frequent[i]
            if len(common_values):
                apart = np.bitwise_count(taken(values, bits)[:, None] ^ common_values)
                for r in range(TAU + 1):
                    expected[:, r] = np.maximum(expected[:, r], ((apart <= r) * times).sum(1))
            costs[:, i] = expected + self.sent[i] * ROW_COST
        return dealt_shares(costs)[0]


def planned(nodes: DataFrame) -> Plan | None:
    """The plan for these fingerprints; what the driver holds of them are sums over bits, pieces and frequent values."""
    n, correlation = correlations(nodes)
    if n < 2:
        return None
    layouts = {m: grouped(correlation, m) for m in PARTITIONS}
    counts = histograms(nodes, layouts)
    best = None
    for m, layout in layouts.items():
        own = [[counts[m, i, k] for k in range(len(pieces_of(bits)))] for i, bits in enumerate(layout)]
        plan = Plan(n, layout, own)
        cost = plan.mean_cost(own)
        if best is None or cost < best[0]:
            best = cost, plan
    plan = best[1]
    own = buckets(nodes, plan, False).groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > n / FREQUENT).collect()
    for i in range(len(plan.layout)):
        there = [r for r in own if r["part"] == i]
        plan.frequent[i] = np.array([r["value"] for r in there], np.int64).view(np.uint64), np.array([r["n"] for r in there], np.int64)
    return plan


# --- probing


def masks(width: int, r: int) -> np.ndarray:
    """Numbers of ``width`` bits with r ones."""
    import itertools

    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), r)], np.uint64)


def buckets(nodes: DataFrame, plan: Plan, visits: bool = True) -> DataFrame:
    """(part, value, f, member, visitor): each fingerprint's row in its bucket of every partition, and in those that it visits."""
    layout = plan.layout

    def run(batches):
        around = {(len(bits), r): masks(len(bits), r) for bits in layout for r in range(1, TAU + 1) if visits and math.comb(len(bits), r) <= 1 << 16}
        for batch in batches:
            own = batch["f"].to_numpy().view(np.uint64)
            for at in range(0, len(own), 4096):
                values = own[at : at + 4096]
                shares = plan.shares(values) if visits else np.zeros((len(values), len(layout)), np.int8)
                for i, bits in enumerate(layout):
                    value = taken(values, bits)
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(values), i, np.int32), "value": signed(value), "f": signed(values), "member": np.ones(len(values), bool), "visitor": shares[:, i] > 0})
                    for r in range(1, int(shares[:, i].max(initial=0))):
                        some = np.flatnonzero(shares[:, i] > r)
                        mask = around.get((len(bits), r))
                        mask = masks(len(bits), r) if mask is None else mask
                        step = max(1, (1 << 18) // len(mask))
                        for k in range(0, len(some), step):
                            who = some[k : k + step]
                            met = (value[who][:, None] ^ mask).ravel()
                            yield pa.RecordBatch.from_pydict({"part": np.full(len(met), i, np.int32), "value": signed(met), "f": signed(np.repeat(values[who], len(mask))), "member": np.zeros(len(met), bool), "visitor": np.ones(len(met), bool)})

    return nodes.select("f").mapInArrow(run, "part int, value long, f long, member boolean, visitor boolean")


def compared(rows: DataFrame) -> DataFrame:
    """(f, root) of the linked fingerprints of each task (part, value, i, j), from its members and visitors, sorted by task.

    With i = j a block's visitors meet its members; otherwise the visitors of each of the two blocks meet the other's members.
    """

    def judge(f: np.ndarray, member: np.ndarray, visitor: np.ndarray, block: np.ndarray, same: bool):
        parent = np.arange(len(f))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return int(x)

        members = np.flatnonzero(member)
        linked = np.zeros(len(f), bool)
        for x in np.flatnonzero(visitor).tolist():
            near = members[np.bitwise_count(f[members] ^ f[x]) <= TAU]
            near = near[f[near] != f[x]] if same else near[block[near] != block[x]]
            if not len(near):
                continue
            linked[near] = linked[x] = True
            roots = {find(y) for y in near.tolist()} | {find(x)}
            least = min(roots, key=lambda k: signed(f[k : k + 1])[0])
            for k in roots:
                parent[k] = least
        at = np.flatnonzero(linked)
        root = np.array([find(k) for k in at.tolist()], np.int64)
        return pa.RecordBatch.from_pydict({"f": signed(f[at]), "root": signed(f[root]) if len(at) else signed(f[at])})

    def run(batches):
        key, held = None, []
        kinds = ("f", "member", "visitor", "block")

        def settled():
            f, member, visitor, block = (np.concatenate([h[k] for h in held]) for k in range(4))
            return judge(f.view(np.uint64), member, visitor, block, key[2] == key[3])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("part", "value", "i", "j")], axis=1)
            own = [batch[c].to_numpy(zero_copy_only=False) for c in kinds]
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                now = tuple(keys[a].tolist())
                if now != key:
                    if held and sum(len(h[0]) for h in held) > 1:
                        yield settled()
                    key, held = now, []
                held.append([c[a:b] for c in own])
        if held and sum(len(h[0]) for h in held) > 1:
            yield settled()

    return rows.mapInArrow(run, "f long, root long")


def forests(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(f, root): linked fingerprints with their roots, by task; a root is linked with all its rows' fingerprints."""
    rows = common.stored(buckets(nodes, plan), "visits")
    # Only buckets of several blocks need to know how many; where nobody visits or nobody lives there is nothing to compare.
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("member").alias("members"), F.count_if("visitor").alias("visitors"))
    sizes = sizes.filter("n > 1 and members > 0 and visitors > 0").select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(sizes, ["part", "value"])
    own = own.withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = own.select("part", "value", "f", "member", "visitor", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    task = ["part", "value", "i", "j"]
    return common.stored(compared(met.repartition(*task).sortWithinPartitions(*task)), "links")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    signs = common.stored(fingerprints(docs), "fingerprints")
    nodes = common.stored(signs.groupBy("f").agg(F.min("doc_id").alias("least")), "nodes")
    plan = planned(nodes)
    if plan is None:
        ended = nodes.select("f", F.col("least").alias("component_id"))
    else:
        roots = components(forests(nodes, plan).filter("f <> root").select(F.col("f").alias("a"), F.col("root").alias("b")))
        linked = nodes.join(roots, nodes["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
        least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        ended = common.stored(linked.select("f", "root").join(least, "root").select("f", "component_id"), "components")
    # Fingerprints are few beside their copies: one row for each, met by all documents in one join that Spark can split.
    return signs.join(ended.hint("merge"), "f", "left").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its component of near copies."""
    return near_copies(common.table(spark, sf_dir, "documents"))
