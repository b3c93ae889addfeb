"""Alignment of the tokens of two tokenizers, and how often their ids end together.

A text is cut into units at single spaces between other characters. Byte-level vocabularies always cut there, and no piece
of a SentencePiece vocabulary crosses such a place, so tokens and groups of a text are those of its units one after the
other. A worker encodes each distinct unit once while it is remembered, and finds its groups: the stretches between bytes
where a token of both ends.

1. Texts become chunks: one row holds the units of many whole texts, the distinct units' links, and how often the chunk has
   each link. A link whose group is one token each with the same bytes, and whose B id is that of the identity map (for each
   A id, the B id of the same bytes), is counted in a vector of the length of A's vocabulary. Only links of other groups
   become pairs of ids, each distinct one once for each chunk.
2. The vectors are summed, the pairs are shuffled on (A id, B id) and summed; each B id's highest count is a vector of the
   length of B's vocabulary. Both vectors are bounded by the vocabularies and are broadcast.
3. The counts of irregular pairs go back to the chunks that have them, and each chunk's texts are summed over their units.

Defined results: null and empty texts, and texts whose joined token bytes differ from a space and the text (a mark of the
vocabulary in the text, say), have no tokens, links or groups; rows are independent of each other, so nulls and repeats of
doc_id give rows of their own; a very long text is a chunk of its own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import MARK
from .tokens import SPACE, byte_letters

#: Units in a chunk, and distinct units that a worker remembers.
CHUNK_UNITS, REMEMBERED = 1 << 22, 400_000
CHUNK = "chunk long, docs binary, units binary, pairs array<struct<a:int,b:int,n:long>>, same array<struct<a:int,n:long>>"


class Vocabularies:
    """Both vocabularies' ids and bytes; A is a byte-level tokenizer, B a SentencePiece model that puts a space first."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {chr(letter): byte for byte, letter in byte_letters().items()}
        size = 1 + max(self.a.get_vocab().values())
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(bytes([letters.get(c, ord(c) & 255)]) for c in token)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(MARK in n.lstrip(MARK) for n in names):
            raise ValueError("a piece of the vocabulary crosses a space")
        self.bytes_b = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # The identity map: of pieces of the same bytes, the one that isn't a byte piece.
        of = {x: i for i, x in sorted(enumerate(self.bytes_b), key=lambda ix: (not sp.is_byte(ix[0]), -ix[0]))}
        self.same = np.array([of.get(x, -1) if x else -1 for x in self.bytes_a], np.int32)
        self.plain = [f"{a}|{b}" for a, b in enumerate(self.same.tolist())]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """(A's ids, B's ids) of texts that begin with a space; B puts one first itself."""
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)

    def groups(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of units whose ids of both kinds join to the same bytes: the number of groups of each, the links of all (A id,
        B id, whether by the identity map), and the text of each one's groups."""
        x, y = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[x]), np.cumsum(self.size_b[y])
        both = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]  # units end in both, so groups don't cross them
        to_a, to_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        from_a, from_b = (np.concatenate([[0], to[:-1]]) if len(to) else to for to in (to_a, to_b))
        last_a, last_b = x[to_a - 1], y[to_b - 1]
        by_map = (to_a - from_a == 1) & (to_b - from_b == 1) & (self.same[last_a] == last_b)
        said = list(map(self.plain.__getitem__, last_a.tolist()))
        odd = np.flatnonzero(~by_map)
        x, y = x.tolist(), y.tolist()
        for k, i, j, m, n in zip(odd.tolist(), *(c[odd].tolist() for c in (from_a, to_a, from_b, to_b))):
            said[k] = ",".join(map(str, x[i:j])) + "|" + ",".join(map(str, y[m:n]))
        tokens = np.cumsum([len(i) for i in ids_a], dtype=np.int64)
        cuts = np.searchsorted(to_a, tokens, side="right")
        sizes = np.diff(cuts, prepend=0)
        return sizes, np.stack([last_a, last_b, by_map], axis=1).astype(np.int32), [";".join(said[b - n : b]) for b, n in zip(cuts.tolist(), sizes.tolist())]

    def joined(self, ids: list[int], of: list[bytes]) -> bytes:
        return b"".join([of[i] for i in ids])


class Units:
    """The distinct units of a chunk: their numbers of tokens, links and groups as text, by unit number."""

    def __init__(self, own: Vocabularies) -> None:
        self.own = own
        self.number: dict[str, int] = {}
        self.fresh: list[str] = []
        self.good: list[bool] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.groups: list[str] = []
        self.n_groups: list[int] = []
        self.links: list[np.ndarray] = []  # of all units, one row for each group: A id, B id, whether by the identity map

    def numbers(self, units: list[str]) -> list[int]:
        number, out = self.number, []
        for u in units:
            k = number.get(u)
            if k is None:
                k = number[u] = len(number)
                self.fresh.append(u)
            out.append(k)
        return out

    def learn(self) -> None:
        """Encodes and aligns the new units."""
        own, fresh = self.own, self.fresh
        if not fresh:
            return
        ids_a, ids_b = own.encode(fresh)
        good = [own.joined(a, own.bytes_a) == (data := text.encode()) and own.joined(b, own.bytes_b) == data for text, a, b in zip(fresh, ids_a, ids_b)]
        none: list[int] = []
        sizes, links, said = own.groups([a if g else none for a, g in zip(ids_a, good)], [b if g else none for b, g in zip(ids_b, good)])
        self.good += good
        self.n_a += map(len, ids_a)
        self.n_b += map(len, ids_b)
        self.n_groups += sizes.tolist()
        self.groups += said
        self.links.append(links)
        self.fresh = []


#: Between two characters that are no white space of the vocabulary's split pattern, nor NUL.
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def units_of(text: str) -> list[str]:
    """The units of a space and the text, each with its space."""
    return [" " + u for u in CUT.split(text)]


def whole(own: Vocabularies, text: str) -> tuple[bool, Units]:
    """A text as one unit."""
    one = Units(own)
    one.numbers([" " + text])
    one.learn()
    return one.good[0], one


DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("units", "<i8"), ("n_a", "<i8"), ("n_b", "<i8"), ("groups", "<i8"), ("sha", "V32")])


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts]))


def unpacked(data: bytes, *types) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * len(types)
    for n, kind in zip(np.frombuffer(data, "<i8", len(types)), types):
        out.append(np.frombuffer(data, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def chunk_row(number: int, docs: list[tuple], sequences: list[np.ndarray], units: Units) -> pa.RecordBatch:
    """A chunk: its texts with their unit numbers, the units' links by number, and the counts of the links."""
    table = np.array(docs, DOC)
    sequence = np.concatenate([*sequences, np.zeros(0, np.int32)]).astype(np.int32)
    links = np.concatenate([*units.links, np.zeros((0, 3), np.int32)])
    sizes = np.array(units.n_groups, np.int64)
    uses = np.bincount(sequence, minlength=len(sizes))
    times = np.repeat(uses, sizes)
    by_map = links[:, 2] == 1
    vector = np.bincount(links[by_map, 0], weights=times[by_map], minlength=len(units.own.same)).astype(np.int64)
    keys, place = np.unique(links[~by_map, 0].astype(np.int64) << 32 | links[~by_map, 1], return_inverse=True)
    counts = np.bincount(place, weights=times[~by_map], minlength=len(keys)).astype(np.int64)
    # A link is an A id of the identity map, or a pair of the chunk's list after those.
    code = np.empty(len(links), np.int32)
    code[by_map] = links[by_map, 0]
    code[~by_map] = len(vector) + place
    some = np.flatnonzero(vector)
    pair = pa.StructArray.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], ["a", "b", "n"])
    same = pa.StructArray.from_arrays([pa.array(some.astype(np.int32)), pa.array(vector[some])], ["a", "n"])
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pair, same)]
    data = [pa.array([number], pa.int64()), pa.array([packed(table, sequence)], pa.binary()), pa.array([packed(sizes, code)], pa.binary()), *lists]
    return pa.RecordBatch.from_arrays(data, ["chunk", "docs", "units", "pairs", "same"])


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Chunks of whole texts with their units, links, and counts of links."""

    def run(batches):
        own, part = Vocabularies(path_a, path_b), TaskContext.get().partitionId()
        units, rows, sequences, n, k = Units(own), [], [], 0, 0
        for batch in batches:
            for piece in common.sliced(batch, limit=1 << 19):
                ids, texts = piece["doc_id"].to_pylist(), piece["text"].to_pylist()
                numbers = [units.numbers(units_of(t)) if t else [] for t in texts]
                units.learn()
                good, n_a, n_b, groups, n_groups = units.good, units.n_a, units.n_b, units.groups, units.n_groups
                for doc, text, own_units in zip(ids, texts, numbers):
                    said = (0, 0, 0, bytes(32))
                    if own_units and not all([good[u] for u in own_units]):
                        # Some unit's bytes differ; the whole text decides.
                        fine, one = whole(own, text)
                        if fine:
                            own_units = [units.number[" " + text]] if " " + text in units.number else units.numbers([" " + text])
                            units.learn()
                        else:
                            own_units = []
                    if own_units:
                        digest = hashlib.sha256(";".join([groups[u] for u in own_units]).encode()).digest()
                        said = (sum([n_a[u] for u in own_units]), sum([n_b[u] for u in own_units]), sum([n_groups[u] for u in own_units]), digest)
                    rows.append((doc or 0, doc is None, len(own_units), *said))
                    sequences.append(np.array(own_units, np.int32))
                    n += len(own_units)
                if n >= CHUNK_UNITS or len(units.number) >= REMEMBERED:
                    yield chunk_row(part << 32 | k, rows, sequences, units)
                    units, rows, sequences, n, k = Units(own), [], [], 0, k + 1
        if rows:
            yield chunk_row(part << 32 | k, rows, sequences, units)

    return common.texts(docs).mapInArrow(run, CHUNK)


def pair_counts(stored: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(A id, count) by the identity map, and (a, b, count) of all other linked ids."""
    same = stored.select(F.explode("same").alias("s")).groupBy(F.col("s.a").alias("a")).agg(F.sum("s.n").alias("count"))
    others = stored.select(F.explode("pairs").alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.n").alias("count"))
    return same, others


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each text's numbers of tokens, groups and links, its links of their B id's highest count, and the sum of counts."""
    own = Vocabularies(path_a, path_b)
    stored = common.stored(chunks(docs, path_a, path_b), "chunks", compression="uncompressed")
    same, others = pair_counts(stored, path_a, path_b)
    others = common.stored(others, "pairs")
    # Vectors of the lengths of the vocabularies.
    by_map, best = np.zeros(len(own.same), np.int64), np.zeros(len(own.bytes_b), np.int64)
    for r in same.collect():
        by_map[r["a"]] = r["count"]
    np.maximum.at(best, own.same[own.same >= 0], by_map[own.same >= 0])
    for r in others.groupBy("b").agg(F.max("count").alias("n")).collect():
        best[r["b"]] = max(best[r["b"]], r["n"])
    vectors = docs.sparkSession.sparkContext.broadcast((by_map, (by_map == best[own.same]) & (by_map > 0), best))

    def run(batches):
        by_map, is_best, best = vectors.value
        for batch in batches:
            for row in batch.to_pylist():
                (table, sequence), (sizes, code) = unpacked(row["docs"], DOC, "<i4"), unpacked(row["units"], "<i8", "<i4")
                listed = row["counts"] or []
                place, b, n = (np.array([x[k] for x in listed], np.int64) for k in ("k", "b", "count"))
                count, top = np.zeros(len(listed), np.int64), np.zeros(len(listed), bool)
                count[place], top[place] = n, n == best[b]
                count, top = np.concatenate([by_map, count])[code], np.concatenate([is_best, top])[code]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                total, tops = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends] for x in (count, top))
                total, tops = np.diff(total)[sequence], np.diff(tops)[sequence]
                ends = np.concatenate([[0], np.cumsum(table["units"])])
                total, tops = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (total, tops))
                sha = [s.tobytes().hex() if g else "" for s, g in zip(table["sha"], table["units"].tolist())]
                doc = pa.array(table["doc"].astype(np.int64), mask=table["null"].astype(bool))
                columns = [doc, *(pa.array(table[c].astype(np.int64)) for c in ("n_a", "n_b", "groups", "groups")), pa.array(tops), pa.array(total), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    wanted = stored.select("chunk", F.posexplode("pairs").alias("k", "p")).select("chunk", "k", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    # One row for each chunk that has a pair: a pair that all chunks have is split by Spark, its count is one row.
    told = wanted.join(others.hint("merge"), ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("k", "b", "count")).alias("counts"))
    rows = stored.select("chunk", "docs", "units").join(told, "chunk", "left").select("docs", "units", "counts")
    return rows.mapInArrow(run, OUT)


def identity_share(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(links, by_map): how many links there are, and how many of them the identity map has; both over all texts."""
    same, others = pair_counts(chunks(docs, path_a, path_b), path_a, path_b)
    both = same.select("count", F.col("count").alias("by_map")).unionByName(others.select("count", F.lit(0).cast("long").alias("by_map")))
    return both.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("links"), F.coalesce(F.sum("by_map"), F.lit(0)).alias("by_map"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of a byte-level and a SentencePiece vocabulary."""
    import public_tokenizers

    return aligned(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
