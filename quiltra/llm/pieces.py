"""Byte-pair encoding with a SentencePiece vocabulary, with seeded merge-dropout, and its decoding.

A text is cut at spaces and line ends, which no piece of the vocabulary crosses. Within a chunk, an agenda holds the
candidate merges of neighbouring symbols, best piece first. A candidate that comes up is skipped if the hash of (seed,
document, place of the chunk in the text, the candidate's turn in the chunk) falls below the dropout rate: each occurrence
of a word is drawn anew, and the same key always gives the same segmentation. What is in no piece becomes byte pieces. Decoding joins the pieces' bytes and is exact for every text: a marked space in the input
is written as bytes, so it can't be mistaken for a space. With a dropout of 0 the pieces are those of plain merging.

Defined results: null and empty texts have no pieces; rows are encoded one by one, so repeated rows give repeated
results (the key of the draws follows from the id) and long texts need no shuffle; extra columns are ignored.

Chunks of a batch are merged side by side: the agendas of those of about one length are the rows of a matrix, and each step
takes the best candidate of every row. Long chunks keep their agenda in a heap.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DROPOUT = 0.1
SEED = 17
MARK = "▁"
#: Draws made at once for each chunk, and the steps of the hash from chunk to chunk and from draw to draw.
DRAWN, CHUNK_STEP, DRAW_STEP = 16, 0xF1357AEA2E62A9C5, 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
#: Widths of the matrices; chunks of more characters have a heap.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 40)
NEVER = np.int32(1 << 30)
#: Characters that are encoded at a time, in whole texts.
BATCH_CHARACTERS = 1 << 19


class PairTable:
    """Values of pairs of numbers: a table of open addresses that whole arrays of pairs are looked up in."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(10, (8 * len(pairs)).bit_length())
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys = np.full(1 << self.bits, M64, np.uint64)
        self.values = np.full(1 << self.bits, NEVER, np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == np.uint64(M64)
            self.keys[at[free]] = keys[free]  # of several that want a place, the last one has it
            there = self.keys[at] == keys
            self.values[at[there]] = values[there]
            keys, values, at = keys[~there], values[~there], (at[~there] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(DRAW_STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each pair, NEVER if it has none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._home(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], NEVER)
        left = np.flatnonzero((got != keys) & (got != np.uint64(M64)))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            got, want = self.keys[at[left]], keys[left]
            out[left[got == want]] = self.values[at[left[got == want]]]
            left = left[(got != want) & (got != np.uint64(M64))]
        return out


class Pieces:
    """Vocabulary, encoder and decoder; ``model`` is the path of a SentencePiece BPE model with byte pieces.

    A symbol is the id of a piece, or size plus the code point of a character that is no piece.
    """

    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
        self.data = pa.array([b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)], pa.large_binary())
        symbol = lambda p: ids.get(p, n + ord(" " if p == MARK else p) if len(p) == 1 else None)
        self.of_character = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1 and p != MARK:
                self.of_character[ord(p)] = i
        self.of_character[ord(" ")] = symbol(MARK)
        # Pieces by rank, best first; a pair's value is the rank of the piece that it makes.
        best = sorted(ids, key=lambda p: (-sp.get_score(ids[p]), ids[p]))
        self.by_rank = np.array([ids[p] for p in best], np.int32)
        self.pairs = {(a, b): r for r, p in enumerate(best) for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None}
        self.table = PairTable(self.pairs)
        self.limit = np.uint64(min(M64, int(dropout * 2.0**64)))
        self.dropout, self.seed = dropout, seed

    def draws(self, keys: np.ndarray, first: int = 0) -> np.ndarray:
        """For each chunk's key, the decisions on candidates ``first`` to first + DRAWN as bits, lowest first; 1 is a skip."""
        if not self.dropout > 0:
            return np.zeros(len(keys), np.uint16)
        turns = np.arange(first + 1, first + DRAWN + 1, dtype=np.uint64) * np.uint64(DRAW_STEP)
        return np.packbits(common.mix(keys[:, None] + turns) < self.limit, axis=1, bitorder="little").view("<u2").ravel()

    def merged(self, symbols: list[int], key: int) -> list[int]:
        """The symbols of one chunk after its agenda, kept in a heap."""
        piece, n, rank = list(symbols), len(symbols), self.pairs.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        agenda = [(r, i, i + 1, piece[i], piece[i + 1]) for i in range(n - 1) if (r := rank((piece[i], piece[i + 1]))) is not None]
        heapq.heapify(agenda)
        turn = bits = 0
        while agenda:
            r, i, j, a, b = heapq.heappop(agenda)
            if right[i] != j or piece[i] != a or piece[j] != b:
                continue  # one of the two has merged with another since
            if turn % DRAWN == 0:
                bits = int(self.draws(np.array([key], np.uint64), turn)[0])
            turn, skip, bits = turn + 1, bits & 1, bits >> 1
            if skip:
                continue
            piece[i] = own = int(self.by_rank[r])
            k = right[i] = right[j]
            right[j] = -2
            if k >= 0:
                left[k] = i
                if (r := rank((own, piece[k]))) is not None:
                    heapq.heappush(agenda, (r, i, k, own, piece[k]))
            k = left[i]
            if k >= 0 and (r := rank((piece[k], own))) is not None:
                heapq.heappush(agenda, (r, k, i, piece[k], own))
        return [p for p, r in zip(piece, right) if r != -2]

    def _side_by_side(self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Merges the rows of a matrix in place, each of its own length; returns which places are left."""
        n, width = symbols.shape
        place = np.arange(width)
        alive = place < lengths[:, None]
        after = np.where(place + 1 < lengths[:, None], place + 1, -1).astype(np.int8)
        before = np.broadcast_to((place - 1).astype(np.int8), (n, width)).copy()
        rank = np.full((n, width), NEVER, np.int32)
        there = after >= 0
        rank[there] = self.table.find(symbols[there], symbols[:, 1:][there[:, :-1]])
        live, turn, bits = np.arange(n), 0, None
        while len(live):
            own = rank[live]
            i = own.argmin(1)
            best = own[np.arange(len(live)), i]
            more = best != NEVER
            if not more.all():
                live, i, best, bits = live[more], i[more], best[more], bits[more] if bits is not None else None
            if turn % DRAWN == 0:
                bits = self.draws(keys[live], turn)
            skip = (bits >> np.uint16(turn % DRAWN) & np.uint16(1)).astype(bool)
            turn += 1
            rank[live[skip], i[skip]] = NEVER
            row, i = live[~skip], i[~skip]
            j = after[row, i]
            k = after[row, j]
            new = self.by_rank[best[~skip]]
            symbols[row, i] = new
            alive[row, j], rank[row, j] = False, NEVER
            after[row, i] = k
            right = k >= 0
            before[row[right], k[right]] = i[right]
            rank[row, i] = NEVER
            rank[row[right], i[right]] = self.table.find(new[right], symbols[row[right], k[right]])
            h = before[row, i]
            left = h >= 0
            rank[row[left], h[left]] = self.table.find(symbols[row[left], h[left]], new[left])
        return alive

    def encode_all(self, texts: list[str], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of them by text); as usual for these vocabularies a space is put before a text."""
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        data = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), "<u4")
        if not len(data):
            return np.zeros(0, np.int32), size
        begin = np.cumsum(size) - size
        # A chunk is a line end, or what follows from a run of spaces, or from a line end, to the next of them.
        space, end = data == 32, data == 10
        first = end | space
        first[1:] = end[1:] | end[:-1] | (space[1:] & ~space[:-1])
        first[begin[size > 0]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(data)))
        text = np.searchsorted(begin + size, starts, side="right")
        place = np.arange(len(starts)) - np.searchsorted(starts, begin)[text]
        root = common.mix(np.array([v & M64 for v in variants], np.uint64) + np.uint64(self.seed * CHUNK_STEP & M64))
        keys = common.mix(root[text] + (place + 1).astype(np.uint64) * np.uint64(CHUNK_STEP))
        symbols, alive = self.of_character[data], np.ones(len(data), bool)
        low = 1
        for width in WIDTHS:
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                cells = np.minimum(starts[part][:, None] + np.arange(width), len(data) - 1)
                matrix = symbols[cells]
                left = self._side_by_side(matrix, lengths[part], keys[part])
                inside = np.arange(width) < lengths[part][:, None]
                symbols[cells[inside]], alive[cells[inside]] = matrix[inside], left[inside]
        for c in np.flatnonzero(lengths > low).tolist():
            a, b = int(starts[c]), int(starts[c] + lengths[c])
            got = self.merged(symbols[a:b].tolist(), int(keys[c]))
            symbols[a : a + len(got)], alive[a + len(got) : b] = got, False
        out, owner = symbols[alive], np.repeat(np.arange(len(texts)), size)[alive]
        odd = out >= self.size
        if odd.any():  # characters that are no piece become their bytes
            points = (out[odd] - self.size).astype(np.int64)
            times = np.ones(len(out), np.int64)
            times[odd] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            spread = np.repeat(odd, times)
            out, owner = np.repeat(out, times), np.repeat(owner, times)
            out[spread] = self.byte[np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)]
        return out.astype(np.int32), np.bincount(owner, minlength=len(texts))

    def encode(self, text: str, variant: int = 0) -> np.ndarray:
        """The ids of a whole text, drawn by the key ``variant``."""
        return self.encode_all([text], [variant])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, without the space before it."""
        _, offsets, data = self.data.take(pa.array(ids)).buffers()
        ends = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(counts)])] if len(ids) else np.zeros(len(counts) + 1, np.int64)
        data = data.to_pybytes() if data is not None else b""
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([len(ids)]))[0]


def encoded(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, variant, ids) of every whole text; ``variant`` is the key of its draws, from seed and id."""

    def run(batches):
        pieces = Pieces(model, dropout, seed)
        for batch in batches:
            for own in common.sliced(batch, limit=BATCH_CHARACTERS):
                ids, counts = pieces.encode_all(own["text"].to_pylist(), own["variant"].to_pylist())
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_pydict({"doc_id": own["doc_id"], "variant": own["variant"], "ids": lists})

    rows = common.texts(docs).withColumn("variant", F.xxhash64(F.lit(seed), "doc_id"))
    return rows.mapInArrow(run, "doc_id long, variant long, ids array<int>")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, variant, n_pieces, ids_crc32, text) of (doc_id, variant, ids)."""

    def run(batches):
        pieces = Pieces(model)
        for batch in batches:
            rows = batch["ids"]
            ids, cuts = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            cuts = cuts - cuts[0]
            own = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            texts = pa.array(pieces.decode_all(ids, np.diff(cuts)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "variant": batch["variant"], "n_pieces": np.diff(cuts).astype(np.int64), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), "text": texts})

    return tokens.select("doc_id", "variant", "ids").mapInArrow(run, "doc_id long, variant long, n_pieces long, ids_crc32 long, text string")


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, variant, n_pieces, ids_crc32, n_bytes, text_crc32) of what decodes from the pieces of every text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    text = F.col("text").cast("binary")
    return decoded(encoded(docs, model), model).select("doc_id", "variant", "n_pieces", "ids_crc32", F.length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    return round_trip(common.table(spark, sf_dir, "documents"))
