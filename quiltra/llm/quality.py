"""Quality classifier: weak labels from overlapping heuristics, resolved by expectation-maximisation, train a linear scorer.

1. Labellers: heuristics over the whole text vote 1 (reject), 0 (keep) or -1 (abstain).
2. Documents are counted by vote pattern, over all of them. The number of patterns is bounded by 3 to the number of
   labellers, so the table of counts is small at any size; EM (Dawid and Skene's model: a class prior, and for each
   labeller the chance of each vote given the class) runs on it and gives each pattern a posterior.
3. A logistic scorer over hashed word features learns the posteriors on a bounded sample: about TRAIN_ROWS distinct texts
   at most (drawn by hash within each half of the posterior, each weighted by the inverse of its half's rate, so bias and
   threshold follow the share of rejects among all distinct texts). Only features of LEAST_DOCS sampled documents or more get a weight.
4. Every document is scored; it is rejected if its score exceeds the threshold that best separates the sample.

Defined results: null and empty texts get the votes of a text without words (all labellers abstain but the length
one); equal texts get equal scores; ties of the sampling hash are kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound on the documents that train the scorer.
TRAIN_ROWS = 8_000
FEATURE_BITS = 22
LEAST_DOCS = 8
ROUNDS = 200
LIFT = 8
#: Bound on the labelled documents that the lexicon of toxic words is drawn from, and the least share of toxic ones with a word.
LABELLED_ROWS = 10_000
MARK_SHARE, LEFT_TO_CHANCE = 0.015, 0.5
#: Lengths in letters of the word beginnings in the lexicon, and in bytes of those that the scorer sees.
BEGINNINGS, BYTE_BEGINNINGS = (4, 5, 6, 7), (4, 5, 7)
#: What is known beforehand of labellers, as so many votes: that their votes on a class are the more often right ones.
BELIEF = 4.0


def beginning(k: int):
    return lambda w: F.substring(w, 1, k)


def lexicon(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[list[str]]:
    """Words, and beginnings of words, that mark toxic documents, two lists, each drawn from a half of the labelled documents of its own.

    An entry is in at least MARK_SHARE of the half's toxic texts, and in so many that chance leaves few, in no other text of
    the half. Reads at most about
    ``rows`` labelled documents, drawn by hash. Each entry is in a fixed share of the sample, so a list has at most
    1/MARK_SHARE times as many entries as a document has words.
    """
    marked = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    chance = (F.shiftright(F.xxhash64("doc_id", F.lit(7)), 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))
    own = common.texts(docs).filter(chance < min(1.0, rows / max(1, n))).join(marked, "doc_id").dropDuplicates(["text"])
    own = own.withColumn("half", F.pmod(F.xxhash64("text", F.lit(8)), F.lit(2)).cast("int"))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) > 3)
    starts = F.array_distinct(F.flatten(F.array(words, *[F.transform(words, beginning(k)) for k in BEGINNINGS])))
    sizes = {(r["half"], r["toxic"]): r["count"] for r in own.groupBy("half", (F.col("toxic") == 1).alias("toxic")).count().collect()}
    found = own.select("toxic", "half", F.explode(starts).alias("start")).groupBy("half", "start").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.count_if(F.col("toxic") != 1).alias("good"))
    found = common.stored(found, "beginnings")
    # Of beginnings in k texts, chance leaves share**k of them in toxic ones alone; from ``least`` on, less than LEFT_TO_CHANCE in all.
    times = {(r["half"], r["k"]): r["count"] for r in found.filter(F.col("bad") + F.col("good") <= 64).groupBy("half", (F.col("bad") + F.col("good")).alias("k")).count().collect()}
    bounds = []
    for half in (0, 1):
        toxic = sizes.get((half, True), 0)
        share, k, left = toxic / max(1, toxic + sizes.get((half, False), 0)), 65, 0.0
        while k > 1 and left + times.get((half, k - 1), 0) * share ** (k - 1) < LEFT_TO_CHANCE:
            k -= 1
            left += times.get((half, k), 0) * share**k
        bounds.append(max(k, int(MARK_SHARE * toxic)))
    least = F.when(F.col("half") == 0, bounds[0]).otherwise(bounds[1])
    kept: list[list[str]] = [[], []]
    for r in sorted(found.filter((F.col("bad") >= least) & (F.col("good") == 0)).select("half", "start").collect(), key=lambda r: (len(r["start"]), r["start"])):
        if not r["start"].startswith(tuple(kept[r["half"]])):
            kept[r["half"]].append(r["start"])
    return kept


#: Labellers of form and of toxic words; each group has an EM of its own, for a text can have either fault without the other.
FORM = ["marked_words", "symbols", "exclamations", "capitals", "same_word_again", "few_words", "bare_marks"]
TOXIC = ["words_of_one_half", "words_of_the_other_half", "several_words"]
LABELLERS = [*FORM, *TOXIC]
#: Bytes that are no symbols: letters, digits, white space, common punctuation and all beyond ASCII.
PLAIN = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum() or chr(b).isspace() or chr(b) in ".,;:'!?()-")
SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def votes_of(text: bytes, marks: list[tuple[str, ...]], starts: frozenset[str]) -> list[int]:
    """The labellers' votes on a whole text: 1 reject, 0 keep, -1 abstain. ``starts`` are the first four letters of the marks."""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    m = max(1, len(counts))
    cores = {w: w.strip(SYMBOLS).lower() for w in counts}
    parts = {p for p in text.decode().lower().replace("\n", " ").split(" ") if p[:4] in starts} if starts else ()
    marked = [sum(p.startswith(own) for p in parts) for own in marks]
    several = sum(p.startswith(marks[0] + marks[1]) for p in parts)
    ends = sum(w[-3:] == w[-1:] * 3 and w[-1] in SYMBOLS for w in counts) / m
    symbols = len(text.translate(None, PLAIN)) / n
    exclamations = text.count(b"!") / n
    capitals = sum(len(w) > 2 and w.isupper() for w in counts) / m
    again = sum(map(operator.eq, words, words[1:])) / n
    bare = sum(k for w, k in counts.items() if not cores[w]) / n
    enough = len(words) >= 5
    vote = lambda bad, good: 1 if bad else 0 if good else -1
    return [
        vote(enough and ends >= 0.3, ends < 0.05), vote(enough and symbols >= 0.5, symbols < 0.2), vote(enough and exclamations >= 0.3, exclamations < 0.05),
        vote(enough and capitals >= 0.4, capitals < 0.1), vote(enough and again >= 0.3, again < 0.05),
        vote(len(words) >= 50 and m < 0.15 * n, len(words) < 50 or m > 0.25 * n), vote(enough and bare >= 0.25, bare < 0.05),
        *[vote(k >= 1, bool(own)) for k, own in zip(marked, marks)], vote(several >= 2, bool(starts) and several == 0),
    ]


def votes(docs: DataFrame, marks: list[list[str]] = ((), ()), with_features: bool = False) -> DataFrame:
    """(doc_id, key, votes, features): a hash of the text, one vote for each labeller, and the hashed features if asked for."""
    all_marks, starts = [tuple(own) for own in marks], frozenset(m[:4] for own in marks for m in own)

    def run(batches):
        for batch in batches:
            texts = common.raw(batch["text"])
            got = [votes_of(t, all_marks, starts) for t in texts]
            rows = [features(t).astype(np.int32).tobytes() if with_features else b"" for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "key": batch["key"], "votes": pa.array(got, pa.list_(pa.int8())), "features": pa.array(rows, pa.binary())})

    return common.texts(docs).withColumn("key", F.xxhash64("text")).mapInArrow(run, "doc_id long, key long, votes array<tinyint>, features binary")


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: the posterior of rejection for each, the labellers' chances [labeller, class, vote], the prior.

    The start takes any rejecting vote for a likely reject. Each vote is smoothed by one, and by BELIEF votes that are right
    on the class; all else is the documents'.
    """
    m = patterns.shape[1]
    share_bad = (patterns == 1).sum(1) / np.maximum(1, (patterns >= 0).sum(1))
    post = np.clip(np.where((patterns == 1).any(1), 0.5 + share_bad / 2, share_bad), 0.01, 0.99)
    chance, prior = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((post * counts).sum() / max(1, counts.sum()), 1e-4, 0.5))
        for vote in (-1, 0, 1):
            own = patterns == vote
            for c, p in enumerate((1 - post, post)):
                chance[:, c, vote] = (own * (p * counts)[:, None]).sum(0) + 1 + BELIEF * (vote == c)
        chance /= chance.sum(2, keepdims=True)
        at = chance[np.arange(m)[None, :], :, patterns]
        odds = np.log(prior / (1 - prior)) + (np.log(at[:, :, 1]) - np.log(at[:, :, 0])).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return post, chance, prior


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance that a text has either fault, by pattern; the labellers' chances), by EM in each group of labellers."""
    clean, chances = np.ones(len(patterns)), []
    for own in (slice(0, len(FORM)), slice(len(FORM), None)):
        kinds, at = np.unique(patterns[:, own], axis=0, return_inverse=True)
        post, chance, _ = accuracies(kinds, np.bincount(at.ravel(), weights=counts, minlength=len(kinds)))
        # Where no labeller of the group rejects, the group has nothing to say against a text.
        clean *= 1 - np.where((kinds == 1).any(1), post, 0.0)[at.ravel()]
        chances.append(chance)
    return 1 - clean, np.concatenate(chances)


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features: lower-cased words without marks at the end, their beginnings, the marks alone, case and repeats."""
    out = set()
    for word in set(text.split()):
        core = word.rstrip(b".,;:*&%$#!?")
        tail = word[len(core) :]
        core_low = core.lower()
        out.add(zlib.crc32(core_low))
        for k in BYTE_BEGINNINGS:
            if len(core_low) > k:
                out.add(zlib.crc32(core_low[:k], 1))
        if len(tail) > 1:
            out.add(zlib.crc32(b"\x00" + tail))
        if core.isupper() and len(core) > 2:
            out.add(zlib.crc32(b"\x01"))
    words = text.split()
    again = sum(a == b for a, b in zip(words, words[1:]))
    out.update(zlib.crc32(b"\x02%d" % k) for k in range(3, 1 + 10 * again // max(1, len(words))))
    return np.fromiter(out, np.int64, len(out)) & ((1 << FEATURE_BITS) - 1)


def train(rows: list[np.ndarray], targets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights over the hashed features, bias, and the threshold on the score; full-batch gradient steps scaled by their running moments (Adam)."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    n1 = max(1e-9, targets.sum())
    n0 = max(1e-9, len(rows) - n1)
    # Features that speak for rejection: in at least LEAST_DOCS documents, LIFT times as common among rejects, far from chance.
    # The rare ones, which are most, go first: what is left is small beside the space of features.
    keep = (np.bincount(flat, minlength=1) >= LEAST_DOCS)[flat]
    owner, flat = owner[keep], flat[keep]
    common_ones, at = np.unique(flat, return_inverse=True)
    with_one, both = np.bincount(at, weights=targets[owner], minlength=len(common_ones)), np.bincount(at, minlength=len(common_ones))
    p1, p0, p = with_one / n1, (both - with_one) / n0, both / (n1 + n0)
    far = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    keep = ((p1 >= LIFT * p0) & (far >= 4))[at]
    owner, flat = owner[keep], flat[keep]
    total = max(1e-9, weights.sum())
    used = np.unique(flat)
    flat_used = np.searchsorted(used, flat)
    v, first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, ROUNDS + 1):
        score = np.bincount(owner, weights=v[:-1][flat_used], minlength=len(rows)) + v[-1]
        gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - targets) * weights / total
        grad = np.append(np.bincount(flat_used, weights=gap[owner], minlength=len(used)), gap.sum()) + np.append(2e-5 * v[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        v -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    w, b = v[:-1], float(v[-1])
    score = np.bincount(owner, weights=w[flat_used], minlength=len(rows)) + b
    order = np.argsort(score)
    gain = np.concatenate([[0.0], np.cumsum((weights * (1 - 2 * targets))[order])])  # right below the cut, less wrong below it
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    k = int(best[len(best) // 2])
    edges = np.concatenate([[score.min(initial=0) - 1], score[order], [score.max(initial=0) + 1]])
    return dense(used, w), b, float((edges[k] + edges[k + 1]) / 2)


def dense(used: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights of all features; those that aren't used have none."""
    out = np.zeros(1 << FEATURE_BITS)
    out[used] = w
    return out


def model_of(docs: DataFrame, marks: list[list[str]] = ((), ()), train_rows: int = TRAIN_ROWS):
    """Posteriors by pattern, and the scorer fitted on a bounded sample."""
    counted = votes(docs, marks).groupBy("votes").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("texts")).collect()
    if not counted:
        return {}, (np.zeros(1 << FEATURE_BITS), 0.0, 0.0), None
    patterns, counts = np.array([r["votes"] for r in counted], dtype=np.int64), np.array([r["n"] for r in counted], dtype=float)
    post, chance = posteriors(patterns, counts)
    posterior = {tuple(map(int, p)): float(x) for p, x in zip(patterns, post)}
    bad = [list(p) for p, x in posterior.items() if x >= 0.5]
    is_bad = F.array_contains(F.array(*[F.array(*[F.lit(v).cast("tinyint") for v in p]) for p in bad]), F.col("votes")) if bad else F.lit(False)
    distinct = np.array([r["texts"] for r in counted], dtype=float)
    draw = lambda key: (F.shiftright(key, 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))
    rates = [min(1.0, 0.45 * train_rows / max(1.0, k)) for k in (distinct[post >= 0.5].sum(), distinct[post < 0.5].sum())]
    sample = votes(docs.filter(draw(F.xxhash64("text")) < max(rates)), marks, True).filter(draw(F.col("key")) < F.when(is_bad, rates[0]).otherwise(rates[1]))
    # All rows of a text are in or none; one of them is kept.
    got = sample.groupBy("key").agg(F.first("votes").alias("votes"), F.first("features").alias("features")).toArrow().sort_by("key")
    rows = [np.frombuffer(f.as_buffer(), np.int32) for f in got["features"]]
    target = np.array([posterior[tuple(v)] for v in got["votes"].to_pylist()])
    weights = 1 / np.where(target >= 0.5, *rates)
    return posterior, train(rows, target, weights), chance


def scored(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, score, rejected) of every document; labels (doc_id, toxic) give the lexicon, if there are any."""
    own = common.texts(docs)
    _, (w, b, cut), _ = model_of(own, lexicon(own, labels) if labels is not None else ((), ()), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((used := np.flatnonzero(w), w[used], b, cut))

    def run(batches):
        used, w, b, cut = shared.value
        w = dense(used, w)
        for batch in batches:
            score = np.array([w[features(t)].sum() + b for t in common.raw(batch["text"])], dtype=float)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": batch["text"], "score": pa.array(score, pa.float64()), "rejected": pa.array(score > cut, pa.bool_())})

    return own.mapInArrow(run, "doc_id long, text string, score double, rejected boolean")


def accepted(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't rejected."""
    own = common.texts(docs, text_col=text_col)
    _, (w, b, cut), _ = model_of(own, lexicon(own, labels) if labels is not None else ((), ()), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((used := np.flatnonzero(w), w[used], b, cut))

    def run(batches):
        used, w, b, cut = shared.value
        w = dense(used, w)
        for batch in batches:
            yield batch.filter(pa.array([w[features(t or b"")].sum() + b <= cut for t in common.raw(batch[text_col])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    return scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select("doc_id", F.round("score", 6).alias("score"), "rejected")
