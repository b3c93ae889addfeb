"""N-gram Jaccard join by MinHash banding, with exact checks on full shingle sets.

1. Each whole text becomes its set of five-word shingles (hashes). Texts with equal sets form a class, represented by the
   smallest doc_id; only representatives go on.
2. Bands of MinHash values: the numbers of bands and rows are chosen for the target recall at the threshold. Buckets of
   two or more representatives connect them; connected buckets form clusters.
3. Units of work are whole clusters, in which each text is sent once, or the single buckets of a cluster whose buckets
   hold fewer pairs than it has itself (one that chance collisions have chained); a pair of those counts only in the
   first band that it shares. A unit's sets meet in tasks of at most two blocks of BLOCK representatives, one task for
   each pair of blocks. A task computes exact similarities of its pairs, block by block, and returns one row for each
   representative: its number of links, and its root in the task's forest of links. Pairs are never rows.
4. Connected components over those roots give each class of equal sets its class id, the smallest doc_id that it is
   linked with; documents get it through their set's key, in one join that Spark can split where copies are many.

Defined results: null texts and texts without words have no shingles, no links and their own id as class; texts of one
to four words have one shingle, all their words; each row is a place of its own, so rows of equal id are told apart by
their texts, and rows of equal text are copies of each other, also with equal ids; null ids come last, so a class id is
null only if all ids of the class are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Most MinHash values; more of them make room for more rows in a band, and so for fewer chance candidates.
HASHES = 192
BLOCK = 96
#: Parts that a large unit's rows are dealt in.
SALTS = 32


def bands_for(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, that reach the recall with at most ``most`` hashes."""
    best = None
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


BANDS, ROWS = bands_for(SIMILARITY, RECALL, HASHES)


def shingles(hashes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The sorted set of shingles of one text's word hashes."""
    return np.unique(common.windows(hashes, min(width, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def sets_of(batch: pa.RecordBatch):
    """(rows, sets): slices of the batch with the shingle set of each row."""
    for part in common.sliced(batch):
        hashes, _, _, before = common.word_table(*common.flat(part["text"]))
        yield part, [shingles(hashes[a:b]) for a, b in zip(before, before[1:])]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, bands): a 128-bit key of the set, its size, and the band hashes."""
    factors = common.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for part, sets in sets_of(batch):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                keys = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    at = (np.cumsum(n) - n)[full]
                    keys[0, full], keys[1, full] = np.add.reduceat(flat, at), np.add.reduceat(common.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    least = np.empty((BANDS * ROWS, len(full)), np.uint64)
                    for j, f in enumerate(factors):
                        x = flat * f
                        x ^= x >> np.uint64(29)
                        x *= factors[-1 - j]
                        least[j] = np.minimum.reduceat(x, at)
                    for b in range(BANDS):
                        total = np.full(len(full), b + 1, np.uint64)
                        for j in range(b * ROWS, (b + 1) * ROWS):
                            total = common.mix(total * np.uint64(31) + least[j])
                        bands[full, b] = total
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32), pa.array(bands[full].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "k1": keys[0].view(np.int64), "k2": keys[1].view(np.int64), "n": n, "bands": lists})

    return common.texts(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) over edges (a, b): smallest label of the neighbours, then the label of the label, until none changes."""
    both = common.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = common.stored(lower.join(jump, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.filter("root <> old").limit(1).count():
            return labels


UNIT = ["cluster", "band", "bucket"]


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, root, links) of rows (cluster, band, bucket, i, j, block, doc_id, bands, text), sorted by unit, i and j.

    With i = j all pairs of the block are compared, otherwise those of block i with block j. In the unit of one bucket,
    pairs that share an earlier band are left to it.
    """

    def judge(ids: list[int], blocks: list[int], sets: list[np.ndarray], bands: list, key: tuple):
        same, band = key[3] == key[4], key[1]
        n = np.array([len(s) for s in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.cumsum(n) - n
        parent, links = list(range(len(ids))), np.zeros(len(ids), np.int64)
        earlier = np.array([b[:band] for b in bands], np.int64) if band > 0 else None

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        mark = np.zeros(int(flat.max()) + 1, bool)
        side = np.array(blocks)
        for x in range(len(ids)):
            if not same and side[x] != side.min():
                continue
            own = flat[at[x] : at[x] + n[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat].astype(np.int64), at)
            mark[own] = False
            near = shared >= similarity * (n + n[x] - shared) - 1e-9
            near &= (np.arange(len(ids)) > x) if same else (side != side[x])
            if earlier is not None:
                near &= ~(earlier == earlier[x]).any(1)
            for y in np.flatnonzero(near).tolist():
                links[x] += 1
                links[y] += 1
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
        got = np.flatnonzero(links).tolist()
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[x] for x in got], pa.int64()), "root": pa.array([ids[find(x)] for x in got], pa.int64()), "links": pa.array(links[got], pa.int64())})

    def run(batches):
        key, held = None, ([], [], [], [])
        for batch in batches:
            for part, own in sets_of(batch):
                for *now, block, doc, bands, s in zip(*(part[c].to_pylist() for c in (*UNIT, "i", "j", "block", "doc_id", "bands")), own):
                    if now != key:
                        if len(held[0]) > 1:
                            yield judge(*held, key)
                        key, held = now, ([], [], [], [])
                    for column, value in zip(held, (doc, block, s, bands)):
                        column.append(value)
        if len(held[0]) > 1:
            yield judge(*held, key)

    return rows.mapInArrow(run, "doc_id long, root long, links long")


def units(signed: DataFrame) -> DataFrame:
    """(doc_id, cluster, band, bucket, bands) of the representatives (doc_id, bands) that are to be compared; band -1 is a whole cluster."""
    rows = signed.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("band", "bucket").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).filter("members > 1")
    shared = common.stored(shared, "buckets")
    # A representative hangs on the smallest leader of its buckets; only leaders are left to connect.
    hung = rows.join(shared, ["band", "bucket"]).groupBy("doc_id").agg(F.min("least").alias("leader"), F.collect_set("least").alias("leaders"))
    hung = common.stored(hung, "leaders")
    edges = hung.select(F.explode("leaders").alias("a"), F.col("leader").alias("b")).filter("a <> b").distinct()
    roots = components(edges).select(F.col("node").alias("leader"), "root")
    clusters = hung.select("doc_id", "leader").join(roots, "leader", "left").select("doc_id", F.coalesce("root", "leader").alias("cluster"))
    whole = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    cost = shared.join(roots, shared["least"] == roots["leader"], "left").groupBy(F.coalesce("root", "least").alias("cluster")).agg(F.sum(F.col("members") * F.col("members")).alias("pairs"))
    chained = whole.join(cost, "cluster").select("cluster", (F.col("n") * F.col("n") > F.col("pairs")).alias("chained"))
    placed = common.stored(clusters.join(chained, "cluster"), "clusters")
    one = placed.filter("not chained").select("doc_id", "cluster", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("array<long>").alias("bands"))
    own = placed.filter("chained").join(signed, "doc_id").select("doc_id", "cluster", "bands", F.posexplode("bands").alias("band", "bucket"))
    some = own.join(shared.select("band", "bucket"), ["band", "bucket"], "left_semi").select("doc_id", "cluster", "band", "bucket", "bands")
    return one.unionByName(some)


def links_of(texts: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, root, links) by task, of the units' representatives with their texts."""
    # Only units of several blocks need to know how many; a large unit's rows are salted, so as to meet that in many tasks.
    sizes = found.groupBy(*UNIT).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    placed = own.join(sizes, [*UNIT, "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = placed.select("doc_id", *UNIT, "block", "bands", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("doc_id", *UNIT, "block", "bands", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Texts are shuffled to their tasks at every size, so that the plan doesn't turn on how many there are.
    pairs = met.join(texts.hint("merge"), "doc_id").repartition(*UNIT, "i", "j").sortWithinPartitions(*UNIT, "i", "j", "doc_id")
    return common.stored(compared(pairs, similarity), "links")


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, representative, n_links, n_shingles) of every document.

    ``representative`` is the smallest doc_id with the same set of shingles; ``n_links`` counts the representatives of
    other sets with a similarity of at least the threshold.
    """
    own, ids = common.placed(docs)
    own = own.withColumnRenamed("place", "doc_id")
    signed = common.stored(signatures(own), "signatures")
    key = ["k1", "k2", "n"]
    classes = signed.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("representative"), F.any_value("bands").alias("bands"))
    classes = common.stored(classes, "classes")
    links = links_of(own, units(classes.select(F.col("representative").alias("doc_id"), "bands")), similarity)
    roots = components(links.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("representative"), "root")
    found = links.groupBy(F.col("doc_id").alias("representative")).agg(F.sum("links").alias("n_links")).join(roots, "representative")
    # Classes are small beside their copies: they are finished first, and met by all documents in one join.
    ended = common.stored(classes.drop("bands").join(found, "representative", "left"), "ended")
    out = signed.select("doc_id", *key).join(ended.hint("merge"), key, "left")
    least = F.coalesce("representative", "doc_id")
    out = out.select("doc_id", F.coalesce("root", least).alias("class_id"), least.alias("representative"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    if ids is None:
        return out
    for name in ("class_id", "representative", "doc_id"):
        out = out.join(ids.select(F.col("place").alias(name), F.col("doc_id").alias("_id")), name).drop(name).withColumnRenamed("_id", name)
    return out.select("doc_id", "class_id", "representative", "n_links", "n_shingles")


def kept() -> Column:
    """Whether a row of ``join`` is the one that stays of its class."""
    return F.col("doc_id") == F.col("class_id")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return join(common.table(spark, sf_dir, "documents"))


#: The same rows in DuckDB, from all pairs of sets that share a shingle.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + k - 1), ' ')) AS sh FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, '' ORDER BY sh)) AS key FROM s GROUP BY doc_id),
r AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n FROM k GROUP BY key),
rs AS (SELECT rep, n, sh FROM r JOIN s ON s.doc_id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM rs a JOIN rs b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
l(id, root) USING KEY (id) AS (SELECT rep, rep FROM r UNION SELECT p.b, min(l.root) FROM l JOIN p ON p.a = l.id JOIN recurring.l o ON o.id = p.b WHERE l.root < o.root GROUP BY p.b),
c AS (SELECT a AS rep, count(*) AS n_links FROM p GROUP BY a)
SELECT d.doc_id, coalesce(l.root, d.doc_id) AS class_id, coalesce(r.rep, d.doc_id) AS representative, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN r ON r.key = k.key LEFT JOIN l ON l.id = r.rep LEFT JOIN c ON c.rep = r.rep
"""
