"""SimHash components, periodic runs and token alignment against brute force, with nulls, empty and long texts and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltra.llm import align, periods, simhash

SCHEMA = "doc_id long, text string, f long, value string, chunk int, w string, n long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, "y", 3) for d, t in rows], SCHEMA).repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# 11


def own_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def own_components(prints):
    u = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3).tolist():
            parent[find(i)] = find(i + 1 + j)
    return {int(v): find(k) for k, v in enumerate(u)}


def own_near_copies(rows):
    prints = [own_fingerprint(t) for _, t in rows]
    of, least = own_components(prints), {}
    for (d, _), f in zip(rows, prints):
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return sorted(((d, f"{f:016x}", least.get(of[f])) for (d, _), f in zip(rows, prints)), key=str)


@pytest.fixture(scope="module")
def variants():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(90)] for _ in range(5)]
    rows = [(None, "x y"), (5, ""), (6, None), (7, "ONE two"), (8, "one\tTWO"), (9, "one"), (1, " ".join(words * 40))]
    for k in range(500):
        text = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            text[r.randrange(90)] = r.choice(words)
        rows.append((10 + k, " ".join(text)))
    return [*rows, (10, "x y"), (10, "x y"), (600, " ".join(base[0]).upper())]


def test_components_are_those_of_all_pairs(spark, variants, monkeypatch):
    want = own_near_copies(variants)
    assert rows_of(simhash.near_copies(table(spark, variants)), "*") == want
    monkeypatch.setattr(simhash, "BLOCK", 20)
    assert rows_of(simhash.near_copies(table(spark, variants)), "*") == want


@pytest.mark.parametrize("m", [2, 6])
def test_any_number_of_partitions_gives_the_same(spark, variants, monkeypatch, m):
    monkeypatch.setattr(simhash, "PARTITIONS", (m,))
    assert rows_of(simhash.near_copies(table(spark, variants)), "*") == own_near_copies(variants)


def test_no_and_one_fingerprint(spark):
    assert simhash.near_copies(table(spark, [])).count() == 0
    assert rows_of(simhash.near_copies(table(spark, [(None, None), (4, ""), (3, " \n")])), "*") == sorted([(None, "0" * 16, 3), (4, "0" * 16, 3), (3, "0" * 16, 3)], key=str)


def test_long_texts_are_hashed_in_pieces():
    r = random.Random(1)
    text = "".join(r.choice("aB \n\té") for _ in range(3000)).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(text, 1 << 20)))
    for piece in (1, 7, 500):
        assert np.concatenate(list(simhash.shingle_hashes(text, piece))).tolist() == whole.tolist()
    assert simhash.fingerprint(text) == own_fingerprint(text.decode())


def test_shares_find_every_near_pair():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    layout = simhash.grouped(np.zeros((64, 64)), 4)
    counts = [[np.bincount(simhash.taken(values, p).astype(int), minlength=1 << len(p)) for p in simhash.pieces_of(bits)] for bits in layout]
    plan = simhash.Plan(len(values), layout, counts)
    # Its own value of one partition is common, so it looks elsewhere, and further.
    plan.frequent[1] = simhash.taken(values[:1], layout[1]), np.array([10**7])
    shares = plan.shares(values)
    assert shares[0, 1] == 0 and (shares.sum(1) == simhash.TAU + 1).all() and sorted(b for bits in layout for b in bits) == list(range(64))
    for k, f in enumerate(values):
        other = f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        apart = [int(np.bitwise_count(simhash.taken(np.array([f ^ other]), bits))[0]) for bits in layout]
        assert any(a < u for a, u in zip(apart, shares[k]))


def test_dealt_shares_are_the_cheapest():
    import itertools

    costs = np.random.default_rng(3).random((20, 3, 4))
    shares, total = simhash.dealt_shares(costs)
    for k in range(20):
        ways = [w for w in itertools.product(range(5), repeat=3) if sum(w) == 4]
        best = min(sum(costs[k, i, u - 1] for i, u in enumerate(w) if u) for w in ways)
        assert abs(total[k] - best) < 1e-12 and abs(sum(costs[k, i, u - 1] for i, u in enumerate(shares[k]) if u) - best) < 1e-12


# 12


def own_runs(x):
    out = []
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            if x[i] == x[i + q]:
                j = i
                while j < len(x) - q and x[j] == x[j + q]:
                    j += 1
                n = j - i + q
                if n >= max(24, 3 * q) and not any(s <= i and i + n <= s + m and p < q for s, m, p in out):
                    out.append((i, n, q))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(r):
    n, kinds = r.randint(0, 400), r.choice([1, 2, 3, 5, 50])
    x = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n > 30 else 0):
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 3))
        for i in range(a, min(n, a + r.randint(3 * p, 6 * p + 30))):
            x[i] = x[a + (i - a) % p] if r.random() > 0.003 else 777
    return x


def test_runs_are_those_of_brute_force():
    r = random.Random(1)
    for _ in range(150):
        x = repeating(r)
        assert sorted(periods.runs_of(np.array(x, np.int64), len(x)), key=lambda r: (r[0], r[2])) == own_runs(x)


def test_transforms_give_exact_mismatches():
    rng = np.random.default_rng(0)
    for size in (2, 4, 16, 128):
        own = periods.Transform(size)
        a, b = (rng.integers(0, int(periods.PRIME), (3, size), dtype=np.uint64) for _ in range(2))
        assert (own.backward(own.forward(a)) == a).all()
        got = own.backward(own.forward(a) * own.forward(b) % periods.PRIME)
        want = [[sum(int(x[i]) * int(y[(k - i) % size]) for i in range(size)) % int(periods.PRIME) for k in range(size)] for x, y in zip(a, b)]
        assert got.tolist() == want
    x = np.concatenate([rng.integers(0, 3, 200), np.full(60, 9)]).astype(np.uint64)
    place, far = periods.zero_distances(x, np.arange(0, 160, 4), 4, 1)
    assert sorted(zip(place.tolist(), far.tolist())) == [(b, d) for b in range(0, 160, 4) for d in range(1, 8) if (x[b : b + 4] == x[b + d : b + d + 4]).all()]


def test_planted_and_judged_texts(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"v{r.randrange(60)}" for _ in range(r.randint(0, 300)))) for i in range(120)]
    rows += [(500 + i, "\t".join(map(str, repeating(r)))) for i in range(40)] + [(None, "a " * 50), (7, None), (8, "b\n" * 30), (8, "b\n" * 30), (9, ""), (1000, "long tale " * 9000)]
    want = []
    for d, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = own_runs(words) if n < 2000 else [(0, n, 2)]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()))
    out = periods.periodic(periods.planted(table(spark, rows)))
    got = out.select(*[c.split()[0] for c in periods.SCHEMA.split(", ")[:7]], F.sha2(F.col("collapsed").cast("binary"), 256))
    assert rows_of(got, "*") == sorted(want, key=str)
    assert periods.periodic(table(spark, [])).count() == 0


# 13


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def own_alignment(rows, paths):
    """Each text's result, from the libraries' ids of whole texts and all pairs of token ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    from quiltra.llm.tokens import byte_letters

    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    letters = {chr(c): b for b, c in byte_letters().items()}
    texts, times = [], collections.Counter()
    for d, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters.get(c, ord(c) & 255) for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            texts.append((d, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(i, ends_b.index(e)) for i, e in enumerate(ends_a) if e in set(ends_b)]
        times.update((a[i], b[j]) for i, j in links)
        texts.append((d, a, b, links, [(a[i], b[j]) for i, j in links]))
    best = collections.Counter()
    for (_, y), n in times.items():
        best[y] = max(best[y], n)
    out = []
    for d, a, b, links, ids in texts:
        said, i, j = [], 0, 0
        for x, y in links:
            said.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        sha = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(links), len(ids), sum(times[p] == best[p[1]] for p in ids), sum(times[p] for p in ids), sha))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    texts = ["hello world", "<|endoftext|> x <s>", "", "▁ marked ▁", None, " lead", "trail ", "a  b   c\n\nd \t e", " x　y z", "it's John's 123 4567", "日本語 テスト です", "x" * 3000, "\x00 a\x00b", "ok 👍🏽"]
    texts += ["".join(r.choice("abc  \n\té日👍'1.,▁") for _ in range(r.randint(1, 50))) for _ in range(150)] + ["many words of one text " * 4000]
    return [*enumerate(texts), (None, "null id"), (3, "again"), (3, "again")]


def test_alignment_is_that_of_whole_texts(spark, odd_texts, paths, monkeypatch):
    want = own_alignment(odd_texts, paths)
    assert rows_of(align.aligned(table(spark, odd_texts), *paths), "*") == want
    monkeypatch.setattr(align, "REMEMBERED", 50)  # several chunks
    assert rows_of(align.aligned(table(spark, odd_texts), *paths), "*") == want
    assert align.aligned(table(spark, []), *paths).count() == 0


def test_identity_map_holds_the_links_of_one_token_each(spark, odd_texts, paths):
    own = align.Vocabularies(*paths)
    assert all(own.bytes_a[i] == own.bytes_b[b] for i, b in enumerate(own.same.tolist()) if b >= 0)
    stored = align.chunks(table(spark, odd_texts), *paths)
    same, others = align.pair_counts(stored, *paths)
    assert not [r for r in others.collect() if own.same[r.a] == r.b]
    whole = align.identity_share(table(spark, odd_texts), *paths).first()
    assert whole.links == sum(r[4] for r in own_alignment(odd_texts, paths)) and 0 < whole.by_map < whole.links
