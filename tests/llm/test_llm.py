"""The corpus operators against brute force on small fixtures, with nulls, empty and long texts, repeats and odd columns."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltra.llm import common, decontaminate, media, near, pieces, pii, quality, sharding, substrings, suffixes, tokens

SCHEMA = "doc_id long, text string, n_chars long, bucket string, kind int"


def corpus():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = say(60)
    texts = [say(r.randint(1, 120)) for _ in range(30)] + [say(20) + " " + shared + "\n" + say(15) for _ in range(6)]
    texts += [texts[3]] * 4 + [shared, shared + " x", "", None, "a", "a\tb  c\n\nd", "word " * 300, "▁ marked ▁▁ spaces  ", say(4000)]
    long = texts[20].split()
    texts += [" ".join(long[:i] + ["changed"] + long[i + 1 :]) for i in (5, 50)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, 1, "x", 7) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {i * 3: t or "" for i, t in corpus()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_table_splits_like_python():
    texts = [b"one two", b"", b"  x\ty ", b"one", b"z" * 200]
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, s, e, before = common.word_table(data, cuts)
    for k, t in enumerate(texts):
        own = [data[a:b].tobytes() for a, b in zip(s[before[k] : before[k + 1]], e[before[k] : before[k + 1]])]
        assert own == t.split()
    assert h[0] == h[before[3]] and len(set(h.tolist())) == len(h) - 1


def test_word_table_in_pieces_is_that_of_the_whole():
    r = random.Random(2)
    texts = ["".join(r.choice("ab \n") for _ in range(r.randint(0, 400))).encode() for _ in range(30)] + [b"x" * 9000, b"", b" " * 300]
    data, cuts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = common.word_table(data, cuts)
    for piece in (1, 50, 3000):
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, common.word_table(data, cuts, piece)))


# 1


def test_blocks_round_trip_with_exceptions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, 30, n).astype(np.uint32)
        ids[::17] = rng.integers(0, 2**32, len(ids[::17]), dtype=np.uint64).astype(np.uint32)
        data = tokens.segment([1], [n], ids)
        assert tokens.read_segment(data)[2].tolist() == ids.tolist()
        for k in range(-(-n // tokens.BLOCK)):
            assert tokens.one_block(data, k).tolist() == ids[k * 128 : (k + 1) * 128].tolist()


def test_token_index_matches_the_library(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got, at = by_id(tokens.token_index(tokens.token_files(docs, path))), 0
    for doc in sorted(texts):
        ids = own.encode(texts[doc], add_special_tokens=False).ids + [0]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert tokens.token_index(tokens.token_files(empty(spark), path)).count() == 0


def test_rows_without_ids_come_last(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(None, "b c", 0, "", 0), (5, "five", 0, "", 0), (None, "a", 0, "", 0), (-2, None, 0, "", 0), (5, "also five", 0, "", 0), (None, None, 0, "", 0)], SCHEMA).repartition(4)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.token_index(tokens.token_files(df, path)).collect())
    assert [x[1] for x in got] == [-2, 5, 5, None, None, None] and [x[0] for x in got] == list(itertools.accumulate([0, *[x[2] for x in got[:-1]]]))


def test_encoder_is_the_library_on_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(21)
    planes = ["abcdefgh ", "it's we'll I'd they've 'S ", "0123456789 ", "\t\n\r \x0b\x0c\x85\xa0\u1680\u2003\u2028\u3000", "éñßÄöÜçłżאבגدж日本語한국", "\x00\x01\x1f\x7f", "👍🏽🇩🇪𝔘𝔫\U0001f9d1", ".,;:!?()[]{}<>|@#$%^&*-_=+/\\\"'`~"]
    texts = ["".join(r.choice(r.choice(planes)) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b " + t for t in texts[:50]]
    own, want = tokens.Encoder(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 100):
        for t, ids in zip(texts[at : at + 100], own.encode(texts[at : at + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == want.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_are_the_library_s_while_parts_are_forgotten(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 40)  # many generations
    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    letters = [*"abcdefghijklmnopqrstuvwxyzABC", *map(chr, range(0xAA, 0x590))]
    others = [*" " * 40, *".,;:!?\"'()[]{}|~`^_-+*/\\@#$%&<>=0123456789\n"]
    texts = ["".join(r.choices(letters + others * 12, k=r.randint(1, 60))) for _ in range(4000)]
    texts += [f" {c}b{c}{d}" for c in letters for d in ".'|\n"]
    own, want = tokens.Encoder(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at : at + 50], own.encode(texts[at : at + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == want.encode(t, add_special_tokens=False).ids, repr(t)


# 2


def repeated_bytes(texts):
    """For each text the mark of its bytes that lie in a repeated string, by brute force."""
    n, seen = suffixes.LENGTH, {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def test_bytes_of_repeated_strings_go(spark, docs, texts):
    data = {d: t.encode() for d, t in texts.items()}
    got = by_id(suffixes.deduplicated(docs))
    for (d, t), mark in zip(data.items(), repeated_bytes(data.values())):
        kept = bytes(b for b, m in zip(t, mark) if not m)
        assert (got[d].n_bytes, got[d].n_removed, bytes(got[d].kept)) == (len(t), int(mark.sum()), kept)
    assert suffixes.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("buckets, flush, most", [(1, 1 << 20, 8), (64, 3000, 64), (300, 1, 300), (90, 5000, 7)])
def test_repeats_over_many_tasks_and_ranges(spark, buckets, flush, most):
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abcde \n\x00") for _ in range(n))
    passage, inner = say(700), say(150)
    texts = [say(r.randint(0, 900)) for _ in range(40)]
    texts += [say(r.randint(0, 300)) + passage + say(r.randint(0, 300)) for _ in range(60)]  # one passage amid unlike text
    texts += [say(100) + passage[a : a + 230] + inner + passage[a + 230 :] for a in range(0, 300, 20)]
    texts += ["x" * 1000, "x" * 199, "x" * 200, "ab" * 300, "\x00" * 500]
    for _ in range(30):  # near copies
        t = list(texts[0] + passage[:300] + texts[1])
        t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    rows = [(None if i % 50 == 7 else i // 2, t, 0, "", 0) for i, t in enumerate(texts)] + [(0, texts[3], 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.deduplicated(df, buckets, flush, most).select("n_bytes", "n_removed", "kept").collect())
    data = [t.encode() for _, t, *_ in rows]
    want = sorted((len(t), int(m.sum()), bytes(np.frombuffer(t, np.uint8)[~m])) for t, m in zip(data, repeated_bytes(data)))
    assert got == want
    assert suffixes.deduplicated(df, buckets, flush).filter("doc_id is null").count() == sum(i is None for i, *_ in rows)


def test_long_texts_are_read_in_chunks(spark):
    r = random.Random(5)
    block = "".join(r.choice("abcdefgh") for _ in range(3000))
    long = "".join(r.choice("abcdefgh") for _ in range(suffixes.CHUNK - 1500)) + block + "".join(r.choice("abcdefgh") for _ in range(suffixes.CHUNK))
    got = by_id(suffixes.deduplicated(spark.createDataFrame([(1, long, 0, "", 0), (2, block, 0, "", 0)], SCHEMA)))
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, bytes(got[1].kept).decode()) == (3000, 1, 3000, long.replace(block, ""))


def test_multikey_order_is_that_of_bytes():
    r = random.Random(3)
    words = sorted((bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 40))) for _ in range(400)), key=lambda _: r.random()) + [b"same" * 8] * 5
    lengths = np.array([len(w) for w in words])
    order, differs = suffixes.multikey(np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.cumsum(lengths) - lengths, lengths)
    got = [words[i] for i in order]
    assert sorted(got) == sorted(words) and [w for w in got if 0 not in w] == sorted(w for w in words if 0 not in w)
    assert [d == -2 for d in differs[1:]] == [a == b for a, b in zip(got, got[1:])]


# 3

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            if kind == "ip" and max(map(int, s.split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_and_redaction(spark):
    rows = ["mail é.x a.b@c.example.com. b@d", "ip 1.2.3.4 256.1.1.1 001.02.3.4.5 1.2.3", "card 4111 1111 1111 1111 or 4111111111111112, 4040549990366437", "call +1 (017) 555-7713 now +12 3", "ñ 192.168.0.1 +44 20 7946 0958 x@y.zz", None, "", "9" * 5000, "a@" + "b." * 3000 + "c", "@" * 2000]
    df = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in enumerate(rows)], SCHEMA)
    found = pii.selected(df)
    got = by_id(pii.report(found))
    for i, t in enumerate(rows):
        assert got[i].base_sha256 == hashlib.sha256(base(t or "").encode()).hexdigest()
    out = by_id(pii.redacted(df))
    assert out[0].text == "mail é.x [EMAIL]. b@d" and out[4].text == "ñ [IP] [PHONE] [EMAIL]" and out[5].text is None and out[4].bucket == "s"
    assert pii.report(pii.selected(empty(spark))).count() == 0


def test_loose_spans_pass_by_merit(spark):
    r = random.Random(6)
    group = lambda: f"{r.randrange(4096, 65536):x}"
    rows = []
    for i in range(400):
        rows += [f"{i} host fe80:{':'.join(group() for _ in range(7))} up", f"{i} ask jo{i} (at) site{i % 50} (dot) org today", f"{i} run {':'.join(str(r.randrange(10, 60)) for _ in range(8))} end", f"{i} meet @ noon. Then go", f"{i} ab{i}@site.org"]
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(rows)], SCHEMA)
    out = by_id(pii.redacted(df))
    for i in range(0, len(rows), 5):
        k = i // 5
        assert (out[i].text, out[i + 1].text, out[i + 2].text, out[i + 3].text) == (f"{k} host [IP] up", f"{k} ask [EMAIL] today", rows[i + 2], rows[i + 3])
        assert out[i + 4].text == f"{k} [EMAIL]"


def test_few_planted_spans_are_added_and_look_alikes_are_not(spark):
    r = random.Random(12)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    plain = [" ".join(some("abcdefghij", r.randint(2, 30)) for _ in range(40)) + f" x{i}@site.org 10.0.0.{i % 200}" for i in range(300)]
    secret = [f'{some("abc", 5)} token = "{some("0123456789abcdef", 36)}" then' for _ in range(12)]
    alike = [f'{some("abc", 5)} total = "{some("abcdefghijklmnop", 36)}" then' for _ in range(12)]
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(plain + secret + alike)], SCHEMA)
    got = by_id(pii.report(pii.selected(df)))
    for i, t in enumerate(plain + secret + alike):
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest()
        want = [x for x in base(t).split(",") if x]
        if i in range(300, 312):
            at = t.index('"') + 1
            want.append(f"secret:{at}:{at + 36}")
        assert got[i].spans == ",".join(want)


def test_prefilters_and_caps_lose_nothing(spark):
    rows = ["code ABCD_1234_EFGH_5678_IJKL end", "code ABCD_1234_EFGH_5678_IJKL end a1", "ask joe@site (dot) org", "token = " + "a1" * 150, "x " + "Zz9" * 400 + " y", "mail " + "n" * 90 + "[at]host[dot]org"]
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: {(pii.KINDS[x.kind], x.start, x.end) for x in r.loose} for r in pii.proposed(df).collect()}
    assert ("secret", 5, 29) in got[0] and got[0] == got[1] and ("email", 4, 22) in got[2]
    assert ("secret", 8, 308) in got[3] and ("secret", 2, 1202) in got[4] and ("email", 5, 111) in got[5]


def test_recall_of_planted_secrets_of_all_lengths(spark):
    """Secrets after a cue word, and of the same make without one, among long words of letters; most of them are found, no word is."""
    r = random.Random(31)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    rows, want = [], {}
    for i in range(600):
        words = [some("abcdefghijklmno", r.randint(2, 34)) for _ in range(40)]
        if i % 3 == 0:
            secret = some("0123456789abcdef", r.choice([24, 32, 40, 64, 128, 300, 700]))
            lead = r.choice(["token = ", "api_key: ", "password="]) if i % 30 else "value = "
            words[20] = lead + secret
            want[i] = (i % 30 == 0, " ".join(words[:20] + [lead]).count("") - 1, len(secret))
        rows.append((i, " ".join(words), 0, "", 0))
    got = {x.doc_id: {(s.start, s.end) for s in x.spans} for x in pii.selected(spark.createDataFrame(rows, SCHEMA)).collect()}
    hits = {i: (at, at + n) in got[i] for i, (_, at, n) in want.items()}
    assert np.mean(list(hits.values())) >= 0.9 and np.mean([hits[i] for i, w in want.items() if w[0]]) >= 0.8
    assert not any(got[i] for i in range(600) if i not in want)


def test_boosted_trees_tell_counted_rows_apart():
    from pyspark.sql import Row

    names = list(pii.CUTS)
    row = lambda good, n, **f: {"f": Row(**{k: f.get(k, 0) for k in names}), "kind": 4, "good": good, "open": True, "held": False, "n": n}
    rows = [row(True, 30, digits=12, assigned=1), row(False, 40, digits=12, assigned=0), row(False, 50, digits=2, assigned=1)]
    trees = pii.boosted(rows)
    m = [pii.margin(trees, x["f"].asDict()) for x in rows]
    assert m[0] > 2 and m[1] < -2 and m[2] < -2


def test_tied_rows_count_before_the_threshold():
    from pyspark.sql import Row

    seen = lambda good, n: {"f": Row(generator=7), "kind": 3, "good": good, "open": True, "held": True, "n": n}
    trees = [("generator", 0, 0.0, 1.0)]
    assert pii.thresholds([seen(True, 90), seen(False, 10)], trees) == {}
    assert pii.thresholds([seen(True, 99), seen(False, 1)], trees) == {3: 1.0}


# 4


def test_pieces_decode_to_the_text(spark, docs, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain, dropped, sp = pieces.Pieces(path, 0.0), pieces.Pieces(path, 0.3), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts.values():
        for v in (0, 1):
            assert dropped.decode(dropped.encode(t, v)).decode() == t
        if "▁" not in t and "  " not in t and t == t.strip():
            assert plain.encode(t).tolist() == sp.encode(t)
    assert dropped.encode(texts[0], 0).tolist() != dropped.encode(texts[0], 1).tolist()
    got = by_id(pieces.round_trip(docs))
    assert all(got[d].text_crc32 == zlib.crc32(t.encode()) for d, t in texts.items())
    assert pieces.round_trip(empty(spark)).count() == 0


def test_rows_of_a_matrix_merge_like_a_heap():
    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.2)
    r = random.Random(7)
    words = ["".join(r.choice("aeinrstlhdé") for _ in range(r.randint(1, 60))) for _ in range(300)] + ["internationalisation", "é" * 30, "日本語 x", "▁▁a", "\x00"]
    for text in words:
        symbols = p.of_character[np.array([ord(c) for c in " " + text])].tolist()
        root = common.mix(np.array([9], np.uint64) + np.uint64(p.seed * pieces.CHUNK_STEP & pieces.M64))
        if " " in text:
            continue
        key = int(common.mix(root + np.array([1], np.uint64) * np.uint64(pieces.CHUNK_STEP))[0])
        ids = []
        for x in p.merged(symbols, key):
            ids += [x] if x < p.size else p.byte[list(chr(x - p.size).encode())].tolist()
        assert p.encode(text, 9).tolist() == ids


def test_each_occurrence_is_drawn_anew(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = pieces.Pieces(path, 0.1)
    word = " internationalisation"
    ids = p.encode("\n".join([word] * 400), 5)
    splits = bytes(ids.astype("<i4")).split(p.encode("\n", 5)[-1:].astype("<i4").tobytes())
    assert len(set(splits)) > 5
    # What is remembered doesn't change the draws, and about a tenth of the candidates is skipped.
    assert p.encode("\n".join([word] * 400), 5).tolist() == ids.tolist() == pieces.Pieces(path, 0.1).encode("\n".join([word] * 400), 5).tolist()
    bits = p.draws(np.arange(20_000, dtype=np.uint64) * np.uint64(77), 16)
    assert abs(np.unpackbits(bits.view(np.uint8)).mean() - 0.1) < 0.005
    rows = spark.createDataFrame([(i, word[1:]) for i in range(300)], "doc_id long, text string")
    got = pieces.encoded(rows, path)
    assert got.select("ids").distinct().count() > 5 and got.select("variant").distinct().count() == 300


# 5


@pytest.mark.parametrize("lacing", list(media.LACING))
def test_matroska_round_trip(lacing):
    payload = bytes(random.Random(1).randbytes(media.PACKET * 600))
    data = media.mux(payload, lacing)
    table, cues = media.packets(data)
    assert media.payload_of(data, table) == payload and len(table) == 600
    assert [t for _, t, _, _ in table] == [i * media.PACKET_MS for i in range(600)]
    for time, at in cues:
        assert int.from_bytes(data[at : at + 4], "big") == media.CLUSTER


def test_uneven_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 3, b"c" * 255, b"d" * 40]
    for lacing in ("xiph", "ebml"):
        body = b"\x81" + struct.pack(">hB", 5, media.LACING[lacing] << 1) + media.laced(frames, lacing)
        assert [body[a : a + n] for a, n in media.frames(body, 0, len(body))[2]] == frames
    cluster = media.element(media.CLUSTER, media.number(media.CLUSTER_TIME, 7) + media.element(media.SIMPLE_BLOCK, b"\x81\x00\x01\x80" + b"xyz"))
    data = media.HEAD + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    assert media.packets(data)[0] == [(1, 8, len(data) - 3, 3)]


def test_malformed_files_have_a_result(spark):
    good = media.mux(media.padded(b"text"))
    rows = [(1, 4, good), (2, 4, good[:-3]), (3, 4, b"no media"), (4, 4, b""), (5, 4, None), (6, 4, good[:40])]
    df = spark.createDataFrame([(i, n, None if d is None else bytearray(d)) for i, n, d in rows], media.MEDIA)
    got = by_id(media.features(df))
    assert got[1].feature != "malformed" and got[1].payload_bytes == 576
    assert all((got[i].feature, got[i].payload_bytes, got[i].tail_crc32) == ("malformed", 0, 0) for i in (2, 3, 4, 5, 6))
    assert media.packet_table(df).filter("doc_id > 1").count() == 0


def test_media_of_documents(spark, docs, texts):
    got = by_id(media.features(media.to_media(docs)))
    for d, t in texts.items():
        p = media.padded(t.encode())
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        x = [b - 128 for b in p]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        mean, rms = sum(x) / len(x), (sum(v * v for v in x) / len(x)) ** 0.5
        assert got[d].feature == f"mean={mean:.4f};rms={rms:.4f};turns={turns};ms={len(p) // media.PACKET * media.PACKET_MS}"
    stored = {r.doc_id: bytes(r.media) for r in media.to_media(docs).collect()}
    for d, data in stored.items():
        assert (got[d].media_bytes, got[d].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        # The file's outermost elements, by their own ids and sizes, fill it: the header and the segment.
        at, ids = 0, []
        while at < len(data):
            width = 9 - data[at].bit_length()
            ids.append(int.from_bytes(data[at : at + width], "big"))
            at += width
            width = 9 - data[at].bit_length()
            size = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
            at += width + size
        assert at == len(data) and ids == [0x1A45DFA3, 0x18538067]
    assert media.packet_table(media.to_media(docs)).filter("size <> 576").count() == 0
    assert media.features(media.to_media(empty(spark))).count() == 0


# 6


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "hot text " * 5 if i % 3 == 0 else f"text {i} " * (i % 11), 0, "", 0) for i in range(6000)] + [(1, None, 0, "", 0), (1, None, 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shards(df, 8).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shards(empty(spark), 8).count() == 0


def test_sharding_query_follows_its_contract(spark, tmp_path):
    """Sizes, checksums, law and slots by brute force; equal texts side by side."""
    r = random.Random(3)
    rows = [(i, None if i % 97 == 0 else "é" * r.randint(0, 40) + str(i % 50 if i % 3 else "same")) for i in range(3000)]
    spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(sharding.op6_sharding(spark, str(tmp_path)))
    assert sorted(got) == [i for i, _ in rows]
    total = 0
    for i, t in rows:
        data = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        total += len(data) + 16
    shards = {}
    for x in got.values():
        shards.setdefault(x.shard, []).append(x)
    assert sorted(shards) == list(range(40))
    most = max(x["size"] for x in got.values())
    for own in shards.values():
        assert sorted(x.slot for x in own) == list(range(len(own))) and abs(sum(x["size"] for x in own) - total / 40) <= most


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# 7


def test_decontamination_matches_windows(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (20, 13, 5, 1, 30)] + ["...", None]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(20)]
    texts += [f"Before {items[0].upper()}! after", items[1] + "\n" + items[1], items[2] + " zz " + items[4], None, ""]
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(i + 8, t) for i, t in enumerate(items)], "item_id long, text string")
    for block in (1 << 20, 200):  # one automaton, and several
        got = by_id(decontaminate.report(decontaminate.contamination(df, bench, block_bytes=block)))
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
            hit, found = set(), set()
            for k, item in enumerate(items):
                v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), item or ""))
                size = min(13, len(v))
                for a in range(len(v) - size + 1) if v else ():
                    for b in range(len(w) - size + 1):
                        if w[b : b + size] == v[a : a + size]:
                            hit.update(range(b, b + size))
                            found.add(str(k + 8))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_hits_are_cut_out(spark):
    df = spark.createDataFrame([(0, "keep this Secret answer, and that", 0, "", 0)], SCHEMA)
    bench = spark.createDataFrame([(1, "secret answer")], "item_id long, text string")
    assert decontaminate.without_hits(decontaminate.contamination(df, bench)).first().text == "keep this  , and that"


# 8


def test_difference_cover_is_one():
    assert substrings.is_cover() and substrings.ANCHOR + substrings.PERIOD - 1 == substrings.WINDOW


def test_words_of_later_windows_go(spark, docs, texts):
    first, gone = {}, {d: set() for d in texts}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            key = tuple(words[d][i : i + 20])
            if key in first:
                gone[d].update(range(i, i + 20))
            first.setdefault(key, (d, i))
    got = by_id(substrings.deduplicated(docs))
    for d, w in words.items():
        assert (got[d].n_words, got[d].n_removed) == (len(w), len(gone[d]))
        assert got[d].text == " ".join(x for i, x in enumerate(w) if i not in gone[d])
    assert substrings.deduplicated(empty(spark)).count() == 0


# 9


def shingle_sets(texts):
    out = {}
    for d, t in texts.items():
        w = t.split()
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def test_join_matches_all_pairs(spark, docs, texts):
    sets = shingle_sets(texts)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {d: set() for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            if sets[a] != sets[b]:
                links[a].add(sets[b])
                links[b].add(sets[a])
    got = by_id(near.join(docs))
    assert {d: got[d].class_id for d in sets} == {d: find(d) for d in sets}
    assert {d: got[d].n_links for d in sets} == {d: len(x) for d, x in links.items()}
    assert near.join(empty(spark)).count() == 0


def test_bands_reach_the_recall():
    b, r = near.bands_for(0.8, 0.9999, 96)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 96


def test_chained_clusters_are_compared_by_bucket(spark):
    """Texts that share half of their words chain into one cluster; its links are those of all pairs."""
    words = [f"w{i}" for i in range(1500)]
    texts = {}
    for i in range(450):  # each text slides along the words, so that neighbours are near and distant ones unlike
        texts[i] = " ".join(words[3 * i : 3 * i + 100] + [f"own{i}"])
        if i % 3 == 0:
            texts[1000 + i] = texts[i] + " more"
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in texts.items()], SCHEMA)
    found = near.units(near.signatures(common.texts(df)).select("doc_id", "bands"))
    assert found.filter("band >= 0").count() > 0
    sets = shingle_sets(texts)
    want = {a: sum(sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    got = by_id(near.join(df))
    assert {d: x.n_links for d, x in got.items()} == want


def test_join_tells_rows_of_equal_or_null_ids_apart(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, say(1)), (5, say(2)), (5, say(2)), (5, say(3)), (None, say(2)), (3, say(3)), (None, say(4)), (9, None)]
    got = near.join(spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], SCHEMA)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted([(None, None), (5, 5), (5, 5), (5, 3), (None, 5), (3, 3), (None, None), (9, 9)], key=key)


def test_large_groups_are_compared_in_blocks(spark):
    base_words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base_words[:i] + ["x"] + base_words[i + 1 :]), 0, "", 0) for i in range(200)] + [(i + 200, " ".join(base_words + [f"end{i}"]), 0, "", 0) for i in range(120)]
    got = near.join(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(got.class_id) == {0} and (got.n_links == 319).all()


# 10


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(truth, rng.random(4000) < 0.9, 0), np.where(truth, rng.random(4000) < 0.6, 0), np.where(truth, rng.random(4000) < 0.5, 0)], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, chance, prior = quality.accuracies(patterns, counts.astype(float))
    assert abs(chance[0, 1, 1] - 0.9) < 0.08 and chance[0, 1, 1] > chance[1, 1, 1] > chance[2, 1, 1] and abs(prior - 0.2) < 0.05
    assert post[(patterns == 1).any(1)].min() > 0.5 > post[(patterns == 0).all(1)].max()


def test_em_on_counted_patterns_is_em_on_rows():
    """A plain EM over single rows, without counts, gives the same posteriors."""
    r = np.random.default_rng(2)
    rows = r.choice([-1, 0, 1], (500, 4), p=[0.2, 0.7, 0.1])
    patterns, at, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post, chance, prior = quality.accuracies(patterns, counts.astype(float), rounds=30)
    said = (rows >= 0).sum(1)
    bad = (rows == 1).sum(1)
    p = [min(0.99, max(0.01, 0.5 + b / max(1, n) / 2 if b else 0.0)) for b, n in zip(bad, said)]
    for _ in range(30):
        share = min(0.5, max(1e-4, sum(p) / len(p)))
        odds = np.full(len(rows), np.log(share / (1 - share)))
        for k in range(4):
            for v in (-1, 0, 1):
                is_v = rows[:, k] == v
                n1, n0 = sum(x for x, y in zip(p, is_v) if y) + 1, sum(1 - x for x, y in zip(p, is_v) if y) + 1
                n1, n0 = n1 + quality.BELIEF * (v == 1), n0 + quality.BELIEF * (v == 0)
                t1, t0 = sum(p) + 3 + quality.BELIEF, len(p) - sum(p) + 3 + quality.BELIEF
                odds[is_v] += np.log(n1 / t1) - np.log(n0 / t0)
        new = list(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        moved = max(abs(a - b) for a, b in zip(p, new))
        if moved < 1e-6:
            break
        p = new
    assert np.abs(post[at.ravel()] - np.array(p)).max() < 1e-6


def test_em_finds_unequal_false_rejects():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.25
    hits, false = (0.9, 0.7, 0.8), (0.01, 0.12, 0.05)
    votes = np.stack([np.where(truth, rng.random(20_000) < h, rng.random(20_000) < f) for h, f in zip(hits, false)], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, chance, prior = quality.accuracies(patterns, counts.astype(float), rounds=400)
    assert all(abs(chance[k, 0, 1] - false[k]) < 0.03 and abs(chance[k, 1, 1] - hits[k]) < 0.05 for k in range(3)) and abs(prior - 0.25) < 0.03


def test_scorer_is_a_logistic_fit_of_its_features():
    """At the weights that it ends with, a plain gradient of the weighted log loss is near 0."""
    r = np.random.default_rng(4)
    targets = (r.random(400) < 0.3).astype(float)
    rows = [np.flatnonzero(r.random(30) < np.where(np.arange(30) < 6, 0.5 if t else 0.02, 0.3)) for t in targets]
    rows = [x.astype(np.int64) for x in rows]
    weights = np.where(targets > 0.5, 1.0, 3.0)
    w, b, cut = quality.train(rows, targets, weights)
    used = np.flatnonzero(w)
    assert set(used) <= set(range(6)) and len(used) == 6
    score = np.array([w[x].sum() + b for x in rows])
    gap = (1 / (1 + np.exp(-score)) - targets) * weights / weights.sum()
    assert abs(gap.sum()) < 1e-2 and all(abs(sum(g for g, x in zip(gap, rows) if f in x)) < 1e-2 for f in used)
    assert (score > cut)[targets > 0.5].mean() > 0.9 and (score > cut)[targets < 0.5].mean() < 0.1


def test_classifier_on_held_out_rows(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, bad = [], set()
    for i in range(600):
        w = [r.choice(vocab) for _ in range(r.randint(20, 80))]
        if i % 6 == 0:
            w = [x + r.choice(["***", "&&&"]) for x in w]
        elif i % 6 == 1:
            w[3], w[9] = r.choice([("zumo", "kilap"), ("kilap", "zumo"), ("zumo", "vertoh")])
        if i % 6 < 2:
            bad.add(i)
        rows.append((i, " ".join(w), 0, "", 0))
    rows += [(600, None, 0, "", 0), (601, "", 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(300)], "doc_id long, toxic int")
    got = by_id(quality.scored(df, labels, train_rows=300))
    wrong = sum(got[i].rejected != (i in bad) for i in range(300, 600))  # not those that the lexicon has seen
    assert wrong <= 6 and not any(got[i].rejected for i in (600, 601))
    assert not any(r.rejected for r in quality.scored(df).collect() if r.doc_id % 6 == 1)  # nothing says so without labels
    assert quality.accepted(df, labels).columns == df.columns
    assert quality.scored(empty(spark)).count() == 0


def test_sample_is_of_distinct_texts_with_their_weights(spark, monkeypatch):
    rows = [(i, f"plain words number {i} of a clean text", 0, "", 0) for i in range(1500)] + [(2000 + i, f"bad*** text%%% says{i}*** such&&& things***", 0, "", 0) for i in range(60)]
    rows += [(3000 + i, "hot*** text%%% is*** one&&& again***", 0, "", 0) for i in range(700)]
    seen = {}
    real = quality.train

    def spy(rows, targets, weights):
        seen.update(rows=rows, targets=targets, weights=weights)
        return real(rows, targets, weights)

    monkeypatch.setattr(quality, "train", spy)
    got = by_id(quality.scored(spark.createDataFrame(rows, SCHEMA), train_rows=300))
    bad = seen["targets"] >= 0.5
    assert len({r.tobytes() for r in seen["rows"]}) == len(seen["rows"]) < 250 and bad.sum() == 61
    assert abs(seen["weights"][~bad].sum() - 1500) < 400 and seen["weights"][bad].sum() == 61
    assert all(got[i].rejected == (i >= 2000) for i in got)


# pipeline


def test_stages_keep_rows_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, say(1)), (5, say(2)), (5, say(2)), (5, say(3)), (None, say(2)), (3, say(3)), (None, say(4)), (None, say(4))]
    df = spark.createDataFrame([(i, t, 0, "", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    out = corpus_pipeline.near_copies_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("None", say(1)), ("5", say(2)), ("3", say(3)), ("None", say(4))])
    spark.createDataFrame([(1, say(9))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, say(9)), (None, say(1)), (7, say(9)), (7, say(2))]
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], SCHEMA)
    got = corpus_pipeline.decontamination_stage(spark, df, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", say(1)), ("7", say(2))])


def odd_tables(spark, folder):
    """Documents with nulls, empty, repeated and long rows and a clashing column, and the tables that stages read."""
    say = lambda k, n=60: " ".join(f"word{k}x{i}" for i in range(n))
    texts = [say(k) for k in range(30)] + [say(3), say(3) + " more", None, "", "short", say(99, 5000), say(5) + " mail me@site.org", "bad*** text%%% is*** one&&& again*** " * 10]
    rows = [(i if i % 9 else None, t, len(t or ""), "x", 7) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    spark.createDataFrame([(1, say(99, 5000)[:400]), (2, say(7))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _key string, cluster int")


def test_every_stage_handles_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = odd_tables(spark, str(tmp_path))
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        left = out.count()
        assert {"quality": left >= count - 3, "near_copies": left == count - 5, "decontamination": left == count - 1, "pii": left == count}[name], (name, left, count)
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.pii_stage(spark, docs, str(tmp_path)).filter("text like '%[EMAIL]%'").count() == 1
    got = corpus_pipeline.pieces_stage(spark, docs, str(tmp_path))
    assert got.count() == count and got.agg(F.sum("n_bytes")).first()[0] == docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages on clean and planted rows: what is left, and that its pieces decode to the redacted text."""
    import corpus_pipeline

    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 9))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = say(30)
    clean = [say(r.randint(40, 120)) for _ in range(120)]
    texts = dict(enumerate(clean))
    texts |= {200 + i: texts[i] for i in range(10)}  # exact copies
    texts |= {300 + i: texts[i + 20] + " tail" for i in range(10)}  # near copies
    texts |= {400 + i: say(40) + " " + item + " " + say(20) for i in range(5)}  # benchmark passages
    texts |= {500 + i: say(30) + f" mail a{i}@b.org or 10.1.2.{i} now" for i in range(5)}
    texts |= {600 + i: " ".join(w + "***" for w in say(60).split()) for i in range(30)}  # rejected
    spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sets = shingle_sets({i: t for i, t in texts.items() if i < 600})
    left = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in left):
            left.append(i)
    left = [i for i in left if not 400 <= i < 410]
    want = {}
    for i in left:
        t = re.sub(r"[a-z0-9]+@b\.org", "[EMAIL]", re.sub(r"10\.1\.2\.[0-9]", "[IP]", texts[i]))
        want[i] = (len(t.encode()), zlib.crc32(t.encode()))
    got = {x.doc_id: (x.n_bytes, x.text_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_near_copies_recall_against_all_pairs(spark):
    """Queries are the rows with doc_id divisible by 100, against all rows of a driver table."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no driver tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text or "" for x in docs.select("doc_id", "text").collect()}
    sets = shingle_sets(texts)
    got = by_id(near.join(docs))
    pairs = found = 0
    for a in (d for d in sets if d % 100 == 0 and sets[d]):
        for b in sets:
            if b != a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += 1
                found += got[a].class_id == got[b].class_id
    assert found >= 0.9 * pairs


def test_quality_training_takes_little_memory_beside_its_sample():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 1 << quality.FEATURE_BITS, 300)).astype(np.int32) for _ in range(400)]
    rows = [np.union1d(r, [7, 9]).astype(np.int32) if i % 2 else r for i, r in enumerate(rows)]
    tracemalloc.start()
    w, b, cut = quality.train(rows, np.arange(400) % 2.0, np.ones(400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(np.flatnonzero(w)) == [7, 9] and b < cut < w[7] + w[9] + b
    assert peak < 3 * w.nbytes
