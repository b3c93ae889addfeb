"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select, all in SQL expressions.

1. Generators are regular expressions. The four strict ones (email, ip, card, phone) give the base spans: leftmost,
   non-overlapping matches of a kind that pass its check. Loose ones (spelled-out mail addresses, IPv6, cards and
   phones with other separators, assigned secrets, any long run of key characters) have high recall and may overlap
   the strict ones and each other.
2. Each proposed span has a few small features of its format and its neighbouring characters, as SQL expressions.
3. Spans of all documents are counted by (features, outcome, fold). All features are bucketed, so this table is bounded
   by the product of their ranges at any size. The outcome is weak: base spans are good, strict ones that fail are bad,
   and a loose span is good if it is vouched for by what the trees don't see: a cue word of its kind in the text before it,
   or a strict generator that matches it whole once its marks are written out. Not every good span has a cue word, so the
   shares are lower bounds; a span without one is taken if spans that look like it are vouched for elsewhere.
4. Boosted trees of depth two are fitted to the table of counts, without one fold of the documents; that fold gives, for
   each kind, the lowest score from which the share of good spans is at least PRECISION. It counts the loose spans that
   can be added, those that meet no base span. The share of a kind is drawn towards that of all kinds, and theirs towards
   what the trees say themselves, by PRIOR spans each: so a kind with few held-out spans, or none, is judged alike.
5. The trees become CASE expressions. Base spans stay; a loose span joins them if its score reaches its kind's threshold
   and no selected span of its kind overlaps it.

The strict patterns are written with possessive repeats. These match the same strings as the plain ones, since what
follows a repeat can't begin with what it repeats, and they neither recurse nor backtrack on long runs.

Defined results: null and empty texts have no spans; equal texts get equal spans; places count code points; an empty
table trains nothing and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
PRECISION = 0.95
#: The weight of what is known beforehand, in held-out spans.
PRIOR = 10
TREES, RATE = 40, 0.3
#: Characters before a span in which cue words count.
CONTEXT = 24

# The strict patterns, by kind.
STRICT = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a strict pattern to match; spares most texts the search.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
# The text that a loose pattern needs is a part of every match of it, so no match is lost. Repeats are open and possessive.
LOOSE = [
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,}+\s?(?:\(at\)|\[at\]|@)\s?[a-z0-9-]{2,}+\s?(?:\(dot\)|\[dot\]|\.)\s?[a-z]{2,}+\b", r"(?i)\(at\)|\[at\]|@"),
    ("ip", r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?(?![0-9a-f:])", r"::"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])", r"[0-9]{4}[ ./_-]{1,2}[0-9]{4}[ ./_-]"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("secret", r"(?i)(?<=(?:token|secret|password|passwd|pwd|key|bearer)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[a-z0-9+/_.~-]{8,}+", r"[nNtTdDyYrR][\"']?\s{0,2}[=:]"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"),
]
#: Cue words of a kind in the CONTEXT before a span.
CUES_OF = {"email": r"(?i)\b(?:e-?mail|mail|contact|write)\b", "ip": r"(?i)\b(?:ip|ipv6|host|server|address)\b", "card": r"(?i)\b(?:card|visa|account|pay)\b", "phone": r"(?i)\b(?:call|tel|phone|fax|mobile|contact)\b", "secret": r"(?i)(?:token|secret|password|passwd|pwd|key|bearer)[\"']?\s{0,2}[=:]"}
SPAN = "array<struct<kind:int,start:int,end:int,s:string>>"
#: Features of a span with the cuts that trees may use.
CUTS = {"generator": range(12), "mixed": [1], "hexadecimal": [1], "assigned": [1], "digits": [1, 4, 8, 9, 10, 12, 13, 15, 16, 19], "luhn": [1], "octets": [1], "separators": [1, 2, 3, 4], "plus": [1], "left_word": [1], "right_word": [1], "spelled": [1], "length": [8, 12, 16, 20, 32]}


def places(pattern: str, kind: int, needs: str) -> Column:
    """All leftmost, non-overlapping matches with their places: lengths of the parts between them, summed up."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    parts = F.split("text", pattern, -1)
    add = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["s"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["s"])).alias("end"), x["s"].alias("s")))).alias("out"),
    )
    pairs = F.zip_with(found, parts, lambda s, gap: F.struct(F.length(gap).alias("gap"), s.alias("s")))
    spans = F.aggregate(F.filter(pairs, lambda x: x["s"].isNotNull()), F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")), add, lambda acc: acc["out"])
    return F.when(F.rlike("text", F.lit(needs)), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass Luhn's check."""
    d = F.split(F.reverse(digits(s)), "")
    values = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(s: Column) -> Column:
    """Whether s is four numbers of at most 255 with dots between."""
    return F.coalesce(F.rlike(s, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}(?<!\.)$")), F.lit(False))


def passes(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    return {"email": F.lit(True), "ip": octets(s), "card": n.between(13, 19) & luhn(s), "phone": n.between(9, 15)}[kind]


def checked(kind: str, wanted: bool):
    return lambda x: passes(kind, x["s"]) if wanted else ~passes(kind, x["s"])


def tagged(generator: int):
    return lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), F.lit(generator).alias("generator"))


def of_kind(kind: int):
    return lambda x: x["kind"] == kind


def proposed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row, base, failed, loose): spans that pass, strict ones that don't, and those of loose generators."""
    out = common.rows(docs)
    for i, kind in enumerate(BASE):
        out = out.withColumn(f"_{kind}", places(STRICT[kind], i, NEEDS[kind]))
    good = [F.filter(f"_{k}", checked(k, True)) for k in BASE]
    bad = [F.filter(f"_{k}", checked(k, False)) for k in BASE if k != "email"]
    loose = [places(pattern, KINDS.index(kind), needs) for kind, pattern, needs in LOOSE]
    out = out.withColumns({"base": F.concat(*good), "failed": F.concat(*bad)} | {f"_loose{i}": x for i, x in enumerate(loose)})
    loose = F.concat(*[F.transform(f"_loose{i}", tagged(len(BASE) + i)) for i in range(len(LOOSE))])
    return out.select("doc_id", "text", "_row", "base", "failed", loose.alias("loose"))


def meets(x: Column, spans: Column) -> Column:
    """Whether a span of x's kind among spans overlaps x."""
    return F.exists(spans, lambda y: (y["kind"] == x["kind"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]))


def before(x: Column) -> Column:
    """The CONTEXT characters before span x in column text."""
    return F.substring(F.col("text"), F.greatest(F.lit(1), x["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), x["start"]))


def cued(x: Column) -> Column:
    """Whether a cue word of the span's kind stands before it."""
    out = F.lit(False)
    for i, kind in enumerate(KINDS):
        out = F.when(x["kind"] == i, F.rlike(before(x), F.lit(CUES_OF[kind]))).otherwise(out)
    return out


def vouched(x: Column) -> Column:
    """The weak outcome of a loose span: a cue word, or a strict generator of its kind that takes it whole when its marks are
    written out; not inside a word."""
    marks = F.regexp_replace(F.regexp_replace(x["s"], r"(?i)\s?[\[(]at[\])]\s?", "@"), r"(?i)\s?[\[(]dot[\])]\s?", ".")
    plain = {"email": marks, "card": F.regexp_replace(x["s"], r"[ ./_-]+", " ")}
    agreed = F.lit(False)
    for kind, s in plain.items():
        agreed = F.when(x["kind"] == KINDS.index(kind), F.rlike(s, F.lit(f"^(?:{STRICT[kind]})$")) & passes(kind, s)).otherwise(agreed)
    right = F.substring(F.col("text"), x["end"] + 1, F.lit(1))
    return F.coalesce((agreed | cued(x)) & ~F.rlike(before(x), F.lit(r"[\p{L}\p{N}]$")) & ~F.rlike(right, F.lit(r"[\p{L}\p{N}]")), F.lit(False))


def described(x: Column, generator: Column) -> Column:
    """The features of span x in column text."""
    s = x["s"]
    left, right = before(x), F.substring(F.col("text"), x["end"] + 1, F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        generator.alias("generator"), F.least(F.length(digits(s)), F.lit(20)).alias("digits"), flag(luhn(s)).alias("luhn"), flag(octets(s)).alias("octets"),
        F.least(F.regexp_count(s, F.lit(r"[ ./_()\[\]:-]+")), F.lit(5)).alias("separators"), flag(s.startswith("+")).alias("plus"),
        flag(F.rlike(left, F.lit(r"[\p{L}\p{N}]$"))).alias("left_word"), flag(F.rlike(right, F.lit(r"[\p{L}\p{N}]"))).alias("right_word"), flag(F.rlike(s, F.lit(r"(?i)[\[(](?:at|dot)[\])]"))).alias("spelled"), F.least(F.floor(F.length(s) / 4) * 4, F.lit(64)).cast("int").alias("length"),
        flag(F.rlike(s, F.lit(r"[0-9]")) & F.rlike(s, F.lit(r"[A-Za-z]"))).alias("mixed"), flag(F.rlike(s, F.lit(r"(?i)^[0-9a-f]+$"))).alias("hexadecimal"), flag(F.rlike(left, F.lit(r"[=:]\s{0,2}[\"']?$"))).alias("assigned"),
    )


def counts(spans: DataFrame) -> list:
    """Rows (features, kind, good, open, held, n) over all proposed spans."""
    as_seen = lambda x, generator, good, open_: F.struct(described(x, generator).alias("f"), x["kind"].alias("kind"), good.alias("good"), open_.alias("open"))
    seen = F.concat(
        F.transform("base", lambda x: as_seen(x, x["kind"], F.lit(True), F.lit(False))),
        F.transform("failed", lambda x: as_seen(x, x["kind"], F.lit(False), F.lit(False))),
        F.transform("loose", lambda x: as_seen(x, x["generator"], vouched(x), ~meets(x, F.col("base")))),
    )
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    rows = spans.filter("size(base) + size(failed) + size(loose) > 0").select(held.alias("held"), F.explode(seen).alias("x"))
    return rows.groupBy("x.f", "x.kind", "x.good", "x.open", "held").agg(F.count("*").alias("n")).collect()


def boosted(rows: list) -> list[tuple]:
    """Trees (feature, cut, left, right), each side a leaf's value or (feature, cut, value, value), fitted to counted rows."""
    data = [(r["f"].asDict(), 1.0 if r["good"] else 0.0, float(r["n"])) for r in rows if not r["held"]]
    margins = [0.0] * len(data)

    def leaf(own: list[int]) -> tuple[float, float]:
        g = sum(data[i][2] * (data[i][1] - 1 / (1 + math.exp(-margins[i]))) for i in own)
        h = sum(data[i][2] * (p := 1 / (1 + math.exp(-margins[i]))) * (1 - p) for i in own) + 1.0
        return g / h, g * g / h

    def split(own: list[int]):
        base, best = leaf(own)[1], None
        for name, cuts in CUTS.items():
            for cut in cuts:
                a = [i for i in own if data[i][0][name] < cut]
                b = [i for i in own if data[i][0][name] >= cut]
                if a and b and (gain := leaf(a)[1] + leaf(b)[1] - base) > (best[0] if best else 1e-9):
                    best = (gain, name, cut, a, b)
        return best

    trees = []
    for _ in range(TREES if data else 0):
        top = split(list(range(len(data))))
        if not top:
            break
        sides = []
        for own in top[3:]:
            low = split(own)
            parts = low[3:] if low else (own,)
            values = [RATE * max(-4.0, min(4.0, leaf(p)[0])) for p in parts]
            sides.append((low[1], low[2], *values) if low else values[0])
            for p, v in zip(parts, values):
                for i in p:
                    margins[i] += v
        trees.append((top[1], top[2], *sides))
    return trees


def margin(trees: list[tuple], f):
    """The sum of the trees: a number for a dict of features, a column for a struct of them."""
    plain = isinstance(f, dict)

    def value(node):
        if not isinstance(node, tuple):
            return node if plain else F.lit(node)
        name, cut, low, high = node
        if plain:
            return value(low) if f[name] < cut else value(high)
        return F.when(f[name] < cut, value(low)).otherwise(value(high))

    out = 0.0 if plain else F.lit(0.0)
    for t in trees:
        out = out + value(t)
    return out


def thresholds(rows: list, trees: list[tuple]) -> dict[int, float]:
    """By kind, the lowest margin from which loose spans that can be added are good often enough.

    The shares are of held-out spans with the margin or more: PRIOR spans of the share of all kinds are added to a kind's,
    and to theirs PRIOR spans of the chance that the margin stands for.
    """
    held, seen = defaultdict(lambda: [0, 0]), defaultdict(set)
    for r in rows:
        if r["open"]:
            m = margin(trees, r["f"].asDict())
            seen[r["kind"]].add(m)
            if r["held"]:
                for own in (held[r["kind"], m], held[None, m]):
                    own[0] += r["n"] * r["good"]
                    own[1] += r["n"]

    def above(kind, m: float) -> tuple[int, int]:
        own = [x for (k, at), x in held.items() if k == kind and at >= m]
        return sum(x[0] for x in own), sum(x[1] for x in own)

    def share(kind: int, m: float) -> float:
        good, n = above(None, m)
        prior = (good + PRIOR / (1 + math.exp(-m))) / (n + PRIOR)
        good, n = above(kind, m)
        return (good + PRIOR * prior) / (n + PRIOR)

    found = {kind: [m for m in margins if m > 0 and share(kind, m) >= PRECISION] for kind, margins in seen.items()}
    return {kind: min(own) for kind, own in found.items() if own}


def selected(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row, base, spans): base spans, and with them the selected loose ones, by kind and start."""
    spans = proposed(docs)
    rows = counts(spans)
    trees = boosted(rows)
    least = thresholds(rows, trees)
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))
    if not least:
        return spans.select("doc_id", "text", "_row", F.array_sort("base").alias("base"), F.array_sort("base").alias("spans"))
    enough = lambda x: F.coalesce(*[F.when(x["kind"] == k, margin(trees, described(x, x["generator"])) >= v) for k, v in least.items()], F.lit(False))
    more = F.transform(F.filter("loose", lambda x: ~meets(x, F.col("base")) & enough(x)), plain)
    # Of loose spans that overlap, the one that starts first stays.
    kept = F.aggregate(F.array_sort(more), F.expr(f"cast(array() as {SPAN})"), lambda acc, x: F.when(meets(x, acc), acc).otherwise(F.concat(acc, F.array(x))))
    return spans.select("doc_id", "text", "_row", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", kept)).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    n = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with redacted text, and n_chars if there: each selected span is replaced by its kind in brackets; overlapping spans become one, named by the first."""
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1)).alias("out"))
    )
    text = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = selected(docs).withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("_row.text")))
    return found.select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return report(selected(common.table(spark, sf_dir, "documents")))
