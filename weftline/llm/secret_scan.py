"""Secret spans: fixed patterns plus character Markov models. DataFrame functions only.

The base patterns give spans of three kinds (``assign``, ``access``, ``hex``). The method adds
spans of kind ``random``: tokens of ``MIN_TOKEN`` characters or more whose log-likelihood under
a character Markov chain of random strings exceeds that under a chain of ordinary identifiers
by ``PER_CHAR`` a character. Both chains are trained with SQL aggregations on labelled samples:
random strings drawn from digests (hexadecimal and base 64), and ordinary words of a bounded,
documented sample of documents (those with the ``MAX_DOCS`` smallest hashes).

Offsets are code points, end exclusive. They come from splitting the text at a pattern: the
pieces and the matches alternate, so their lengths add up to every span's start.

Defined results: null text is empty and has no spans (its digest is that of the empty string);
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is too short holds no longer run, so the least length is part of these two.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN, PER_CHAR, MAX_DOCS, DRAWS = 20, 0.4, 1_000, 2_000
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


_SPAN = "struct<s:int,k:int,e:int,v:string>"


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Array of (s, k, e, v): start, kind's number, end and value of each match, in order."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    sized = F.zip_with(matches, values, lambda m, v: F.struct(F.length(m).alias("len"), v.alias("v")))
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), sized, lambda p, m: F.struct(F.length(p).alias("gap"), m["len"].alias("len"), m["v"].alias("v")))
    found = let(steps, lambda x: _placed(x, kind))
    if least:
        found = F.filter(found, lambda x: F.length(x["v"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _placed(steps: Column, kind: int) -> Column:
    """Spans of steps (gap before a match, its length, its value).

    Adding to an array copies it, so steps are added up in groups of about the square root of
    their number, and the groups' lengths then.
    """
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["len"]).alias("e"), x["v"].alias("v")))
        return F.struct((s + x["len"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    def in_groups(n: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps)), n)
        own = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out"))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(steps, i, n), own, step))

    def shifted(groups: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("bases"))
        bases = F.aggregate(groups, begin, lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])
        moved = lambda g, base: F.transform(g["out"], lambda x: F.struct((x["s"] + base).alias("s"), x["k"].alias("k"), (x["e"] + base).alias("e"), x["v"].alias("v")))
        return F.flatten(F.zip_with(groups, bases, moved))

    return let(let(size, in_groups), shifted)


def _pairs(tokens: DataFrame) -> DataFrame:
    """n by (a, b): neighbouring characters of ``t``; a is the empty string before the first."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.struct(F.substring("t", i - 1, F.when(i > 1, 1).otherwise(0)).alias("a"), F.substring("t", i, F.lit(1)).alias("b"))))
    return tokens.select(pair.alias("p")).groupBy("p.a", "p.b").count()


def _chain(counts: list) -> list[float]:
    """Log-probabilities of b after a, add-one smoothed; rows by a (start first), columns by b."""
    import math

    size = len(ALPHABET)
    table = [[1.0] * size for _ in range(size + 1)]
    for r in counts:
        a, b = ALPHABET.find(r["a"]) + 1 if r["a"] else 0, ALPHABET.find(r["b"])
        if b >= 0:
            table[a][b] += r["count"]
    return [math.log(x / sum(row)) for row in table for x in row]


def train(docs: DataFrame, max_docs: int = MAX_DOCS, draws: int = DRAWS) -> list[float]:
    """Log-likelihood ratios (random against ordinary) by pair of characters."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    drawn = spark.range(draws).select(F.explode(F.array(F.substring(digest, 1, 40), coded, F.regexp_replace(coded, "[+/]", ""), F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")), F.lit("")))).alias("t"))
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_docs ids at most
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("t"))
    random_, ordinary = _chain(_pairs(drawn).collect()), _chain(_pairs(words).collect())  # a row per pair of ALPHABET at most
    return [round(r - o, 6) for r, o in zip(random_, ordinary, strict=True)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token a character."""
    size, table = len(ALPHABET), F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))  # 1 for the first letter
    total = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum")),
        lambda acc, b: F.struct(b.alias("a"), (acc["sum"] + F.coalesce(F.get(table, acc["a"] * size + b - 1), F.lit(0.0))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.length(token)


def secrets(docs: DataFrame, ratios: list[float], per_char: float = PER_CHAR) -> DataFrame:
    """doc_id, base and found: arrays of (s, k, e, v), ordered by start, then kind."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = F.array_sort(F.concat(spans(text, ASSIGN, 0, 2, 8), spans(text, ACCESS, 1), spans(text, HEX, 2)))
    # Spans that the method adds never touch a base span. Access and hex spans lie within one token, so a token shows them.
    more = F.filter(spans(text, TOKEN, 3), lambda x: ~x["v"].rlike(f"{ACCESS}|{HEX}"))
    more = F.filter(more, lambda x: mean_ratio(x["v"], ratios) >= per_char)

    def joined(base: Column) -> Column:
        assigned = F.filter(base, lambda b: b["k"] == 0)
        apart = let(assigned, lambda own: F.filter(more, lambda m: ~F.exists(own, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, apart)).alias("found"))

    return rows.select("doc_id", let(base, joined).alias("x")).select("doc_id", "x.base", "x.found")


def _listed(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = secrets(docs, train(docs))
    n = [_count(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *n, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
