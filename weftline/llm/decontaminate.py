"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, units after numbers and capitalised names inside sentences become typed placeholders;
other words are lower-cased and lose punctuation. Five-token windows of these templates with at
least ``MIN_LITERAL`` ordinary words are hash-joined between the documents and the benchmark.
A document is tied to an item when it holds ``SHARE`` of the item's distinct windows or more.
Placeholders keep the text they stand for, so the slots of matching windows can be compared: if
the values are equal (or there are none) the copy is ``exact``; if every value of the item is
replaced by one value of the document throughout, it is ``reparameterised``; if neither holds
for ``SHARE`` of the windows or slots, the pair is no leak.

Pairs that are no leak so far are looked at again in the open form, where every capitalised word
is a name wherever it stands, so names at sentence starts can be replaced too. Items that miss
windows for want of ordinary words (in the open form: more than ``1 - SHARE`` of them) or tokens
are looked for by their whole template, as one run of tokens that counts as one window; a copy
with other values needs five tokens and an ordinary word, a shorter one must be ``exact``.

Known limits: a word that starts a sentence in the item and stands in lower case in the document
matches in the first form only, so an item with such a word and a renamed sentence start is
found only while ``SHARE`` of the windows agree in one form. Signs such as + are no tokens.
``OP10_SQL`` covers the first form only; it has no rows of the open form or of whole templates.

Defined results: null and empty texts have no windows and match nothing; repeated rows of one ``doc_id`` count as one document; repeated
items are reported once; null ``doc_id`` and ``item_id`` are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, staged

WIDTH, MIN_LITERAL, SHARE = 5, 3, 0.8
#: Forms of a template, as bits: names inside sentences, or every capitalised word as a name.
STRICT, OPEN = 1, 2
#: Windows of a benchmark that are broadcast; beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 500_000
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
#: The same for Java, as a loop: without the last sign it goes one call deeper for each part of a long list of numbers.
NUMBER_LOOP = NUMBER + "+"
UNIT = r"(\x01n[^ ]* +)(kilometres|kilometers|metres|meters|miles|feet|inches|grams|pounds|ounces|litres|liters|hours|minutes|seconds|days|weeks|months|years|dollars|euros|cents|percent|degrees|kg|km|cm|mm|mg|ml|mph|hrs|min|sec|usd|eur|lbs|oz|m|g|l|h|s|%|€|\$)( |$)"
NAME = r"([a-zß-öø-ÿ][,;:]? )([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)"
TOKEN = r"\x01[nup][^ ]*|[\p{L}]+"


def tokens(text: Column) -> Column:
    """Words of a text; a slot starts with U+0001 and its type (n, u or p), then its own text."""
    t = F.translate(F.coalesce(text, F.lit("")), "\x01\n\r\t", "    ")
    t = F.regexp_replace(t, NAME, "$1\x01p$2 ")
    t = F.regexp_replace(t, NUMBER_LOOP, " \x01n$0 ")
    t = F.when(F.contains(t, F.lit("\x01n")), F.regexp_replace(t, UNIT, "$1\x01u$2$3")).otherwise(t)
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def _capital(token: Column) -> Column:
    return ((token >= "A") & (token < "[")) | ((token >= "À") & (token < "ß"))


def _codes(toks: Column) -> Column:
    """A hash for each token with two low bits: 1 for an ordinary word, 2 for a capitalised one; slots have neither."""

    def code(t: Column) -> Column:
        word = F.shiftleft(F.xxhash64(F.lower(t)), 2).bitwiseOR(F.when(_capital(t), F.lit(3).cast("long")).otherwise(F.lit(1).cast("long")))
        return F.when(F.startswith(t, F.lit("\x01")), F.shiftleft(F.xxhash64(F.substring(t, 1, 2)), 2)).otherwise(word)

    return F.transform(toks, code)


def _strict(code: Column) -> Column:
    return code.bitwiseAND(F.lit(-3).cast("long"))


def _opened(code: Column) -> Column:
    """The code in the open form: every capitalised word, wherever it stands, is a name."""
    name = F.shiftleft(F.xxhash64(F.lit("\x01p")), 2)
    return F.when(code.bitwiseAND(F.lit(2).cast("long")) != 0, name).otherwise(code)


def _both_codes(toks: Column, body) -> Column:
    """``body(codes, open codes)`` of an array of tokens."""
    return let(_codes(toks), lambda c: let(F.transform(c, _strict), lambda s: let(F.transform(c, _opened), lambda o: body(s, o))))


def _slots(toks: Column, form: int) -> Column:
    """The values of the slots among some tokens, in order."""
    if form == OPEN:
        toks = F.transform(toks, lambda t: F.when(_capital(t), F.concat(F.lit("\x01p"), t)).otherwise(t))
    return F.transform(F.filter(toks, lambda t: F.startswith(t, F.lit("\x01"))), lambda t: F.lower(F.substr(t, F.lit(2))))


def _hash(own: list[Column]) -> Column:
    """Of the codes of a window, with two free low bits."""
    return F.shiftleft(F.xxhash64(*own), 2)


def _window(codes: Column, i: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """(hash, number of ordinary words) of the window at ``i``."""
    own = [F.get(codes, i + k) for k in range(width)]
    literal = own[0].bitwiseAND(F.lit(1))
    for x in own[1:]:
        literal = literal + x.bitwiseAND(F.lit(1))
    return _hash(own), literal


def windows(rows: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """key, win, form: windows of ``rows`` (key, toks); those with capitalised words also in the open form.

    ``form`` tells by its bits which forms of items a window may match. A row per place leaves with
    its few codes, so the hashes run in generated code and not in an array function's lambda.
    """
    places = let(_codes(F.col("toks")), lambda c: F.transform(c, lambda _, i: F.slice(c, i + 1, max(widths))))
    rows = rows.select(key, F.explode(places).alias("c"))
    found = []
    for w in widths:
        own = [F.get("c", F.lit(k)) for k in range(w)]
        any_ = own[0]
        for x in own[1:]:
            any_ = any_.bitwiseOR(x)
        fits = F.size("c") >= w
        named = any_.bitwiseAND(F.lit(2).cast("long")) != 0
        found.append(F.when(fits, _hash([_strict(x) for x in own]).bitwiseOR(F.lit(STRICT | OPEN))))
        found.append(F.when(fits & named, _hash([_opened(x) for x in own]).bitwiseOR(F.lit(OPEN))))
    rows = rows.select(key, F.explode(F.array(*found)).alias("x")).where("x is not null")
    return rows.select(key, F.col("x").bitwiseAND(F.lit(-4).cast("long")).alias("win"), F.col("x").bitwiseAND(F.lit(3).cast("long")).cast("int").alias("form"))


def _tokenised(rows: DataFrame, key: str) -> DataFrame:
    rows = rows.where(F.col(key).isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col(key).cast("long").alias(key), tokens(F.col("text")).alias("toks"))


def _located(rows: DataFrame, key: str, form: int) -> DataFrame:
    """key, win, slots: every window with enough ordinary words, and the values of its slots."""

    def located(toks: Column) -> Column:
        def at(codes: Column, i: Column) -> Column:
            win, literal = _window(codes, i)
            return F.when(literal >= MIN_LITERAL, F.struct(win.alias("win"), _slots(F.slice(toks, i + 1, WIDTH), form).alias("slots")))

        def places(codes: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(codes) - WIDTH), lambda i: at(codes, i))

        own = let(F.transform(_codes(toks), _opened if form == OPEN else _strict), places)
        return F.when(F.size(toks) >= WIDTH, own)

    rows = rows.select(key, F.explode(let(F.col("toks"), located)).alias("x")).where("x is not null")
    return rows.select(key, "x.win", "x.slots")


def _item_forms(benchmark: DataFrame) -> DataFrame:
    """item_id, form, toks, codes, n_places, n_literal, at, anchor: a row per item, text and form.

    ``at`` is the place of the window of the most ordinary words and ``anchor`` its hash, for
    items of fewer than ``WIDTH`` tokens that of them all.
    """
    rows = _tokenised(benchmark, "item_id").where(F.size("toks") > 0)
    rows = rows.select("item_id", "toks", F.explode(_both_codes(F.col("toks"), lambda c, o: F.array(F.struct(F.lit(STRICT).alias("form"), c.alias("codes")), F.struct(F.lit(OPEN).alias("form"), o.alias("codes"))))).alias("x"))
    rows = rows.select("item_id", "toks", "x.form", "x.codes")
    literal = lambda codes: F.aggregate(codes, F.lit(0), lambda n, c: n + c.bitwiseAND(F.lit(1)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("codes") - WIDTH, F.lit(0))), lambda i: literal(F.slice("codes", i + 1, WIDTH)))
    rows = rows.withColumn("counts", counts).withColumn("n_places", F.greatest(F.size("codes") - WIDTH + 1, F.lit(0)))
    rows = rows.withColumn("n_literal", F.when(F.col("n_places") > 0, F.size(F.filter("counts", lambda n: n >= MIN_LITERAL))).otherwise(0))
    rows = rows.withColumn("at", (F.array_position("counts", F.array_max("counts")) - 1).cast("int"))
    anchor = F.when(F.size("codes") >= WIDTH, _window(F.col("codes"), F.col("at"))[0])
    for n in range(1, WIDTH):
        anchor = anchor.when(F.size("codes") == n, _window(F.col("codes"), F.lit(0), n)[0])
    return rows.withColumn("anchor", anchor).drop("counts")


def _by_windows(docs: DataFrame, found: DataFrame, items: DataFrame, form: int, share: float, near, done: DataFrame | None) -> DataFrame:
    """Leaks whose windows match in one form, without the pairs in ``done``."""
    sizes = items.groupBy("item_id").agg(F.countDistinct("win").alias("n_windows"))
    own = found.where(F.col("form").bitwiseAND(F.lit(form)) > 0).select("doc_id", "win").distinct()
    pairs = own.join(near(items.select("item_id", "win").distinct()), "win").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matched"))
    pairs = pairs.join(near(sizes), "item_id").where(F.col("n_matched") >= share * F.col("n_windows"))
    pairs = staged(pairs.join(done.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti") if done is not None else pairs, "leak-candidates")
    # Slots: only documents and items of candidate pairs are cut into windows with values again.
    again = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    again = _tokenised(again, "doc_id")
    own = _located(again, "doc_id", STRICT)
    own = own if form == STRICT else own.unionByName(_located(again, "doc_id", OPEN))
    own = own.withColumnRenamed("slots", "doc_slots").distinct()
    both = own.join(pairs.select("doc_id", "item_id"), "doc_id").join(near(items), ["item_id", "win"])
    both = staged(both, "leak-windows")
    exact = both.where(F.col("slots") == F.col("doc_slots")).groupBy("doc_id", "item_id").agg(F.countDistinct("win").alias("n_exact"))
    slots = both.select("doc_id", "item_id", F.explode(F.arrays_zip("slots", "doc_slots")).alias("z"))
    slots = slots.groupBy("doc_id", "item_id", "z.slots").agg((F.min("z.doc_slots") == F.max("z.doc_slots")).cast("long").alias("one"))
    slots = slots.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_slots"), F.sum("one").alias("n_consistent"))
    out = pairs.join(exact, ["doc_id", "item_id"], "left").join(slots, ["doc_id", "item_id"], "left")
    out = out.select("doc_id", "item_id", "n_windows", "n_matched", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_slots", "n_consistent")))
    kind = F.when(F.col("n_exact") >= share * F.col("n_windows"), "exact").when((F.col("n_slots") > 0) & (F.col("n_consistent") >= share * F.col("n_slots")), "reparameterised")
    return out.withColumn("kind", kind).where("kind is not null")


def _by_whole(docs: DataFrame, found: DataFrame, items: DataFrame, share: float, near, done: DataFrame) -> DataFrame:
    """Leaks of ``items`` whose whole template stands in a document, without the pairs in ``done``."""
    own = found.join(near(items.select("item_id", F.col("form").alias("of"), F.col("anchor").alias("win"))), "win").where(F.col("form").bitwiseAND(F.col("of")) > 0)
    pairs = staged(own.select("doc_id", "item_id").distinct().join(done.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"), "whole-candidates")
    again = _tokenised(docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").withColumnRenamed("toks", "doc_toks")
    both = again.join(pairs, "doc_id").join(near(items), "item_id")
    length = F.size("codes")

    def places(codes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(codes) - length)
        return F.filter(at, lambda i: (F.get(codes, i + F.col("at")) == F.get("codes", "at")) & (F.slice(codes, i + 1, length) == F.col("codes")))

    here = _both_codes(F.col("doc_toks"), lambda c, o: F.when(F.col("form") == OPEN, places(o)).otherwise(places(c)))
    both = both.where(F.size("doc_toks") >= length).withColumn("place", F.explode(here))
    part = F.slice("doc_toks", F.col("place") + 1, length)
    values = lambda toks: F.when(F.col("form") == OPEN, _slots(toks, OPEN)).otherwise(_slots(toks, STRICT))
    both = both.select("doc_id", "item_id", "codes", values(F.col("toks")).alias("slots"), values(part).alias("doc_slots"))
    one = lambda s: F.size(F.array_distinct(F.transform(F.filter(F.arrays_zip("slots", "doc_slots"), lambda z: z["slots"] == s), lambda z: z["doc_slots"]))) == 1
    both = both.select(
        "doc_id", "item_id", (F.col("slots") == F.col("doc_slots")).cast("long").alias("n_exact"), F.size(F.array_distinct("slots")).cast("long").alias("n_slots"), F.size(F.filter(F.array_distinct("slots"), one)).cast("long").alias("n_consistent"),
        ((F.size("codes") >= WIDTH) & F.exists("codes", lambda c: c.bitwiseAND(F.lit(1)) == 1)).alias("told"),
    )
    kind = F.when(F.col("n_exact") == 1, "exact").when(F.col("told") & (F.col("n_slots") > 0) & (F.col("n_consistent") >= share * F.col("n_slots")), "reparameterised")
    both = both.withColumn("kind", kind).where("kind is not null")
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_exact", "n_consistent", "n_slots", "kind")).alias("b"))
    count = F.lit(1).cast("long")
    return best.select("doc_id", "item_id", count.alias("n_windows"), count.alias("n_matched"), "b.n_exact", "b.n_slots", "b.n_consistent", "b.kind")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_exact, n_slots, n_consistent, kind: a row per leak."""
    forms = staged(_item_forms(benchmark).distinct(), "item-forms")
    strict, opened = (staged(_located(forms.where(F.col("form") == f).select("item_id", "toks"), "item_id", f).distinct(), "item-windows") for f in (STRICT, OPEN))
    # The open form makes more slots: with few windows left, an item is told by its whole template only.
    thin = forms.where((F.col("form") == OPEN) & ((F.col("n_places") == 0) | (F.col("n_literal") < share * F.col("n_places")))).select("item_id").distinct()
    opened = staged(opened.join(thin, "item_id", "left_anti"), "item-windows")
    short = forms.where((F.col("form") == STRICT) & ((F.col("n_places") == 0) | (F.col("n_literal") < F.col("n_places")))).select("item_id")
    whole = staged(forms.join(short.union(thin).distinct(), "item_id", "left_semi"), "item-whole")
    wanted = strict.select("win").union(opened.select("win")).union(whole.select(F.col("anchor").alias("win"))).distinct()
    small = strict.count() + opened.count() + whole.count() <= BROADCAST_WINDOWS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    widths = sorted({WIDTH} | {r[0] for r in whole.where(F.size("codes") < WIDTH).select(F.size("codes")).distinct().collect()})  # WIDTH values at most
    rows = windows(_tokenised(docs, "doc_id"), "doc_id", widths)
    found = staged(rows.join(near(wanted), "win").distinct(), "matched-windows")
    out = staged(_by_windows(docs, found, strict, STRICT, share, near, None), "leaks")
    for more in (lambda: _by_windows(docs, found, opened, OPEN, share, near, out), lambda: _by_whole(docs, found, whole, share, near, out)):
        out = staged(out.unionByName(more()), "leaks")
    return out


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql(table: str, key: str, name: str) -> str:
    """DuckDB: windows of a table as strings with their slots."""
    unit = UNIT.replace("\\x01", "\x01")
    return f"""
{name}_t AS (
  SELECT {key}, regexp_replace(regexp_replace(translate(text, chr(1) || chr(10) || chr(13) || chr(9), '    '),
    '{NAME}', '\\1' || chr(1) || 'p\\2 ', 'g'), '({NUMBER})', ' ' || chr(1) || 'n\\1 ', 'g') AS t
  FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL
), {name}_k AS (
  SELECT {key}, regexp_extract_all(regexp_replace(t, '{unit}', '\\1' || chr(1) || 'u\\2\\3', 'g'), chr(1) || '[nup][^ ]*|[\\p{{L}}]+') AS toks FROM {name}_t
), {name}_p AS (
  SELECT {key}, unnest(list_transform(range(1, len(toks) - {WIDTH - 2}), lambda i: toks[i:i + {WIDTH - 1}])) AS w FROM {name}_k
), {name} AS (
  SELECT DISTINCT {key}, array_to_string(list_transform(w, lambda x: CASE WHEN starts_with(x, chr(1)) THEN left(x, 2) ELSE lower(x) END), ' ') AS win,
    list_transform(list_filter(w, lambda x: starts_with(x, chr(1))), lambda x: lower(substr(x, 2))) AS slots
  FROM {name}_p WHERE len(list_filter(w, lambda x: NOT starts_with(x, chr(1)))) >= {MIN_LITERAL}
)"""


OP10_SQL = f"""
WITH {_sql("benchmark", "item_id", "iw")}, {_sql("documents", "doc_id", "dw")}, sizes AS (
  SELECT item_id, count(DISTINCT win) AS n_windows FROM iw GROUP BY item_id
), both_w AS (
  SELECT d.doc_id, i.item_id, i.win, i.slots, d.slots AS doc_slots FROM dw d JOIN iw i ON d.win = i.win
), pairs AS (
  SELECT doc_id, item_id, count(DISTINCT win) AS n_matched, count(DISTINCT win) FILTER (slots = doc_slots) AS n_exact FROM both_w GROUP BY ALL
), z AS (
  SELECT doc_id, item_id, unnest(slots) AS s, unnest(doc_slots) AS v FROM both_w
), one AS (
  SELECT doc_id, item_id, s, CASE WHEN min(v) = max(v) THEN 1 ELSE 0 END AS one FROM z GROUP BY ALL
), sl AS (SELECT doc_id, item_id, count(*) AS n_slots, sum(one) AS n_consistent FROM one GROUP BY ALL), o AS (
  SELECT doc_id, item_id, n_windows, n_matched, n_exact, coalesce(n_slots, 0)::BIGINT AS n_slots, coalesce(n_consistent, 0)::BIGINT AS n_consistent,
    CASE WHEN n_exact >= {SHARE} * n_windows THEN 'exact' WHEN n_slots > 0 AND n_consistent >= {SHARE} * n_slots THEN 'reparameterised' END AS kind
  FROM pairs JOIN sizes USING (item_id) LEFT JOIN sl USING (doc_id, item_id) WHERE n_matched >= {SHARE} * n_windows
)
SELECT * FROM o WHERE kind IS NOT NULL
"""
