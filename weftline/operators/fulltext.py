"""Full-text search over symbols: positional postings, phrases, AND, OR and NOT, prefixes, fields.

``postings`` has a row per token occurrence, dealt and sorted by token, so a stored index is read
only where the queries' tokens are. A query is written as users of full-text engines write it::

    get_user            words of a name side by side (as "get user")
    "open ledger" total both, anywhere          name : total     in one field
    led* OR report      a prefix, alternatives  ^ open           at the beginning of a field
    a NOT (b AND c)     NOT before AND before OR; words side by side first of all

Every query becomes phrases and alternatives of phrases to be held or not held; all queries are
answered by one join with the postings. A query that breaks these rules is looked up as a part of
names instead; one that keeps them and finds nothing has no hits.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: The fields of a symbol that are searched.
FIELDS = ("node_id", "name", "qualified_name", "signature", "file_path")
#: Prefixes meet the index's words at equal beginnings of up to this many characters.
_HEAD = 3
_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x80-\U0010ffff]+)|([()*+:^]))')


@functools.lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Lower-case letters with marks and what they are without, by their Unicode decomposition."""
    marked = {c: d for c in map(chr, range(0xDF, 0x250)) for d in [unicodedata.normalize("NFD", c)] if len(d) > 1 and all(map(unicodedata.combining, d[1:]))}
    return "".join(marked), "".join(d[0] for d in marked.values())


def words(text: Column) -> Column:
    """Runs of letters and digits in order, lower case, without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), *_plain_letters()), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def postings(nodes: DataFrame) -> DataFrame:
    """token, node_id, field, pos: a row per occurrence."""
    fields = nodes.select("node_id", F.posexplode(F.array(*(F.coalesce(c, F.lit("")) for c in FIELDS))).alias("field", "text"))
    return fields.select("node_id", "field", F.posexplode(words(F.col("text"))).alias("pos", "token")).select("token", "node_id", "field", "pos")


def by_token(index: DataFrame) -> DataFrame:
    """Postings in ranges of tokens, sorted: files of a stored index hold few tokens each; a frequent one takes several."""
    return index.repartitionByRange("token", "node_id").sortWithinPartitions("token", "node_id", "field", "pos")


class _Query:
    """Alternatives (phrases held, phrases not held) of a query's text."""

    def __init__(self, text: str):
        self.phrases: list[dict] = []
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:].lstrip()[0]!r}")
            quoted, word, mark = m.groups()
            self.tokens.append(("text", quoted.replace('""', '"')) if quoted is not None else (word, word) if word in ("AND", "OR", "NOT") else ("text", word) if word else (mark, mark))
            at = m.end()
        self.tokens.append(("end", ""))
        self.clauses = self._any()
        if self.tokens[0][0] != "end":
            raise ValueError(f"unexpected {self.tokens[0][1]!r}")

    def _take(self, *kinds: str) -> str | None:
        return self.tokens.pop(0)[1] if self.tokens[0][0] in kinds else None

    def _any(self) -> list:
        out = self._all()
        while self._take("OR"):
            out = out + self._all()
        return out

    def _all(self) -> list:
        out = self._but()
        while self._take("AND"):
            out = self._both(out, self._but())
        return out

    def _but(self) -> list:
        out = self._one()
        while self._take("NOT"):
            for held, missing in self._one():  # none of its alternatives holds
                out = self._both(out, [(set(), {p}) for p in held] + [({p}, set()) for p in missing])
        return out

    @staticmethod
    def _both(a: list, b: list) -> list:
        return [(x[0] | y[0], x[1] | y[1]) for x in a for y in b]

    def _one(self) -> list:
        if self._take("("):
            out = self._any()
            if not self._take(")"):
                raise ValueError("a parenthesis is open")
            return out
        out = [(self._phrase(), set())]
        while self.tokens[0][0] in ("text", "^"):
            out = self._both(out, [(self._phrase(), set())])
        return out

    def _phrase(self) -> set:
        field = None
        if self.tokens[1:2] == [(":", ":")] and self.tokens[0][0] == "text":
            field = FIELDS.index(self.tokens[0][1].lower())  # a ValueError for other names
            del self.tokens[:2]
        first, text = bool(self._take("^")), self._take("text")
        if text is None:
            raise ValueError(f"unexpected {self.tokens[0][1] or 'end'!r}")
        while self._take("+"):
            more = self._take("text")
            if more is None:
                raise ValueError("nothing after +")
            text += " " + more
        self.phrases.append({"text": text, "prefix": bool(self._take("*")), "field": field, "first": first})
        return {len(self.phrases) - 1}


_PHRASE = "struct<text:string,prefix:boolean,field:int,first:boolean>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrase = pa.list_(pa.struct([("text", pa.string()), ("prefix", pa.bool_()), ("field", pa.int32()), ("first", pa.bool_())]))
    clause = pa.list_(pa.struct([("held", pa.list_(pa.int32())), ("missing", pa.list_(pa.int32()))]))
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            try:
                q = _Query(text or "")
                rows.append((q.phrases, [{"held": sorted(h), "missing": sorted(m)} for h, m in q.clauses], None))
            except ValueError as e:
                rows.append((None, None, str(e)))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, (phrase, clause, pa.string()), strict=True))], names=["query_id", "query", "phrases", "clauses", "error"])


def parse_queries(queries: DataFrame) -> DataFrame:
    """query_id, query, phrases, clauses, error of queries (query_id, query)."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
    return rows.mapInArrow(_parse, f"query_id long, query string, phrases array<{_PHRASE}>, clauses array<struct<held:array<int>,missing:array<int>>>, error string")


def _candidates(index: DataFrame, terms: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, node_id: symbols that hold the rarest word of one of a query's alternatives.

    Frequent words are then read for these symbols only, not once for every query that has them.
    """
    sized = terms.join(index.groupBy("token").agg(F.count("*").alias("df")), "token", "left")
    places = sized.groupBy("query_id", "leaf", "i").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"))
    phrases = places.groupBy("query_id", "leaf").agg(F.min_by("i", "df").alias("i"), F.min("df").alias("df"))
    clauses = asked.select("query_id", F.posexplode("clauses").alias("c", "clause")).select("query_id", "c", F.explode_outer("clause.held").alias("leaf"))
    clauses = clauses.join(phrases, ["query_id", "leaf"], "left").groupBy("query_id", "c").agg(F.min_by(F.struct("leaf", "i"), "df").alias("at"))
    leading = clauses.where("at is not null").select("query_id", "at.leaf", "at.i")
    # An alternative whose phrases have no words is met by any other phrase of its query.
    void = phrases.join(clauses.where("at is null").select("query_id").distinct(), "query_id", "left_semi").select("query_id", "leaf", "i")
    chosen = terms.join(leading.unionByName(void).distinct(), ["query_id", "leaf", "i"], "left_semi").select("query_id", "token").distinct()
    return staged(index.join(chosen, "token").select("query_id", "node_id").distinct(), "candidates")


def matches(index: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, node_id: symbols that fit a parsed query."""
    parts = asked.select("query_id", F.posexplode("phrases").alias("leaf", "p")).withColumn("t", words(F.col("p.text")))
    last = F.col("p.prefix") & (F.col("i") == F.col("n") - 1)
    terms = parts.select("query_id", "leaf", "p", F.size("t").alias("n"), F.posexplode("t").alias("i", "token"))
    terms = terms.select("query_id", "leaf", F.col("p.field").alias("only"), F.col("p.first").alias("first"), "n", "i", "token", last.alias("open"))
    exact = terms.where(~F.col("open")).drop("open")
    if asked.where(F.exists("phrases", lambda p: p["prefix"])).limit(1).count():
        heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(_HEAD), F.length("token"))), lambda k: F.substring("token", F.lit(1), k))
        dictionary = index.select("token").distinct().select(F.col("token").alias("word"), F.explode(heads).alias("head"))
        begun = terms.where("open").drop("open").withColumn("head", F.substring("token", 1, _HEAD)).join(dictionary, "head").where(F.startswith("word", F.col("token")))
        exact = exact.unionByName(begun.withColumn("token", F.col("word")).drop("head", "word"))
    exact = staged(exact, "terms")
    index = index.join(exact.select("token").distinct(), "token", "left_semi")
    near = _candidates(index, exact, asked)
    hits = index.join(near, "node_id").join(exact, ["query_id", "token"]).where((F.col("only").isNull() | (F.col("only") == F.col("field"))) & (~F.col("first") | (F.col("pos") == F.col("i"))))
    single = hits.where("n = 1").select("query_id", "leaf", "node_id")
    places = hits.where("n > 1").groupBy("query_id", "leaf", "n", "node_id", "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("k"))
    held = single.unionByName(places.where("k = n").select("query_id", "leaf", "node_id")).groupBy("query_id", "node_id").agg(F.collect_set("leaf").alias("got"))  # phrases of one query
    # A phrase without a word, as "...", asks for nothing.
    void = F.transform(F.filter(F.transform("phrases", lambda p, i: F.struct(i.alias("i"), F.size(words(p["text"])).alias("n"))), lambda x: x["n"] == 0), lambda x: x["i"])
    rules = asked.select("query_id", "clauses", void.alias("void"))
    fits = F.exists("clauses", lambda c: F.forall(c["held"], lambda x: F.array_contains("got", x) | F.array_contains("void", x)) & ~F.arrays_overlap(c["missing"], F.col("got")))
    return held.join(rules, "query_id").where(fits).select("query_id", "node_id")


def find(index: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node_id for queries (query_id, query); those that break the rules are parts of names."""
    asked = staged(parse_queries(queries), "asked")
    out = matches(index, asked.where("error is null"))
    broken = asked.where("error is not null").select("query_id", F.lower(F.concat(F.lit("%"), F.replace("query", F.lit("\\"), F.lit("\\\\")), F.lit("%"))).alias("pattern"))
    if not broken.limit(1).count():
        return out
    # Each such query is asked of every symbol; there is no key to meet on.
    part = nodes.select("node_id", "name", "qualified_name").join(broken, F.like(F.lower("name"), F.col("pattern")) | F.like(F.lower("qualified_name"), F.col("pattern")))
    return out.unionByName(part.select("query_id", "node_id"))


def find_nodes(index: DataFrame, nodes: DataFrame, query: str, kind: str | None = None, limit: int | None = 20) -> DataFrame:
    """The symbols of one query, of one kind if it is given, by id."""
    asked = nodes.sparkSession.createDataFrame([(1, query)], "query_id long, query string")
    hits = nodes.join(find(index, nodes, asked).select("node_id"), "node_id", "left_semi")
    hits = hits.where(F.col("kind") == kind.lower()) if kind else hits
    return hits.orderBy("node_id").limit(limit) if limit else hits
