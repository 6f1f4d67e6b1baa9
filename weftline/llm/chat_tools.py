"""Tool-call linking for chat data. DataFrame functions only.

Calls and results are hash-joined by identifier, ordered topologically by their dependencies,
checked against the schema of their tool, and serialised as canonical JSON (keys in order, no
blanks, taken from Spark's variant type).

``link`` works on two tables: calls (conv_id, call_id, turn, name, arguments, needs) and results
(conv_id, call_id, turn, content); ``needs`` lists the call_ids of the same conversation that a
call builds on. A call's level is one more than the highest of those it needs. Each call follows
one of its needs at a time; the lengths of these chains come from pointer doubling, so a chain of
n calls takes log2(n) rounds of joins. Calls with several needs then turn to a need of a higher
level, if they have one, and the chains are measured again until none does. Calls on a cycle, or
that build on one, never reach an end and get no level. One row per call leaves, so a
conversation of any length is never gathered.

A tool's schema is a subset of JSON Schema: ``type`` (object, array, string, integer, number,
boolean, null), ``properties``, ``required``, ``additionalProperties`` (false only), ``items``,
``minItems``, ``maxItems``, ``minLength``, ``maxLength``, ``pattern``, ``minimum``, ``maximum``
and ``enum`` (strings or numbers), nested as deep as one likes.

Defined results: of repeated call_ids in a conversation the one with the smallest (turn,
arguments) counts, likewise for results; a need that names no call is ignored; null arguments
or broken JSON are invalid; null conversation or call ids are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged

#: Tool: schema of its arguments.
SCHEMAS = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}
_KEY = ["conv_id", "call_id"]
#: What ``schema_of_variant`` says of each type; numbers without fraction are BIGINT, or DECIMAL where larger.
_KINDS = {"object": r"^OBJECT<", "array": r"^ARRAY<", "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$", "null": "^VOID$"}
_ENDLESS = 2**62


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant fits a schema; a missing one (null) does not."""
    checks = [F.schema_of_variant(value).rlike(_KINDS[schema["type"]])] if "type" in schema else [value.isNotNull()]
    as_text, as_number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if "enum" in schema:
        texts, numbers = [x for x in schema["enum"] if isinstance(x, str)], [float(x) for x in schema["enum"] if not isinstance(x, str)]
        checks.append(F.coalesce(as_text.isin(texts) if texts else F.lit(False), F.lit(False)) | F.coalesce(as_number.isin(numbers) if numbers else F.lit(False), F.lit(False)))
    for name, test in (
        ("minLength", lambda n: F.length(as_text) >= n), ("maxLength", lambda n: F.length(as_text) <= n), ("pattern", as_text.rlike),
        ("minimum", lambda n: as_number >= n), ("maximum", lambda n: as_number <= n),
    ):
        if name in schema:
            checks.append(test(schema[name]))
    if {"items", "minItems", "maxItems"} & schema.keys():
        items = F.try_variant_get(value, "$", "array<variant>")
        if "items" in schema:
            checks.append(F.forall(items, lambda x: F.coalesce(fits(x, schema["items"]), F.lit(False))))
        checks += [test for name, test in (("minItems", F.size(items) >= schema.get("minItems", 0)), ("maxItems", F.size(items) <= schema.get("maxItems", 0))) if name in schema]
    for name, inner in schema.get("properties", {}).items():
        part = F.try_variant_get(value, f"$['{name}']", "variant")
        missing = F.lit(name not in schema.get("required", ()))
        checks.append(F.when(part.isNull(), missing).otherwise(F.coalesce(fits(part, inner), F.lit(False))))
    if schema.get("additionalProperties", True) is False:
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        checks.append(F.size(F.array_except(F.json_object_keys(F.to_json(value)), known)) == 0)
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in checks))


def validity(schemas: dict = SCHEMAS) -> Column:
    """Whether ``args`` (variant) fits the schema of ``name``; an unknown tool never does."""
    out = F.lit(False)
    for tool, schema in schemas.items():
        out = F.when(F.col("name") == tool, fits(F.col("args"), schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _chains(nodes: DataFrame, follows: DataFrame, most: int) -> DataFrame:
    """conv_id, call_id, level: lengths of the chains of ``follows`` (conv_id, call_id, need), by pointer doubling.

    Chains of more than ``most`` calls are cycles; their level is null.
    """
    level = F.when(F.col("need").isNull(), 0).cast("long").alias("level")
    at = staged(nodes.join(follows, _KEY, "left").select(*_KEY, F.col("need").alias("ptr"), F.lit(1).cast("long").alias("dist"), level), "chains")
    reach = 1
    while reach <= most and at.where("level is null").limit(1).count():
        far = at.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("level").alias("level2"))
        step = at.join(far, ["conv_id", "ptr"], "left")
        known = F.coalesce("level", F.col("dist") + F.col("level2"))
        after = staged(step.select(*_KEY, F.when(known.isNull(), F.col("ptr2")).alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), known.alias("level")), "chains")
        drop_staged(at)
        at, reach = after, 2 * reach
    return at


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, turn, needs); null on or behind a cycle."""
    nodes = calls.select(*_KEY)
    edges = calls.select(*_KEY, F.explode(F.array_distinct("needs")).alias("need"))
    edges = staged(edges.join(calls.select("conv_id", F.col("call_id").alias("need"), "turn"), ["conv_id", "need"]), "needs")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    # At first a call follows its latest need.
    follows = staged(edges.groupBy(*_KEY).agg(F.max(F.struct("turn", "need"))["need"].alias("need"), (F.count("*") > 1).alias("several")), "follows")
    several = bool(follows.where("several").limit(1).count())
    while True:
        out = _chains(nodes, follows.select(*_KEY, "need"), most)
        if not several:
            return out.select(*_KEY, "level")
        known = out.select("conv_id", F.col("call_id").alias("need"), F.coalesce("level", F.lit(_ENDLESS)).alias("height"))
        best = edges.join(follows.where("several").select(*_KEY), _KEY, "left_semi").join(known, ["conv_id", "need"])
        best = best.groupBy(*_KEY).agg(F.max(F.struct("height", "need")).alias("b"))
        own = out.select(*_KEY, F.coalesce("level", F.lit(_ENDLESS)).alias("own"))
        better = staged(best.join(own, _KEY).where(F.col("b.height") >= F.col("own")).where(F.col("own") < _ENDLESS).select(*_KEY, F.col("b.need").alias("better")), "follows")
        if not better.limit(1).count():
            return out.select(*_KEY, "level")
        after = staged(follows.join(better, _KEY, "left").select(*_KEY, F.coalesce("better", "need").alias("need"), "several"), "follows")
        for t in (out, follows, better):
            drop_staged(t)
        follows = after


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row per call: conv_id, call_id, turn, name, level, valid, result_turn, content, arguments, message."""
    calls = calls.where("conv_id is not null and call_id is not null")
    rest = F.struct("turn", "arguments", "name", "needs")
    calls = calls.groupBy(*_KEY).agg(F.min(rest).alias("c")).select(*_KEY, "c.*")
    calls = staged(calls, "calls")
    results = results.where("conv_id is not null and call_id is not null").groupBy(*_KEY).agg(F.min(F.struct("turn", "content")).alias("r"))
    out = calls.hint("shuffle_hash").join(results, _KEY, "left").join(levels(calls.select(*_KEY, "turn", "needs")), _KEY, "left")
    out = out.withColumn("args", F.try_parse_json("arguments")).withColumn("valid", validity(schemas))
    out = out.withColumn("canonical", F.to_json("args"))
    head = F.struct(F.col("canonical").alias("arguments"), F.col("r.content").alias("content"), F.col("call_id").alias("id"), F.col("name"))
    message = F.to_json(F.try_parse_json(F.to_json(head.alias("x"))))
    return out.select(*_KEY, "turn", "name", "level", "valid", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.col("canonical").alias("arguments"), message.alias("message"))


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user turn calls ``reply``, which the next turn answers.

    A call builds on the user turn two turns before it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("turn is not null")
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    users = rows.where("role = 'user'")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn"))
    calls = users.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("needs"))
    answers = rows.where("role = 'assistant'")
    results = answers.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    out = link(*as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("conv_id", "call_id", "turn", F.col("level").cast("long").alias("level"), "valid", "result_turn", F.sha2("arguments", 256).alias("arguments_sha256"), F.sha2("content", 256).alias("content_sha256"), F.sha2("message", 256).alias("message_sha256"))


OP4_SQL = """
WITH u AS (
  SELECT conv_id, turn, min(json_object('prompt', coalesce(text, ''), 'turn', turn)::VARCHAR) AS arguments FROM conversations
  WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), g AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM u
), l AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM g
), a AS (
  SELECT conv_id, turn, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL
)
SELECT l.conv_id, 't' || l.turn AS call_id, l.turn, l.level, json_extract_string(l.arguments, '$.prompt') <> '' AS valid, a.turn AS result_turn,
  sha256(l.arguments) AS arguments_sha256, sha256(a.content) AS content_sha256,
  sha256(CASE WHEN a.content IS NULL THEN json_object('arguments', l.arguments, 'id', 't' || l.turn, 'name', 'reply') ELSE json_object('arguments', l.arguments, 'content', a.content, 'id', 't' || l.turn, 'name', 'reply') END::VARCHAR) AS message_sha256
FROM l LEFT JOIN a ON a.conv_id = l.conv_id AND a.turn = l.turn + 1
"""
