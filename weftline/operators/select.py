"""Selection under a token budget, rendering, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..config import COMPRESSED, SIGNATURES, ContextConfig
from ..functions.text import signature_lines, token_estimate
from ..staging import staged


def heading() -> Column:
    """What stands before a file's body: its path, facts and the opening fence."""
    facts = F.format_string("<!-- score=%.3f rank=%d depth=%d reasons=%s -->", "score", "rank", "depth", F.array_join(F.slice("reasons", 1, 2), ","))
    return F.concat(F.lit("## "), "path", F.lit("\n"), facts, F.lit("\n```"), "language", F.lit("\n"))


def render(compress: Column | None = None) -> Column:
    """A file's section: heading, facts, then its source or signatures between fences."""
    body = F.when(F.col("output_mode") == SIGNATURES, F.col("signatures"))
    if compress is not None:
        body = body.when(F.col("output_mode") == COMPRESSED, compress)
    return F.concat(heading(), body.otherwise(F.col("source")), F.lit("\n```"))


def greedy(rows: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(picked: request_id, pos, path, sig and further columns of rows; totals: request_id, used, original, n) from rows
    (request_id, pos, path, tok, sig_tok, orig and what is to be kept).

    First fit with a fallback: a file whose section is too large enters with its signatures if
    these fit, or is passed over; the fold ends when the budget is used up. A task holds one
    request's counters, never its files, and takes a step for each file that fits: those between are passed over at once.
    """
    held = ["request_id", "pos", "path", *(c for c in rows.columns if c not in ("request_id", "pos", "path", "tok", "sig_tok", "orig"))]
    rows = rows.select(*held, *(F.col(c).cast("long").alias(c) for c in ("tok", "sig_tok", "orig")))
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[: len(held)]), *StructType.fromDDL("sig boolean, used long, original long, n long").fields])
    arrow, cut = to_arrow_schema(schema), len(held)

    def picked(batch: pa.RecordBatch, at: list[int], sig: list[bool]) -> pa.RecordBatch:
        columns = [batch.column(i).take(pa.array(at, pa.int64())).cast(arrow.field(i).type) for i in range(cut)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sig, pa.bool_()), *(pa.nulls(len(at), pa.int64()) for _ in range(3))], schema=arrow)

    def total(key, used: int, original: int, n: int) -> pa.RecordBatch:
        first = [key, *[None] * cut, used, original, n]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(first, arrow, strict=True)], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, original, n, any_yet = None, 0, 0, 0, False
        for batch in parts:
            keys, at, sig = batch.column(0).to_pylist(), [], []
            tok, sig_tok, orig = (batch.column(cut + i).to_numpy(zero_copy_only=False) for i in range(3))
            least = np.minimum(tok, sig_tok)
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            i = 0
            for end in ends if keys else ():
                if not any_yet or keys[i] != key:
                    if any_yet:
                        yield total(key, used, original, n)
                    key, used, original, n, any_yet = keys[i], 0, 0, 0, True
                    stopped = False
                while i < end and not stopped:
                    step, fits = _STEP, -1
                    while i < end:  # the next file that fits; those before it are passed over
                        to = min(end, i + step)
                        hits = np.flatnonzero(least[i:to] <= budget - used)
                        if len(hits):
                            fits = i + int(hits[0])
                            break
                        original, i, step = original + int(orig[i:to].sum()), to, step * 4
                    if fits < 0:
                        break
                    full = used + int(tok[fits]) <= budget
                    used, original, n = used + int(tok[fits] if full else sig_tok[fits]), original + int(orig[i : fits + 1].sum()), n + 1
                    at.append(fits)
                    sig.append(not full)
                    i, stopped = fits + 1, used >= budget
                i = end
            if at:
                yield picked(batch, at, sig)
        if any_yet:
            yield total(key, used, original, n)

    out = rows.repartition("request_id").sortWithinPartitions("request_id", "pos").mapInArrow(run, schema)
    out = staged(out, "greedy")  # read twice
    return out.where("pos is not null").select(*held, "sig"), out.where("pos is null").select("request_id", "used", "original", "n")


#: Files looked at first for one that fits; four times as many after each miss.
_STEP = 16


def heading_length(language: str = "language") -> Column:
    """The length of ``heading``, without making it."""
    whole = lambda c: F.length(F.col(c).cast("string"))
    score = F.when((F.col("score") >= 0) & (F.col("score") < 9.999), 5).otherwise(F.length(F.format_string("%.3f", "score")))
    fixed = len("## \n<!-- score= rank= depth= reasons= -->\n```\n")
    return F.length("path") + score + whole("rank") + whole("depth") + F.length(F.array_join(F.slice("reasons", 1, 2), ",")) + F.length(language) + fixed


def select_files(ranked: DataFrame, files: DataFrame, corpus: DataFrame, config: ContextConfig, compress: Callable[[Column, float], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected rows with their rendered text, totals per request).

    The choice needs sizes only, which the index holds; sources and further columns are read for the files chosen.
    ``compress`` takes a source and the configured ratio, and renders files of mode compressed,
    whose sizes are then taken from the texts.
    """
    facts = files.where("chars > 0").select("path", "language", "chars", F.length("signatures").alias("sig_chars"), F.col("token_estimate").alias("orig"))
    sized, short = ranked.join(facts, "path"), compress(F.col("source"), config.compression_ratio) if compress else None
    body = F.when(F.col("output_mode") == SIGNATURES, F.col("sig_chars"))
    if compress:
        sized = sized.join(corpus.select("path", "source"), "path")
        body = body.when(F.col("output_mode") == COMPRESSED, F.length(short))
    tokens = lambda n: F.greatest(F.lit(1), F.floor(n / 4))
    sized = sized.select("request_id", "path", "changed", "rank", "language", tokens(heading_length() + body.otherwise(F.col("chars")) + 4).alias("tok"), tokens(F.col("sig_chars")).alias("sig_tok"), "orig")
    sizes = sized.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("changed"), "rank"))).drop("changed")
    picked, totals = greedy(sizes, config.token_budget)
    chosen = ranked.join(picked, ["request_id", "rank", "path"]).join(files.select("path", "signatures"), "path").join(corpus.select("path", "source"), "path")
    brief = F.concat(F.format_string("# %s [signatures only, score=%.2f]\n", "path", "score"), "signatures")
    chosen = chosen.withColumn("rendered", F.when(F.col("sig"), brief).otherwise(render(short)))
    return chosen.drop("source", "signatures"), totals


def batches(selected: DataFrame, size: int) -> DataFrame:
    """Selected files with the number of their chunk."""
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))
    return selected.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def review_snippets(ranked: DataFrame, corpus: DataFrame, max_depth: int = 2, max_files: int = 30, max_lines: int = 120) -> DataFrame:
    """request_id, place, path, changed, snippet, signature_lines, tokens: changed files first, then the nearest."""
    rows = ranked.where((F.col("depth") <= max_depth) | F.col("changed"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("changed"), F.desc("score"), "file_ord"))).where(F.col("place") <= max_files)
    rows = rows.join(corpus.select("path", "source"), "path")
    lines = F.split("source", "\n", -1)
    more = F.size(lines) - max_lines
    text = F.array_join(F.slice(lines, 1, max_lines), "\n")
    snippet = F.when(more > 0, F.concat(text, F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(text)
    return rows.select("request_id", "place", "path", "changed", snippet.alias("snippet"), signature_lines(F.col("source"), 20).alias("signature_lines"), token_estimate(snippet).alias("tokens"))
