"""Relevance: keyword score, fusion with the graph score, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FULL, SIGNATURES, SMART, ContextConfig
from ..functions.text import is_test, query_tokens, stem
from ..staging import staged

K1, B, AVERAGE, IDF = 1.5, 0.75, 20.0, 0.6931471805599453


def document_terms(files: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """path, term, tf, dl: parts of symbol names and of the file's stem (of ``among``, if given); empty parts count."""
    names = F.concat(F.transform("symbols", lambda s: s["name"]), F.array(stem(F.col("path"))))
    terms = F.flatten(F.transform(names, lambda n: F.split(F.lower(n), "_", -1)))
    rows = files.select("path", F.size(terms).alias("dl"), F.explode(terms).alias("term"))
    rows = rows if among is None else rows.join(among.select("term").distinct(), "term", "left_semi").repartition("path")
    return rows.groupBy("path", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def keyword_scores(files: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, path, bm25 for files that hold a query term; others have none (0)."""
    text = F.concat_ws(" ", F.coalesce("diff_text", F.lit("")), F.coalesce("commit_message", F.lit("")), F.coalesce("query", F.lit("")))
    terms = requests.select("request_id", query_tokens(text).alias("t")).select("request_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    terms = staged(terms, "asked-terms")  # few terms are known to be few then, and sent to the files
    hits = document_terms(files, terms).join(terms, "term")  # dealt by path already where the terms are few
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / AVERAGE))
    total = hits.groupBy("request_id", "path").agg(F.sum(F.lit(IDF) * norm).alias("s"), F.first("n").alias("n"))
    return total.select("request_id", "path", F.least(F.lit(1.0), F.col("s") / F.greatest("n", F.lit(1))).alias("bm25"))


def rank_files(files: DataFrame, graph: DataFrame, bm25: DataFrame, changed: DataFrame, config: ContextConfig) -> DataFrame:
    """request_id, path, file_ord, score, rank, reasons, depth, output_mode, changed.

    ``graph`` has the traversal's scores, ``changed`` (request_id, path) the changed files.
    Files that no traversal reached are never joined: without a change they fall below min_score.
    """
    marked = staged(changed.select("request_id", "path").distinct().withColumn("changed", F.lit(True)), "changed-files")
    near, both = graph.where(F.col("score") >= config.min_score), ["request_id", "path"]
    alone = marked.join(near.select(*both).join(marked, both, "left_semi"), both, "left_anti")  # changed, but not reached
    near = near.join(marked, both, "left").unionByName(alone, allowMissingColumns=True)
    rows = near.join(files.select("path", "file_ord", "line_count"), "path").join(bm25, ["request_id", "path"], "left")
    is_changed = F.coalesce("changed", F.lit(False))
    g = F.when(is_changed, 1.0).otherwise(F.col("score"))
    reasons = F.when(is_changed, F.array(F.lit("directly changed"))).otherwise(F.col("reasons"))
    c0 = config.graph_weight * g + config.bm25_weight * F.coalesce("bm25", F.lit(0.0))
    test = is_test(F.col("path"))
    rows = rows.select("request_id", "path", "file_ord", "line_count", is_changed.alias("changed"), g.alias("g"), reasons.alias("reasons"), F.when(is_changed, 0).otherwise(F.col("depth")).alias("depth"), c0.alias("c"), test.alias("test"))
    if not config.include_tests:
        rows = rows.where(~F.col("test"))
    bonus = F.col("test") & (F.col("g") > 0)
    c1 = F.when(bonus, F.least(F.lit(1.0), F.col("c") + 0.15)).otherwise(F.col("c"))
    r1 = F.when(bonus, F.concat("reasons", F.array(F.lit("test coverage bonus")))).otherwise(F.col("reasons"))
    rows = rows.withColumns({"c": c1, "reasons": r1})
    rows = rows.withColumn("c", F.when(F.exists("reasons", lambda r: F.contains(r, F.lit("dynamic_import"))), F.col("c") * 0.8).otherwise(F.col("c")))
    large = (F.col("line_count") > 1000) & ~F.col("changed")
    rows = rows.withColumns({"c": F.when(large, F.col("c") * 0.85).otherwise(F.col("c")), "reasons": F.when(large, F.concat("reasons", F.array(F.lit("large file penalty")))).otherwise(F.col("reasons"))})
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c")))
    mode = F.when(c >= config.smart_threshold, FULL).otherwise(SIGNATURES) if config.output_mode == SMART else F.lit(config.output_mode)
    rows = rows.select("request_id", "path", "file_ord", F.round(c, 4).alias("score"), "reasons", "depth", mode.alias("output_mode"), "changed")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "file_ord")))
