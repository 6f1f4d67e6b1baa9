"""Symbol search: substring, across repositories, TF-IDF, named edge patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import symbol_tokens
from .fulltext import find_nodes

#: Fixed value: version of stored term weights.
EMBED_VERSION = "1"


def search_symbols(nodes: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name or path holds a text, whatever its case."""
    low = F.lit(needle.lower())
    hits = nodes.where(F.contains(F.lower("qualified_name"), low) | F.contains(F.lower("name"), low) | F.contains(F.lower("file_path"), low))
    return hits.orderBy("node_id").limit(limit) if limit else hits


def cross_repo(index: DataFrame, nodes: DataFrame, repos: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """repo, root, name, qualified_name, kind, file, line by name: hits below the roots of ``repos`` (root, name), ``limit`` for each."""
    from pyspark.sql.window import Window

    hits = find_nodes(index, nodes, query, kind, None).withColumn("parts", F.split("file_path", "/"))
    # Every folder above a hit is a key, so roots of any depth are found by an equi join.
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    rows = hits.withColumn("root", F.explode(above)).join(repos.select("root", F.col("name").alias("repo")), "root")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("node_id"))).where(F.col("r") <= limit)
    return rows.select("repo", "root", "name", "qualified_name", "kind", F.col("file_path").alias("file"), F.col("line_start").alias("line")).orderBy("name", "root", "file")


def tfidf(nodes: DataFrame) -> DataFrame:
    """node_id, token, weight."""
    text = F.concat_ws(" ", "name", "qualified_name", "signature", "file_path")
    tokens = nodes.select("node_id", symbol_tokens(text).alias("t")).where(F.size("t") > 0)
    tf = tokens.select("node_id", F.size("t").alias("len"), F.explode("t").alias("token")).groupBy("node_id", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    total = nodes.agg(F.count("*").alias("n"))
    weight = F.col("tf") / F.col("len") * F.log((F.col("n") + 1) / (F.col("df") + 1))
    return tf.join(df, "token").join(F.broadcast(total), F.lit(True)).select("node_id", "token", F.round(weight, 6).alias("weight"))  # total: one row


def semantic_search(weights: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """node_id, score: nodes by the weight they give the query's tokens."""
    tokens = F.transform(F.array_distinct(symbol_tokens(F.lit(query))), lambda t: t)
    return weights.where(F.array_contains(tokens, F.col("token"))).groupBy("node_id").agg(F.round(F.sum("weight"), 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def edge_query(pattern: str, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """seed, hit, kind for a named pattern: callers_of, callees_of, children_of, imports_of,
    importers_of, tests_for, inheritors_of. ``seeds`` has seed (a node id)."""
    out = {"callees_of": True, "children_of": True, "imports_of": True, "callers_of": False, "importers_of": False, "tests_for": False, "inheritors_of": False}
    if pattern not in out:
        raise ValueError(f"unknown pattern {pattern}")
    near, far = ("source_id", "target_id") if out[pattern] else ("target_id", "source_id")
    rows = edges.select(F.col(near).alias("seed"), F.col(far).alias("node_id"), "kind", "edge_ord").join(seeds, "seed", "left_semi").join(nodes.select("node_id", "file_path"), "node_id")
    if pattern in ("imports_of", "importers_of"):
        rows = rows.where("kind = 'imports'")
    if pattern == "inheritors_of":
        rows = rows.where("kind = 'inherits'")
    if pattern == "tests_for":
        rows = rows.where(F.contains(F.lower("file_path"), F.lit("test")))
    rows = rows.select("seed", F.col("node_id").alias("hit"), "kind", "edge_ord")
    if limit:
        from pyspark.sql.window import Window

        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("edge_ord"))).where(F.col("r") <= limit).drop("r")
    return rows
