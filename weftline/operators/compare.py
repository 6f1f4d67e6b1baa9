"""Comparing results and checking requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, state (added, removed, kept), delta of two rankings (path, score)."""
    b, a = before.select("path", F.col("score").alias("b")), after.select("path", F.col("score").alias("a"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("kept")
    return b.join(a, "path", "full_outer").select("path", state.alias("state"), F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def score_changes(diff: DataFrame, least: float = 0.01) -> DataFrame:
    return diff.where((F.col("state") == "kept") & (F.abs("delta") > least)).orderBy(F.desc(F.abs("delta")), "path")


def result_diff(before: DataFrame, after: DataFrame, files_before: DataFrame, files_after: DataFrame, most: int = 10) -> DataFrame:
    """A row per request that both results (request_id, files_selected, total_rendered_tokens, reduction_ratio) have.

    ``files_before`` and ``files_after`` (request_id, path, score) are the selected files. Adds
    files_added and files_removed by path, score_changes (the ``most`` largest, of those above 0.01),
    token and reduction deltas, a ``summary`` text and everything as ``json``.
    """
    keys, facts = ["request_id", "path"], {"files_selected": "files", "total_rendered_tokens": "tokens", "reduction_ratio": "reduction"}
    both = files_before.select(*keys, F.col("score").alias("b")).join(files_after.select(*keys, F.col("score").alias("a")), keys, "full_outer")
    change = F.when(F.abs(F.col("a") - F.col("b")) > 0.01, F.struct((-F.abs(F.col("a") - F.col("b"))).alias("o"), "path", F.col("b").alias("before"), F.col("a").alias("after")))
    lists = both.groupBy("request_id").agg(  # a request's selected files fit its budget
        F.sort_array(F.collect_list(F.when(F.col("b").isNull(), F.col("path")))).alias("files_added"),
        F.sort_array(F.collect_list(F.when(F.col("a").isNull(), F.col("path")))).alias("files_removed"), F.sort_array(F.collect_list(change)).alias("c"),
    )
    side = lambda df, name: df.select("request_id", *(F.col(c).alias(f"{n}_{name}") for c, n in facts.items()))
    rows = side(before, "before").join(side(after, "after"), "request_id").join(lists, "request_id", "left")
    none = F.expr("cast(array() as array<string>)")
    shown = F.transform(F.slice("c", 1, most), lambda x: F.struct(x["path"].alias("path"), x["before"].alias("before"), x["after"].alias("after"), F.round(x["after"] - x["before"], 4).alias("delta")))
    rows = rows.select(
        "*", (F.col("tokens_after") - F.col("tokens_before")).alias("token_delta"), F.round(F.col("reduction_after") - F.col("reduction_before"), 4).alias("reduction_delta"),
        F.coalesce(F.size("c"), F.lit(0)).alias("scores_changed"), F.coalesce(shown, F.expr("cast(array() as array<struct<path:string,before:double,after:double,delta:double>>)")).alias("score_changes"),
    ).drop("c").fillna(0, ["scores_changed"]).withColumns({c: F.coalesce(c, none) for c in ("files_added", "files_removed")})
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    first = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(c, 1, 5), ", ")))
    summary = F.concat_ws(
        "\n", F.format_string("Files: %d to %d", "files_before", "files_after"), F.format_string("Tokens: %d to %d (%+d)", "tokens_before", "tokens_after", "token_delta"),
        F.concat(F.lit("Reduction: "), percent("reduction_before"), F.lit(" to "), percent("reduction_after")), first("files_added", "Added"), first("files_removed", "Removed"),
        F.when(F.col("scores_changed") > 0, F.format_string("Scores changed: %d", "scores_changed")),
    )
    return rows.select("*", summary.alias("summary"), F.to_json(F.struct(*[c for c in rows.columns if c != "request_id"])).alias("json"))


class RequestRules:
    """Rules over requests as columns: each breach is a message under its field."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, Column, str]] = []

    def add(self, field: str, ok: Column, message: str) -> RequestRules:
        self.rules.append((field, ok, message))
        return self

    def require_changed_files(self) -> RequestRules:
        return self.add("changed_files", F.size("changed_files") > 0, "changed_files must not be empty")

    def require_max_files(self, n: int) -> RequestRules:
        return self.add("changed_files", F.size("changed_files") <= n, f"more than {n} changed files")

    def require_extensions(self, allowed: set[str]) -> RequestRules:
        ok = F.forall("changed_files", lambda p: F.regexp_extract(p, r"(\.[^./]+)$", 1).isin(*sorted(allowed)))
        return self.add("changed_files", ok, "a changed file has another extension")

    def require_no_secrets(self) -> RequestRules:
        return self.add("query", ~F.coalesce("query", F.lit("")).rlike(r"sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}"), "the query holds a key")

    def validate(self, requests: DataFrame) -> DataFrame:
        """Adds violations: array of (field, message)."""
        found = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, ok, m in self.rules]
        empty = F.expr("cast(array() as array<struct<field:string,message:string>>)")
        return requests.withColumn("violations", F.array_compact(F.array(*found)) if found else empty)
