"""Analyses over a built graph: risk, flows, communities, dead code, large symbols, wiki, refactoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ValidationError
from ..functions.text import file_of, security_hits, stem
from ..staging import numbered, staged
from .traverse import Reach, count_by_entry, propagate_labels, reach_sets, reached, sweep_labels


def caller_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, callers: edges that point at a file's symbols."""
    into = edges.groupBy(F.col("target_id").alias("node_id")).count()
    return into.join(nodes.select("node_id", F.col("file_path").alias("path")), "node_id").groupBy("path").agg(F.sum("count").alias("callers"))


def tested_files(files: DataFrame) -> DataFrame:
    """path of files whose ``test_{stem}`` or ``{stem}_test`` occurs in another file's stem.

    The stem is cut out of every other stem around the marker, which makes this an equi join.
    """
    stems = files.select("path", F.lower(stem(F.col("path"))).alias("s"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    after, before = F.split(F.col("s"), "test_", -1), F.split(F.col("s"), "_test", -1)
    tails = F.flatten(F.transform(F.sequence(F.lit(1), F.size(after)), lambda i: F.when(i > 1, ends(F.array_join(F.slice(after, i, F.size(after)), "test_"))).otherwise(F.expr("cast(array() as array<string>)"))))
    head = lambda i: F.array_join(F.slice(before, 1, i), "_test")
    tips = lambda h: F.transform(F.sequence(F.lit(1), F.length(h)), lambda n: F.substring(h, -n, n))
    heads = F.flatten(F.transform(F.sequence(F.lit(1), F.size(before)), lambda i: F.when((i < F.size(before)) & (F.length(head(i)) > 0), tips(head(i))).otherwise(F.expr("cast(array() as array<string>)"))))
    marked = stems.where(F.contains("s", F.lit("test_")) | F.contains("s", F.lit("_test")))
    by = marked.select(F.col("path").alias("other"), F.explode(F.array_distinct(F.concat(F.filter(tails, lambda x: x != ""), heads))).alias("s"))
    return stems.join(by, "s").where("path <> other").select("path").distinct()


def risk(files: DataFrame, nodes: DataFrame, edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """path, risk_score, reasons, callers, hits, has_test."""
    rows = files.select("path").join(caller_counts(nodes, edges), "path", "left")
    rows = rows.join(corpus.select("path", security_hits(F.col("source")).alias("hits")), "path", "left")
    rows = rows.join(tested_files(files).withColumn("has_test", F.lit(True)), "path", "left")
    rows = rows.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("callers", "hits")), F.coalesce("has_test", F.lit(False)).alias("has_test"))
    score = 0.4 * F.least(F.lit(1.0), F.col("callers") / 20) + 0.4 * F.least(F.lit(1.0), F.col("hits") / 5) + 0.2 * F.when(F.col("has_test"), 0.0).otherwise(0.5)
    reasons = F.array_compact(F.array(
        F.when(F.col("callers") > 10, F.format_string("high caller count (%d)", "callers")),
        F.when(F.col("hits") > 0, F.format_string("security-relevant (%d keywords)", "hits")),
        F.when(~F.col("has_test"), F.lit("no test coverage detected")),
    ))
    return rows.select("path", F.round(score, 4).alias("risk_score"), reasons.alias("reasons"), "callers", "hits", "has_test")


#: Names and decorators that mark entry points.
ENTRY_NAMES = r"(?i)^(main|run|execute|handle|dispatch|start|serve|__call__|__main__)$|^test_"
ENTRY_DECORATORS = r"(?i)(command|route|get|post|put|delete|patch|task|celery|handler|endpoint)"


def flow_reach(nodes: DataFrame, edges: DataFrame, max_depth: int = 15, max_flows: int = 500) -> tuple[DataFrame, Reach]:
    """(the first entry points: entry, flow_name; what they reach over calls, imports and bases)."""
    called = edges.where("kind = 'calls'").select(F.col("target_id").alias("node_id")).distinct().withColumn("called", F.lit(True))
    rows = nodes.where("kind in ('function', 'method', 'module')").join(called, "node_id", "left")
    entry = F.col("called").isNull() | F.col("name").rlike(ENTRY_NAMES) | F.exists("decorators", lambda d: d.rlike(ENTRY_DECORATORS))
    first = staged(rows.where(entry).orderBy("file_ord", "sym_ord", "node_id").limit(max_flows).select(F.col("node_id").alias("entry"), F.col("name").alias("flow_name")), "entries")
    known = edges.where("kind in ('calls', 'imports', 'inherits')").join(nodes.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    return first, reach_sets(known, first, max_depth)


def flows(nodes: DataFrame, edges: DataFrame, max_depth: int = 15, max_flows: int = 500, found: tuple[DataFrame, Reach] | None = None) -> DataFrame:
    """entry, flow_name, node_count, file_count, depth, criticality: what entry points reach over calls, imports and bases;
    ``found`` (as ``flow_reach`` gives it) spares the traversal."""
    first, reach = found or flow_reach(nodes, edges, max_depth, max_flows)
    degree = edges.groupBy(F.col("target_id").alias("entry")).agg(F.count("*").alias("degree"))
    files = reach.sets.join(reach.ids.select("id", file_of(F.col("node_id")).alias("file")), "id").groupBy("block", "file").agg(F.bit_or("bits").alias("bits"))
    sized = count_by_entry(reach.sets, reach.places, "node_count").join(count_by_entry(files, reach.places, "file_count"), "entry").where("node_count >= 2").join(degree, "entry", "left")
    weight = F.log1p(F.coalesce("degree", F.lit(0)) + 1) * F.log1p(F.col("node_count"))
    named = sized.join(first, "entry")
    return named.select("entry", "flow_name", "node_count", "file_count", F.least(F.lit(max_depth).cast("long"), "node_count").alias("depth"), F.round(weight, 4).alias("criticality"))


def numbered_flows(flow_table: DataFrame) -> DataFrame:
    """Flows with flow_id from 1, most critical first."""
    return numbered(flow_table, "__n", F.desc("criticality"), "entry").withColumn("flow_id", F.col("__n") + 1).drop("__n")


def get_flow(flow_table: DataFrame, nodes: DataFrame, edges: DataFrame, flow_id: int | None = None, flow_name: str = "", most: int = 50, corpus: DataFrame | None = None, reach: Reach | None = None) -> DataFrame:
    """At most one row: a flow by its number, or the first whose name holds a text, with its first nodes by depth and id;
    with ``corpus`` also source_snippets (file, source), the beginnings of the files of its first ten nodes. ``reach`` is the flows'."""
    rows = numbered_flows(flow_table)
    rows = rows.where(F.col("flow_id") == flow_id) if flow_id is not None else rows.where(F.contains(F.lower("flow_name"), F.lit(flow_name.lower()))).orderBy("flow_id").limit(1)
    rows = staged(rows, "flow")
    first = staged(reached(reach or flow_reach(nodes, edges)[1], rows).orderBy("depth", "node_id").limit(most), "flow-nodes")
    listed = first.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    out = rows.join(listed, "entry").select("flow_id", "flow_name", F.col("entry").alias("entry_point"), "node_count", "criticality", "nodes")
    if corpus is None:
        return out
    ten = first.orderBy("depth", "node_id").limit(10).groupBy(file_of(F.col("node_id")).alias("path")).agg(F.min(F.struct("depth", "node_id")).alias("at"))
    texts = corpus.join(F.broadcast(ten), "path").select("at", F.struct(F.col("path").alias("file"), F.substring("source", 1, 300).alias("source")).alias("snippet"))  # ten: ten rows
    gathered = texts.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "snippet"))), lambda x: x["snippet"]).alias("source_snippets"))
    return out.join(F.broadcast(gathered), F.lit(True))  # one row


def overview(files: DataFrame, nodes: DataFrame, edges: DataFrame, risks: DataFrame, community: DataFrame, schema_version: int = 0) -> DataFrame:
    """section, position, name, value: totals, the 20 largest communities by number, and the ten riskiest files from 0.5 on."""
    count = lambda df, k, name: df.agg(F.lit("total").alias("section"), F.lit(k).alias("position"), F.lit(name).alias("name"), F.count("*").cast("double").alias("value"))
    out = count(nodes, 1, "nodes").unionByName(count(edges, 2, "edges")).unionByName(count(files, 3, "files")).unionByName(count(community, 4, "communities"))
    out = out.unionByName(files.sparkSession.createDataFrame([("total", 5, "schema_version", float(schema_version))], "section string, position int, name string, value double"))
    large = community.orderBy("community_id").limit(20).select(F.lit("community").alias("section"), (F.col("community_id") + 1).cast("int").alias("position"), F.col("label").alias("name"), F.col("node_count").cast("double").alias("value"))
    top = risks.where("risk_score >= 0.5").orderBy(F.desc("risk_score"), "path").limit(10)
    place = F.row_number().over(Window.orderBy(F.desc("risk_score"), "path"))  # ten rows
    return out.unionByName(large).unionByName(top.select(F.lit("high_risk_file").alias("section"), place.alias("position"), F.col("path").alias("name"), F.col("risk_score").alias("value")))


def get_community(community: DataFrame, community_id: int | None = None, name: str = "", include_members: bool = False) -> DataFrame:
    """At most one row: a community by its number, or the first whose label holds a text."""
    rows = community.where(F.col("community_id") == community_id) if community_id is not None else community.where(F.contains(F.lower("label"), F.lit(name.lower()))).orderBy("community_id").limit(1)
    return rows.select("community_id", "label", "node_count", *(["members"] if include_members else []))


def wiki_page(pages: DataFrame, name: str) -> DataFrame:
    """page_name, content of one page: the first by name whose name holds a text, whatever its case."""
    part = F.regexp_replace(F.lit(name.lower()), "[^a-z0-9_-]", "_")
    return pages.where(F.contains(F.lower("page_name"), part)).orderBy("page_name").limit(1)


def suggestions(dead: DataFrame) -> DataFrame:
    """suggestion: a line per unused symbol."""
    return dead.select(F.format_string("Consider removing unused %s '%s' in %s:%d", "kind", "name", "file_path", "line_start").alias("suggestion"))


def refactor(nodes: DataFrame, edges: DataFrame, mode: str = "rename", **params) -> DataFrame:
    """rename (old_name, new_name), dead_code (kind, file_pattern, limit) or suggest."""
    if mode == "rename":
        if not params.get("old_name") or not params.get("new_name"):
            raise ValidationError("old_name and new_name are required", {"mode": ["rename needs both names"]})
        return rename_preview(nodes, params["old_name"], params["new_name"])
    if mode == "dead_code":
        return dead_code(nodes, edges, **params)
    if mode == "suggest":
        return suggestions(dead_code(nodes, edges, limit=params.get("limit", 10)))
    raise ValidationError(f"unknown mode {mode}", {"mode": ["rename, dead_code or suggest"]})


def max_risk(requests: DataFrame, risks: DataFrame) -> DataFrame:
    """request_id, max_risk_score: of the changed files; 0 where none is indexed."""
    rows = requests.select("request_id", F.explode_outer("changed_files").alias("path")).join(risks.select("path", "risk_score"), "path", "left")
    return rows.groupBy("request_id").agg(F.round(F.coalesce(F.max("risk_score"), F.lit(0.0)), 3).alias("max_risk_score"))


#: Columns that a short answer leaves out.
VERBOSE = ("source_preview", "source", "rendered_context", "nodes", "metadata")


def compact(rows: DataFrame, detail_level: str) -> DataFrame:
    return rows.drop(*VERBOSE) if detail_level == "minimal" else rows


def with_preview(rows: DataFrame, corpus: DataFrame, most: int = 500) -> DataFrame:
    """Rows (path, ...) with source_preview: the beginning of each file, empty for unknown or empty ones."""
    text = F.concat(F.substring("source", 1, most), F.lit("..."))
    return rows.join(corpus.select("path", F.when(F.length("source") > 0, text).otherwise("").alias("source_preview")), "path", "left").fillna("", ["source_preview"])


def affected_flows(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Flows that touch a changed file (path), most critical first."""
    first, reach = flow_reach(nodes, edges)
    own = reach.ids.join(changed.select(F.col("path").alias("file")), file_of(F.col("node_id")) == F.col("file"), "left_semi").select("id")
    touched = reach.sets.join(own, "id", "left_semi").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    hit = reach.places.join(touched, "block").where("shiftright(bits, bit) & 1 = 1").select("entry")
    return flows(nodes, edges, found=(first, reach)).join(hit, "entry", "left_semi").orderBy(F.desc("criticality"), "entry")


def file_links(edges: DataFrame) -> DataFrame:
    """Pairs of files (a, b) whose module nodes an edge joins."""
    ends = edges.where(F.endswith("source_id", F.lit("::__module__")) & F.endswith("target_id", F.lit("::__module__")))
    return ends.select(file_of(F.col("source_id")).alias("a"), file_of(F.col("target_id")).alias("b")).distinct()


def file_labels(files: DataFrame, edges: DataFrame, rounds: int = 10, in_order: bool = False) -> DataFrame:
    """node, label of files: by halves that settle soon, or ``in_order``, as a sweep over the files one by one gives them."""
    if not in_order:
        return propagate_labels(file_links(edges), rounds)
    return sweep_labels(file_links(edges), files.select(F.col("path").alias("node"), F.col("file_ord").alias("pos")), rounds)


def communities(files: DataFrame, edges: DataFrame, min_size: int = 2, rounds: int = 10, labels: DataFrame | None = None) -> DataFrame:
    """community_id, label, node_count, dominant_language, members (first 20), key; ``labels`` (node, label) spares the rounds."""
    labels = (file_labels(files, edges, rounds) if labels is None else labels).join(files.select(F.col("path").alias("node"), "language", "file_ord"), "node")
    size = labels.groupBy("label").agg(F.count("*").alias("node_count"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("file_ord").alias("first"))
    size = size.where(F.col("node_count") >= min_size)
    lang = labels.groupBy("label", "language").agg(F.count("*").alias("n"), F.min("file_ord").alias("at"))
    lang = lang.groupBy("label").agg(F.min_by("language", F.struct(-F.col("n"), F.col("at"))).alias("dominant_language"))
    spot = labels.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("file_ord"))).where("r <= 20")
    members = spot.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("members"))
    # The common folder of a set of paths is that of its smallest and largest path.
    low, high = F.split("low", "/"), F.split("high", "/")
    shared = F.filter(F.zip_with(F.slice(low, 1, F.size(low) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: F.when(a == b, a)), lambda x: F.lit(True))
    stop = F.array_position(F.transform(shared, lambda x: x.isNull()), True)
    prefix = F.array_join(F.when(stop > 0, F.slice(shared, 1, F.greatest(F.lit(0), (stop - 1).cast("int")))).otherwise(shared), "/")
    out = numbered(size.join(lang, "label").join(members, "label"), "community_id", F.desc("node_count"), "first")
    return out.select("community_id", prefix.alias("label"), "node_count", "dominant_language", "members", F.col("label").alias("key"))


def dead_code(nodes: DataFrame, edges: DataFrame, kind: str | None = None, file_pattern: str | None = None, limit: int | None = 50) -> DataFrame:
    """Symbols other than modules that no edge points at, in order."""
    rows = nodes.where("kind <> 'module'").join(edges.select(F.col("target_id").alias("node_id")).distinct(), "node_id", "left_anti")
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.contains("file_path", F.lit(file_pattern))) if file_pattern else rows
    return rows.orderBy("file_ord", "sym_ord").limit(limit) if limit else rows


def large_symbols(nodes: DataFrame, min_lines: int = 50, kind: str | None = None, path_part: str | None = None, limit: int | None = 50) -> DataFrame:
    rows = nodes.withColumn("lines", F.col("line_end") - F.col("line_start")).where((F.col("lines") >= min_lines) & (F.col("line_end") > 0))
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.contains("file_path", F.lit(path_part))) if path_part else rows
    return rows.orderBy(F.desc("lines"), "node_id").limit(limit) if limit else rows


def rename_preview(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Edits that renaming a symbol would make."""
    hits = nodes.where((F.col("name") == old) | (F.col("qualified_name") == old))
    refactor = F.substring(F.sha2(F.lit(f"{old}->{new}"), 256), 1, 8)
    return hits.select(refactor.alias("refactor_id"), "node_id", "file_path", F.col("line_start").alias("line"), F.lit(old).alias("old_name"), F.lit(new).alias("new_name"))


def apply_rename(corpus: DataFrame, preview: DataFrame, root: str = "") -> DataFrame:
    """A new corpus with the old name replaced in files of the preview below ``root``; nothing is written in place."""
    hit = preview.where(F.startswith("file_path", F.lit(root))).select(F.col("file_path").alias("path"), "old_name", "new_name").distinct()
    rows = corpus.join(hit, "path", "left")
    return rows.withColumn("source", F.when(F.col("old_name").isNotNull(), F.replace("source", "old_name", "new_name")).otherwise(F.col("source"))).drop("old_name", "new_name")


def wiki_pages(community: DataFrame, risks: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """page_name, content: a Markdown page per community, from all its files in ``labels`` (node, label).

    A page shows the first 50 files and 20 symbols by name, and every file of high risk.
    """
    rows = community.select("community_id", "label", "node_count", "dominant_language", "key").join(labels.select(F.col("label").alias("key"), F.col("node").alias("path")), "key").drop("key")
    high = risks.where("risk_score >= 0.6").select("path", F.lit(True).alias("high"))
    rows = rows.join(high, "path", "left")
    line = F.concat(F.lit("- `"), "path", F.lit("`"), F.when(F.col("high"), " [HIGH RISK]").otherwise(""))
    # What a page shows is kept before it is gathered: the first files by path, and those of high risk.
    place = F.row_number().over(Window.partitionBy("community_id").orderBy("path"))
    shown = rows.withColumn("line", line).withColumn("r", place).where("r <= 50").groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("m"))
    risky = rows.where("high").groupBy("community_id").agg(F.sort_array(F.collect_list("path")).alias("risky"))
    body = community.select("community_id", "label", "node_count", "dominant_language").join(shown, "community_id").join(risky, "community_id", "left")
    keys = rows.join(nodes.where("kind <> 'module'").select(F.col("file_path").alias("path"), "name"), "path").select("community_id", "name").distinct()
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("name"))).where("r <= 20").groupBy("community_id").agg(F.sort_array(F.collect_list("name")).alias("symbols"))
    out = body.join(keys, "community_id", "left")
    title = F.when(F.col("label") == "", F.concat(F.lit("community_"), "community_id")).otherwise(F.col("label"))
    content = F.concat(
        F.lit("# "), title, F.lit("\n\n- id: "), "community_id", F.lit("\n- files: "), "node_count", F.lit("\n- language: "), "dominant_language", F.lit("\n\n## Members\n"),
        F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.when(F.col("node_count") > 50, F.format_string("\n- _...and %d more_", F.col("node_count") - 50)).otherwise(""), F.lit("\n\n## Key symbols\n"), F.coalesce(F.array_join("symbols", ", "), F.lit("")),
        F.lit("\n\n## High risk\n"), F.coalesce(F.array_join("risky", "\n"), F.lit("")), F.lit("\n"),
    )
    return out.select(F.regexp_replace(title, "[^A-Za-z0-9_-]", "_").alias("page_name"), content.alias("content"))


def wiki_changes(pages: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """One row: generated, updated, unchanged."""
    old = existing.select("page_name", F.col("content").alias("old"))
    state = F.when(F.col("old").isNull(), "generated").when((F.col("old") == F.col("content")) & F.lit(not force), "unchanged").otherwise("updated")
    rows = pages.join(old, "page_name", "left").withColumn("state", state)
    return rows.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("generated", "updated", "unchanged")))


def doc_sections(docs: DataFrame, keyword: str, most: int = 4_000) -> DataFrame:
    """path, section: from the first heading that holds the keyword to the next of its level or above, else the head."""
    lines = docs.select("path", "source", F.split("source", "\n", -1).alias("l"))
    level = lambda x: F.length(F.regexp_extract(x, r"^(#+)\s", 1))
    heads = F.transform("l", lambda x, i: F.struct(i.alias("i"), level(x).alias("level"), F.contains(F.lower(x), F.lit(keyword.lower())).alias("hit")))
    first = F.get(F.filter(heads, lambda h: (h["level"] > 0) & h["hit"]), 0)
    rows = lines.select("path", "source", "l", first.alias("first"), heads.alias("heads"))
    end = F.get(F.filter("heads", lambda h: (h["i"] > F.col("first.i")) & (h["level"] > 0) & (h["level"] <= F.col("first.level"))), 0)["i"]
    body = F.array_join(F.slice("l", F.col("first.i") + 1, F.coalesce(end, F.size("l")) - F.col("first.i")), "\n")
    return rows.select("path", F.substring(F.when(F.col("first").isNull(), F.col("source")).otherwise(body), 1, most).alias("section"), F.col("first").isNotNull().alias("found"))


def graph_html(nodes: DataFrame, edges: DataFrame, files: DataFrame, most_files: int = 300, most_edges: int = 1_000) -> DataFrame:
    """html: a page with the first files and edges between them as JSON (a preview, so its limits are its feature)."""
    shown = files.orderBy("file_ord").limit(most_files).select("path", "language")
    pairs = edges.select(file_of(F.col("source_id")).alias("source"), file_of(F.col("target_id")).alias("target"), "kind", "edge_ord")
    for end in ("source", "target"):
        pairs = pairs.join(F.broadcast(shown.select(F.col("path").alias(end))), end, "left_semi")  # at most most_files rows
    links = pairs.orderBy("edge_ord").limit(most_edges).agg(F.to_json(F.collect_list(F.struct("source", "target", "kind"))).alias("links"))
    points = shown.agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "language")))).alias("nodes"))
    page = F.concat(F.lit("<!doctype html><meta charset='utf-8'><title>Graph</title><script>const nodes="), "nodes", F.lit(",links="), "links", F.lit(";</script>"))
    return points.join(links, F.lit(True)).select(page.alias("html"))
