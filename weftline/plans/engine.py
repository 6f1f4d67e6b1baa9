"""The engine: index a corpus, build contexts, answer named queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SIGNATURES, ContextConfig
from ..errors import ValidationError, WeftlineError
from ..functions.text import excluded, token_estimate
from ..operators import analyse, fulltext, search
from ..operators.delta import Delta, change
from ..operators.edges import build_edges, resolved_names
from ..operators.parse import index_stats, nodes_of, parsed
from ..operators.rank import keyword_scores, rank_files
from ..operators.select import review_snippets, select_files
from ..operators.traverse import propagate_labels, ranked_neighbors
from ..staging import staged


def first_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best rows of each request, by score and path."""
    at = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "path"))
    return rows.withColumn("at", at).where(F.col("at") <= limit).drop("at")


class Engine:
    """A corpus (path, source, file_ord) as files, nodes, resolved import names (links) and edges, each written once:
    files and nodes at the start, links and edges, which follow from these, when they are first asked for."""

    def __init__(self, corpus: DataFrame, config: ContextConfig | None = None, compress: Callable[[Column, float], Column] | None = None):
        self.config, self.compress = config or ContextConfig(), compress
        self.corpus = self._shown(corpus)
        self.files = staged(parsed(self.corpus), "files")
        self.nodes = staged(nodes_of(self.files), "nodes")
        self._index: DataFrame | None = None
        self.delta: Delta | None = None
        self._before: Engine | None = None

    @cached_property
    def links(self) -> DataFrame:
        rows = resolved_names(self.files) if self._before is None else self.delta.merged_links(self._before.links)
        return staged(rows, "links")

    @cached_property
    def edges(self) -> DataFrame:
        rows = build_edges(self.files, self.nodes, self.links) if self._before is None else self.delta.merged_edges(self._before.edges)
        return staged(rows, "edges")

    @classmethod
    def of_tables(cls, corpus: DataFrame, files: DataFrame, nodes: DataFrame, links: DataFrame, edges: DataFrame, config: ContextConfig | None = None, compress: Callable[[Column, float], Column] | None = None) -> Engine:
        """An engine over tables that are there already, as in a store; nothing is parsed."""
        self = object.__new__(cls)
        self.corpus, self.config, self.compress = corpus, config or ContextConfig(), compress
        self.files, self.nodes, self.links, self.edges, self._index, self.delta, self._before = files, nodes, links, edges, None, None, None
        return self

    def stats(self) -> DataFrame:
        edges = self.edges.agg(F.count("*").alias("edges_created"))
        return index_stats(self.files).join(edges, F.lit(True))

    def _seeds(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id", F.explode("changed_files").alias("path"))

    def impact(self, requests: DataFrame, max_depth: int | None = None, min_score: float = 0.0) -> DataFrame:
        out = ranked_neighbors(self.nodes, self.edges, self._seeds(requests), max_depth or self.config.max_depth, self.config.include_dynamic, self.config.decay)
        return out.where(F.col("score") >= min_score)

    def ranked(self, requests: DataFrame) -> DataFrame:
        ok = self.files.where("error is null")
        graph, words = staged(self.impact(requests), "impact"), staged(keyword_scores(ok, requests), "keyword-scores")  # columns of either are read many times
        return rank_files(ok, graph, words, self._seeds(requests), self.config)

    def context(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(selected files with text, result row per request). Requests without changed files are refused."""
        if requests.where(F.size("changed_files") == 0).limit(1).count():
            raise ValidationError("changed_files must not be empty", {"changed_files": ["must not be empty"]})
        ranked = staged(self.ranked(requests), "ranked")
        chosen, totals = select_files(ranked, self.files, self.corpus, self.config, self.compress)
        chosen = staged(chosen, "selected")
        texts = chosen.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "path", "rendered"))).alias("s"))  # within the budget
        scanned = self.files.agg(F.count_if(F.col("error").isNull()).alias("files_scanned"))
        saving = F.round(F.when(F.col("original") > 0, 1 - F.col("used") / F.col("original")).otherwise(0.0), 4)
        out = requests.join(totals, "request_id").join(texts, "request_id", "left").join(F.broadcast(scanned), F.lit(True))  # scanned: one row
        header = F.concat(F.lit("# Context\n"), F.lit("Commit: "), F.coalesce("commit_message", F.lit("")), F.lit("\nQuery: "), F.coalesce("query", F.lit("")), F.lit("\nChanged: "), F.array_join("changed_files", ", "), F.lit("\n\n"))
        return chosen, out.select(
            "request_id", F.transform("s", lambda x: x["path"]).alias("selected_files"), F.concat(header, F.array_join(F.transform("s", lambda x: x["rendered"]), "\n\n")).alias("rendered_context"),
            F.col("original").alias("total_original_tokens"), F.col("used").alias("total_rendered_tokens"), saving.alias("reduction_ratio"), "files_scanned", F.col("n").alias("files_selected"),
            F.round(saving * 100, 2).alias("token_savings_pct"), F.round((1 - saving) * 100, 2).alias("token_kept_pct"),
        )

    def contexts(self, requests: DataFrame) -> DataFrame:
        """The result row of each request, and ``error``: a request that breaks a rule gets no result, the others do."""
        bad = F.coalesce(F.size("changed_files") <= 0, F.lit(True))
        rows = staged(requests.withColumn("error", F.when(bad, "changed_files must not be empty")), "requests")
        good = self.context(rows.where("error is null").drop("error"))[1].withColumn("error", F.lit(None).cast("string"))
        return good.unionByName(rows.where("error is not null").select("request_id", "error"), allowMissingColumns=True)

    def prompts(self, requests: DataFrame) -> DataFrame:
        """request_id, prompt: what a reviewing model would be sent."""
        _, out = self.context(requests)
        return out.join(requests.select("request_id", "query"), "request_id").select("request_id", F.concat("query", F.lit("\n\n"), "rendered_context").alias("prompt"))

    def minimal(self) -> Engine:
        """The same graph with signatures only and a small budget."""
        other, _ = object.__new__(Engine), self.edges  # which both share
        other.__dict__ = {**self.__dict__, "config": ContextConfig(token_budget=8_000, output_mode=SIGNATURES)}
        return other

    def review(self, requests: DataFrame, max_depth: int = 2) -> DataFrame:
        return review_snippets(self.ranked(requests), self.corpus, max_depth)

    def risk(self) -> DataFrame:
        return analyse.risk(self.files, self.nodes, self.edges, self.corpus)

    def postprocess(self, store=None, flows: bool = True, communities: bool = True, risk: bool = True, fts: bool = True) -> dict[str, DataFrame]:
        """Flows, communities, risk and the search index, in that order; each can be left out."""
        out: dict[str, DataFrame] = {}
        if flows:
            out["flows"] = analyse.flows(self.nodes, self.edges)
        if communities:
            out["communities"] = analyse.communities(self.files, self.edges)
        if risk:
            out["risk_index"] = self.risk()
        if fts:
            out["search_index"] = fulltext.by_token(fulltext.postings(self.nodes))
        if store is not None:
            for name in out:
                out[name] = store.write(name, out[name])
        if fts:
            self._index = out["search_index"]
        return out

    def search_index(self) -> DataFrame:
        """The postings of all symbols: those of the last ``postprocess``, else written once."""
        if self._index is None:
            self._index = staged(fulltext.by_token(fulltext.postings(self.nodes)), "postings")
        return self._index

    def save(self, store) -> None:
        """Replaces the store's tables by this graph."""
        for name, rows in (("files", self.files), ("nodes", self.nodes), ("links", self.links), ("edges", self.edges)):
            store.write(name, rows)

    @classmethod
    def load(cls, store, corpus: DataFrame, config: ContextConfig | None = None) -> Engine:
        """The engine of a stored graph; ``corpus`` has the sources, which a store does not keep."""
        return cls.of_tables(corpus, store.read("files"), store.nodes(), store.read("links"), store.read("edges"), config)

    def _shown(self, corpus: DataFrame) -> DataFrame:
        return corpus.where(~excluded(F.col("path"), self.config.exclude_patterns)) if self.config.exclude_patterns else corpus

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> Engine:
        """A new engine with changed files in place of old ones and without removed ones. Only changed files are
        parsed, and only edges that depend on them are made anew (``operators/delta.py``): at once if this engine has its
        edges already, as one of stored tables does, else when they are first asked for."""
        rows = self._shown(changed)
        fresh = staged(parsed(rows), "fresh")
        delta = change(self.files, self.nodes, lambda: self.links, fresh, removed)
        out = object.__new__(Engine)
        out.corpus = self.corpus.join(delta.paths, "path", "left_anti").unionByName(rows.select(*self.corpus.columns))
        out.config, out.compress, out._index, out.delta, out._before = self.config, self.compress, None, delta, self
        out.files, out.nodes = (staged(t, n) for n, t in zip(("files", "nodes"), delta.merged_nodes(self.files, self.nodes), strict=True))
        if "edges" in self.__dict__:
            _ = out.links, out.edges
        return out

    def embed(self, store, force: bool = False) -> DataFrame:
        """One row: status, nodes_embedded, vocab_size, embed_version. Term weights are written to the store's
        ``embeddings`` once; a store that has them is left alone unless ``force``."""
        row = "status string, nodes_embedded long, vocab_size long, embed_version string"
        if store.exists("embeddings") and store.fact("embed_version") and not force:
            return store.spark.createDataFrame([("already_embedded", None, None, store.fact("embed_version"))], row)
        weights = store.write("embeddings", search.tfidf(self.nodes))
        store.upsert("graph_meta", store.spark.createDataFrame([("embed_version", search.EMBED_VERSION)], "key string, value string"))
        counts = weights.agg(F.countDistinct("node_id").alias("nodes_embedded"), F.countDistinct("token").alias("vocab_size"))
        return counts.select(F.lit("embedded").alias("status"), "nodes_embedded", "vocab_size", F.lit(search.EMBED_VERSION).alias("embed_version"))

    def detect_changes(self, requests: DataFrame, max_depth: int = 4, include_source: bool = False, limit: int = 50) -> DataFrame:
        """Affected files of each request, the best ``limit``, with their risk and the largest of its changed files."""
        risks = staged(self.risk().select("path", "risk_score"), "risk")
        out = first_of_each(self.impact(requests, max_depth), limit).join(risks, "path", "left").fillna(0.0, ["risk_score"])
        out = out.join(analyse.max_risk(requests, risks), "request_id")
        return analyse.with_preview(out, self.corpus) if include_source else out

    def file_summary(self, target: str, limit: int = 5) -> DataFrame:
        """seed, file, language, symbols, token_estimate: the files of the first symbols that match."""
        seeds = search.search_symbols(self.nodes, target, limit).select(F.col("node_id").alias("seed"), F.col("file_path").alias("path"))
        return self._summaries(seeds)

    def _summaries(self, seeds: DataFrame) -> DataFrame:
        return seeds.join(self.files, "path").select("seed", F.col("path").alias("file"), "language", F.size("symbols").alias("symbols"), "token_estimate")

    def list_flows(self, sort_by: str = "criticality", limit: int = 50) -> DataFrame:
        """Flows by criticality, node_count, file_count (largest first) or name."""
        key = {"node_count": F.desc("node_count"), "file_count": F.desc("file_count"), "name": F.asc("flow_name")}.get(sort_by, F.desc("criticality"))
        return analyse.flows(self.nodes, self.edges).orderBy(key, "entry").limit(limit)

    def list_communities(self, sort_by: str = "size", min_size: int = 2, limit: int = 50) -> DataFrame:
        """Communities by size (largest first) or name."""
        key = F.asc("label") if sort_by == "name" else F.desc("node_count")
        return analyse.communities(self.files, self.edges, min_size).orderBy(key, "community_id").limit(limit)

    def query_graph(self, pattern: str, target: str, limit: int = 20) -> DataFrame:
        if pattern == "file_summary":
            return self.file_summary(target)
        seeds = search.search_symbols(self.nodes, target, 5).select(F.col("node_id").alias("seed"))
        return search.edge_query(pattern, seeds, self.nodes, self.edges, limit)

    def index_summary(self) -> DataFrame:
        """One row: the counts and a sentence."""
        line = F.format_string("%d files, %d symbols, %d edges", "files_indexed", "symbols_extracted", "edges_created")
        return self.stats().withColumn("summary", line)

    # Named queries -----------------------------------------------------------------------------

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        """Named queries; each returns a DataFrame."""
        n, e, f = self.nodes, self.edges, self.files
        return {
            "get_context": lambda requests: self.context(requests)[1],
            "minimal_context": lambda requests: self.minimal().context(requests)[1],
            "get_impact": self.impact,
            "get_impact_radius": lambda requests, max_depth=2, min_score=0.1, limit=50: first_of_each(self.impact(requests, max_depth, min_score), limit),
            "graph_status": self.stats,
            "list_graph_stats": self.index_summary,
            "search_symbols": lambda needle, limit=20: search.search_symbols(n, needle, limit),
            "semantic_search_nodes": lambda query, kind=None, limit=20: fulltext.find_nodes(self.search_index(), n, query, kind, limit),
            "similar_nodes": lambda query, limit=20, store=None: search.semantic_search(store.read("embeddings") if store else search.tfidf(n), query, limit),
            "cross_repo_search": lambda repos, query, kind=None, limit=20: search.cross_repo(self.search_index(), n, repos, query, kind, limit),
            "list_repos": lambda store: store.repos(),
            "list_files": lambda limit=100: f.select("path", "language", "token_estimate").orderBy(F.desc("token_estimate"), "path").limit(limit),
            "get_file_context": lambda path: self.corpus.where(F.endswith("path", F.lit(path)) | F.endswith(F.lit(path), F.col("path"))).orderBy("file_ord").limit(1),
            "detect_changes": self.detect_changes,
            "query_graph": self.query_graph,
            "get_review_context": self.review,
            "list_flows": self.list_flows,
            "list_communities": self.list_communities,
            "get_flow": lambda include_source=False, **k: analyse.get_flow(analyse.flows(n, e, found=(r := analyse.flow_reach(n, e))), n, e, corpus=self.corpus if include_source else None, reach=r[1], **k),
            "get_affected_flows": lambda changed: analyse.affected_flows(n, e, changed),
            "get_community": lambda **k: analyse.get_community(analyse.communities(f, e), **k),
            "get_wiki_page": lambda name: analyse.wiki_page(self.wiki(), name),
            "refactor": lambda mode="rename", **k: analyse.refactor(n, e, mode, **k),
            "get_architecture_overview": self.overview,
            "find_dead_code": lambda **k: analyse.dead_code(n, e, **k),
            "find_large_functions": lambda **k: analyse.large_symbols(n, **k),
            "rename_preview": lambda old, new: analyse.rename_preview(n, old, new),
            "apply_refactor": lambda old, new, root="": analyse.apply_rename(self.corpus, analyse.rename_preview(n, old, new), root),
            "generate_wiki": self.wiki,
            "get_docs_section": lambda keyword: analyse.doc_sections(self.corpus, keyword),
            "embed_graph": lambda store=None, force=False: search.tfidf(n) if store is None else self.embed(store, force),
            "visualize": lambda: analyse.graph_html(n, e, f),
        }

    def query(self, name: str, /, **params) -> DataFrame:
        tools = self.tools()
        if name not in tools:
            raise WeftlineError(f"no query named {name}")
        return tools[name](**params)

    def wiki(self) -> DataFrame:
        """page_name, content: a page per community."""
        labels = propagate_labels(analyse.file_links(self.edges))
        return analyse.wiki_pages(analyse.communities(self.files, self.edges, labels=labels), self.risk(), self.nodes, labels)

    def overview(self, store=None) -> DataFrame:
        """section, position, name, value: totals, large communities, risky files; ``store`` gives the schema's version."""
        return analyse.overview(self.files, self.nodes, self.edges, self.risk(), analyse.communities(self.files, self.edges), store.schema_version() if store else 0)


def index_roots(roots: dict[str, DataFrame], config: ContextConfig | None = None) -> tuple[Engine, DataFrame]:
    """(one engine over all roots, stats per root): imports resolve across roots."""
    rows = None
    for i, (name, corpus) in enumerate(roots.items()):
        part = corpus.select("path", "source", (F.col("file_ord") + F.lit(i << 40)).alias("file_ord"), F.lit(name).alias("root"))
        rows = part if rows is None else rows.unionByName(part)
    engine = Engine(rows, config)
    which = F.element_at(F.array(*map(F.lit, roots)), F.shiftright("file_ord", 40).cast("int") + 1)
    ok = F.col("error").isNull()
    stats = engine.files.groupBy(which.alias("root")).agg(F.count_if(ok).alias("files_indexed"), F.count_if(~ok).alias("files_skipped"), F.sum(F.when(ok, F.size("symbols")).otherwise(0)).alias("symbols_extracted"))
    return engine, stats


def incremental(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the corpus whose (path, sha256) is not among the indexed files."""
    hashed = corpus.withColumn("sha256", F.sha2("source", 256))
    return hashed.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti").drop("sha256")


def token_total(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.sum(token_estimate(F.col("source"))).alias("tokens"))


def update_store(store, changed: DataFrame, removed: DataFrame | None = None, config: ContextConfig | None = None) -> Delta:
    """The same on a stored graph: buckets of the tables that hold a changed row are rewritten, no others.

    Edges come first and files last, so an update that broke off can be run again: until files
    and nodes are replaced, the same delta follows from them.
    """
    old = Engine.load(store, changed, config)
    fresh = staged(parsed(old._shown(changed)), "fresh")
    delta = change(old.files, old.nodes, lambda: old.links, fresh, removed)
    store.merge("edges", delta.sources, ["source_id", "step"], delta.edges)
    store.merge("links", delta.names, ["name"], delta.links)
    store.merge("nodes", delta.paths.withColumnRenamed("path", "file_path"), ["file_path"], delta.nodes)
    store.merge("files", delta.paths, ["path"], delta.files)
    return delta
