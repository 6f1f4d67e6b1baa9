
import json

import pytest
from pyspark.sql import functions as F

from weftline.config import ContextConfig
from weftline.errors import ConfigurationError, LanguageNotSupported, ValidationError
from weftline.operators import analyse, compare, control, parse, search
from weftline.operators.traverse import propagate_labels, ranked_neighbors
from weftline.plans.engine import Engine, incremental, index_roots
from weftline.plans.evolve import AnalysisPipeline, PlanCache, SchemaEvolution
from weftline.sources.files import load_sources, snapshot_diff
from weftline.sources.store import GraphStore

LEDGER = """import decimal


class Ledger:
    def __init__(self, rows):
        self.rows = list(rows)

    def add_entry(self, amount: decimal.Decimal) -> None:
        self.rows.append(amount)

    def total(self) -> decimal.Decimal:
        return sum(self.rows)


def open_ledger(rows=()):
    return Ledger(rows)
"""
REPORT = "from ledger import open_ledger\n\n\ndef render_report(rows):\n    return str(open_ledger(rows).total())\n"
TEST = "from ledger import Ledger, open_ledger\n\n\ndef test_total():\n    assert not open_ledger().total()\n\n\ndef test_open():\n    assert isinstance(open_ledger(), Ledger)\n"
WORDS = "def composed(word):\n    import unicodedata\n    return unicodedata.normalize('NFC', word)\n"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("lib/ledger.py", LEDGER, 0), ("lib/report.py", REPORT, 1), ("tests/test_ledger.py", TEST, 2), ("lib/words.py", WORDS, 3)]
    return Engine(spark.createDataFrame(rows, "path string, source string, file_ord long"))


@pytest.fixture(scope="module")
def request_(spark):
    row = (1, ["lib/ledger.py"], "", "fix ledger rounding", "Check ledger totals")
    return spark.createDataFrame([row], "request_id long, changed_files array<string>, diff_text string, commit_message string, query string")


def test_graph(engine):
    assert engine.nodes.count() == 13
    assert {(r["kind"], r["count"]) for r in engine.edges.groupBy("kind").count().collect()} == {("imports", 5)}
    module = engine.nodes.where("node_id = 'lib/ledger.py::__module__'").first()
    assert (module.name, module.qualified_name) == ("ledger", "ledger")


def test_ranking(engine, request_):
    """Worked by hand: one of five query terms, "ledger", occurs 4 times in 13 terms of the changed file and twice in 8 of its test."""
    bm25 = lambda tf, dl: min(1, 0.6931471805599453 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 20)) / 5)
    assert round(0.7 + 0.3 * bm25(4, 13), 4) == 0.7814 and round(0.49 + 0.3 * bm25(2, 8) + 0.15, 4) == 0.7136
    got = [(r.path, r.score, r.output_mode, r.reasons) for r in engine.ranked(request_).orderBy("rank").collect()]
    assert got == [
        ("lib/ledger.py", 0.7814, "full", ["directly changed"]),
        ("tests/test_ledger.py", 0.7136, "full", ["caller via imports (depth 1)", "test coverage bonus"]),
        ("lib/report.py", 0.49, "signatures", ["caller via imports (depth 1)"]),
    ]


def test_context(engine, request_):
    chosen, out = engine.context(request_)
    row = out.first()
    assert row.files_scanned == 4 and row.files_selected == 3 and "## lib/ledger.py" in row.rendered_context
    broken = request_.withColumn("changed_files", F.expr("cast(array() as array<string>)"))
    with pytest.raises(ValidationError):
        engine.context(broken)
    both = engine.contexts(request_.unionByName(broken.withColumn("request_id", F.lit(2).cast("long")))).orderBy("request_id").collect()
    assert [(r.error, r.files_selected) for r in both] == [(None, 3), ("changed_files must not be empty", None)]


def test_compression(spark, request_):
    rows = [("lib/ledger.py", LEDGER, 0)]
    small = Engine(spark.createDataFrame(rows, "path string, source string, file_ord long"), ContextConfig(output_mode="compressed"), lambda s, ratio: F.left(s, F.floor(F.length(s) * F.lit(ratio)).cast("int")))
    text = small.context(request_)[1].first().rendered_context
    assert LEDGER[:60] in text and LEDGER[-60:] not in text


def test_every_tool(spark, engine, request_, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/registry")
    store.register_repo("lib")
    store.register_repo("tests/", "checks")
    paths = {"lib/ledger.py", "tests/test_ledger.py", "lib/report.py"}
    top = lambda r: {x.path for x in r}
    want = {
        "get_context": ({"requests": request_}, lambda r: r[0].files_selected == 3), "minimal_context": ({"requests": request_}, lambda r: r[0].files_selected == 3),
        "get_impact": ({"requests": request_}, lambda r: top(r) == paths), "get_impact_radius": ({"requests": request_}, lambda r: top(r) == paths),
        "graph_status": ({}, lambda r: (r[0].files_indexed, r[0].symbols_extracted, r[0].edges_created) == (4, 13, 5)), "list_graph_stats": ({}, lambda r: r[0].summary == "4 files, 13 symbols, 5 edges"),
        "search_symbols": ({"needle": "LEDGER"}, lambda r: len(r) == 9), "semantic_search_nodes": ({"query": "open ledger", "kind": "function"}, lambda r: "lib/ledger.py::open_ledger" in {x.node_id for x in r}),
        "similar_nodes": ({"query": "render report"}, lambda r: r[0].node_id == "lib/report.py::render_report"), "cross_repo_search": ({"repos": store.repos(), "query": "total"}, lambda r: {(x.repo, x.name) for x in r} == {("lib", "total"), ("checks", "test_total")}),
        "list_repos": ({"store": store}, lambda r: {(x.root, x.name) for x in r} == {("lib", "lib"), ("tests", "checks")}), "list_files": ({}, lambda r: r[0].path == "lib/ledger.py"), "get_file_context": ({"path": "words.py"}, lambda r: r[0].source == WORDS),
        "detect_changes": ({"requests": request_, "include_source": True}, lambda r: top(r) == paths and {x.source_preview for x in r} == {LEDGER + "...", TEST + "...", REPORT + "..."}),
        "query_graph": ({"pattern": "callers_of", "target": "ledger"}, lambda r: {x.hit for x in r} == {"lib/report.py::__module__", "tests/test_ledger.py::__module__"}), "get_review_context": ({"requests": request_}, lambda r: r[0].path == "lib/ledger.py" and len(r) == 3),
        "list_flows": ({}, lambda r: {x.entry for x in r} == {"lib/report.py::__module__", "tests/test_ledger.py::__module__"}), "get_flow": ({"flow_name": "REPORT"}, lambda r: r[0].nodes == ["lib/report.py::__module__", "lib/ledger.py::__module__"]),
        "get_affected_flows": ({"changed": spark.createDataFrame([("lib/report.py",)], "path string")}, lambda r: [x.flow_name for x in r] == ["report"]),
        "list_communities": ({}, lambda r: [(x.node_count, x.label, x.dominant_language) for x in r] == [(3, "", "python")]), "get_community": ({"community_id": 0, "include_members": True}, lambda r: set(r[0].members) == paths),
        "get_wiki_page": ({"name": "community_0"}, lambda r: r[0].content.startswith("# community_0")), "generate_wiki": ({}, lambda r: [x.page_name for x in r] == ["community_0"]), "get_architecture_overview": ({}, lambda r: {x.name: x.value for x in r if x.section == "total"} == {"files": 4, "nodes": 13, "edges": 5, "communities": 1, "schema_version": 0} and [x.value for x in r if x.section == "community"] == [3]),
        "refactor": ({"mode": "suggest", "limit": 1}, lambda r: [x.suggestion for x in r] == ["Consider removing unused class 'Ledger' in lib/ledger.py:4"]), "find_dead_code": ({"kind": "function"}, lambda r: len(r) == 5), "find_large_functions": ({"min_lines": 1, "kind": "method"}, lambda r: len(r) == 3),
        "rename_preview": ({"old": "total", "new": "balance"}, lambda r: [(x.file_path, x.line) for x in r] == [("lib/ledger.py", 11)]), "apply_refactor": ({"old": "total", "new": "balance"}, lambda r: {x.path for x in r if "balance" in x.source} == {"lib/ledger.py"}),
        "get_docs_section": ({"keyword": "x"}, lambda r: len(r) == 4 and not any(x.found for x in r)), "embed_graph": ({}, lambda r: len(r) > 20), "visualize": ({}, lambda r: "lib/words.py" in r[0].html),
    }
    assert set(want) == set(engine.tools())
    for name, (arguments, holds) in want.items():
        got = engine.query(name, **arguments).collect()
        assert holds(got), (name, got)
    with pytest.raises(ValidationError):
        engine.query("refactor", mode="rename", old_name="x")


def test_roots_share_a_graph(spark):
    schema = "path string, source string, file_ord long"
    both, stats = index_roots({"a": spark.createDataFrame([("a/base.py", "x = 1\n", 0)], schema), "b": spark.createDataFrame([("b/user.py", "import base\n", 0), ("b/bad.py", "def (", 1)], schema)})
    assert [(r.source_id, r.target_id) for r in both.edges.collect()] == [("b/user.py::__module__", "a/base.py::__module__")]
    assert {(r.root, r.files_indexed, r.files_skipped) for r in stats.collect()} == {("a", 1, 0), ("b", 1, 1)}


def test_communities_settle(spark):
    """A pair, a star, a path and a clique each end as one group, whatever halves their nodes fall into."""
    links = [("pa", "pb"), *(("hub", f"leaf{i}") for i in range(9)), *((f"q{i}", f"q{i + 1}") for i in range(3)), *((f"k{i}", f"k{j}") for i in range(5) for j in range(i))]
    labels = {r.node: r.label for r in propagate_labels(spark.createDataFrame(links, "a string, b string")).collect()}
    for group in ("p", "k"):
        assert len({v for k, v in labels.items() if k.startswith(group)}) == 1
    assert len({labels["hub"], *(labels[f"leaf{i}"] for i in range(9))}) == 1
    assert len({labels[f"q{i}"] for i in range(4)}) <= 2 and all(sum(v == labels[f"q{i}"] for v in labels.values()) > 1 for i in range(4))


def test_limits_hold_for_each_request(spark):
    source = "import hub\n"
    rows = [("hub.py", "x = 1\n", 0), *((f"u{i:02}.py", source, i + 1) for i in range(60))]
    many = Engine(spark.createDataFrame(rows, "path string, source string, file_ord long"))
    ask = spark.createDataFrame([(i, ["hub.py"], "", "", "q") for i in range(3)], "request_id long, changed_files array<string>, diff_text string, commit_message string, query string")
    for name in ("detect_changes", "get_impact_radius"):
        got = many.query(name, requests=ask)
        assert {r.request_id: r["count"] for r in got.groupBy("request_id").count().collect()} == {0: 50, 1: 50, 2: 50}, name
        assert {r.path for r in got.where("request_id = 2").collect()} == {"hub.py", *(f"u{i:02}.py" for i in range(49))}


def test_flows_query_goes_the_whole_depth(spark):
    from weftline import catalog

    sf = "/root/testdata/sf0.001"
    e = catalog.engine(spark, sf)
    got, want = catalog.QUERIES["flows"](spark, sf).collect(), analyse.flows(e.nodes, e.edges, 15).collect()
    assert sorted(got) == sorted(want) and max(r.depth for r in got) > 3


def test_wiki_has_all_members(spark):
    risky = "import hub\n" + "# password secret token auth\n" * 3 + "def late():\n    pass\n"
    rows = [("hub.py", "x = 1\n", 0), *((f"u{i:02}.py", "import hub\n", i + 1) for i in range(59)), ("u59.py", risky, 60)]
    many = Engine(spark.createDataFrame(rows, "path string, source string, file_ord long"))
    labels = propagate_labels(analyse.file_links(many.edges))
    community = analyse.communities(many.files, many.edges, labels=labels)
    size = community.first().node_count
    assert size > 50 and len(community.first().members) == 20
    risks = many.risk().withColumn("risk_score", F.when(F.col("path") == "u59.py", 0.9).otherwise(0.1))
    page = analyse.wiki_pages(community, risks, many.nodes, labels).first().content
    assert page.count("- `") == 50 and f"_...and {size - 50} more_" in page
    assert page.endswith("## High risk\nu59.py\n") and "late" in page
    assert many.query("generate_wiki").first().content.count("- `") == 50


def test_languages():
    go = parse.get_parser("go")("a.go", 'import "net"\nfunc (q *Queue) Push() {}\ntype Sink interface {}\ntype Queue struct {}\nfunc Open(x int) {}\n')
    assert {s["qualified_name"] for s in go["symbols"]} == {"a", "Queue.Push", "Sink", "Queue", "Open"} and "net" in go["imports"]
    sh = parse.get_parser("bash")("a.sh", 'source lib/paths.sh\n. env.sh\nexport BUILD_DIR=out\nMODE=x\nclean() {\n}\nfunction pack () {\n}\neval "$CMD run"\n')
    assert [s["name"] for s in sh["symbols"]] == ["a", "clean", "pack", "BUILD_DIR", "MODE"] and sh["imports"] == ["lib/paths.sh", "env.sh"] and sh["dynamic_imports"] == ["$CMD run"]
    tf = parse.get_parser("hcl")("net.tf", 'variable "zone" {}\nresource "dns_record" "www" {}\nmodule "cdn" {\n  source = "./cdn"\n}\noutput "host" {}\n')
    assert [s["qualified_name"] for s in tf["symbols"]] == ["net", "dns_record.www", "module.cdn", "var.zone", "output.host"] and tf["imports"] == ["./cdn"]
    js = parse.get_parser("javascript")("a.js", "export async function load(url) {}\nimport x from './util'\nconst b = require('./wire')\nclass Box extends Base {}\n")
    assert js["imports"] == ["./util", "./wire"] and [(s["name"], s["is_async"]) for s in js["symbols"][1:]] == [("load", True), ("Box", False)]
    ts = parse.get_parser("typescript")("a.ts", "function id<T>(x: T) {}\nexport const f: Fn = (a) => a\nconst g = async (b) => b\n")
    assert [s["name"] for s in ts["symbols"]] == ["a", "id", "f", "g"]
    rust = parse.get_parser("rust")("a.rs", "    use std::io\npub async fn go_on(x: u8) {}\nfn two() {}\n")
    assert [s["name"] for s in rust["symbols"]] == ["a", "go_on", "two"] and rust["imports"] == ["std::io"]
    with pytest.raises(LanguageNotSupported):
        parse.get_parser("cobol")


def test_broken_source(spark):
    files = parse.parsed(spark.createDataFrame([("a.py", "def f(:\n", 0), ("b.py", "", 1)], "path string, source string, file_ord long")).orderBy("path").collect()
    assert files[0].error.startswith("SyntaxError") and files[1].error is None and files[1].line_count == 0


def test_traversal_against_a_queue(spark):
    """Random graphs: the level-wise joins give what a first-in-first-out queue gives."""
    import random
    from collections import deque

    rng = random.Random(7)
    nodes = [(f"f{i}::__module__", f"f{i}") for i in range(12)] + [(f"f{i}::g", f"f{i}") for i in range(12)]
    names = [n for n, _ in nodes]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["imports", "inherits", "dynamic_import"]), rng.choice([1.0, 1.5, 0.6, 0.8]), i) for i in range(60)]
    outs, ins = {}, {}
    for s, t, k, w, _ in edges:
        outs.setdefault(s, []).append((t, k, w, "depends_on"))
        ins.setdefault(t, []).append((s, k, w, "caller"))
    scores, seen, queue = {"f0": (1.0, 0, ["directly changed"])}, {"f0::__module__"}, deque([("f0::__module__", 1.0, 0)])
    where = dict(nodes)
    while queue:
        n, score, depth = queue.popleft()
        if depth >= 3:
            continue
        for other, k, w, side in outs.get(n, []) + ins.get(n, []):
            new, f = score * 0.7 * w, where[other]
            if f not in scores or new > scores[f][0]:
                scores[f] = (new, depth + 1, [*scores.get(f, (0, 0, []))[2], f"{side} via {k} (depth {depth + 1})"])
            if other not in seen:
                seen.add(other)
                queue.append((other, new, depth + 1))
    got = ranked_neighbors(
        spark.createDataFrame(nodes, "node_id string, file_path string"), spark.createDataFrame(edges, "source_id string, target_id string, kind string, weight double, edge_ord long"),
        spark.createDataFrame([(1, "f0")], "request_id long, path string"), 3,
    )
    assert {r.path: (r.score, r.depth, r.reasons) for r in got.collect()} == scores


def test_communities_and_search(spark, engine):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "a string, b string")
    labels = {r.node: r.label for r in propagate_labels(links).collect()}
    assert len({labels[n] for n in "abc"}) == 1 and labels["a"] != labels["x"]
    assert {r.hit for r in search.edge_query("callers_of", engine.nodes.where("node_id = 'lib/ledger.py::__module__'").selectExpr("node_id as seed"), engine.nodes, engine.edges).collect()} == {"lib/report.py::__module__", "tests/test_ledger.py::__module__"}
    assert "lib/ledger.py" in {r.path for r in analyse.tested_files(engine.files).collect()}


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("a", 0.2), ("b", 0.9)], "path string, risk_score double")
    store.upsert("risk_index", one)
    store.upsert("risk_index", spark.createDataFrame([("a", 0.7)], "path string, risk_score double"))
    assert [(r.path, r.risk_score) for r in store.risk_index(0.5).collect()] == [("b", 0.9), ("a", 0.7)]
    assert store.stats().first()["rows"] == 2
    store.register_repo("lib")
    assert store.unregister_repo("lib/") and not store.unregister_repo("lib") and store.repos().count() == 0
    for text in ("first", "second"):
        store.save_summaries(spark.createDataFrame([(1, text, ["a", "b"])], "community_id long, summary_text string, key_symbols array<string>"))
    assert [(r.summary_text, r.key_symbols) for r in store.read("community_summaries").collect()] == [("second", ["a", "b"])]
    flow = lambda *rows: spark.createDataFrame(rows, "entry string, flow_name string, node_count long, file_count long, criticality double")
    assert [r.id for r in store.save_flows(flow(("a", "x", 2, 1, 1.0), ("b", "y", 3, 1, 2.0))).orderBy("id").collect()] == [1, 2]
    store.save_flows(flow(("c", "z", 4, 1, 2.0)))
    assert [(r.id, r.entry) for r in store.list_flows(limit=5).collect()] == [(3, "c"), (1, "b"), (2, "a")] and [r.id for r in store.list_flows("name", 1).collect()] == [2]
    store.clear()
    assert not store.exists("risk_index")


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "build").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "build" / "c.py").write_text("no")
    got = load_sources(spark, str(tmp_path))
    assert [r.source for r in got.collect()] == ["x = 1\n"]
    assert incremental(got, got.select("path", F.sha2("source", 256).alias("sha256"))).count() == 0
    before, after = (spark.createDataFrame(rows, "path string, modified int") for rows in ([("a", 1), ("b", 1)], [("b", 2), ("c", 1)]))
    assert {(r.path, r.change) for r in snapshot_diff(before, after).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}


def test_control(spark):
    rules = compare.RequestRules().require_changed_files().require_max_files(1).require_extensions({".py"}).require_no_secrets()
    rows = spark.createDataFrame([(["a.js", "b.py"], "sk-" + "a" * 24)], "changed_files array<string>, query string")
    assert len(rules.validate(rows).first().violations) == 3
    evo = SchemaEvolution(3)
    evo.register(1, 2, lambda d: d.withColumn("a", F.lit(1)))
    evo.register(2, 3, lambda d: d.withColumn("b", F.lit(2)))
    out, audit = evo.migrate(spark.range(1), 1)
    assert len(audit) == 2 and out.first()["__schema_version__"] == 3 and not evo.compatible(0)
    cache = PlanCache(3, None)
    for k in "abcd":
        cache.set(k, k)
    assert cache.get("a") is None and cache.get("d") == "d" and cache.evictions == 1
    calls = []
    nothing = cache.memoize(lambda x: calls.append(x))
    assert nothing(1) is None and nothing(1) is None and calls == [1]
    cache.invalidate()
    assert cache.stats()["size"] == 0
    tries = []
    pipe = AnalysisPipeline().add_step("flaky", lambda d: d if tries.append(1) or len(tries) > 2 else 1 / 0).with_retry(3, 0)
    pipe.run(spark.range(1))
    assert len(pipe.audit) == 3 and pipe.audit[2][4:] == (1, 1, 0)
    lost = []

    def unlucky(x):  # fails while the job runs, once
        import pathlib

        mark = pathlib.Path(lost[0])
        if not mark.exists():
            mark.touch()
            raise OSError("lost")
        return x

    import tempfile

    lost.append(tempfile.mktemp())
    late = AnalysisPipeline().add_step("late", lambda d: d.select(F.udf(unlucky, "long")("id").alias("id"))).with_retry(1, 0)
    assert late.run(spark.range(5).coalesce(1)).count() == 5 and [(a[1], a[3] is None, a[5]) for a in late.audit] == [(0, False, None), (1, True, 5)]
    with pytest.raises(ConfigurationError):
        ContextConfig(token_budget=10)


def test_result_diff(spark):
    row = "request_id long, files_selected long, total_rendered_tokens long, reduction_ratio double"
    files = "request_id long, path string, score double"
    before, after = spark.createDataFrame([(1, 2, 300, 0.5), (2, 0, 0, 0.0)], row), spark.createDataFrame([(1, 2, 250, 0.625), (2, 0, 0, 0.0)], row)
    a, b = spark.createDataFrame([(1, "old.py", 0.9), (1, "both.py", 0.5)], files), spark.createDataFrame([(1, "new.py", 0.9), (1, "both.py", 0.75)], files)
    got = compare.result_diff(before, after, a, b).orderBy("request_id").collect()
    assert (got[0].files_added, got[0].files_removed, got[0].token_delta, got[0].reduction_delta, got[0].scores_changed) == (["new.py"], ["old.py"], -50, 0.125, 1)
    assert got[0].summary == "Files: 2 to 2\nTokens: 300 to 250 (-50)\nReduction: 50.0% to 62.5%\nAdded: new.py\nRemoved: old.py\nScores changed: 1"
    assert json.loads(got[0].json)["score_changes"] == [{"path": "both.py", "before": 0.5, "after": 0.75, "delta": 0.25}]
    assert (got[1].files_added, got[1].scores_changed, got[1].summary.count("\n")) == ([], 0, 2)


def test_store_migrations(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    old = "source_id string, target_id string, kind string"
    store.write("edges", spark.createDataFrame([("a", "b", "imports")], old))
    assert store.schema_version() == 0 and store.migrate() == [1, 2, 3, 4, 5] and store.migrate() == []
    assert store.schema_version() == 5 and store.read("edges").first().asDict() == {"source_id": "a", "target_id": "b", "kind": "imports", "weight": None}
    assert "community_id" in store.read("nodes").columns and {r["table"]: r["rows"] for r in store.stats().collect()}["schema_version"] == 5
    assert store.migrate([(6, "notes", {"files": "note string"})]) == [6] and "note" in store.read("files").columns


def test_folds_of_long_logs(spark):
    """A key with more events than an Arrow batch holds, a null key and no rows at all."""
    events = spark.range(30_000).select(F.lit(1).cast("long").alias("key"), F.col("id").cast("double").alias("t"), "id", F.lit(1.0).alias("n"), (F.col("id") % 3 < 2).alias("failed"))
    events = events.unionByName(spark.range(2).select(F.lit(None).cast("long").alias("key"), F.lit(0.0).alias("t"), "id", F.lit(1.0).alias("n"), F.lit(False).alias("failed")))
    bucket = {r.key: (r.granted, r.denied) for r in control.token_bucket(events, 0.5, 1.0).collect()}
    assert bucket == {1: (15_000, 15_000), None: (1, 1)}
    state = ("closed", 0, 0.0, 0, 0, 0)
    for t in range(30_000):
        state = control.breaker_step(state, float(t), t % 3 < 2, 2, 5.0)
    got = {r.key: tuple(r)[1:] for r in control.circuit_breaker(events, 2, 5.0).collect()}
    assert got[1] == (state[0], *state[3:]) and got[None] == ("closed", 2, 0, 0)
    assert {r.key: (r.hits, r.misses) for r in control.cache_hits(events, 9.0).collect()} == {1: (27_000, 3_000), None: (1, 1)}
    assert control.token_bucket(events.limit(0)).count() == 0


def test_retry_outcomes(spark):
    calls = spark.createDataFrame([(1, [("TimeoutError", 1.0), (None, 1.0)]), (2, [("KeyError", 1.0)]), (3, [("TimeoutError", 0.0)] * 5), (4, [("TimeoutError", 9.0)] * 2), (5, [])], "id int, tries array<struct<error:string,seconds:double>>")
    got = {r.id: (r.outcome, r.attempts, r.waited, [tuple(a) for a in r.audit]) for r in control.retry_outcomes(calls, 3, 0.5, 30.0, 5.0, ("TimeoutError",)).collect()}
    assert got[1] == ("ok", 2, 0.5, [(1, "TimeoutError", 0.5)]) and got[2] == ("refused", 1, 0.0, [])
    assert got[3] == ("exhausted", 3, 1.5, [(1, "TimeoutError", 0.5), (2, "TimeoutError", 1.0), (3, "TimeoutError", 2.0)])
    assert got[4] == ("deadline", 1, 0.0, [(1, "TimeoutError", 0.5)]) and got[5][:2] == ("pending", 0)


def test_streaming_control(spark, tmp_path):
    """Streams hold what the folds over the whole log say, though the log comes in two batches."""
    from weftline.streaming.live import circuit_broken, rate_limited

    rows = [(k, 1_000 + i, i % 4 != k) for i in range(40) for k in (0, 1)]  # time 0 is late from the start
    log = spark.createDataFrame(rows, "key long, s long, failed boolean").select("key", F.timestamp_seconds("s").alias("ts"), "failed")
    folder, out = f"{tmp_path}/in", {}
    for part in (log.where("ts < timestamp_seconds(1020)"), log.where("ts >= timestamp_seconds(1020)")):
        part.coalesce(1).write.mode("append").parquet(folder)
        for name, run in (("breaker", lambda e: circuit_broken(e, 2, 3.0)), ("bucket", lambda e: rate_limited(e, 0.5, 2.0))):
            stream = run(spark.readStream.schema(log.schema).parquet(folder))
            stream.writeStream.foreachBatch(lambda b, _, name=name: out.setdefault(name, []).extend(b.collect())).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    whole = log.select("key", F.unix_seconds("ts").cast("double").alias("t"), F.unix_seconds("ts").alias("id"), F.lit(1.0).alias("n"), "failed")
    last = {r.key: tuple(r)[1:] for r in out["breaker"]}  # totals so far: the later batch comes last
    assert last == {r.key: tuple(r)[1:] for r in control.circuit_breaker(whole, 2, 3.0).collect()}
    for r in control.token_bucket(whole, 0.5, 2.0).collect():
        assert (r.granted, r.denied) == tuple(sum(x[i] for x in out["bucket"] if x.key == r.key) for i in (1, 2))


def test_sorted_lists(engine):
    by = lambda key: [tuple(r) for r in engine.query("list_flows", sort_by=key).select("flow_name", "node_count").collect()]
    assert by("name") == [("report", 2), ("test_ledger", 2)] and [n for _, n in by("node_count")] == [2, 2]
    got = engine.query("query_graph", pattern="file_summary", target="report").first()
    assert (got.file, got.language, got.symbols) == ("lib/report.py", "python", 2)
