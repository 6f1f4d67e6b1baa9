"""What the registered queries owe their SQL and larger tables."""

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import edges as ed
from weftline.operators import fulltext, parse, traverse


def test_security_words_end_where_sql_ends_them(spark):
    texts = {"éauth": 1, "authé": 1, "٣auth": 1, "auth_": 0, "aſecret": 1, "ſecret": 0, "toKen": 1, "SQL x": 1, "xſs": 1}
    rows = spark.createDataFrame(list(texts.items()), "t string, n long")
    assert not rows.where(tx.security_hits(F.col("t")) != F.col("n")).collect()


def test_sources_of_one_partition_are_parsed_by_many_tasks(spark):
    corpus = spark.createDataFrame([(f"a/f{i}.py", f"import f{i + 1}\n", i) for i in range(40)], "path string, source string, file_ord long").coalesce(1)
    files = parse.parsed(corpus)
    assert files.select(F.spark_partition_id()).distinct().count() > 1
    assert files.count() == 40


def test_entries_go_through_the_graph_together(spark):
    """130 entries (three blocks) against a breadth-first search; a level holds a row a node and block, not an entry."""
    n, depth = 150, 4
    links = {i: {(3 * i + 1) % n, (i * i) % n} for i in range(n)}
    edges = spark.createDataFrame([(str(i), str(j)) for i, js in links.items() for j in js], "source_id string, target_id string")
    entries = [str(i) for i in range(130)] + ["alone"]
    want = set()
    for e in entries:
        front, seen = {e}, {e}
        want |= {(e, e, 0)}
        for level in range(1, depth + 1):
            front = {str(j) for i in front if i != "alone" for j in links[int(i)]} - seen
            seen |= front
            want |= {(e, x, level) for x in front}
    reach = traverse.reach_sets(edges, spark.createDataFrame([(e,) for e in entries], "entry string"), depth)
    rows = [tuple(r) for r in traverse.reached(reach).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert reach.sets.count() < len(want) / 4
    counts = dict(traverse.count_by_entry(reach.sets, reach.places, "n").collect())
    assert counts == {e: sum(x[0] == e for x in want) for e in entries}
    some = spark.createDataFrame([("7",), ("alone",)], "entry string")
    assert {tuple(r) for r in traverse.reached(reach, some).collect()} == {x for x in want if x[0] in ("7", "alone")}


def _written(monkeypatch, module):
    """Tables that a module writes, by label."""
    tables, write = {}, module.staged

    def keep(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(module, "staged", keep)
    return tables


def test_candidates_of_one_score_are_combined_before_they_are_written(spark, monkeypatch):
    """Sixty files between a changed one and a hub: the hub is one row of the second level, with the first file's place."""
    names = ["a", "hub", *(f"m{i:02d}" for i in range(60))]
    nodes = spark.createDataFrame([(f"{x}::__module__", x) for x in names], "node_id string, file_path string")
    pairs = [(x, y) for m in names[2:] for x, y in (("a", m), (m, "hub"))]
    edges = spark.createDataFrame([(f"{x}::__module__", f"{y}::__module__", "imports", 1.0, i) for i, (x, y) in enumerate(pairs)], "source_id string, target_id string, kind string, weight double, edge_ord long")
    tables = _written(monkeypatch, traverse)
    rows = traverse.ranked_neighbors(nodes, edges, spark.createDataFrame([(1, "a")], "request_id long, path string"), 2)
    got = {r.path: (round(r.score, 6), r.depth, r.reasons) for r in rows.collect()}
    assert got["hub"] == (0.49, 2, ["depends_on via imports (depth 2)"]) and got["m07"] == (0.7, 1, ["depends_on via imports (depth 1)"]) and len(got) == 62
    assert tables["level-2"].count() == 2  # the hub and the changed file
    assert all(k != "array<bigint>" for _, k in tables["level-2"].dtypes)


def test_only_rises_go_on_to_the_result(spark, monkeypatch):
    """a-b-c-d in a chain, a inherits d: depth 2 leads back to a and to d by a lower score, and neither is passed on."""
    nodes = spark.createDataFrame([(f"{x}::__module__", x) for x in "abcd"], "node_id string, file_path string")
    pairs = [("a", "b", "imports", 1.0), ("b", "c", "imports", 1.0), ("c", "d", "imports", 1.0), ("a", "d", "inherits", 1.5)]
    edges = spark.createDataFrame([(f"{x}::__module__", f"{y}::__module__", k, w, i) for i, (x, y, k, w) in enumerate(pairs)], "source_id string, target_id string, kind string, weight double, edge_ord long")
    tables = _written(monkeypatch, traverse)
    rows = traverse.ranked_neighbors(nodes, edges, spark.createDataFrame([(1, "a")], "request_id long, path string"), 3)
    got = {r.path: (round(r.score, 6), r.depth, r.reasons) for r in rows.collect()}
    via_b, via_d = "depends_on via imports (depth 2)", "caller via imports (depth 2)"
    assert got["a"] == (1.1025, 2, ["directly changed", "caller via inherits (depth 2)"])
    assert got["c"] == (0.735, 2, [via_b, via_d]) and got["d"] == (1.05, 1, ["depends_on via inherits (depth 1)"]) and got["b"][2] == ["depends_on via imports (depth 1)"]
    assert {k: t.count() for k, t in tables.items() if k.startswith("rises")} == {"rises-1": 2, "rises-2": 3, "rises-3": 0}


def test_prefixes_are_cut_out_of_texts_that_begin_like_one(spark, monkeypatch):
    names = ["p", "part_1", "part_12", "part_1.f", "pa", "", None, "part_12.f_1"]
    keys = ["part_1", "part_12", "part_123", "src.part_1", "p", "q", "par", "part_1.f", "part_12.f_1.g"]
    tables = _written(monkeypatch, ed)
    left, right = (spark.createDataFrame([(x,) for x in rows], f"{n} string") for rows, n in ((keys, "key"), (names, "name")))
    got = {(r.key, r.name) for r in ed.prefix_pairs(left, "key", right, "name").collect()}
    assert got == {(k, n) for k in keys for n in names if n and k.startswith(n)}
    assert {r["__head"]: sorted(r["__n"]) for r in tables["prefix-heads"].collect()} == {"p": [1], "pa": [2], "part_1": [6, 7, 8, 11]}


def test_plain_annotations_need_no_unparser(monkeypatch):
    source = "def f(x: int, *y: str) -> int:\n    return x\n"
    want = parse.parse_python("a.py", source)["symbols"][1]["signature"]
    monkeypatch.setattr(parse.ast, "unparse", None)
    assert want == "def f(x: int, *y) -> int" == parse.parse_python("a.py", source + "\n")["symbols"][1]["signature"]


def test_frequent_words_are_read_for_candidates_only(spark, monkeypatch):
    rows = [(f"a/x.py::f_{i}", f"f_{i}", f"f_{i}", f"def f_{i}(x)", "a/x.py") for i in range(50)]
    nodes = spark.createDataFrame(rows, "node_id string, name string, qualified_name string, signature string, file_path string")
    index, tables = fulltext.postings(nodes), _written(monkeypatch, fulltext)
    asked = spark.createDataFrame([(1, '"def f 7"'), (2, "f_8 OR (x f_9)"), (3, "f_1* NOT x"), (4, 'f_3 NOT "..."')], "query_id long, query string")
    got = {(r.query_id, r.node_id.split("_")[1]) for r in fulltext.find(index, nodes, asked).collect()}
    assert got == {(1, "7"), (2, "8"), (2, "9"), (4, "3")}
    assert tables["candidates"].count() == 1 + 2 + 11 + 1


def test_labels_travel_as_numbers_in_the_order_of_names(spark, monkeypatch):
    tables = _written(monkeypatch, traverse)
    got = {r.node: r.label for r in traverse.propagate_labels(spark.createDataFrame([("n10", "n2"), ("n9", "n30")], "a string, b string")).collect()}
    assert got["n10"] == got["n2"] and got["n9"] == got["n30"] and set(got) == {"n10", "n2", "n9", "n30"}
    assert dict(tables["links"].dtypes) == {"i": "bigint", "j": "bigint", "half": "int"}


def test_sources_are_dealt_before_anything_is_read_from_them(spark):
    corpus = spark.createDataFrame([("a/f.py", "import g\n", 0)], "path string, source string, file_ord long")
    plan = parse.parsed(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("sha2") < plan.index("RepartitionByExpression")


def test_only_ids_that_may_be_shared_are_grouped(spark, monkeypatch):
    """Files apart are no rows of the grouping; a repeated path, a repeated symbol and colons are, and give one row an id."""
    tables = _written(monkeypatch, parse)
    rows = [
        ("a.py", "class C: pass\ndef f(): pass\n", 0), ("b.py", "def f(): pass\nx = 1\ndef f(y): pass\n", 1), ("c.py", "def g(): pass\n", 2), ("c.py", "def h(): pass\ndef g(z): pass\n", 3),
        ("d.tf", 'resource "x::y" "z" {\n', 4), ("d.tf::x", 'resource "y" "z" {\n', 5), ("e.py", "", 6), ("bad.py", "def (", 7),
    ]
    nodes = parse.nodes_of(parse.parsed(spark.createDataFrame(rows, "path string, source string, file_ord long")))
    got = sorted((r.node_id, r.file_ord, r.sym_ord, r.line_start) for r in nodes.where("file_path not like 'd%' and file_path <> 'c.py'").collect())
    assert got == [("a.py::C", 0, 1, 1), ("a.py::__module__", 0, 0, 1), ("a.py::f", 0, 2, 2), ("b.py::__module__", 1, 0, 1), ("b.py::f", 1, 1, 3), ("e.py::__module__", 6, 0, 1)]
    ids = [r.node_id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and {"c.py::g", "c.py::h", "c.py::__module__", "d.tf::__module__"} <= set(ids)
    assert {r.path for r in tables["shared-ids"].collect()} == {"b.py", "c.py", "d.tf", "d.tf::x"}


def test_names_are_resolved_from_the_best_keys_of_a_prefix(spark, monkeypatch):
    tables = _written(monkeypatch, ed)
    paths = [*(f"src/p{i % 3}/part_{i}.py" for i in range(130)), "p.py", "src/part.py", "src/p1/part.py"]
    index = ed.path_index(spark.createDataFrame([(p, (7 * i) % 131) for i, p in enumerate(paths)], "path string, file_ord long"))
    names = ["p", "part", "part_1", "part_1.f_1", "part_12", "part_129.f", "p1.part_1", "src.p1.p", "q", "", None]
    keys = [(r.key, r.path, tuple(r.key_ord)) for r in index.collect()]
    want = set()
    for name in filter(None, names):
        best: dict = {}
        for key, path, at in keys:
            if key.startswith(name) or name.startswith(key) and key:
                best[path] = min(best.get(path, (True, (1 << 40,))), (key != name, at))
        want |= {(name, path, i + 1) for i, path in enumerate(sorted(best, key=best.get)[:3])}
    rows = ed.resolve_imports(spark.createDataFrame([(n,) for n in names] * 2, "name string"), index)
    assert {tuple(r) for r in rows.collect()} == want
    assert tables["import-names"].count() == 9 and tables["path-index"].count() == len(keys)  # written once, read thrice


def test_definitions_come_in_the_order_of_a_walk():
    block = "\n".join(["if x:", "    def a(): pass", "else:", "    class B:", "        def c(self): pass", "try:", "    def d(): pass", "except E:", "    def e(): pass", "else:", "    def g(): pass", "finally:", "    def h(): pass"])
    source = f"def z():\n    \"\"\"Text\"\"\"\n    def y(): pass\n{block}\nmatch x:\n    case 1:\n        def i(): pass\nwith q:\n    async def j(): pass\n"
    tree = parse.ast.parse(source)
    want = [n for n in parse.ast.walk(tree) if isinstance(n, parse.ast.ClassDef | parse.ast.FunctionDef | parse.ast.AsyncFunctionDef)]
    assert list(parse._definitions(tree)) == want and len(want) == 11


def test_lines_end_where_an_editor_ends_them(spark):
    texts = ["", "a", "a\n", "\r\n", "\n\r", "a\r\r\n\nb", "\x1c\x1d\x1e\x1f", "\x85x\u2028", "é\u2029\x0b\x0c", "\r\n\r\n "]
    rows = spark.createDataFrame([(t, len(t.splitlines())) for t in texts], "t string, n long")
    assert not rows.where(tx.line_count(F.col("t")) != F.col("n")).collect()
    assert "regexp" not in str(tx.line_count(F.col("t")))


def test_edges_follow_when_they_are_asked_for(spark, monkeypatch):
    """Symbols after an update need no edges; edges asked for later are those of the delta."""
    from weftline.plans import engine as en

    tables, schema = _written(monkeypatch, en), "path string, source string, file_ord long"
    rows = [(f"m{k}.py", f"import m{k + 1}\nclass C{k}(C{k // 2}): pass\n", k) for k in range(5)]
    edit = spark.createDataFrame([("m2.py", "import m4\nclass D: pass\n", 2)], schema)
    old = en.Engine(spark.createDataFrame(rows, schema))
    new = old.update(edit, spark.createDataFrame([("m0.py",)], "path string"))
    names = {r.name for r in new.nodes.where("kind = 'class'").collect()}
    assert names == {"C1", "D", "C3", "C4"} and not {"links", "edges"} & tables.keys()
    found = {(r.source_id, r.target_id) for r in new.edges.collect()}
    module = lambda a, b: (f"m{a}.py::__module__", f"m{b}.py::__module__")
    assert found == {module(1, 2), module(2, 4), module(3, 4), ("m3.py::C3", "m1.py::C1")}
    assert {r.name for r in new.delta.names.collect()} >= {"m4"} and new.links.count() == 2
    again = new.update(spark.createDataFrame([("m9.py", "import m1\n", 9)], schema))
    assert {"links", "edges"} <= again.__dict__.keys()  # a graph with edges keeps them up at once


def test_requests_go_through_the_graph_together(spark, monkeypatch):
    """70 requests (two blocks) against a queue a request; a level has a row a file and block, whatever the requests, also
    where a file's rows come in many batches."""
    import random
    from collections import deque

    rng, n = random.Random(7), 24
    ids = [f"{f:02d}::{x}" for f in range(n) for x in ("__module__", "A", "B")]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(150)} | {(f"{f:02d}::__module__", "00::__module__") for f in range(1, n, 2)})
    links = [(a, b, *rng.choice([("imports", 1.0), ("inherits", 1.5), ("dynamic_import", 0.6), ("decorates", 0.8)]), i) for i, (a, b) in enumerate(rng.sample(pairs, len(pairs)))]
    seeds = [(100 + r, f"{(r + k) % n:02d}") for r in range(70) for k in range(1 + r % 2)]
    nodes = spark.createDataFrame([(x, x[:2]) for x in ids], "node_id string, file_path string")
    edges = spark.createDataFrame(links, "source_id string, target_id string, kind string, weight double, edge_ord long")
    tables = _written(monkeypatch, traverse)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = traverse.ranked_neighbors(nodes, edges, spark.createDataFrame(seeds, "request_id long, path string"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {(r.request_id, r.path): (r.score, r.depth, r.reasons) for r in rows}
    assert len(got) == len(rows)
    hashed = {r.path: r.h for r in nodes.select(F.col("file_path").alias("path"), F.xxhash64("file_path").alias("h")).distinct().collect()}
    want = {}
    for request in {r for r, _ in seeds}:
        first = sorted((p for r, p in seeds if r == request), key=hashed.get)
        score = {p: (1.0, 0, ["directly changed"]) for p in first}
        queue = deque((f"{p}::__module__", 1.0, 0) for p in first)
        visited = {x for x, *_ in queue}
        while queue:
            node, s, depth = queue.popleft()
            if depth == 3:
                continue
            out = [(b, k, w, "depends_on") for a, b, k, w, _ in links if a == node] + [(a, k, w, "caller") for a, b, k, w, _ in links if b == node]
            for other, kind, weight, side in out:
                new, known = s * 0.7 * weight, score.get(other[:2], (-1.0, 0, []))
                if new > known[0]:
                    score[other[:2]] = (new, depth + 1, [*known[2], f"{side} via {kind} (depth {depth + 1})"])
                if other not in visited:
                    visited.add(other)
                    queue.append((other, new, depth + 1))
        want |= {(request, p): v for p, v in score.items()}
    assert got == want
    assert tables["level-3"].count() <= 2 * n < len(want) / 10


def test_a_step_of_the_selection_is_a_file_that_fits(spark, monkeypatch):
    """Against the plain fold, in small batches and small looks ahead; nothing but sizes goes through it."""
    import random

    from weftline.operators import select

    rng, rows = random.Random(3), []
    for request in range(9):
        rows += [(request, i, f"f{i}", t := rng.choice([3, 9, 40, 200, 900]), max(1, t // rng.choice([1, 2, 5])), rng.randint(1, 9), f"k{i}") for i in range(1, 120)]
    rows += [(9, 1, "a", 500, 100, 7, "x"), (9, 2, "b", 1, 1, 8, "y"), (10, 1, "a", 501, 501, 7, "x"), (11, 1, "a", 1, 600, 7, "x")]
    want, ends = set(), set()
    for request in range(12):
        used = original = n = 0
        for r, pos, path, tok, sig, orig, tag in rows:
            if r != request or used >= 500:
                continue
            original += orig
            if used + tok <= 500 or used + sig <= 500:
                want.add((r, pos, path, tag, used + tok > 500))
                used, n = used + (tok if used + tok <= 500 else sig), n + 1
        ends.add((request, used, original, n))
    monkeypatch.setattr(select, "_STEP", 2)
    table = spark.createDataFrame(rows, "request_id long, pos int, path string, tok long, sig_tok long, orig long, tag string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        picked, totals = select.greedy(table, 500)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {tuple(r) for r in picked.select("request_id", "pos", "path", "tag", "sig").collect()} == want
    assert {tuple(r) for r in totals.collect()} == ends


def test_the_length_of_a_heading_is_known_before_it(spark):
    from weftline.operators import select

    rows = [("é/a.py", s, r, d, w, "python") for s in (0.0, 0.0004, 0.9996, 1.0, 9.9989, 9.9996, 12.5, -0.25) for r, d, w in ((1, 0, ["directly changed"]), (12345, 10, ["a", "b", "c"]), (10, 2, []))]
    table = spark.createDataFrame(rows, "path string, score double, rank int, depth int, reasons array<string>, language string")
    assert not table.where(F.length(select.heading()) != select.heading_length()).collect()


def test_files_that_nothing_reads_are_deleted(spark, monkeypatch):
    """Of the traversal's tables, those between two others go; what others wrote stays, and so does the session's setting."""
    import os
    from urllib.parse import urlparse

    from weftline import staging

    folder = lambda df: os.path.dirname(urlparse(df.inputFiles()[0]).path)
    table = staging.staged(spark.range(10).repartition(3), "mine")
    other = spark.range(3)
    at = folder(table)
    assert os.path.isdir(at)
    staging.released(table, other)
    assert not os.path.exists(at)
    tables, at = {}, {}

    def keep(df, label):
        tables[label] = staging.staged(df, label)
        at[label] = folder(tables[label])
        return tables[label]

    monkeypatch.setattr(traverse, "staged", keep)
    nodes = spark.createDataFrame([(f"{x}::__module__", x) for x in "abc"], "node_id string, file_path string")
    edges = spark.createDataFrame([(f"{x}::__module__", f"{y}::__module__", "imports", 1.0, i) for i, (x, y) in enumerate(["ab", "bc"])], "source_id string, target_id string, kind string, weight double, edge_ord long")
    rows = traverse.ranked_neighbors(nodes, edges, spark.createDataFrame([(1, "a")], "request_id long, path string"), 3)
    assert {r.path: r.depth for r in rows.collect()} == {"a": 0, "b": 1, "c": 2}
    assert not os.path.exists(at["known-edges"]) and os.path.exists(at["incident"])
    assert spark.conf.get(staging._CLEANUP, "false") == "false"


def test_few_terms_are_sent_to_the_files(spark):
    """Candidates of a query's words are not dealt again by request, and a changed file that nothing reaches keeps its rank."""
    from weftline.config import ContextConfig
    from weftline.operators import rank

    files = spark.createDataFrame([(f"a/part_{i}.py", [{"name": f"f_{i}"}, {"name": "part"}], i, 10) for i in range(30)], "path string, symbols array<struct<name: string>>, file_ord long, line_count long")
    asked = spark.createDataFrame([(i, "", "part 7", f"f {i}") for i in range(3)], "request_id long, diff_text string, commit_message string, query string")
    scores = rank.keyword_scores(files, asked)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1 and "hashpartitioning(request_id" not in plan
    got = {(r.request_id, r.path): r.bm25 for r in scores.collect()}
    hit = lambda tf: rank.IDF * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 5 / 20))  # noqa: E731  f, i, part, part, i
    assert len(got) == 90 and abs(got[0, "a/part_9.py"] - (hit(2) + hit(1)) / 4) < 1e-12 and abs(got[2, "a/part_7.py"] - (2 * hit(2) + hit(1)) / 4) < 1e-12
    graph = spark.createDataFrame([(0, "a/part_1.py", 0.9, 1, ["x"])], "request_id long, path string, score double, depth int, reasons array<string>")
    changed = spark.createDataFrame([(0, "a/part_2.py"), (1, "a/part_1.py")], "request_id long, path string")
    rows = rank.rank_files(files, graph, scores, changed, ContextConfig()).collect()
    assert sorted((r.request_id, r.path, r.depth, r.reasons, r.changed, r.rank) for r in rows) == [(0, "a/part_1.py", 1, ["x"], False, 2), (0, "a/part_2.py", 0, ["directly changed"], True, 1), (1, "a/part_1.py", 0, ["directly changed"], True, 1)]
