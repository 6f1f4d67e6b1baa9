"""Incremental maintenance against rebuilding, in memory, in a store and while a folder is watched."""

import os
import random
import time

from pyspark.sql import functions as F

from weftline.plans.engine import Engine, update_store
from weftline.sources.store import GraphStore
from weftline.streaming.live import refresh, watch

SCHEMA = "path string, source string, file_ord long"


def _source(rng):
    mods = ["a", "ab", "abc", "x", "pkg.ab", "pkg.x.abc", "b", "os", "pkg"]
    lines = [f"import {rng.choice(mods)}" for _ in range(rng.randint(0, 2))] + [f"from {rng.choice(mods)} import {rng.choice(['C', 'f', 'D'])}" for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.3:
        lines.append(f"p = __import__('{rng.choice(mods)}')")
    for c in rng.sample(["C", "D", "E", "f"], rng.randint(0, 3)):
        lines += [f"@{rng.choice(['C', 'D.g', 'f'])}", f"class {c}({rng.choice(['C', 'D', 'E', 'Base'])}):", "    def f(self): pass"]
    return "\n".join([*lines, "def broken("] if rng.random() < 0.08 else lines) + "\n"


def _paths():
    return [f"{d}{n}.py" for d in ("", "pkg/", "pkg/x/", "a/") for n in ("a", "ab", "abc", "x", "b")]


def _tables(engine):
    order = lambda df: sorted(tuple(map(str, r)) for r in df.select(sorted(c for c in df.columns if c not in ("symbols", "meta"))).collect())
    return [order(getattr(engine, n)) for n in ("files", "nodes", "links", "edges")]


def test_random_edits_equal_a_rebuild(spark):
    rng = random.Random(11)
    have = {p: (_source(rng), k) for k, p in enumerate(rng.sample(_paths(), 9))}
    rows = lambda d: spark.createDataFrame([(p, s, k) for p, (s, k) in d.items()], SCHEMA)
    engine, at = Engine(rows(have)), 100
    for step in range(3):
        changed = {}
        for p in rng.sample(sorted(have), 2):
            changed[p] = (_source(rng), have[p][1] if step < 2 else at)  # late steps also move files to the end
            at += 1
        for p in rng.sample([p for p in _paths() if p not in have], 2):
            changed[p], at = (_source(rng), at), at + 1
        removed = rng.sample([p for p in have if p not in changed], rng.randint(0, 2))
        engine = engine.update(rows(changed), spark.createDataFrame([(p,) for p in removed], "path string"))
        have = {p: v for p, v in have.items() if p not in removed} | changed
        assert engine.delta.files.count() == len(changed)  # nothing else was parsed
        assert _tables(engine) == _tables(Engine(rows(have)))


def test_content_alone_resolves_nothing_else(spark):
    rows = [(f"m{k}.py", f"import m{k + 1}\n", k) for k in range(6)]
    engine = Engine(spark.createDataFrame(rows, SCHEMA)).update(spark.createDataFrame([("m2.py", "import m4\n", 2)], SCHEMA))
    assert {r.name for r in engine.delta.names.collect()} == {"m3", "m4"}  # what the file imports and what no file imports any more
    assert {(r.source_id, r.target_id) for r in engine.delta.edges.collect()} == {("m2.py::__module__", "m4.py::__module__")}


def _files(root):
    return {os.path.join(d, n): (os.stat(os.path.join(d, n)).st_ino, os.stat(os.path.join(d, n)).st_mtime_ns) for d, _, ns in os.walk(root) for n in ns if n.endswith(".parquet")}


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    rows = [(f"p{k}/m{k}.py", f"import m{(k * 7) % 200}\nclass C{k}(C{k // 2}): pass\n", k) for k in range(200)]
    store = GraphStore(spark, f"file://{tmp_path}/store", 16)
    Engine(spark.createDataFrame(rows, SCHEMA)).save(store)
    before = _files(f"{tmp_path}/store/nodes")
    edit = spark.createDataFrame([("p3/m3.py", "import m9\nclass C3(C1): pass\n", 3)], SCHEMA)
    update_store(store, edit)
    after = _files(f"{tmp_path}/store/nodes")
    moved = {p.split("__bucket=")[1].split("/")[0] for p in before.keys() ^ after.keys() | {p for p in before.keys() & after.keys() if before[p] != after[p]}}
    assert len(moved) == 1
    have = [r if r[0] != "p3/m3.py" else ("p3/m3.py", "import m9\nclass C3(C1): pass\n", 3) for r in rows]
    assert _tables(Engine.load(store, edit)) == _tables(Engine(spark.createDataFrame(have, SCHEMA)))
    # Upserts by key touch the buckets of their keys.
    before = _files(f"{tmp_path}/store/files")
    store.upsert("files", store.read("files").where("path = 'p7/m7.py'").withColumn("token_estimate", F.lit(99).cast("long")))
    after = _files(f"{tmp_path}/store/files")
    assert 0 < len(before.keys() - after.keys()) <= 1 and store.read("files").count() == 200 and store.read("files").where("token_estimate = 99").count() == 1


def test_an_update_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    rows = [("a.py", "x = 1\n", 0), ("b.py", "import ab\nclass C: pass\n", 1), ("c.py", "class D(C): pass\n", 2)]
    edit = spark.createDataFrame([("ab.py", "class C: pass\n", 3), ("b.py", "import ab\n", 1)], SCHEMA)
    gone = spark.createDataFrame([("a.py",)], "path string")
    want = _tables(Engine(spark.createDataFrame([("b.py", "import ab\n", 1), ("c.py", "class D(C): pass\n", 2), ("ab.py", "class C: pass\n", 3)], SCHEMA)))
    merge = GraphStore.merge
    for stop in (1, 3):
        store = GraphStore(spark, f"file://{tmp_path}/store{stop}", 4)
        Engine(spark.createDataFrame(rows, SCHEMA)).save(store)
        calls = []

        def failing(self, *a, calls=calls, stop=stop):
            calls.append(a[0])
            if len(calls) > stop:
                raise OSError("lost")
            return merge(self, *a)

        monkeypatch.setattr(GraphStore, "merge", failing)
        try:
            update_store(store, edit, gone)
        except OSError:
            pass
        monkeypatch.setattr(GraphStore, "merge", merge)
        update_store(store, edit, gone)
        assert _tables(Engine.load(store, edit)) == want, stop


def _batch(spark, folder):
    from weftline.sources.files import load_sources

    return Engine(load_sources(spark, folder))


def _names(engine):
    return {r.node_id.rsplit("/", 1)[1] for r in engine.nodes.collect()}, {(r.source_id.rsplit("/", 1)[1], r.target_id.rsplit("/", 1)[1], r.kind) for r in engine.edges.collect()}


def test_refresh_and_watch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("def f():\n    pass\n")
    (folder / "notes.txt").write_text("import a\n")
    store = GraphStore(spark, f"file://{tmp_path}/store", 4)
    assert refresh(store, str(folder)) == (1, 0) and refresh(store, str(folder)) == (0, 0)
    (folder / "b.py").write_text("import a\n")
    (folder / "c.py").write_text("import b\n")
    assert refresh(store, str(folder)) == (2, 0)
    loaded = lambda: _names(Engine.load(store, spark.createDataFrame([], SCHEMA)))
    assert loaded() == _names(_batch(spark, str(folder)))
    query = watch(store, str(folder), str(tmp_path / "ck"), "1 second")
    try:
        (folder / "b.py").unlink()
        (folder / "a.py").write_text("import c\n\n\nclass A(A):\n    pass\n")
        (folder / "d.py").write_text("import a\n")
        until = time.time() + 90
        while time.time() < until and query.exception() is None:
            if store.exists("listing") and store.read("listing").count() == 3 and store.read("files").where("path like '%d.py'").count():
                break
            time.sleep(1)
    finally:
        query.stop()
    assert loaded() == _names(_batch(spark, str(folder))) and loaded()[1] == {("a.py::__module__", "c.py::__module__", "imports"), ("d.py::__module__", "a.py::__module__", "imports"), ("a.py::A", "a.py::A", "inherits")}


def test_stored_weights_and_malformed_nodes(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store", 4)
    engine = Engine(spark.createDataFrame([("a.py", "class OpenLedger: pass\n", 0)], SCHEMA))
    engine.save(store)
    first = engine.query("embed_graph", store=store).first()
    assert (first.status, first.nodes_embedded, first.embed_version) == ("embedded", 2, "1") and engine.query("embed_graph", store=store).first().status == "already_embedded"
    assert engine.query("embed_graph", store=store, force=True).first().status == "embedded"
    assert [r.node_id for r in engine.query("similar_nodes", query="ledger", store=store).collect()] == ["a.py::OpenLedger"]
    store.upsert("nodes", store.read("nodes").limit(1).withColumn("node_id", F.lit("a.py::bad")).withColumn("name", F.lit(None).cast("string")))
    assert store.read("nodes").count() == 3 and Engine.load(store, engine.corpus).nodes.count() == 2
