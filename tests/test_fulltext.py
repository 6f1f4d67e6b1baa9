"""Full-text search against SQLite's own, where it is built in, and by hand."""

import random
import sqlite3

import pytest

from weftline.operators import fulltext

NODES = [
    ("lib/a.py::get_user", "get_user", "get_user", "def get_user(name: str) -> User", "lib/a.py"),
    ("lib/a.py::User", "User", "User", "class User", "lib/a.py"),
    ("lib/a.py::User.get_name", "get_name", "User.get_name", "def get_name(self) -> str", "lib/a.py"),
    ("src/user_store.py::__module__", "user_store", "user_store", "", "src/user_store.py"),
    ("src/user_store.py::UserStore.get", "get", "UserStore.get", "def get(self, user: User, café: int)", "src/user_store.py"),
    ("src/b.py::get_get_user", "get_get_user", "get_get_user", "async def get_get_user()", "src/b.py"),
    ("src/c.py::ünï", "ünï", "ünï", "def ünï(straße)", "src/c.py"),
    ("src/d.py::x", "x", "x", None, "src/d.py"),
]
ASKED = [
    "get_user", "user get", '"get user"', "get + user", "get_u*", "use*", '"get us" *', "get OR store", "get NOT user", "get NOT user NOT name", "user AND NOT_THERE", "get user OR store NOT lib", "(get OR store) AND src",
    "get NOT (name OR store)", "name : user", "name:get_user", "file_path : user_store", "^ get", "name : ^ user", '"..." get', '""', "cafe", "café", "uni", "UNI", "strasse", "no_such_name", "get get", "get_get", "a.py", "lib/a.py", "get AND", "(get", "name : ", "^",
    "x*", "u*", "nothing : get", '"get', "+ get", "g* NOT s*", "class user OR (def AND str NOT (self OR async))", "User", "NOT get",
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, name string, qualified_name string, signature string, file_path string")


def _sqlite():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(node_id, name, qualified_name, signature, file_path)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this SQLite")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", NODES)
    return con


def _expected(con, query):
    try:
        return {r[0] for r in con.execute("SELECT node_id FROM t WHERE t MATCH ?", (query,))}
    except sqlite3.OperationalError:
        return {r[0] for r in con.execute("SELECT node_id FROM t WHERE name LIKE ? OR qualified_name LIKE ?", (f"%{query}%",) * 2)}


def test_equals_sqlite(spark, nodes):
    con, rng = _sqlite(), random.Random(7)
    leaves = ["get", "user", "get_user", "name", "sto*", '"def get"', "lib", "src", "self", "us*", "signature : user"]

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(leaves)
        a, b = some(depth - 1), some(depth - 1)
        return f"({a} {rng.choice(['AND', 'OR', 'NOT'])} {b})" if rng.random() < 0.5 else f"{a} {rng.choice(['AND', 'OR', 'NOT'])} {b}"

    texts = ASKED + [some(3) for _ in range(150)]
    index = fulltext.by_token(fulltext.postings(nodes))
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    got = {}
    for r in fulltext.find(index, nodes, asked).collect():
        assert r.node_id not in got.setdefault(r.query_id, set())
        got[r.query_id].add(r.node_id)
    for k, text in enumerate(texts):
        assert got.get(k, set()) == _expected(con, text), text


def test_no_hits_are_no_fallback(nodes):
    index = fulltext.postings(nodes)
    assert fulltext.find_nodes(index, nodes, "et_use").count() == 0  # a part of a name is no word
    assert [r.node_id for r in fulltext.find_nodes(index, nodes, "get_user").collect()] == ["lib/a.py::get_user", "src/b.py::get_get_user"]
    assert [r.node_id for r in fulltext.find_nodes(index, nodes, "er.ge").collect()] == ["lib/a.py::User.get_name"]  # a full stop is no query


def test_stored_index_is_read_by_token(spark, nodes, tmp_path):
    fulltext.by_token(fulltext.postings(nodes)).write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    plan = index.where("token = 'user'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,user)" in plan
    assert fulltext.find_nodes(index, nodes, "user_store").count() == 2


def test_empty(spark, nodes):
    index = fulltext.postings(nodes.limit(0))
    assert fulltext.find_nodes(index, nodes.limit(0), "get").count() == 0
    none = spark.createDataFrame([], "query_id long, query string")
    assert fulltext.find(fulltext.postings(nodes), nodes, none).count() == 0
    assert fulltext.find(fulltext.postings(nodes), nodes, spark.createDataFrame([(1, None), (2, " ")], "query_id long, query string")).count() >= 0
