"""Registered queries, one or more for every operator family, and their oracle SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ContextConfig
from .functions import text as tx
from .operators import analyse, compare, control, fulltext, parse, search
from .operators.edges import path_index
from .operators.select import greedy, render
from .operators.traverse import propagate_labels, ranked_neighbors, sweep_labels
from .plans.engine import Engine, incremental, index_roots
from .plans.evolve import AnalysisPipeline, SchemaEvolution
from .sources import corpus as cv
from .sources.files import manifest, read_manifest, snapshot_diff, write_manifest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_ENGINES: dict[tuple[str, str], Engine] = {}


def _register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = cv.duck_view(sql)
        return fn

    return wrap


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return cv.spark_view(spark, sf, cv.DOC_FILES)


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return cv.spark_view(spark, sf, cv.CODE_FILES)


def engine(spark: SparkSession, sf: str) -> Engine:
    """The engine over the generated sources, indexed once a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(_code(spark, sf))
    return _ENGINES[key]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per brand: the brand's first part has changed."""
    part = cv.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    files = _code(spark, sf).select(F.col("file_ord").alias("k"), "path")
    rows = part.join(files, "k")
    return rows.select(F.col("k").alias("request_id"), F.array("path").alias("changed_files"), F.lit("").alias("diff_text"), F.lit("fix token check").alias("commit_message"), F.concat(F.lit("review part "), F.col("k").cast("string")).alias("query"))


C1, C3 = cv.DOC_FILES, cv.CODE_FILES
_LANG = "CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.sh' THEN 'bash' WHEN path LIKE '%.tf' THEN 'hcl' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.java' THEN 'java' ELSE 'unknown' END"
_TOKENS = "greatest(1, length(source) // 4)::BIGINT"

# Scans and row-wise operators -------------------------------------------------------------------


@_register("detect_language", f"SELECT path, {_LANG} AS language FROM ({C1})")
def _(spark, sf):
    return _docs(spark, sf).select("path", tx.detect_language(F.col("path")).alias("language"))


_SUFFIXES = ".py .pyi .js .mjs .cjs .ts .tsx .go .rs .java .cpp .cxx .cc .c .h .rb .php .sh .bash .zsh .tf .tfvars .hcl .PY .md .yaml".split()
_OF_SUFFIX = "python python javascript javascript javascript typescript typescript go rust java cpp cpp cpp c c ruby php bash bash bash hcl hcl hcl python unknown".split()


@_register("languages_of_suffixes", f"""SELECT path, CASE s WHEN '.yaml' THEN CASE WHEN path LIKE '%/templates/%' THEN 'helm' ELSE 'unknown' END {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_SUFFIXES, _OF_SUFFIX, strict=False))} END AS language
FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'x/templates/d' ELSE 'x/y/d' END || doc_id || s AS path, s FROM (SELECT doc_id, ([{', '.join(f"'{x}'" for x in _SUFFIXES)}])[doc_id % {len(_SUFFIXES)} + 1] AS s FROM documents))""")
def _(spark, sf):
    d = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (d % len(_SUFFIXES) + 1).cast("int"))
    path = F.concat(F.when(d % 3 == 0, "x/templates/d").otherwise("x/y/d"), d.cast("string"), ext)
    return cv.table(spark, sf, "documents").select(path.alias("path")).select("path", tx.detect_language(F.col("path")).alias("language"))


@_register("dynamic_import_patterns", """SELECT doc_id, 'm' || doc_id AS name FROM documents WHERE doc_id % 6 < 4""")
def _(spark, sf):
    d = F.col("doc_id")
    name = F.concat(F.lit("m"), d.cast("string"))
    forms = ['importlib.import_module("%s")', "__import__('%s')", 'importlib.util.spec_from_file_location(a, "%s")', 'plugin = __import__("%s")', 'importlib.util.find_spec("%s")', "importlib.import_module(%s)"]
    text = F.element_at(F.array(*(F.format_string(f"x = 1\n{f}\n", name) for f in forms)), (d % 6 + 1).cast("int"))
    return cv.table(spark, sf, "documents").select("doc_id", F.explode(tx.dynamic_imports(text)).alias("name"))


@_register("token_estimate", f"SELECT path, {_TOKENS} AS tokens FROM ({C1})")
def _(spark, sf):
    return _docs(spark, sf).select("path", tx.token_estimate(F.col("source")).alias("tokens"))


@_register("file_metrics", f"SELECT path, sha256(source) AS sha256, octet_length(encode(source))::BIGINT AS size_bytes, (CASE WHEN source = '' THEN 0 ELSE len(string_split(source, chr(10))) - CASE WHEN ends_with(source, chr(10)) THEN 1 ELSE 0 END END)::BIGINT AS line_count FROM ({C1})")
def _(spark, sf):
    s = F.col("source")
    return _docs(spark, sf).select("path", F.sha2(s, 256).alias("sha256"), F.octet_length(s).cast("long").alias("size_bytes"), tx.line_count(s).alias("line_count"))


@_register("exclude_filter", f"SELECT path FROM ({C1}) WHERE NOT (list_contains(string_split(lower(path), '/'), 'de') OR len(list_filter(string_split(lower(path), '/'), lambda x: ends_with(x, 'c7'))) > 0)")
def _(spark, sf):
    return _docs(spark, sf).where(~tx.excluded(F.col("path"), ("de", "*c7"))).select("path")


@_register("is_test", f"SELECT path, (lower(path) LIKE '%/test%') AS is_test FROM ({C3})")
def _(spark, sf):
    return _code(spark, sf).select("path", tx.is_test(F.col("path")).alias("is_test"))


@_register("lang_histogram", f"SELECT {_LANG} AS language, count(*) AS files FROM ({C1}) GROUP BY 1")
def _(spark, sf):
    return _docs(spark, sf).groupBy(tx.detect_language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@_register("ext_top8", f"SELECT regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext, count(*) AS files FROM ({C1}) GROUP BY 1 ORDER BY files DESC, ext LIMIT 8")
def _(spark, sf):
    return _docs(spark, sf).groupBy(tx.suffix(F.col("path")).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(8)


#: Written out again, so that the oracle does not read the list under test.
_WORDS = "password|secret|token|api_key|auth|crypt|hash|jwt|oauth|bearer|credential|private_key|sign|verify|encrypt|decrypt|sanitize|escape|sql|query|execute|inject|xss|csrf|cors|permission|sudo|root|admin"


@_register("security_hits", f"SELECT path, len(regexp_extract_all(source, '(?i)\\b({_WORDS})\\b'))::BIGINT AS hits FROM ({C1})")
def _(spark, sf):
    return _docs(spark, sf).select("path", tx.security_hits(F.col("source")).alias("hits"))


@_register("signature_head60", f"SELECT path, sha256(array_to_string(string_split(source, chr(10))[1:60], chr(10))) AS head FROM ({C1})")
def _(spark, sf):
    return _docs(spark, sf).select("path", F.sha2(tx.head(F.col("source")), 256).alias("head"))


@_register("query_tokens", f"SELECT path, len(list_distinct(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}_]+')))::BIGINT AS tokens FROM ({C1})")
def _(spark, sf):
    return _docs(spark, sf).select("path", F.size(tx.query_tokens(F.col("source"))).cast("long").alias("tokens"))


_GUIDE = "SELECT doc_id, 'page_' || CAST(doc_id AS STRING) AS path, '# Guide ' || CAST(doc_id AS STRING) || chr(10) || 'intro' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## Set-up' WHEN doc_id % 3 = 1 THEN '### Quick SET-UP' ELSE '## Other' END || chr(10) || replace(coalesce(text, ''), '#', ' ') || chr(10) || '### Detail' || chr(10) || 'x' || chr(10) || '## Next' || chr(10) || 'y' AS source FROM {documents}"


@_register("docs_section", f"""SELECT path, doc_id % 3 < 2 AS found, left(CASE doc_id % 3 WHEN 0 THEN regexp_extract(source, '(?s)(## Set-up.*)' || chr(10) || '## Next', 1) WHEN 1 THEN regexp_extract(source, '(?s)(### Quick SET-UP.*)' || chr(10) || '### Detail', 1) ELSE source END, 4000) AS section FROM ({_GUIDE})""")
def _(spark, sf):
    return analyse.doc_sections(cv.spark_view(spark, sf, _GUIDE), "set-up").select("path", "found", "section")


@_register("incremental_new_files", f"WITH f AS ({C1}) SELECT path FROM f WHERE file_ord >= (SELECT count(*) / 2 FROM f)")
def _(spark, sf):
    files = _docs(spark, sf)
    half = files.agg((F.count("*") / 2).alias("h"))
    known = files.join(F.broadcast(half), F.col("file_ord") < F.col("h")).select("path", F.sha2("source", 256).alias("sha256"))
    return incremental(files, known).select("path")


@_register("snapshot_diff", f"""WITH f AS ({C1}) SELECT path, CASE WHEN file_ord % 3 = 0 THEN 'added' WHEN file_ord % 3 = 1 THEN 'removed' ELSE 'changed' END AS change FROM f""")
def _(spark, sf):
    f = _docs(spark, sf)
    before = f.where("file_ord % 3 <> 0").select("path", F.lit(1).alias("modified"))
    return snapshot_diff(before, f.where("file_ord % 3 <> 1").select("path", F.lit(2).alias("modified")))


# Parsing and edges over generated sources --------------------------------------------------------

_BASE = "(SELECT p_partkey AS k, (p_partkey * 7 + 1) % n + 1 AS a, (p_partkey * 3 + 2) % n + 1 AS b, CAST(floor(p_partkey / 2) AS BIGINT) AS c, (p_partkey * 11) % n + 1 AS d, 'src/b' || p_partkey % 25 || '/p' || p_partkey % 7 || '/' || CASE WHEN p_partkey % 10 = 3 THEN 'test_' ELSE '' END || 'part_' || p_partkey || '.py' AS path FROM part CROSS JOIN (SELECT count(*) AS n FROM part))"
_SYMBOLS = f"""SELECT path || '::__module__' AS node_id, 'module' AS kind, regexp_extract(path, '([^/]*).py$', 1) AS name, k, 0 AS s FROM {_BASE}
UNION ALL SELECT path || '::P_' || k, 'class', 'P_' || k, k, 1 FROM {_BASE} UNION ALL SELECT path || '::P_' || k || '.m_' || k, 'method', 'm_' || k, k, 2 FROM {_BASE}
UNION ALL SELECT path || '::f_' || k, 'function', 'f_' || k, k, 3 FROM {_BASE}"""
_IMPORTS = f"SELECT DISTINCT k, path, name FROM (SELECT k, path, unnest(['part_' || a, 'part_' || a || '.f_' || a, 'part_' || b]) AS name FROM {_BASE})"
_KEYS = f"""SELECT k, path, key, pos FROM (SELECT k, path, regexp_replace(path, '.py$', '') AS bare FROM {_BASE}),
  LATERAL (SELECT unnest([regexp_extract(bare, '([^/]*)$', 1), regexp_extract(replace(bare, '/', '.'), '([^.]*\\.[^.]*\\.[^.]*)$', 1), regexp_extract(replace(bare, '/', '.'), '([^.]*\\.[^.]*)$', 1), replace(bare, '/', '.')]) AS key, unnest([0, 1, 2, 3]) AS pos)"""


def _resolved(names: str) -> str:
    return f"""SELECT name, target FROM (SELECT n.name, i.path AS target, min(CASE WHEN i.key = n.name THEN 0 ELSE 1 END * 1000000000000 + i.k * 10 + i.pos) AS o
  FROM (SELECT DISTINCT name FROM ({names})) n JOIN ({_KEYS}) i ON starts_with(i.key, n.name) OR starts_with(n.name, i.key) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY name ORDER BY o) <= 3"""


_IMPORT_SQL = f"SELECT i.path || '::__module__' AS source_id, r.target || '::__module__' AS target_id, 'imports' AS kind, CAST(1.0 AS DOUBLE) AS weight FROM ({_IMPORTS}) i JOIN ({_resolved(_IMPORTS)}) r USING (name)"
_DYN = f"SELECT k, path, 'part_' || c AS name FROM {_BASE} WHERE k % 6 = 0"
_DYN_SQL = f"SELECT i.path || '::__module__' AS source_id, r.target || '::__module__' AS target_id, 'dynamic_import' AS kind, CAST(0.6 AS DOUBLE) AS weight FROM ({_DYN}) i JOIN ({_resolved(_DYN)}) r USING (name)"
_INHERIT_SQL = f"SELECT x.path || '::P_' || x.k AS source_id, y.path || '::P_' || y.k AS target_id, 'inherits' AS kind, CAST(1.5 AS DOUBLE) AS weight FROM {_BASE} x JOIN {_BASE} y ON y.k = x.c"
_DECORATE_SQL = f"SELECT x.path || '::P_' || x.k AS source_id, y.path || '::__module__' AS target_id, 'decorates' AS kind, CAST(0.8 AS DOUBLE) AS weight FROM {_BASE} x JOIN {_BASE} y ON y.k = x.d AND y.k % 10 <> 3"
_EDGES_SQL = " UNION ALL ".join(f"({s})" for s in (_IMPORT_SQL, _DYN_SQL, _INHERIT_SQL, _DECORATE_SQL))
_EDGE = ["source_id", "target_id", "kind", "weight"]


@_register("py_symbols", f"SELECT node_id, kind, name FROM ({_SYMBOLS})")
def _(spark, sf):
    return engine(spark, sf).nodes.select("node_id", "kind", "name")


@_register("py_imports", f"SELECT path, name FROM ({_IMPORTS})")
def _(spark, sf):
    return engine(spark, sf).files.select("path", F.explode("imports").alias("name"))


@_register("dynamic_imports", f"SELECT path, name FROM ({_DYN})")
def _(spark, sf):
    return _code(spark, sf).select("path", F.explode(tx.dynamic_imports(F.col("source"))).alias("name"))


@_register("path_index", f"SELECT key, path FROM ({_KEYS})")
def _(spark, sf):
    return path_index(_code(spark, sf)).select("key", "path")


for _name, _kind, _sql in (("import_edges", "imports", _IMPORT_SQL), ("dynamic_edges", "dynamic_import", _DYN_SQL), ("inherits_edges", "inherits", _INHERIT_SQL), ("decorates_edges", "decorates", _DECORATE_SQL)):
    _register(_name, _sql)(lambda spark, sf, kind=_kind: engine(spark, sf).edges.where(F.col("kind") == kind).select(*_EDGE))


#: The sources after an update: every fiftieth imports another file, every fortieth (from the seventh on) has gone.
_OTHER = "((p_partkey * 7 + 1) % n + 1) % n + 1"
_AFTER = _BASE.replace("(p_partkey * 7 + 1) % n + 1 AS a", f"CASE WHEN p_partkey % 50 = 0 THEN {_OTHER} ELSE (p_partkey * 7 + 1) % n + 1 END AS a").removesuffix(")") + " WHERE p_partkey % 40 <> 7)"


def updated_engine(spark: SparkSession, sf: str) -> Engine:
    """An engine without every thirtieth source, updated: changed, removed and new files."""
    key = (spark.sparkContext.applicationId, sf + "#updated")
    if key not in _ENGINES:
        code = _code(spark, sf)
        changed = cv.spark_view(spark, sf, cv.CODE_FILES.replace("(p_partkey * 7 + 1) % n + 1 AS a", f"{_OTHER} AS a")).where("file_ord % 50 = 0")
        new = code.where("file_ord % 30 = 4 AND file_ord % 50 <> 0")
        _ENGINES[key] = Engine(code.where("file_ord % 30 <> 4")).update(changed.unionByName(new).where("file_ord % 40 <> 7"), code.where("file_ord % 40 = 7").select("path"))
    return _ENGINES[key]


@_register("incremental_update", _EDGES_SQL.replace(_BASE, _AFTER))
def _(spark, sf):
    return updated_engine(spark, sf).edges.select(*_EDGE)


@_register("incremental_symbols", f"SELECT node_id, kind, name FROM ({_SYMBOLS.replace(_BASE, _AFTER)})")
def _(spark, sf):
    return updated_engine(spark, sf).nodes.select("node_id", "kind", "name")


@_register("incremental_parsed", f"SELECT path FROM {_BASE} WHERE (k % 50 = 0 OR k % 30 = 4) AND k % 40 <> 7")
def _(spark, sf):
    return updated_engine(spark, sf).delta.files.select("path")


@_register("graph_stats", f"SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM ({_SYMBOLS})) AS nodes, (SELECT count(*) FROM ({_EDGES_SQL})) AS edges")
def _(spark, sf):
    e = engine(spark, sf)
    a, b, c = (df.agg(F.count("*").alias(n)) for df, n in ((e.files, "files"), (e.nodes, "nodes"), (e.edges, "edges")))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # three single rows


@_register("index_stats", "SELECT count(*) AS files_indexed, 0::BIGINT AS files_skipped, 4 * count(*) AS symbols_extracted FROM part")
def _(spark, sf):
    return engine(spark, sf).stats().select("files_indexed", "files_skipped", "symbols_extracted")


@_register("dead_code", f"SELECT node_id FROM ({_SYMBOLS}) WHERE kind <> 'module' AND node_id NOT IN (SELECT target_id FROM ({_EDGES_SQL}))")
def _(spark, sf):
    e = engine(spark, sf)
    return analyse.dead_code(e.nodes, e.edges, limit=None).select("node_id")


@_register("large_symbols", f"SELECT node_id, 1::INT AS lines FROM ({_SYMBOLS}) WHERE kind = 'method'")
def _(spark, sf):
    return analyse.large_symbols(engine(spark, sf).nodes, 1, "method", limit=None).select("node_id", "lines")


@_register("symbol_search", f"SELECT node_id FROM ({_SYMBOLS}) WHERE lower(node_id) LIKE '%part\\_1%' ESCAPE '\\'")
def _(spark, sf):
    return search.search_symbols(engine(spark, sf).nodes, "PART_1").select("node_id")


for _pattern, _near, _far, _extra in (
    ("callers_of", "target_id", "source_id", ""), ("callees_of", "source_id", "target_id", ""), ("imports_of", "source_id", "target_id", " AND kind = 'imports'"),
    ("importers_of", "target_id", "source_id", " AND kind = 'imports'"), ("tests_for", "target_id", "source_id", " AND source_id LIKE '%test%'"), ("inheritors_of", "target_id", "source_id", " AND kind = 'inherits'"),
):
    _register(_pattern, f"SELECT {_near} AS seed, {_far} AS hit, kind FROM ({_EDGES_SQL}) WHERE true{_extra}")(
        lambda spark, sf, p=_pattern: search.edge_query(p, (e := engine(spark, sf)).nodes.select(F.col("node_id").alias("seed")), e.nodes, e.edges).select("seed", "hit", "kind")
    )


#: Words of the five searched fields of a generated symbol, a space around each, fields apart.
_FIELDS = f"""SELECT node_id, k, s, list_transform([node_id, name, CASE kind WHEN 'method' THEN 'P_' || k || '.' || name ELSE name END, CASE kind WHEN 'module' THEN '' WHEN 'class' THEN 'class ' || name WHEN 'method' THEN 'def ' || name || '(self, x: int) -> int' ELSE 'def ' || name || '(x: int) -> int' END, regexp_replace(node_id, '::.*', '')],
  lambda f: ' ' || array_to_string(regexp_extract_all(lower(f), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ') AS f FROM ({_SYMBOLS})"""
_HOLDS = "len(list_filter(f, lambda x: contains(x, ' {} '))) > 0"


def _asked(spark, sf, *forms: str) -> DataFrame:
    """query_id, query: each form for the first part of every brand; its number takes the place of ``%d``."""
    keys = cv.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    texts = [F.replace(F.lit(f), F.lit("%d"), F.col("k").cast("string")) for f in forms]
    return keys.select("k", F.posexplode(F.array(*texts)).alias("i", "query")).select((F.col("k") * 10 + F.col("i")).alias("query_id"), "query")


def _found(spark, sf, *forms: str) -> DataFrame:
    e = engine(spark, sf)
    return fulltext.find(e.search_index(), e.nodes, _asked(spark, sf, *forms)).select("query_id", "node_id")


def _found_sql(*conditions: str) -> str:
    """``q`` is the number asked for, ``f`` the fields; a condition for each form."""
    parts = [f"SELECT q * 10 + {i} AS query_id, node_id FROM (SELECT min(p_partkey) AS q FROM part GROUP BY p_brand) JOIN w ON {c}" for i, c in enumerate(conditions)]
    return f"WITH w AS MATERIALIZED ({_FIELDS}) " + " UNION ALL ".join(parts)


_NUMBER = "' || q || '"
_REGISTERED = {
    "fts_search": (("p %d", "m_%d"), (f"{_HOLDS.format('p')} AND {_HOLDS.format(_NUMBER)}", _HOLDS.format(f"m {_NUMBER}"))),
    "fts_phrase": (('"def f %d"', "part + _%d", "name : P_%d", "^ class P_%d", "no_such_name_%d"), (
        _HOLDS.format(f"def f {_NUMBER}"), _HOLDS.format(f"part {_NUMBER}"), f"contains(f[2], ' p {_NUMBER} ')", f"len(list_filter(f, lambda x: starts_with(x, ' class '))) > 0 AND {_HOLDS.format(f'p {_NUMBER}')}", "false")),
    "fts_prefix": (("m_%d*", "pa* f_%d"), (f"len(list_filter(f, lambda x: contains(x, ' m {_NUMBER}'))) > 0", f"len(list_filter(f, lambda x: contains(x, ' pa'))) > 0 AND {_HOLDS.format(f'f {_NUMBER}')}")),
    "fts_boolean": (("P_%d NOT m", "m_%d OR f_%d NOT test", "part_%d AND (self OR class)", "part_%d NOT (x OR class)"), (
        f"{_HOLDS.format(f'p {_NUMBER}')} AND NOT ({_HOLDS.format('m')})", f"({_HOLDS.format(f'm {_NUMBER}')} OR ({_HOLDS.format(f'f {_NUMBER}')} AND NOT ({_HOLDS.format('test')})))",
        f"{_HOLDS.format(f'part {_NUMBER}')} AND ({_HOLDS.format('self')} OR {_HOLDS.format('class')})", f"{_HOLDS.format(f'part {_NUMBER}')} AND NOT ({_HOLDS.format('x')}) AND NOT ({_HOLDS.format('class')})")),
    # A full stop breaks the rules, so the text is looked for in names.
    "fts_broken": (("P_%d.m",), (f"k::VARCHAR LIKE q || '%' AND s = 2 AND ('P_' || k || '.m_' || k) LIKE '%P_{_NUMBER}.m%'",)),
}
for _name, (_forms, _conditions) in _REGISTERED.items():
    _register(_name, _found_sql(*_conditions))(lambda spark, sf, forms=_forms: _found(spark, sf, *forms))


@_register("semantic_search_nodes", f"SELECT node_id FROM ({_FIELDS}) WHERE s = 3 AND {_HOLDS.format('f 7')}")
def _(spark, sf):
    return engine(spark, sf).query("semantic_search_nodes", query="f_7", kind="function").select("node_id")


_SIGNED = "SELECT doc_id, 'class C_' || doc_id || ':' || chr(10) || '    \"\"\"About ' || doc_id || '\"\"\"' || chr(10) || '    def m(self, *rest, key: int = 1, **more) -> str:' || chr(10) || '        \"\"\"Say.\"\"\"' || chr(10) || '        return key' || chr(10) || '@a_' || doc_id || '().b' || chr(10) || 'async def g(x, /, y: int):' || chr(10) || '    pass' || chr(10) || 'class D(C_' || doc_id || ', m.E, f().G): pass' || chr(10) AS source FROM {documents}"


@_register("py_signatures", """SELECT doc_id, 'class C_' || doc_id || '():' || chr(10) || '    \"\"\"About ' || doc_id || '\"\"\"' || chr(10) || '    async def g(y: int, x)' || chr(10) || 'class D(C_' || doc_id || ', m.E, .G):' || chr(10)
  || '    def m(self, key: int, *rest, **more) -> str' || chr(10) || '        \"\"\"Say.\"\"\"' AS signatures, 'a_' || doc_id || '.b' AS decorator FROM documents""")
def _(spark, sf):
    rows = cv.spark_view(spark, sf, _SIGNED).select(F.concat(F.lit("d/f"), "doc_id", F.lit(".py")).alias("path"), "source", F.col("doc_id").alias("file_ord"))
    return parse.parsed(rows).select(F.col("file_ord").alias("doc_id"), "signatures", F.array_join(F.flatten("symbols.decorators"), "|").alias("decorator"))


@_register("rename_preview", f"SELECT node_id, 'P_7' AS old_name, 'Q_7' AS new_name FROM ({_SYMBOLS}) WHERE name = 'P_7'")
def _(spark, sf):
    return analyse.rename_preview(engine(spark, sf).nodes, "P_7", "Q_7").select("node_id", "old_name", "new_name")


@_register("apply_rename", f"SELECT path, sha256(CASE WHEN file_ord = 7 THEN replace(source, 'P_7', 'Q_7') ELSE source END) AS sha256 FROM ({C3})")
def _(spark, sf):
    e = engine(spark, sf)
    return analyse.apply_rename(e.corpus, analyse.rename_preview(e.nodes, "P_7", "Q_7")).select("path", F.sha2("source", 256).alias("sha256"))


_CALLERS = f"SELECT split_part(target_id, '::', 1) AS path, count(*) AS callers FROM ({_EDGES_SQL}) GROUP BY 1"
_HITS = f"SELECT path, len(regexp_extract_all(source, '(?i)\\b({_WORDS})\\b')) AS hits FROM ({C3})"
_TESTED = f"SELECT DISTINCT x.path FROM (SELECT path, regexp_extract(path, '([^/]*).py$', 1) AS s FROM {_BASE}) x JOIN (SELECT path, regexp_extract(path, '([^/]*).py$', 1) AS s FROM {_BASE} WHERE k % 10 = 3) y ON x.path <> y.path AND (contains(y.s, 'test_' || x.s) OR contains(y.s, x.s || '_test'))"


@_register("risk_index", f"""SELECT path, round(0.4 * least(1.0, coalesce(callers, 0) / 20) + 0.4 * least(1.0, hits / 5) + 0.2 * CASE WHEN t.path IS NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 4) AS risk_score, coalesce(callers, 0) AS callers, hits, t.path IS NOT NULL AS has_test
FROM ({_HITS}) LEFT JOIN ({_CALLERS}) USING (path) LEFT JOIN (SELECT path, path AS p2 FROM ({_TESTED})) t USING (path)""".replace("t.path IS NULL", "p2 IS NULL").replace("t.path IS NOT NULL", "p2 IS NOT NULL"))
def _(spark, sf):
    return engine(spark, sf).risk().select("path", "risk_score", "callers", "hits", "has_test")


_PARTS = f"SELECT node_id, t, count(*) AS tf, any_value(n) AS len FROM (SELECT node_id, len(ts) AS n, unnest(ts) AS t FROM (SELECT node_id, list_filter(list_transform(regexp_extract_all(name || ' ' || sig || ' ' || regexp_replace(node_id, '^(.*)::.*$', '\\1'), '[a-zA-Z][a-z]*|\\d+'), lambda x: lower(x)), lambda x: length(x) > 1) AS ts FROM (SELECT node_id, name, CASE kind WHEN 'module' THEN name || ' ' WHEN 'class' THEN name || ' class ' || name WHEN 'method' THEN 'P_' || k || '.' || name || ' def ' || name || '(self, x: int) -> int' ELSE name || ' def ' || name || '(x: int) -> int' END AS sig FROM ({_SYMBOLS})))) GROUP BY node_id, t"


@_register("tfidf", f"WITH p AS ({_PARTS}), d AS (SELECT t, count(*) AS df FROM p GROUP BY t) SELECT node_id, t AS token, round(tf / len * ln(((SELECT count(*) FROM ({_SYMBOLS})) + 1) / (df + 1)), 6) AS weight FROM p JOIN d USING (t)")
def _(spark, sf):
    return search.tfidf(engine(spark, sf).nodes)


# Traversal ---------------------------------------------------------------------------------------


def impact_ctes(depth: int, edges: str, requests: str) -> str:
    """CTEs up to ``g``: levels unrolled as candidates and the next frontier, then the rises of each file's score.

    ``edges`` has source_id, target_id, kind, weight, edge_ord (a list), ``requests`` request_id, changed.
    """
    ctes = [
        f"e AS MATERIALIZED ({edges})",
        "inc AS MATERIALIZED (SELECT source_id AS node_id, target_id AS other, 0::BIGINT AS dir, kind, weight, edge_ord FROM e UNION ALL SELECT target_id, source_id, 1::BIGINT, kind, weight, edge_ord FROM e)",
        f"r AS MATERIALIZED ({requests})",
        "f0 AS (SELECT request_id, changed || '::__module__' AS node_id, 1.0::DOUBLE AS score, []::BIGINT[] AS ord FROM r)",
    ]
    ups = ["SELECT request_id, changed AS path, 1.0::DOUBLE AS score, 0 AS lvl, []::BIGINT[] AS ord, 'directly changed' AS reason FROM r"]
    for i in range(1, depth + 1):
        ctes.append(f"c{i} AS MATERIALIZED (SELECT f.request_id, inc.other AS node_id, f.score * 0.7::DOUBLE * inc.weight AS score, list_concat(list_concat(f.ord, [inc.dir]), inc.edge_ord) AS ord, CASE dir WHEN 0 THEN 'depends_on' ELSE 'caller' END || ' via ' || kind || ' (depth {i})' AS reason FROM f{i - 1} f JOIN inc ON inc.node_id = f.node_id)")
        seen = " UNION ALL ".join(f"SELECT request_id, node_id FROM f{j}" for j in range(i))
        ctes.append(f"f{i} AS MATERIALIZED (SELECT request_id, node_id, arg_min(score, ord) AS score, min(ord) AS ord FROM c{i} WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.request_id = c{i}.request_id AND s.node_id = c{i}.node_id) GROUP BY ALL)")
        ups.append(f"SELECT request_id, split_part(node_id, '::', 1), score, {i}, ord, reason FROM c{i}")
    ctes.append("u AS (" + " UNION ALL ".join(ups) + ")")
    ctes.append("w AS (SELECT *, max(score) OVER (PARTITION BY request_id, path ORDER BY lvl, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)")
    ctes.append("g AS MATERIALIZED (SELECT request_id::BIGINT AS request_id, path, max(score) AS score, max(lvl)::INT AS depth, list(reason ORDER BY lvl, ord) AS reasons FROM w WHERE before IS NULL OR score > before GROUP BY request_id, path)")
    return ", ".join(ctes)


def impact_sql(depth: int, dynamic: bool = True) -> str:
    keep = "" if dynamic else " WHERE kind <> 'dynamic_import'"
    ctes = impact_ctes(depth, f"SELECT source_id, target_id, kind, weight, [edge_ord] AS edge_ord FROM ({cv.GRAPH_EDGES}){keep}", cv.REQUESTS)
    return f"WITH {ctes} SELECT request_id, path, round(score, 6) AS score, depth, array_to_string(reasons, '|') AS reasons FROM g"


def _impact(depth: int, dynamic: bool = True):
    def run(spark, sf):
        nodes, edges = cv.spark_view(spark, sf, cv.GRAPH_NODES), cv.spark_view(spark, sf, cv.GRAPH_EDGES)
        seeds = cv.spark_view(spark, sf, cv.REQUESTS).select(F.col("request_id").cast("long").alias("request_id"), F.col("changed").alias("path"))
        out = ranked_neighbors(nodes, edges, seeds, depth, dynamic)
        return out.select("request_id", "path", F.round("score", 6).alias("score"), "depth", F.array_join("reasons", "|").alias("reasons"))

    return run


for _d in (1, 2, 3):
    _register(f"impact_radius_d{_d}", impact_sql(_d))(_impact(_d))
_register("impact_no_dynamic", impact_sql(2, False))(_impact(2, False))


@_register("degree", f"SELECT target_id AS node_id, kind, count(*) AS degree FROM ({cv.GRAPH_EDGES}) GROUP BY ALL")
def _(spark, sf):
    return cv.spark_view(spark, sf, cv.GRAPH_EDGES).groupBy(F.col("target_id").alias("node_id"), "kind").agg(F.count("*").alias("degree"))


def labels_sql(links: str, rounds: int = 10) -> str:
    """CTEs up to ``labels``: rounds unrolled, each half of the nodes after the other."""
    ctes = [
        f"both_ways AS MATERIALIZED (SELECT DISTINCT a, b, CASE WHEN md5(a)[1] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE 0 END AS half FROM (SELECT a, b FROM ({links}) UNION ALL SELECT b, a FROM ({links})) WHERE a <> b)",
        "l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM both_ways)",
    ]
    for i in range(2 * rounds):
        votes = f"SELECT a, label, count(*) AS n FROM (SELECT a, label FROM both_ways JOIN l{i} ON b = node WHERE half = {i % 2} UNION ALL SELECT node, label FROM l{i} WHERE node IN (SELECT a FROM both_ways WHERE half = {i % 2})) GROUP BY ALL"
        ctes.append(f"l{i + 1} AS MATERIALIZED (SELECT node, coalesce(won, label) AS label FROM l{i} LEFT JOIN (SELECT a, arg_min(label, (-n, label)) AS won FROM ({votes}) GROUP BY a) ON a = node)")
    return ", ".join([*ctes, f"labels AS (SELECT * FROM l{2 * rounds})"])


#: Trees of forty parts, pairs and stars of suppliers.
TREES = """
SELECT 'p' || CAST(p_partkey AS STRING) AS a, 'p' || CAST(p_partkey - p_partkey % 40 + CAST(floor((p_partkey % 40) / 3) AS BIGINT) AS STRING) AS b FROM {part}
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey - s_suppkey % CASE WHEN s_suppkey % 60 < 30 THEN 2 ELSE 10 END AS STRING) FROM {supplier}
"""


@_register("label_propagation", f"WITH {labels_sql(TREES)} SELECT * FROM labels")
def _(spark, sf):
    return propagate_labels(cv.spark_view(spark, sf, TREES))


def sweep_sql(links: str, order: str, rounds: int = 10, steps: int = 6) -> str:
    """CTEs up to ``labels`` (node, label): rounds of ``steps`` repetitions, enough where no ascending chain is longer."""
    ctes = [f"place AS MATERIALIZED ({order})", f"pair AS (SELECT x.pos AS i, y.pos AS j FROM ({links}) l JOIN place x ON l.a = x.node JOIN place y ON l.b = y.node)", "near AS MATERIALIZED (SELECT i, j FROM pair UNION SELECT j, i FROM pair)", "r0 AS MATERIALIZED (SELECT DISTINCT i, i AS label FROM near)"]
    for r in range(rounds):
        for t in range(steps):
            now = f"r{r}" if t == 0 else f"r{r}_{t}"
            votes = f"SELECT i, label, count(*) AS n, min(j) AS first FROM (SELECT near.i, near.j, CASE WHEN near.j < near.i THEN new.label ELSE old.label END AS label FROM near JOIN {now} new ON new.i = near.j JOIN r{r} old ON old.i = near.j) GROUP BY i, label"
            ctes.append(f"{f'r{r}_{t + 1}' if t + 1 < steps else f'r{r + 1}'} AS MATERIALIZED (SELECT i, arg_max(label, (n, -first)) AS label FROM ({votes}) GROUP BY i)")
    return ", ".join([*ctes, f"labels AS (SELECT node, label FROM r{rounds} JOIN place ON i = pos)"])


_TREE_ORDER = "SELECT DISTINCT a AS node, CAST(substr(a, 2) AS BIGINT) + CASE WHEN a LIKE 'p%' THEN 0 ELSE 1000000000 END AS pos FROM (SELECT a FROM ({0}) AS x UNION ALL SELECT b FROM ({0}) AS y) AS z".format(TREES)


@_register("label_sweep", f"WITH {sweep_sql(TREES, _TREE_ORDER)} SELECT * FROM labels")
def _(spark, sf):
    return sweep_labels(cv.spark_view(spark, sf, TREES), cv.spark_view(spark, sf, _TREE_ORDER))


_GROUP_LINKS = "SELECT f.path AS a, t.path AS b FROM ({0}) AS f JOIN ({0}) AS t ON f.target = t.file_ord".format(cv.GROUP_FILES)
_GROUPS = f"""WITH {sweep_sql(_GROUP_LINKS, f"SELECT path AS node, file_ord AS pos FROM ({cv.GROUP_FILES})", 10, 12)}, f AS MATERIALIZED ({cv.GROUP_FILES}), m AS MATERIALIZED (SELECT label AS key, path, file_ord AS k, CASE WHEN ends_with(path, '.ts') THEN 'typescript' ELSE 'python' END AS language FROM labels JOIN f ON path = node),
c AS (SELECT key, count(*) AS node_count, min(k) AS first, string_split(min(path), '/')[:-2] AS l, string_split(max(path), '/')[:-2] AS h, array_to_string(list(path ORDER BY k)[1:20], '|') AS members, CASE WHEN count_if(language = 'python') > count_if(language = 'typescript') THEN 'python' ELSE 'typescript' END AS dominant_language FROM m GROUP BY key HAVING count(*) >= 2),
g AS (SELECT row_number() OVER (ORDER BY node_count DESC, first) - 1 AS community_id, array_to_string(l[1:len(list_filter(range(1, least(len(l), len(h)) + 1), lambda i: l[1:i] = h[1:i]))], '/') AS label, node_count, dominant_language, members FROM c)"""


def grouped_engine(spark: SparkSession, sf: str) -> Engine:
    """The engine over customers as sources, whose communities are their groups."""
    key = (spark.sparkContext.applicationId, sf + "#groups")
    if key not in _ENGINES:
        _ENGINES[key] = Engine(cv.spark_view(spark, sf, cv.GROUP_FILES).select("path", "source", "file_ord"))
    return _ENGINES[key]


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    e = grouped_engine(spark, sf)
    return analyse.communities(e.files, e.edges, labels=analyse.file_labels(e.files, e.edges, in_order=True))


@_register("communities_in_order", f"{_GROUPS} SELECT * FROM g")
def _(spark, sf):
    return _grouped(spark, sf).drop("key").withColumn("members", F.array_join("members", "|"))


@_register("get_community_with_members", f"{_GROUPS} SELECT community_id, label, node_count, members FROM g WHERE community_id = 3")
def _(spark, sf):
    return analyse.get_community(_grouped(spark, sf), 3, include_members=True).withColumn("members", F.array_join("members", "|"))


_FILE_LINKS = f"SELECT DISTINCT split_part(source_id, '::', 1) AS a, split_part(target_id, '::', 1) AS b FROM ({_EDGES_SQL}) WHERE ends_with(source_id, '::__module__') AND ends_with(target_id, '::__module__')"
_COMMUNITIES = f"""WITH {labels_sql(_FILE_LINKS)}, g AS (SELECT label AS key, count(*) AS node_count, min(node) AS low, max(node) AS high, min(k) AS first FROM labels JOIN {_BASE} ON path = node GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT *, string_split(low, '/')[:-2] AS l, string_split(high, '/')[:-2] AS h FROM g)
SELECT row_number() OVER (ORDER BY node_count DESC, first) - 1 AS community_id, array_to_string(l[1:len(list_filter(range(1, least(len(l), len(h)) + 1), lambda i: l[1:i] = h[1:i]))], '/') AS label, node_count, 'python' AS dominant_language FROM c"""


@_register("list_communities", _COMMUNITIES)
def _(spark, sf):
    e = engine(spark, sf)
    return analyse.communities(e.files, e.edges).select("community_id", "label", "node_count", "dominant_language")


@_register("get_community", f"SELECT community_id, label, node_count FROM ({_COMMUNITIES}) WHERE community_id = 0")
def _(spark, sf):
    return engine(spark, sf).query("get_community", community_id=0)


def flows_sql(depth: int = 15) -> str:
    """CTEs up to ``flow``: levels unrolled, each without what an entry has reached before."""
    ctes = [
        f"sym AS MATERIALIZED ({_SYMBOLS})", f"edge AS MATERIALIZED ({_EDGES_SQL})", "go AS MATERIALIZED (SELECT DISTINCT source_id, target_id FROM edge WHERE kind IN ('imports', 'inherits') AND target_id IN (SELECT node_id FROM sym))",
        "start AS MATERIALIZED (SELECT node_id AS entry, name FROM sym WHERE kind IN ('function', 'method', 'module') ORDER BY k, s, node_id LIMIT 500)", "v0 AS MATERIALIZED (SELECT entry, entry AS node FROM start)", "f0 AS (SELECT * FROM v0)",
    ]
    for i in range(1, depth + 1):
        ctes.append(f"f{i} AS MATERIALIZED (SELECT DISTINCT entry, target_id AS node FROM f{i - 1} JOIN go ON source_id = node WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v WHERE v.entry = f{i - 1}.entry AND v.node = target_id))")
        ctes.append(f"v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM f{i})")
    ctes.append(f"""flow AS (SELECT entry, any_value(name) AS flow_name, count(*) AS node_count, count(DISTINCT split_part(node, '::', 1)) AS file_count, least({depth}, count(*)) AS depth,
      round(ln(1 + any_value(coalesce(d, 0)) + 1) * ln(1 + count(*)), 4) AS criticality FROM v{depth} JOIN start USING (entry) LEFT JOIN (SELECT target_id AS entry, count(*) AS d FROM edge GROUP BY 1) USING (entry) GROUP BY entry HAVING count(*) >= 2)""")
    return ", ".join(ctes)


@_register("flows", f"WITH {flows_sql()} SELECT * FROM flow")
def _(spark, sf):
    e = engine(spark, sf)
    return analyse.flows(e.nodes, e.edges)


@_register("get_flow", f"WITH {flows_sql()}, one AS (SELECT *, row_number() OVER (ORDER BY criticality DESC, entry) AS flow_id FROM flow QUALIFY flow_id = 1) SELECT flow_id, flow_name, entry AS entry_point, node_count, criticality FROM one")
def _(spark, sf):
    return analyse.compact(engine(spark, sf).query("get_flow", flow_id=1), "minimal")


#: Nodes of the first flow in order of depth, and its first ten nodes' files.
_ONE = f"one AS MATERIALIZED (SELECT * FROM flow ORDER BY criticality DESC, entry LIMIT 1), reached AS MATERIALIZED (SELECT node, lvl FROM ({' UNION ALL '.join(f'SELECT entry, node, {i} AS lvl FROM f{i}' for i in range(16))}) JOIN one USING (entry))"


@_register("get_flow_nodes", f"""WITH {flows_sql()}, {_ONE}, ten AS (SELECT split_part(node, '::', 1) AS path, min((lvl, node)) AS o FROM (SELECT * FROM reached ORDER BY lvl, node LIMIT 10) GROUP BY 1)
SELECT 1::BIGINT AS flow_id, entry AS entry_point, (SELECT string_agg(node, '|' ORDER BY lvl, node) FROM (SELECT * FROM reached ORDER BY lvl, node LIMIT 50)) AS nodes,
  (SELECT string_agg(path || ':' || sha256(left(source, 300)), '|' ORDER BY o) FROM ten JOIN ({C3}) USING (path)) AS snippets FROM one""")
def _(spark, sf):
    out = engine(spark, sf).query("get_flow", flow_id=1, include_source=True)
    snippets = F.transform("source_snippets", lambda x: F.concat(x["file"], F.lit(":"), F.sha2(x["source"], 256)))
    return out.select("flow_id", "entry_point", F.array_join("nodes", "|").alias("nodes"), F.array_join(snippets, "|").alias("snippets"))


@_register("flow_history", f"""WITH {flows_sql()}, h AS (SELECT *, row_number() OVER (ORDER BY a, criticality DESC, entry) AS id FROM flow JOIN (VALUES (0), (1), (2)) AS t(a) ON a = 0 OR a = 1 AND node_count % 2 = 0 OR a = 2 AND file_count % 2 = 1)
SELECT id, entry, flow_name, node_count, file_count, criticality FROM (SELECT * FROM h ORDER BY id DESC LIMIT 200) ORDER BY criticality DESC, id DESC LIMIT 100""")
def _(spark, sf):
    from .sources.store import GraphStore
    from .staging import shared_dir, staged

    e = engine(spark, sf)
    found = staged(analyse.flows(e.nodes, e.edges), "flows")
    store = GraphStore(spark, f"{shared_dir(spark)}/weftline/history-{uuid.uuid4().hex}")
    for part in ("true", "node_count % 2 = 0", "file_count % 2 = 1"):
        store.save_flows(found.where(part))
    return store.list_flows("criticality", 100).select("id", "entry", "flow_name", "node_count", "file_count", "criticality")


@_register("architecture_overview", f"""WITH c AS MATERIALIZED ({_COMMUNITIES}) SELECT 'total' AS section, 1 AS position, 'nodes' AS name, count(*)::DOUBLE AS value FROM ({_SYMBOLS}) UNION ALL SELECT 'total', 2, 'edges', count(*) FROM ({_EDGES_SQL})
UNION ALL SELECT 'total', 3, 'files', count(*) FROM part UNION ALL SELECT 'total', 4, 'communities', count(*) FROM c UNION ALL SELECT 'total', 5, 'schema_version', 0 UNION ALL SELECT 'community', community_id + 1, label, node_count FROM c WHERE community_id < 20
UNION ALL SELECT 'high_risk_file', row_number() OVER (ORDER BY risk_score DESC, path), path, risk_score FROM (SELECT path, risk_score FROM ({ORACLES['risk_index']}) WHERE risk_score >= 0.5 ORDER BY risk_score DESC, path LIMIT 10)""")
def _(spark, sf):
    return engine(spark, sf).query("get_architecture_overview")


@_register("wiki_of_groups", f"""{_GROUPS}, p AS (SELECT key, string_agg('- `' || path || '`', chr(10) ORDER BY path) AS listed FROM m GROUP BY key)
SELECT regexp_replace(label, '[^A-Za-z0-9_-]', '_', 'g') AS page_name, '# ' || label || chr(10) || chr(10) || '- id: ' || community_id || chr(10) || '- files: ' || node_count || chr(10) || '- language: ' || dominant_language || chr(10) || chr(10) || '## Members' || chr(10) || listed
  || chr(10) || chr(10) || '## Key symbols' || chr(10) || chr(10) || chr(10) || '## High risk' || chr(10) || chr(10) AS content FROM g JOIN p ON list_contains(string_split(g.members, '|'), split_part(p.listed, '`', 2))""")
def _(spark, sf):
    e = grouped_engine(spark, sf)
    labels = analyse.file_labels(e.files, e.edges, in_order=True)
    return analyse.wiki_pages(analyse.communities(e.files, e.edges, labels=labels), e.risk(), e.nodes, labels)


@_register("custom_parser_sql", f"SELECT path, left(line, 40) AS name, i::INT AS line_start FROM (SELECT path, unnest(string_split(source, chr(10))) AS line, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS i FROM ({C1}) WHERE path LIKE '%.md') WHERE length(line) >= 20")
def _(spark, sf):
    """Long lines of notes as symbols, by a parser that SQL calls."""

    def notes(path: str, source: str) -> dict:
        return {"symbols": [{"kind": "note", "name": x[:40], "qualified_name": x[:40], "line_start": i, "line_end": i, "signature": x} for i, x in enumerate(source.split("\n"), 1) if len(x) >= 20]}

    parse.register_table_function(spark, "weftline_notes", notes)
    return spark.sql("SELECT f.path, s.name, s.line_start FROM {files} f, LATERAL weftline_notes(f.path, f.source) s WHERE f.path LIKE '%.md'", files=_docs(spark, sf))


@_register("pipeline_audit", """SELECT step, attempt, rows_in::BIGINT AS rows_in, rows_out::BIGINT AS rows_out, failed::BIGINT AS failed FROM (SELECT 'languages' AS step, 0 AS attempt, count(*) AS rows_in, count(*) AS rows_out, 0::BIGINT AS failed FROM documents UNION ALL SELECT 'python', 0, count(*), count_if(doc_id % 8 = 0), 0 FROM documents
UNION ALL SELECT 'checked', 0, count_if(doc_id % 8 = 0), count_if(doc_id % 8 = 0), count_if(doc_id % 16 = 0) FROM documents)""")
def _(spark, sf):
    pipe = AnalysisPipeline().add_step("languages", lambda d: d.select("path", "file_ord", tx.detect_language(F.col("path")).alias("language"))).add_step("python", lambda d: d.where("language = 'python'"))
    pipe.add_step("checked", lambda d: d.withColumn("error", F.when(F.col("file_ord") % 16 == 0, "refused")))
    pipe.run(_docs(spark, sf))
    return spark.createDataFrame([(a[0], a[1], *a[4:]) for a in pipe.audit], "step string, attempt int, rows_in long, rows_out long, failed long")


@_register("affected_flows", f"WITH {flows_sql()} SELECT * FROM flow WHERE entry IN (SELECT entry FROM v15 JOIN {_BASE} ON split_part(node, '::', 1) = path WHERE k = 3)")
def _(spark, sf):
    changed = _code(spark, sf).where("file_ord = 3").select("path")
    return engine(spark, sf).query("get_affected_flows", changed=changed)


@_register("refactor_suggest", f"SELECT 'Consider removing unused ' || kind || ' ' || chr(39) || name || chr(39) || ' in ' || split_part(node_id, '::', 1) || ':' || line AS suggestion FROM (SELECT *, CASE s WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 9 END + CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END AS line FROM ({_SYMBOLS}) WHERE kind <> 'module' AND node_id NOT IN (SELECT target_id FROM ({_EDGES_SQL})) ORDER BY k, s LIMIT 10)")
def _(spark, sf):
    return engine(spark, sf).query("refactor", mode="suggest")


_REPOS = "SELECT DISTINCT 'src/b' || CAST(p_partkey % 25 AS STRING) AS root, 'b' || CAST(p_partkey % 25 AS STRING) AS name, 'src/b' || CAST(p_partkey % 25 AS STRING) || '/.weftline' AS db_path FROM {part}"


@_register("list_repos", _REPOS)
def _(spark, sf):
    from .sources.store import GraphStore
    from .staging import shared_dir

    store = GraphStore(spark, f"{shared_dir(spark)}/weftline/registry-{uuid.uuid4().hex}")
    store.upsert("repos", cv.spark_view(spark, sf, _REPOS))
    return engine(spark, sf).query("list_repos", store=store)


@_register("index_roots", "SELECT CASE p_partkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS root, count(*) AS files_indexed, 0::BIGINT AS files_skipped, 4 * count(*) AS symbols_extracted FROM part GROUP BY 1")
def _(spark, sf):
    code = _code(spark, sf)
    _, stats = index_roots({"even": code.where("file_ord % 2 = 0"), "odd": code.where("file_ord % 2 = 1")})
    return stats


@_register("manifest", f"SELECT path, 'repo' AS root, (SELECT count(*) FROM part) AS files_indexed, (SELECT 4 * count(*) FROM part) AS symbols_extracted, (SELECT count(*) FROM ({_EDGES_SQL})) AS edges_created FROM ({C3})")
def _(spark, sf):
    from .staging import shared_dir

    e = engine(spark, sf)
    folder = f"{shared_dir(spark)}/weftline/manifest-{uuid.uuid4().hex}"
    write_manifest(manifest("repo", e.stats(), e.corpus), folder)
    return read_manifest(spark, folder)


@_register("compressed_sections", f"SELECT path, sha256('## ' || path || chr(10) || '<!-- score=0.250 rank=1 depth=0 reasons=x -->' || chr(10) || '```md' || chr(10) || left(source, CAST(floor(length(source) * 0.35::DOUBLE) AS BIGINT)) || chr(10) || '```') AS section FROM ({C1})")
def _(spark, sf):
    ratio = ContextConfig().compression_ratio
    rows = _docs(spark, sf).select("path", "source", F.lit("compressed").alias("output_mode"), F.lit(0.25).alias("score"), F.lit(1).alias("rank"), F.lit(0).alias("depth"), F.array(F.lit("x")).alias("reasons"), F.lit("md").alias("language"), F.lit("").alias("signatures"))
    shorter = F.left("source", F.floor(F.length("source") * F.lit(ratio)).cast("int"))
    return rows.select("path", F.sha2(render(shorter), 256).alias("section"))


@_register("source_previews", f"SELECT path, CASE WHEN source = '' THEN '' ELSE left(source, 500) || '...' END AS source_preview FROM ({C1})")
def _(spark, sf):
    d = _docs(spark, sf)
    return analyse.with_preview(d.select("path"), d)


@_register("score_changes", "SELECT 'd' || doc_id AS path, 'kept' AS state, round(doc_id % 7 / 100.0, 4)::DOUBLE AS delta FROM documents WHERE doc_id % 7 / 100.0 > 0.01 ORDER BY delta DESC, path")
def _(spark, sf):
    d = cv.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"))
    return compare.score_changes(compare.context_diff(d.select("path", F.lit(0.25).alias("score")), d.select("path", (F.lit(0.25) + F.col("doc_id") % 7 / 100).alias("score"))))


@_register("wiki_pages")
def _(spark, sf):
    return engine(spark, sf).query("generate_wiki")


# Ranking and selection ---------------------------------------------------------------------------


def _places(names: str) -> str:
    return _resolved(names).replace("SELECT name, target FROM", "SELECT name, target, o FROM", 1)


_REQUEST_KEYS = "SELECT min(p_partkey) AS k FROM part GROUP BY p_brand"
_ASKED = f"SELECT k AS request_id, path AS changed FROM ({_REQUEST_KEYS}) JOIN {_BASE} USING (k)"
_IMPORTS_AT = f"SELECT k, path, name, min(i) AS i FROM (SELECT k, path, unnest(['part_' || a, 'part_' || a || '.f_' || a, 'part_' || b]) AS name, unnest([0, 1, 2]) AS i FROM {_BASE}) GROUP BY ALL"
#: The generated sources' edges in their order of creation.
_ORDERED_EDGES = f"""SELECT i.path || '::__module__' AS source_id, r.target || '::__module__' AS target_id, 'imports' AS kind, 1e0 AS weight, [0, k, 0, i, o]::BIGINT[] AS edge_ord FROM ({_IMPORTS_AT}) i JOIN ({_places(_IMPORTS)}) r USING (name)
UNION ALL SELECT i.path || '::__module__', r.target || '::__module__', 'dynamic_import', 0.6e0, [0, k, 1, 0, o]::BIGINT[] FROM ({_DYN}) i JOIN ({_places(_DYN)}) r USING (name)
UNION ALL SELECT x.path || '::P_' || x.k, y.path || '::P_' || y.k, 'inherits', 1.5e0, [1, x.k, 1, 0, 0]::BIGINT[] FROM {_BASE} x JOIN {_BASE} y ON y.k = x.c
UNION ALL SELECT x.path || '::P_' || x.k, y.path || '::__module__', 'decorates', 0.8e0, [2, x.k, 1, 0, 0]::BIGINT[] FROM {_BASE} x JOIN {_BASE} y ON y.k = x.d AND y.k % 10 <> 3"""
_NEAR = impact_ctes(4, _ORDERED_EDGES, _ASKED)
_SIGNATURES = "'class P_' || k || '(P_' || c || '):' || chr(10) || '    def f_' || k || '(x: int) -> int' || chr(10) || '    def m_' || k || '(self, x: int) -> int'"
#: Terms of a file: "part" twice, its number five times, of ten (a test: twelve); of a query: six, two of which can occur.
_TERM = "0.6931471805599453e0 * ({0} * 2.5e0 / ({0} + 1.5e0 * (0.25e0 + 0.75e0 * (10 + CASE WHEN k % 10 = 3 THEN 2 ELSE 0 END) / 20e0)))"
_RANKED = f"""{_NEAR}, file AS MATERIALIZED (SELECT k, path, source, {_SIGNATURES} AS sig FROM {_BASE} JOIN (SELECT path, source FROM ({C3})) USING (path)),
s0 AS (SELECT request_id, path, k, path = changed AS changed, CASE WHEN path = changed THEN 1e0 ELSE score END AS g, CASE WHEN path = changed THEN 0 ELSE depth END AS depth, CASE WHEN path = changed THEN ['directly changed'] ELSE reasons END AS reasons,
  least(1e0, ({_TERM.format('2e0')} + CASE WHEN k = request_id THEN {_TERM.format('5e0')} ELSE 0e0 END) / 6) AS bm25 FROM g JOIN r USING (request_id) JOIN file USING (path) WHERE score >= 0.1e0 OR path = changed),
s1 AS (SELECT *, CASE WHEN k % 10 = 3 THEN least(1e0, 0.7e0 * g + 0.3e0 * bm25 + 0.15e0) ELSE 0.7e0 * g + 0.3e0 * bm25 END * CASE WHEN len(list_filter(reasons, lambda x: contains(x, 'dynamic_import'))) > 0 THEN 0.8e0 ELSE 1e0 END AS s FROM s0),
ranked AS MATERIALIZED (SELECT request_id, path, k, changed, depth, round(least(1e0, greatest(0e0, s)), 4) AS score, CASE WHEN k % 10 = 3 THEN list_append(reasons, 'test coverage bonus') ELSE reasons END AS reasons,
  CASE WHEN s >= 0.5e0 THEN 'full' ELSE 'signatures' END AS output_mode, row_number() OVER (PARTITION BY request_id ORDER BY round(least(1e0, greatest(0e0, s)), 4) DESC, k) AS rank FROM s1)"""


@_register("rank_files", f"WITH {_RANKED} SELECT request_id, path, score, rank, array_to_string(reasons, '|') AS reasons, depth, output_mode FROM ranked")
def _(spark, sf):
    return engine(spark, sf).ranked(requests(spark, sf)).select("request_id", "path", "score", "rank", F.array_join("reasons", "|").alias("reasons"), "depth", "output_mode")


def context_sql(budget: int, mode: str = "output_mode") -> str:
    """Sections of the ranked files, the fold under the budget a position at a time, then the texts."""
    return f"""WITH RECURSIVE {_RANKED},
h AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY changed DESC, rank) AS pos, round(score * 10000)::BIGINT AS s4 FROM ranked JOIN file USING (k, path)),
o AS MATERIALIZED (SELECT request_id, pos, path, greatest(1, length(section) // 4) AS tok, greatest(1, length(sig) // 4) AS sig_tok, greatest(1, length(source) // 4) AS orig, section, brief FROM (SELECT *,
  '## ' || path || chr(10) || '<!-- score=' || printf('%d.%03d', (s4 + 5) // 10 // 1000, (s4 + 5) // 10 % 1000) || ' rank=' || rank || ' depth=' || depth || ' reasons=' || array_to_string(reasons[1:2], ',') || ' -->' || chr(10) || '```python' || chr(10)
    || CASE WHEN {mode} = 'signatures' THEN sig ELSE source END || chr(10) || '```' AS section,
  '# ' || path || ' [signatures only, score=' || printf('%d.%02d', (s4 + 50) // 100 // 100, (s4 + 50) // 100 % 100) || ']' || chr(10) || sig AS brief FROM h)),
z AS MATERIALIZED (SELECT request_id, pos, tok, sig_tok, orig FROM o),
t AS (SELECT DISTINCT request_id, 0::BIGINT AS pos, 0::BIGINT AS used, 0::BIGINT AS original, 0::BIGINT AS n, 0 AS took FROM z UNION ALL
  SELECT request_id, pos, used + CASE took WHEN 1 THEN tok WHEN 2 THEN sig_tok ELSE 0 END, original, n + CASE took WHEN 0 THEN 0 ELSE 1 END, took FROM (SELECT t.request_id, z.pos, t.used, t.original + z.orig AS original, t.n, z.tok, z.sig_tok,
    CASE WHEN t.used + z.tok <= {budget} THEN 1 WHEN t.used + z.sig_tok <= {budget} THEN 2 ELSE 0 END AS took FROM t JOIN z ON z.request_id = t.request_id AND z.pos = t.pos + 1 WHERE t.used < {budget})),
total AS (SELECT request_id, max(used) AS used, max(original) AS original, max(n) AS n FROM t GROUP BY 1),
body AS (SELECT request_id, string_agg(path, '|' ORDER BY pos) AS selected_files, string_agg(CASE took WHEN 1 THEN section ELSE brief END, chr(10) || chr(10) ORDER BY pos) AS texts FROM (SELECT request_id, pos, took FROM t WHERE took > 0) JOIN o USING (request_id, pos) GROUP BY 1)
SELECT request_id, selected_files, '# Context' || chr(10) || 'Commit: fix token check' || chr(10) || 'Query: review part ' || request_id || chr(10) || 'Changed: ' || changed || chr(10) || chr(10) || texts AS rendered_context, original AS total_original_tokens, used AS total_rendered_tokens,
  round(1 - used / original, 4) AS reduction_ratio, (SELECT count(*) FROM part) AS files_scanned, n AS files_selected, round(round(1 - used / original, 4) * 100, 2) AS token_savings_pct, round((1 - round(1 - used / original, 4)) * 100, 2) AS token_kept_pct
FROM total JOIN body USING (request_id) JOIN r USING (request_id)"""


@_register("context_result", context_sql(80_000))
def _(spark, sf):
    return engine(spark, sf).context(requests(spark, sf))[1].withColumn("selected_files", F.array_join("selected_files", "|"))


@_register("minimal_context", context_sql(8_000, "'signatures'"))
def _(spark, sf):
    return engine(spark, sf).minimal().context(requests(spark, sf))[1].withColumn("selected_files", F.array_join("selected_files", "|"))


@_register("review_snippets", f"""WITH {_RANKED} SELECT request_id, place, path, changed, source AS snippet, 'class P_' || k || '(P_' || c || '):|    def m_' || k || '(self, x: int) -> int:|def f_' || k || '(x: int) -> int:' AS signature_lines, greatest(1, length(source) // 4) AS tokens
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY changed DESC, score DESC, k)::INT AS place FROM ranked WHERE depth <= 2 OR changed QUALIFY place <= 30) JOIN file USING (k, path) JOIN (SELECT k, c FROM {_BASE}) USING (k)""")
def _(spark, sf):
    return engine(spark, sf).review(requests(spark, sf)).withColumn("signature_lines", F.array_join("signature_lines", "|"))


@_register("detect_changes", f"""WITH {_NEAR}, risk AS MATERIALIZED ({ORACLES['risk_index']}), worst AS (SELECT request_id, round(risk_score, 3) AS max_risk_score FROM r JOIN risk ON path = changed)
SELECT request_id, path, round(score, 6) AS score, depth, risk_score, max_risk_score FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) <= 50) JOIN risk USING (path) JOIN worst USING (request_id)""")
def _(spark, sf):
    return engine(spark, sf).query("detect_changes", requests=requests(spark, sf)).drop("reasons").withColumn("score", F.round("score", 6))


@_register("file_summary", f"SELECT path || '::__module__' AS seed, path AS file, 'python' AS language, 4::INT AS symbols, greatest(1, length(source) // 4)::BIGINT AS token_estimate FROM ({C3})")
def _(spark, sf):
    e = engine(spark, sf)
    return e._summaries(e.nodes.where("kind = 'module'").select(F.col("node_id").alias("seed"), F.col("file_path").alias("path")))


for _by, _key in (("node_count", "node_count DESC"), ("file_count", "file_count DESC"), ("name", "flow_name")):
    _register(f"list_flows_by_{_by}", f"WITH {flows_sql()} SELECT * FROM flow ORDER BY {_key}, entry LIMIT 50")(lambda spark, sf, by=_by: engine(spark, sf).query("list_flows", sort_by=by))


@_register("list_communities_by_name", f"SELECT * FROM ({_COMMUNITIES}) ORDER BY label, community_id LIMIT 50")
def _(spark, sf):
    return engine(spark, sf).query("list_communities", sort_by="name").select("community_id", "label", "node_count", "dominant_language")


@_register("result_diff", """WITH d AS (SELECT doc_id, doc_id // 20 AS request_id, 'd' || doc_id AS path, doc_id % 4 <> 0 AS b, doc_id % 4 <> 1 AS a, doc_id % 4 > 1 AND 0.25e0 + doc_id % 7 / 100e0 - 0.25e0 > 0.01e0 AS c FROM documents)
SELECT request_id, count_if(b)::BIGINT AS files_before, count_if(a)::BIGINT AS files_after, (90 * count_if(a) - 100 * count_if(b))::BIGINT AS token_delta, 0.25e0 AS reduction_delta, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE NOT b), '') AS added,
  coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE NOT a), '') AS removed, count_if(c)::INT AS scores_changed, coalesce(array_to_string(list(path ORDER BY doc_id % 7 DESC, path) FILTER (WHERE c)[1:10], ','), '') AS changes FROM d GROUP BY 1 HAVING count_if(a) > 0 AND count_if(b) > 0""")
def _(spark, sf):
    d = cv.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("request_id"), "doc_id", F.concat(F.lit("d"), "doc_id").alias("path"))
    sides = [(d.where("doc_id % 4 <> 0").withColumn("score", F.lit(0.25)), 100, 0.5), (d.where("doc_id % 4 <> 1").withColumn("score", F.lit(0.25) + F.col("doc_id") % 7 / 100), 90, 0.75)]
    rows = [s.groupBy("request_id").agg(F.count("*").alias("files_selected"), (F.count("*") * n).alias("total_rendered_tokens"), F.lit(q).alias("reduction_ratio")) for s, n, q in sides]
    out = compare.result_diff(*rows, sides[0][0], sides[1][0])
    return out.select("request_id", "files_before", "files_after", "token_delta", "reduction_delta", F.array_join("files_added", ",").alias("added"), F.array_join("files_removed", ",").alias("removed"), "scores_changed", F.array_join("score_changes.path", ",").alias("changes"))


@_register("max_risk", f"SELECT k AS request_id, round(risk_score, 3) AS max_risk_score FROM ({_REQUEST_KEYS}) JOIN {_BASE} USING (k) JOIN ({ORACLES['risk_index']}) USING (path)")
def _(spark, sf):
    return analyse.max_risk(requests(spark, sf), engine(spark, sf).risk())


@_register("request_errors", f"SELECT k AS request_id, CASE WHEN k % 2 = 0 THEN 'changed_files must not be empty' END AS error, k % 2 = 1 AS has_context FROM ({_REQUEST_KEYS})")
def _(spark, sf):
    none = F.expr("cast(array() as array<string>)")
    asked = requests(spark, sf).withColumn("changed_files", F.when(F.col("request_id") % 2 == 0, none).otherwise(F.col("changed_files")))
    return engine(spark, sf).contexts(asked).select("request_id", "error", F.col("rendered_context").isNotNull().alias("has_context"))


@_register("greedy_budget", """WITH RECURSIVE o AS (
  SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, greatest(1, length(text) // 4)::BIGINT AS tok, greatest(1, length(text) // 20)::BIGINT AS sig FROM documents
), r AS (
  SELECT DISTINCT g, 0::BIGINT AS pos, 0::BIGINT AS used, 0::BIGINT AS original, 0::BIGINT AS n, false AS stopped FROM o
  UNION ALL
  SELECT r.g, o.pos, r.used + CASE WHEN r.used + tok <= 20000 THEN tok WHEN r.used + sig <= 20000 THEN sig ELSE 0 END, r.original + tok, r.n + CASE WHEN r.used + tok <= 20000 OR r.used + sig <= 20000 THEN 1 ELSE 0 END,
    r.used + CASE WHEN r.used + tok <= 20000 THEN tok WHEN r.used + sig <= 20000 THEN sig ELSE 0 END >= 20000 FROM r JOIN o ON o.g = r.g AND o.pos = r.pos + 1 WHERE NOT r.stopped
) SELECT g AS request, arg_max(used, pos) AS used, arg_max(original, pos) AS original, arg_max(n, pos) AS n FROM r GROUP BY g""")
def _(spark, sf):
    docs = cv.table(spark, sf, "documents")
    n = F.length("text")
    size = lambda k: F.greatest(F.lit(1), F.floor(n / k)).cast("long")
    rows = docs.select(F.col("source").alias("request_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("path"), size(4).alias("tok"), size(20).alias("sig_tok"), size(4).alias("orig"))
    return greedy(rows, 20_000)[1].withColumnRenamed("request_id", "request")


# Comparison, control and evolution ---------------------------------------------------------------


@_register("context_diff", "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'added' WHEN doc_id % 4 = 1 THEN 'removed' ELSE 'kept' END AS state, CASE WHEN doc_id % 4 > 1 THEN 0.25::DOUBLE END AS delta FROM documents")
def _(spark, sf):
    d = cv.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"))
    return compare.context_diff(d.where("doc_id % 4 <> 0").select("path", F.lit(0.25).alias("score")), d.where("doc_id % 4 <> 1").select("path", F.lit(0.5).alias("score")))


@_register("validate_requests", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'a changed file has another extension' ELSE '' END AS messages FROM documents")
def _(spark, sf):
    d = cv.table(spark, sf, "documents")
    reqs = d.select("doc_id", F.array(F.concat(F.lit("a"), F.when(F.col("source").isin("src0", "src1"), ".js").otherwise(".py"))).alias("changed_files"), F.lit("look").alias("query"))
    rules = compare.RequestRules().require_changed_files().require_max_files(3).require_extensions({".py"}).require_no_secrets()
    return rules.validate(reqs).select("doc_id", F.array_join(F.transform("violations", lambda v: v["message"]), "|").alias("messages"))


_LOG = "SELECT user_id AS key, epoch_us(ts) / 1000000.0 AS t, event_id AS id, event_type = 'error' AS failed FROM events"


def _log(spark, sf) -> DataFrame:
    e = cv.table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select(F.col("user_id").alias("key"), t.alias("t"), F.col("event_id").alias("id"), F.lit(1.0).alias("n"), (F.col("event_type") == "error").alias("failed"))


_ORDERED = f"o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS pos FROM ({_LOG}))"


@_register("rate_limiter_batch", f"""WITH RECURSIVE {_ORDERED}, r AS (
  SELECT key, pos, t, 1.0::DOUBLE AS tokens, 1::BIGINT AS granted, 0::BIGINT AS denied FROM o WHERE pos = 1
  UNION ALL SELECT o.key, o.pos, o.t, least(2.0, tokens + (o.t - r.t) * 0.0005) - CASE WHEN least(2.0, tokens + (o.t - r.t) * 0.0005) >= 1 THEN 1 ELSE 0 END, granted + CASE WHEN least(2.0, tokens + (o.t - r.t) * 0.0005) >= 1 THEN 1 ELSE 0 END, denied + CASE WHEN least(2.0, tokens + (o.t - r.t) * 0.0005) >= 1 THEN 0 ELSE 1 END
  FROM r JOIN o ON o.key = r.key AND o.pos = r.pos + 1
) SELECT key, arg_max(granted, pos) AS granted, arg_max(denied, pos) AS denied FROM r GROUP BY key""")
def _(spark, sf):
    return control.token_bucket(_log(spark, sf), 0.0005, 2.0).select("key", "granted", "denied")


@_register("circuit_breaker_batch", f"""WITH RECURSIVE {_ORDERED}, r AS (
  SELECT key, 0::BIGINT AS pos, 'closed' AS state, 0 AS failures, 0.0::DOUBLE AS since, 0::BIGINT AS passed, 0::BIGINT AS rejected, 0::BIGINT AS opened FROM o WHERE pos = 1
  UNION ALL
  SELECT key, pos, CASE WHEN st = 'open' THEN 'open' WHEN trips THEN 'open' WHEN failed THEN st ELSE 'closed' END, fl, CASE WHEN trips THEN t ELSE since END, passed + CASE WHEN st = 'open' THEN 0 ELSE 1 END, rejected + CASE WHEN st = 'open' THEN 1 ELSE 0 END, opened + CASE WHEN trips THEN 1 ELSE 0 END
  FROM (SELECT *, st <> 'open' AND failed AND (st = 'half_open' OR fl >= 2) AS trips FROM (SELECT *, CASE WHEN st = 'open' THEN failures WHEN failed THEN failures + 1 ELSE 0 END AS fl
    FROM (SELECT o.key, o.pos, o.t, o.failed, r.failures, r.since, r.passed, r.rejected, r.opened, CASE WHEN r.state = 'open' AND o.t - r.since >= 3600 THEN 'half_open' ELSE r.state END AS st FROM r JOIN o ON o.key = r.key AND o.pos = r.pos + 1)))
) SELECT key, arg_max(state, pos) AS state, arg_max(passed, pos) AS passed, arg_max(rejected, pos) AS rejected, arg_max(opened, pos) AS opened FROM r GROUP BY key""")
def _(spark, sf):
    return control.circuit_breaker(_log(spark, sf), 2, 3600.0)


@_register("cache_simulation", f"""WITH RECURSIVE {_ORDERED}, r AS (
  SELECT key, pos, t AS held, 0::BIGINT AS hits, 1::BIGINT AS misses FROM o WHERE pos = 1
  UNION ALL SELECT o.key, o.pos, CASE WHEN o.t - held <= 86400 THEN held ELSE o.t END, hits + CASE WHEN o.t - held <= 86400 THEN 1 ELSE 0 END, misses + CASE WHEN o.t - held <= 86400 THEN 0 ELSE 1 END FROM r JOIN o ON o.key = r.key AND o.pos = r.pos + 1
) SELECT key, arg_max(hits, pos) AS hits, arg_max(misses, pos) AS misses FROM r GROUP BY key""")
def _(spark, sf):
    return control.cache_hits(_log(spark, sf), 86_400.0)


@_register("retry_schedule", "SELECT r_regionkey, '0.5|1.0|2.0|3.0' AS delays FROM region")
def _(spark, sf):
    return cv.table(spark, sf, "region").select("r_regionkey", F.array_join(control.retry_delays(5, 0.5, 3.0).cast("array<string>"), "|").alias("delays"))


@_register("retry_outcomes", """SELECT doc_id, outcome, attempts::INT AS attempts, CASE attempts WHEN 1 THEN 0e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 1.5e0 ELSE 2.5e0 END AS waited, CASE WHEN outcome IN ('ok', 'refused') THEN attempts - 1 ELSE attempts END::INT AS audited FROM (
  SELECT doc_id, CASE WHEN f > 0 AND doc_id % 7 = 3 THEN 'refused' WHEN f < least_stop THEN 'ok' WHEN least_stop = 4 THEN 'exhausted' ELSE 'deadline' END AS outcome, CASE WHEN f > 0 AND doc_id % 7 = 3 THEN 1 ELSE least(f + 1, least_stop) END AS attempts
  FROM (SELECT doc_id, doc_id % 5 AS f, CASE doc_id % 3 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS least_stop FROM documents))""")
def _(spark, sf):
    """Up to four failures, then success; a try takes 0, 0.5 or 1 s; waits of 0.5, 1 and 1 s must end by 3 s."""
    d, seconds = F.col("doc_id"), (F.col("doc_id") % 3) * 0.5
    fails = F.sequence(F.lit(0), F.lit(3))
    tries = F.transform(F.concat(fails, F.array(F.lit(4))), lambda i: F.struct(F.when(i < d % 5, F.when((d % 7 == 3) & (i == 0), "ValueError").otherwise("TimeoutError")).alias("error"), seconds.alias("seconds")))
    calls = cv.table(spark, sf, "documents").select("doc_id", tries.alias("tries"))
    return control.retry_outcomes(calls, 4, 0.5, 1.0, 3.0, ("TimeoutError",)).select("doc_id", "outcome", "attempts", "waited", F.size("audit").alias("audited"))


@_register("store_migrations", "SELECT * FROM (VALUES (1, 'files, nodes and edges'), (2, 'flows'), (3, 'communities'), (4, 'risk'), (5, 'facts and repositories')) AS t(version, description)")
def _(spark, sf):
    from .sources.store import GraphStore
    from .staging import shared_dir

    store = GraphStore(spark, f"{shared_dir(spark)}/weftline/migrated-{uuid.uuid4().hex}")
    store.migrate()
    return store.migrations()


@_register("schema_evolution", "SELECT r_regionkey, upper(r_name) AS name, length(r_name)::INT AS size, 3 AS version FROM region")
def _(spark, sf):
    evo = SchemaEvolution(3)
    evo.register(1, 2, lambda d: d.withColumn("name", F.upper("r_name")).drop("r_name"), "upper-case names")
    evo.register(2, 3, lambda d: d.withColumn("size", F.length("name")), "add sizes")
    out, _audit = evo.migrate(cv.table(spark, sf, "region"), 1)
    return out.withColumnRenamed("__schema_version__", "version")


@_register("cross_repo_search", f"SELECT 'b' || k % 25 AS repo, 'src/b' || k % 25 AS root, name, split_part(node_id, '::', 1) AS file, kind FROM ({_SYMBOLS}) WHERE kind = 'method' AND lower(node_id) LIKE '%m\\_1%' ESCAPE '\\' QUALIFY row_number() OVER (PARTITION BY k % 25 ORDER BY node_id) <= 5")
def _(spark, sf):
    out = engine(spark, sf).query("cross_repo_search", repos=cv.spark_view(spark, sf, _REPOS), query="m_1*", kind="method", limit=5)
    return out.select("repo", "root", "name", "file", "kind")
