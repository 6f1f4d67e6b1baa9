"""Parsing: sources to symbols, imports and signatures.

Python needs its own grammar, so it runs in Arrow batches; the other languages use regular
expressions whose matches need offsets for line numbers, so they share the batch. Metrics are
JVM expressions. A file that cannot be parsed yields a row whose ``error`` says why.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LanguageNotSupported
from ..functions import text as tx
from ..staging import staged

SYMBOL = "struct<kind:string,name:string,qualified_name:string,line_start:int,line_end:int,signature:string,decorators:array<string>,bases:array<string>,is_async:boolean,meta:map<string,string>>"
PARSED = f"symbols array<{SYMBOL}>, imports array<string>, dynamic_imports array<string>, signatures string, error string"
PARSED_COLUMNS = ["symbols", "imports", "dynamic_imports", "signatures", "error"]


def _symbol(kind, name, qual=None, line=0, end=0, signature="", decorators=(), bases=(), is_async=False, **meta):
    return {"kind": kind, "name": name, "qualified_name": qual or name, "line_start": line, "line_end": end, "signature": signature, "decorators": list(decorators), "bases": list(bases), "is_async": is_async, "meta": meta}


def _stem(path: str) -> str:
    name = path.rpartition("/")[2]
    if name in ("", "."):
        return PurePosixPath(path).stem
    dot = name.rfind(".")
    return name[:dot] if 0 < dot < len(name) - 1 else name


def _unique(items) -> list[str]:
    return list(dict.fromkeys(items))


def _dotted(node: ast.expr, calls: bool = False) -> str:
    """A name with its attributes, through calls if ``calls``; what has no name counts as an empty one."""
    names: list[str] = []
    while isinstance(node, ast.Attribute) or calls and isinstance(node, ast.Call):
        if isinstance(node, ast.Call):
            node = node.func
        else:
            names.append(node.attr)
            node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "", *reversed(names)])


def _written(node: ast.expr) -> str:
    """An annotation as text; a plain name needs no unparser."""
    return node.id if isinstance(node, ast.Name) else ast.unparse(node)


def _signature(fn) -> str:
    shown = lambda a: a.arg + (f": {_written(a.annotation)}" if a.annotation else "")
    args = [shown(a) for a in (*fn.args.args, *fn.args.posonlyargs, *fn.args.kwonlyargs)]
    args += [star + a.arg for star, a in (("*", fn.args.vararg), ("**", fn.args.kwarg)) if a]
    returns = f" -> {_written(fn.returns)}" if fn.returns else ""
    return f"{'async ' * isinstance(fn, ast.AsyncFunctionDef)}def {fn.name}({', '.join(args)}){returns}"


@functools.lru_cache(1)
def _tree(source: str) -> ast.Module:
    """The tree of the source at hand, which symbols and signatures both read."""
    return ast.parse(source)


_DEFINITIONS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
_DYNAMIC = [re.compile(p) for p in tx.DYNAMIC_IMPORTS]


def _definitions(tree: ast.Module) -> Iterator[ast.stmt]:
    """Classes and functions in the order of ``ast.walk``; they stand in blocks only, so no expression is gone into."""
    level: list[ast.AST] = [tree]
    while level:
        below = []
        for node in level:
            if isinstance(node, _DEFINITIONS):
                yield node
            for block in ("body", "handlers", "orelse", "finalbody", "cases"):
                below += getattr(node, block, ())
        level = below


def parse_python(path: str, source: str) -> dict:
    tree = _tree(source)
    symbols, imports = [_symbol("module", _stem(path), line=1, end=len(source.splitlines()))], []

    def visit(parent, prefix):
        for node in parent.body:
            if isinstance(node, _DEFINITIONS):
                qual = f"{prefix}.{node.name}" if prefix else node.name
                decorators = [d for d in (_dotted(x, True) for x in node.decorator_list) if d]
                if isinstance(node, ast.ClassDef):
                    bases = [b for b in map(_dotted, node.bases) if b]
                    symbols.append(_symbol("class", node.name, qual, node.lineno, node.end_lineno, f"class {node.name}", decorators, bases))
                else:
                    kind = "method" if prefix else "function"
                    symbols.append(_symbol(kind, node.name, qual, node.lineno, node.end_lineno, _signature(node), decorators, is_async=isinstance(node, ast.AsyncFunctionDef)))
                visit(node, qual)
            elif isinstance(node, ast.Import):
                imports.extend(a.name for a in node.names)
            elif isinstance(node, ast.ImportFrom) and node.module:
                imports.extend([node.module, *(f"{node.module}.{a.name}" for a in node.names)])

    visit(tree, "")
    dynamic = [m for p in _DYNAMIC for m in p.findall(source)]
    return {"symbols": symbols, "imports": _unique(imports), "dynamic_imports": _unique(dynamic)}


def python_signatures(source: str) -> str:
    try:
        tree = _tree(source)
    except SyntaxError:
        return source[:500]
    out = []
    for node in _definitions(tree):
        doc = (ast.get_docstring(node) or "") if isinstance(node.body[0], ast.Expr) else ""
        if isinstance(node, ast.ClassDef):
            out.append(f"class {node.name}({', '.join(map(_dotted, node.bases))}):")
            out += [f'    """{doc[:120]}"""'] * bool(doc)
        else:
            out.append(f"    {_signature(node)}")
            out += [f'        """{doc[:80]}"""'] * bool(doc)
    return "\n".join(out)


#: Definitions and imports of the languages read by pattern; group 1 is the name.
PATTERNS = {
    "javascript": (
        ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"),
        ("function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>"),
        ("class", r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"),
        ("import", r"""import\s+.*?\s+from\s+["']([^"']+)["']"""),
        ("import", r"""require\(["']([^"']+)["']\)"""),
        ("dynamic", r"""import\(["']([^"']+)["']\)"""),
    ),
    "typescript": (
        ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
        ("function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>"),
        ("class", r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"),
        ("import", r"""import\s+.*?\s+from\s+["']([^"']+)["']"""),
        ("import", r"""require\(["']([^"']+)["']\)"""),
        ("dynamic", r"""import\(["']([^"']+)["']\)"""),
    ),
    "go": (
        ("function", r"^func\s+(\w+)\s*\("),
        ("receiver", r"^func\s+\(\w+\s+\*?(\w+)\)\s+(\w+)\s*\("),
        ("class", r"^type\s+(\w+)\s+struct\s*\{"),
        ("interface", r"^type\s+(\w+)\s+interface\s*\{"),
        ("import", r'"([^"]+)"'),
        ("dynamic", r"""plugin\.Open\(["']([^"']+)["']\)"""),
    ),
    "rust": (
        ("function", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\(([^)]*)\)"),
        ("import", r"use\s+([\w:]+)"),
        ("dynamic", r"""libloading::Library::new\(["']([^"']+)["']\)"""),
    ),
    "bash": (
        ("shell", r"^(?:function\s+)?(\w+)\s*\(\s*\)\s*\{"),
        ("import", r"^(?:source|\.)\s+([\w./\-]+)"),
        ("variable", r"^(?:export\s+)?([A-Z_][A-Z0-9_]{2,})\s*="),
        ("eval", r"""\beval\s+["'`]([^"'`]+)["'`]"""),
    ),
    "hcl": (
        ("resource", r'^resource\s+"([^"]+)"\s+"([^"]+)"\s*\{'),
        ("data", r'^data\s+"([^"]+)"\s+"([^"]+)"\s*\{'),
        ("module", r'^module\s+"([^"]+)"\s*\{'),
        ("setting", r'^variable\s+"([^"]+)"\s*\{'),
        ("output", r'^output\s+"([^"]+)"\s*\{'),
        ("import", r'^\s*source\s*=\s*"([^"]+)"'),
    ),
}
_COMPILED = {lang: [(k, re.compile(p, re.MULTILINE)) for k, p in ps] for lang, ps in PATTERNS.items()}


def _found(kind: str, m: re.Match, line: int) -> dict:
    """The symbol of a match."""
    signature = m[0][:120]
    if kind == "receiver":
        return _symbol("method", m[2], f"{m[1]}.{m[2]}", line, signature=signature, receiver_type=m[1])
    if kind == "interface":
        return _symbol("class", m[1], line=line, signature=signature, is_interface="true")
    if kind in ("resource", "data"):
        return _symbol("class", m[2], f"{m[1]}.{m[2]}", line, signature=signature, hcl_block=kind, resource_type=m[1])
    if kind in ("module", "output"):
        return _symbol("function" if kind == "output" else "module", m[1], f"{kind}.{m[1]}", line, signature=signature, hcl_block=kind)
    if kind == "setting":
        return _symbol("variable", m[1], f"var.{m[1]}", line, hcl_block="variable")
    if kind == "variable":
        return _symbol("variable", m[1], line=line)
    if kind == "shell":
        return _symbol("function", m[1], line=line, signature=f"function {m[1]}()")
    return _symbol(kind, m[1], line=line, signature=signature, is_async="async" in signature)


def parse_patterns(language: str) -> Callable[[str, str], dict]:
    def parse(path: str, source: str) -> dict:
        symbols, imports, dynamic = [_symbol("module", _stem(path))], [], []
        for kind, pattern in _COMPILED.get(language, ()):
            for m in pattern.finditer(source):
                if kind == "import":
                    imports.append(m[1])
                elif kind in ("dynamic", "eval"):
                    dynamic.append(m[1][:80] if kind == "eval" else m[1])
                else:
                    symbols.append(_found(kind, m, source.count("\n", 0, m.start()) + 1))
        return {"symbols": symbols, "imports": _unique(imports), "dynamic_imports": _unique(dynamic)}

    return parse


def _bash_signatures(source: str) -> str:
    return "\n".join(f"function {m[1]}()" for m in _COMPILED["bash"][0][1].finditer(source)) or source[:200]


def _hcl_signatures(source: str) -> str:
    """Headers of blocks, kind by kind."""
    return "\n".join(m[0].rstrip("{").strip() for _, pattern in _COMPILED["hcl"][:5] for m in pattern.finditer(source)) or source[:200]


_PARSERS: dict[str, Callable[[str, str], dict]] = {"python": parse_python, **{lang: parse_patterns(lang) for lang in PATTERNS}}
_SIGNATURES: dict[str, Callable[[str], str]] = {"python": python_signatures, "bash": _bash_signatures, "hcl": _hcl_signatures}


def get_parser(language: str) -> Callable[[str, str], dict]:
    if language not in _PARSERS:
        raise LanguageNotSupported(language)
    return _PARSERS[language]


def register_parser(language: str, parser: Callable[[str, str], dict], signatures: Callable[[str], str] | None = None) -> None:
    """A parser takes (path, source) and returns symbols, imports and dynamic_imports."""
    _PARSERS[language] = parser
    if signatures:
        _SIGNATURES[language] = signatures


def register_table_function(spark, name: str, parser: Callable[[str, str], dict]) -> None:
    """A parser as a table function of SQL: a row per symbol.

    ``SELECT f.path, s.* FROM files f, LATERAL name(f.path, f.source) s``; a source that the parser
    refuses gives one row whose ``error`` says why.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="kind string, name string, qualified_name string, line_start int, line_end int, signature string, error string")
    class Symbols:
        def eval(self, path: str, source: str):
            try:
                found = parser(path, source or "")["symbols"]
            except Exception as e:  # one source never fails the query
                yield None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            for x in found:
                yield x["kind"], x["name"], x["qualified_name"], x["line_start"], x["line_end"], x["signature"], None

    spark.udtf.register(name, Symbols)


def _module_only(path: str, source: str) -> dict:
    return {"symbols": [_symbol("module", _stem(path))], "imports": [], "dynamic_imports": []}


def _head(source: str) -> str:
    return "\n".join(source.splitlines()[:60])


_ARROW = pa.struct([
    *((n, pa.string()) for n in ("kind", "name", "qualified_name")), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string()), ("decorators", pa.list_(pa.string())),
    ("bases", pa.list_(pa.string())), ("is_async", pa.bool_()), ("meta", pa.map_(pa.string(), pa.string())),
])


def _symbol_lists(rows: list[list[dict] | None]) -> pa.Array:
    """Lists of symbols in Arrow, field by field."""
    flat, ends, none = [], [0], []
    for symbols in rows:
        flat += symbols or ()
        ends.append(len(flat))
        none.append(symbols is None)
    fields = [pa.array([x.get(f.name) for x in flat], f.type) for f in _ARROW]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ARROW)), mask=pa.array(none) if any(none) else None)


#: Rows of a batch that are handed on together, and characters of source after which they are handed on anyway.
_ROWS, _CHARS = 500, 4_000_000


def parsed(corpus: DataFrame) -> DataFrame:
    """files: path, file_ord, language, metrics, symbols, imports, dynamic_imports, signatures, error.

    Sources are dealt by path before anything is read from them: metrics and parsing are most of the work, and a small
    table of them may lie in one partition. Metrics are columns beside the source, which leaves after parsing.
    """
    parsers, signers = dict(_PARSERS), dict(_SIGNATURES)

    def one(path: str, language: str, source: str) -> tuple:
        try:
            row = parsers.get(language, _module_only)(path, source) | {"error": None}
        except Exception as e:  # one file never fails the job
            row = {"symbols": [], "imports": [], "dynamic_imports": [], "error": f"{type(e).__name__}: {e}"}
        try:
            signatures = signers.get(language, _head)(source)
        except Exception as e:
            signatures, row["error"] = source[:500], row["error"] or f"{type(e).__name__}: {e}"
        symbols = [x | {"meta": list(x["meta"].items())} for x in row["symbols"]]
        return symbols, row["imports"], row["dynamic_imports"], signatures, row["error"]

    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.drop_columns(["source"])
            at, size, rows = 0, 0, []
            for i, (path, language, source) in enumerate(zip(*(batch.column(n) for n in ("path", "language", "source")), strict=True)):
                text = source.as_py() or ""
                rows.append(one(path.as_py(), language.as_py(), text))
                size += len(text)
                if len(rows) == _ROWS or size > _CHARS or i + 1 == batch.num_rows:
                    part = plain.slice(at, len(rows))
                    new = [_symbol_lists([r[0] for r in rows]), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *PARSED_COLUMNS])
                    at, size, rows = i + 1, 0, []

    s = F.coalesce("source", F.lit(""))
    spark = corpus.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = corpus.select("path", "file_ord", "source").repartition(tasks, "path").select(
        "path", F.col("file_ord").cast("long").alias("file_ord"), tx.detect_language(F.col("path")).alias("language"), F.octet_length(s).cast("long").alias("size_bytes"), tx.line_count(s).alias("line_count"),
        F.sha2(s, 256).alias("sha256"), tx.token_estimate(s).alias("token_estimate"), F.length(s).cast("long").alias("chars"), s.alias("source"),
    )
    head = "path string, file_ord long, language string, size_bytes long, line_count long, sha256 string, token_estimate long, chars long"
    return rows.mapInArrow(run, f"{head}, {PARSED}")


def nodes_of(files: DataFrame) -> DataFrame:
    """A row per symbol: node_id and its order; repeated names in a file keep the first place, last value.

    A file's own module is ``__module__`` in node ids; its qualified name is the file's stem.
    Ids are dealt and compared only of files that may share one with another row: those with a repeated path or
    symbol, or with a colon in either. All other files give their rows as they are.
    """
    good = files.where("error is null").select("path", "file_ord", "language", "symbols")
    name = lambda s: F.when((s["kind"] == "module") & (s["name"] == s["qualified_name"]), "__module__").otherwise(s["qualified_name"])
    names = F.transform("symbols", name)
    apart = (F.size(F.array_distinct(names)) == F.size("symbols")) & ~F.exists(names, lambda x: F.coalesce(F.contains(x, F.lit(":")), F.lit(True))) & ~F.contains("path", F.lit(":"))
    shared = good.groupBy("path").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(apart, F.lit(False))).alias("apart")).where("n > 1 or not apart").select("path")
    shared = staged(shared, "shared-ids")

    def rows(part: DataFrame) -> DataFrame:
        part = part.select("path", "file_ord", "language", F.posexplode("symbols").alias("sym_ord", "s"))
        return part.select(F.concat("path", F.lit("::"), name(F.col("s"))).alias("node_id"), F.col("path").alias("file_path"), "language", "s.*", "file_ord", "sym_ord")

    repeated = rows(good.join(shared, "path", "left_semi"))
    value = F.struct(*[c for c in repeated.columns if c not in ("node_id", "sym_ord")])
    grouped = repeated.groupBy("node_id").agg(F.max_by(value, "sym_ord").alias("v"), F.min("sym_ord").alias("sym_ord"))
    return rows(good.join(shared, "path", "left_anti")).unionByName(grouped.select("node_id", "v.*", "sym_ord"))


def index_stats(files: DataFrame) -> DataFrame:
    """One row: files_indexed, files_skipped, symbols_extracted, languages (map)."""
    ok = F.col("error").isNull()
    by = files.groupBy("language").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("bad"), F.sum(F.when(ok, F.size("symbols")).otherwise(0)).alias("symbols"))
    return by.agg(F.sum("n").alias("files_indexed"), F.sum("bad").alias("files_skipped"), F.sum("symbols").alias("symbols_extracted"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("languages"))
