"""Column functions over paths and sources. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file by its suffix.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".rb": "ruby", ".php": "php",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".tf": "hcl", ".hcl": "hcl", ".tfvars": "hcl",
}
#: Words that make a file security relevant.
SECURITY_WORDS = (
    "password", "secret", "token", "api_key", "auth", "crypt", "hash", "jwt", "oauth", "bearer", "credential", "private_key", "sign", "verify", "encrypt", "decrypt",
    "sanitize", "escape", "sql", "query", "execute", "inject", "xss", "csrf", "cors", "permission", "sudo", "root", "admin",
)
#: Dynamic imports of Python, in order of their patterns.
DYNAMIC_IMPORTS = (
    r"""importlib\.import_module\(["']([^"']+)["']\)""",
    r"""__import__\(["']([^"']+)["']\)""",
    r"""importlib\.util\.spec_from_file_location\([^,]+,\s*["']([^"']+)["']\)""",
    r"""plugin\s*=\s*__import__\(["']([^"']+)["']\)""",
)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _ends_with(end: str):
    return lambda x: F.endswith(x, F.lit(end))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def detect_language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    ext = F.lower(suffix(path))
    helm = path.rlike(r"(^|[/\\])templates[/\\]") | file_name(path).isin("Chart.yaml", "values.yaml")
    return F.when(ext.isin(".yaml", ".yml"), F.when(helm, "helm").otherwise("unknown")).otherwise(F.coalesce(F.try_element_at(table, ext), F.lit("unknown")))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def line_count(text: Column) -> Column:
    """Lines as an editor numbers them: no empty line after the last line break."""
    breaks = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    pairs = (F.length(text) - F.length(F.replace(text, F.lit("\r\n")))) / 2
    count = F.length(text) - F.length(F.translate(text, breaks, "")) - pairs
    return F.when(F.length(text) == 0, 0).otherwise(count + F.when(F.right(text, F.lit(1)).isin(*breaks), 0).otherwise(1)).cast("long")


def is_test(path: Column) -> Column:
    low, name = F.lower(path), file_name(path)
    return _any([F.contains(low, F.lit(x)) for x in ("/test", "/tests/", "\\test", "\\tests\\")] + [F.startswith(name, F.lit("test_"))] + [F.endswith(name, F.lit(x)) for x in ("_test.py", ".test.ts", ".spec.ts", ".test.js")])


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a segment or the stem equals a pattern, or ends with what follows its star."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    names = [p.removesuffix("/*").lower() for p in patterns]
    plain, stars = [p for p in names if not p.startswith("*")], [p[1:] for p in names if p.startswith("*")]
    tests = [F.arrays_overlap(parts, F.array(*map(F.lit, plain))) | F.lower(stem(path)).isin(plain)] if plain else []
    tests += [F.exists(parts, _ends_with(s)) for s in stars]
    return _any(tests) if tests else F.lit(False)


def security_hits(text: Column) -> Column:
    """Security words in a text. Boundaries are those of ASCII words and letters fold as in Unicode (long s, Kelvin sign),
    as RE2 has it; Java's ``\\b`` and ``(?i)`` do it the other way round."""
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    folded = "|".join(SECURITY_WORDS).replace("s", "[s\u017f]").replace("k", "[k\u212a]")
    return F.regexp_count(text, F.lit(f"(?i){edge}({folded}){edge}")).cast("long")


def dynamic_imports(text: Column) -> Column:
    """Names that Python sources import at run time: pattern by pattern, first seen once."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DYNAMIC_IMPORTS)))


def head(text: Column, lines: int = 60) -> Column:
    """The first lines of a source."""
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")


def signature_lines(text: Column, most: int) -> Column:
    """Lines that open a definition, as review contexts show them."""
    keep = lambda x: F.ltrim(x).rlike(r"^(def |async def |class |func |fn )") | x.rlike(r"^(export |module |pub fn |interface )")
    return F.slice(F.filter(F.split(text, "\n", -1), keep), 1, most)


def query_tokens(text: Column) -> Column:
    """Distinct lower-case words of a query."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def symbol_tokens(text: Column) -> Column:
    """Parts of symbol names for TF-IDF: camel humps and numbers, lower case, two letters or more."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z][a-z]*|\d+"), F.lit(0)), F.lower), lambda t: F.length(t) > 1)


def file_of(node_id: Column) -> Column:
    return F.split_part(node_id, F.lit("::"), F.lit(1))
