"""Dependency edges from parsed files. Every resolution is an equi join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stem
from ..staging import staged

IMPORTS, DYNAMIC_IMPORT, INHERITS, DECORATES = "imports", "dynamic_import", "inherits", "decorates"
WEIGHTS = {IMPORTS: 1.0, DYNAMIC_IMPORT: 0.6, INHERITS: 1.5, DECORATES: 0.8}


def path_keys(files: DataFrame) -> DataFrame:
    """path, file_ord, k, key: four module names a file."""
    bare = F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    last = lambda n: F.array_join(F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts), ".")
    full = F.when(F.startswith("path", F.lit("/")), F.concat(F.lit("/."), F.array_join(parts, "."))).otherwise(F.array_join(parts, "."))
    return files.select("path", "file_ord", F.posexplode(F.array(stem(F.col("path")), last(3), last(2), full)).alias("k", "key"))


def path_index(files: DataFrame) -> DataFrame:
    """key, path, key_ord: module names; the last file wins, the first place stays."""
    return path_keys(files).groupBy("key").agg(F.max_by("path", F.struct("file_ord", "k")).alias("path"), F.min(F.struct("file_ord", "k")).alias("key_ord"))


#: Characters of a prefix that are looked up before it is cut out in full.
_HEAD = 6


def prefix_cuts(left: DataFrame, column: str, right: DataFrame, prefix: str) -> DataFrame:
    """A row of ``left`` for each prefix of the column's text that has a length which occurs on the right among prefixes
    of the same head, so texts that begin like none are cut nowhere."""
    heads = right.select(F.substring(prefix, 1, _HEAD).alias("__head"), F.length(prefix).alias("n")).where("n > 0").groupBy("__head").agg(F.collect_set("n").alias("__n"))
    heads = staged(heads, "prefix-heads")
    lengths = heads.agg(F.collect_set(F.length("__head")).alias("__m"))  # one row of lengths
    cut = lambda n: F.transform(F.filter(n, lambda i: i <= F.length(column)), lambda i: F.substring(F.col(column), F.lit(1), i))
    begun = left.join(F.broadcast(lengths), F.lit(True)).withColumn("__head", F.explode(cut("__m"))).drop("__m").join(heads, "__head")
    return begun.withColumn(prefix, F.explode(cut("__n"))).drop("__n", "__head")


def prefix_pairs(left: DataFrame, column: str, right: DataFrame, prefix: str) -> DataFrame:
    """Rows of ``left`` joined with those of ``right`` whose text is a prefix of the column's: an equi join on the prefixes."""
    return prefix_cuts(left, column, right, prefix).join(right, prefix)


#: Keys that ``path_keys`` gives a file.
_KEYS = 4


def resolve_imports(names: DataFrame, index: DataFrame, cap: int = 3) -> DataFrame:
    """name, target, rank (1 to cap) for distinct import names: exact key first, then keys of which
    one is the other's prefix, in index order, different targets only.

    A prefix of keys keeps its best rows on the map side, before it meets the names; ``cap`` files have at most
    ``_KEYS`` rows each among them. So a short name that many keys begin with sends few rows to its task.
    """
    names = staged(names.select("name").where("name is not null and name <> ''").distinct(), "import-names")
    index = staged(index.select("key", "path", "key_ord"), "path-index")
    over = prefix_cuts(index, "key", names, "name")
    under = prefix_pairs(names, "name", index, "key").where("key <> name")
    order = F.struct((F.col("key") != F.col("name")).alias("loose"), "key_ord")
    hits = over.unionByName(under).select("name", "path", order.alias("o"))
    best = hits.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("o"))).where(F.col("at") <= cap * _KEYS)
    targets = best.join(names, "name", "left_semi").groupBy("name", "path").agg(F.min("o").alias("o"))
    ranked = targets.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("o")))
    return ranked.where(F.col("rank") <= cap).select("name", F.col("path").alias("target"), "rank")


def import_names(files: DataFrame) -> DataFrame:
    """path, name: what files import, at run time too."""
    return files.where("error is null").select("path", F.explode(F.array_distinct(F.concat("imports", "dynamic_imports"))).alias("name"))


def import_edges(files: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of files' imports by resolved names (``links``: name, target, rank)."""
    good = files.where("error is null")
    used = lambda column, d: good.select("path", "file_ord", F.lit(d).alias("d"), F.posexplode(column).alias("i", "name"))
    found = used("imports", 0).unionByName(used("dynamic_imports", 1)).join(links, "name")
    order = F.array(F.lit(0), F.col("file_ord"), F.col("d"), F.col("i"), F.col("rank")).cast("array<bigint>")
    return _edge(found, F.concat("path", F.lit("::__module__")), F.concat("target", F.lit("::__module__")), F.col("d") == 0, (IMPORTS, DYNAMIC_IMPORT), order)


def _edge(df: DataFrame, source, target, first, kinds: tuple[str, str], order) -> DataFrame:
    """Edges of two kinds: of the first one where ``first`` holds."""
    pick = lambda x, y: F.when(first, F.lit(x)).otherwise(F.lit(y))
    return df.select(source.alias("source_id"), target.alias("target_id"), pick(*kinds).alias("kind"), pick(*(WEIGHTS[k] for k in kinds)).alias("weight"), order.alias("edge_ord"))


def name_index(nodes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """name, target_id: short and qualified names (of ``among``, if given); the last node wins."""
    names = nodes.select("node_id", F.struct("file_ord", "sym_ord").alias("o"), F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    names = names if among is None else names.join(among.select("name").distinct(), "name", "left_semi")
    return names.where("name <> '__module__'").groupBy("name").agg(F.max_by("node_id", F.struct("o", "node_id")).alias("target_id"))


def references(nodes: DataFrame) -> DataFrame:
    """node_id, file_ord, sym_ord, step, i, name: bases (step 1) and decorators (step 2) by the name they are looked up by."""
    rows = lambda column, step, name: nodes.select("node_id", "file_ord", "sym_ord", F.lit(step).alias("step"), F.posexplode(column).alias("i", "ref")).withColumn("name", name).drop("ref")
    return rows("bases", 1, F.col("ref")).unionByName(rows("decorators", 2, F.split_part("ref", F.lit("."), F.lit(1))))


def named_edges(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Edges from references to the nodes that bear their names."""
    order = F.array(F.col("step"), F.col("file_ord"), F.col("sym_ord"), F.col("i"), F.lit(0)).cast("array<bigint>")
    return _edge(refs.join(index, "name"), F.col("node_id"), F.col("target_id"), F.col("step") == 1, (INHERITS, DECORATES), order)


def resolved_names(files: DataFrame) -> DataFrame:
    """name, target, rank of every name that files import."""
    return resolve_imports(import_names(files), path_index(files.where("error is null")))


def build_edges(files: DataFrame, nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, kind, weight, edge_ord (comparable array, in order of creation); ``links`` spares resolving the names."""
    links = resolved_names(files) if links is None else links
    refs = references(nodes)
    return import_edges(files, links).unionByName(named_edges(refs, name_index(nodes, refs)))
