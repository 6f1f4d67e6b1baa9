"""Incremental maintenance: what a change of files does to files, nodes, names and edges.

A changed, new or removed file is parsed (or not) alone. From it follow, by joins with the stored
tables: the module keys that appear, vanish or move; the import names that stand in a prefix
relation to such a key, which alone can resolve differently; and the symbol names whose last
bearer is another one now. Edges are made anew for the changed files, for files that import such
a name and for symbols that refer to such a name; all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .edges import import_edges, import_names, name_index, named_edges, path_index, path_keys, prefix_pairs, references, resolve_imports
from .parse import nodes_of


class Delta:
    """For each table the rows that go, by key, and the rows that come. Files and nodes are there at once; what follows
    from them for names and edges is looked up and written when it is first asked for."""

    def __init__(self, paths: DataFrame, files: DataFrame, nodes: DataFrame, follow: Callable[[], tuple[DataFrame, ...]]):
        self.paths = paths  # path: files that change, come or go
        self.files, self.nodes, self._follow = files, nodes, follow  # their new rows

    @cached_property
    def _followed(self) -> tuple[DataFrame, ...]:
        return self._follow()

    @property
    def names(self) -> DataFrame:
        """name: import names resolved anew."""
        return self._followed[0]

    @property
    def links(self) -> DataFrame:
        return self._followed[1]

    @property
    def sources(self) -> DataFrame:
        """source_id, step: whose edges of imports (0) or names (1) are made anew."""
        return self._followed[2]

    @property
    def edges(self) -> DataFrame:
        return self._followed[3]

    def merged_nodes(self, files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Files and nodes after the change."""
        return replaced(files, self.paths, ["path"], self.files), replaced(nodes, self.paths.withColumnRenamed("path", "file_path"), ["file_path"], self.nodes)

    def merged_links(self, links: DataFrame) -> DataFrame:
        return replaced(links, self.names, ["name"], self.links)

    def merged_edges(self, edges: DataFrame) -> DataFrame:
        return replaced(edges.withColumn("step", step_of(F.col("kind"))), self.sources, ["source_id", "step"], self.edges).drop("step")


def replaced(old: DataFrame, gone: DataFrame, keys: list[str], new: DataFrame) -> DataFrame:
    return old.join(gone, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def step_of(kind):
    """0 for edges of imports, 1 for edges of names."""
    return F.when(kind.isin("imports", "dynamic_import"), 0).otherwise(1)


def _moved(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column of rows that are in one table only."""
    return old.exceptAll(new).unionByName(new.exceptAll(old)).select(name).distinct()


def change(files: DataFrame, nodes: DataFrame, links: Callable[[], DataFrame], fresh: DataFrame, removed: DataFrame | None = None) -> Delta:
    """The delta of parsed new rows ``fresh`` and of files that go, ``removed`` (path), against stored tables."""
    paths = fresh.select("path")
    paths = staged((paths if removed is None else paths.unionByName(removed.select("path"))).distinct(), "touched")
    fresh_nodes = staged(nodes_of(fresh), "fresh-nodes")
    return Delta(paths, fresh, fresh_nodes, lambda: _followed(files, nodes, links(), fresh, paths, fresh_nodes))


def _followed(files: DataFrame, nodes: DataFrame, links: DataFrame, fresh: DataFrame, paths: DataFrame, fresh_nodes: DataFrame) -> tuple[DataFrame, ...]:
    """Names, links, sources and edges that follow from a change of files and nodes."""
    after_files, after_nodes = replaced(files, paths, ["path"], fresh), replaced(nodes, paths.withColumnRenamed("path", "file_path"), ["file_path"], fresh_nodes)
    good = after_files.where("error is null")

    # Module keys, and the import names that can resolve differently.
    gone = files.where("error is null").join(paths, "path", "left_semi")
    keys = staged(_moved(path_keys(gone), path_keys(fresh.where("error is null")), "key"), "moved-keys")
    used = import_names(after_files)
    known = used.select("name").distinct()
    touched = prefix_pairs(known, "name", keys, "key").select("name").unionByName(prefix_pairs(keys, "key", known, "name").select("name")).distinct()
    touched = staged(touched, "touched-names")
    own = import_names(fresh).select("name").distinct()
    unused = import_names(gone).select("name").distinct().join(known, "name", "left_anti")
    names = staged(touched.unionByName(own).unionByName(unused).distinct(), "renewed-names")
    new_links = staged(resolve_imports(names.join(known, "name", "left_semi"), path_index(good)), "renewed-links")

    # Files whose imports are looked up again: the new ones, and those that import such a name.
    importing = used.join(touched, "name", "left_semi").select("path").unionByName(fresh.where("error is null").select("path")).distinct()
    importing = staged(importing, "importing")
    own_files = after_files.join(importing, "path", "left_semi")
    all_links = replaced(links, names, ["name"], new_links)
    needed = all_links.join(import_names(own_files).select("name").distinct(), "name", "left_semi")

    # Symbol names with another last bearer, and who refers to them.
    lost = nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    borne = lambda n: n.select(F.explode(F.array("name", "qualified_name")).alias("name"))
    names_of_symbols = staged(borne(lost).unionByName(borne(fresh_nodes)).distinct(), "touched-symbols")
    moved = staged(_moved(name_index(nodes, names_of_symbols), name_index(after_nodes, names_of_symbols), "name"), "moved-symbols")
    refs = references(after_nodes)
    referring = staged(refs.join(moved, "name", "left_semi").select("node_id").unionByName(fresh_nodes.select("node_id")).distinct(), "referring")
    refs = refs.join(referring, "node_id", "left_semi")

    module = lambda p: p.select(F.concat("path", F.lit("::__module__")).alias("source_id"), F.lit(0).alias("step"))
    symbols = referring.unionByName(lost.select("node_id")).distinct()
    sources = module(importing.unionByName(paths).distinct()).unionByName(symbols.select(F.col("node_id").alias("source_id"), F.lit(1).alias("step")))
    edges = import_edges(own_files, needed).unionByName(named_edges(refs, name_index(after_nodes, refs)))
    return names, new_links, staged(sources, "renewed-sources"), staged(edges.withColumn("step", step_of(F.col("kind"))), "renewed-edges")
