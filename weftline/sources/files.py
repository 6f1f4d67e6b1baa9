"""File scans as DataFrames: path, source and an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix

#: Suffixes that are read and folders that are left out unless a caller says otherwise.
EXTENSIONS = (".py", ".pyi", ".js", ".mjs", ".ts", ".tsx", ".go", ".rs", ".java", ".cpp", ".c", ".h", ".rb", ".php")
EXCLUDED = ("venv", ".venv", "node_modules", "dist", "build", "__pycache__", ".git", ".tox", ".mypy_cache", ".pytest_cache", "*.egg-info")

#: The same for building a graph from a folder.
BUILD_EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java")
BUILD_EXCLUDED = ("venv", ".venv", "node_modules", ".git", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache")


def _listed(spark: SparkSession, root: str, extensions, exclude) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    return files.where(F.lower(suffix(F.col("path"))).isin(*extensions) & ~F.arrays_overlap(parts, F.array(*map(F.lit, exclude))))


def load_sources(spark: SparkSession, root: str, extensions=EXTENSIONS, exclude=EXCLUDED, max_bytes: int = 500_000, encoding: str = "utf-8") -> DataFrame:
    """path, source, modified, file_ord. Suffix, folder and size are tested before contents are read."""
    files = _listed(spark, root, extensions, exclude).where(F.col("length") <= max_bytes)
    text = F.make_valid_utf8(F.col("content").cast("string")) if encoding.lower().replace("-", "") == "utf8" else F.decode("content", encoding)
    out = files.select("path", text.alias("source"), F.col("modificationTime").alias("modified"))
    return with_order(out)


def with_order(files: DataFrame) -> DataFrame:
    """Adds file_ord, increasing in order of path and with gaps: a range sort, whose partitions number their rows apart."""
    ranged = files.sort("path").withColumn("__id", F.monotonically_increasing_id())
    return ranged.withColumnRenamed("__id", "file_ord")


def list_paths(spark: SparkSession, root: str, extensions=EXTENSIONS, exclude=EXCLUDED) -> DataFrame:
    """path only: contents are pruned from the scan."""
    return _listed(spark, root, extensions, exclude).select("path")


def listing(spark: SparkSession, root: str, extensions=EXTENSIONS, exclude=EXCLUDED, max_bytes: int = 500_000) -> DataFrame:
    """path, modified, length: contents are pruned from the scan."""
    files = _listed(spark, root, extensions, exclude).where(F.col("length") <= max_bytes)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


#: Paths that the driver hands to a scan; more are found by a scan of the whole folder.
_PATHS = 10_000


def sources_of(spark: SparkSession, root: str, paths: DataFrame, count: int) -> DataFrame:
    """path, source of ``count`` files below a root."""
    if count > _PATHS:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).join(paths, "path", "left_semi")
    else:
        named = [r.path for r in paths.collect()]
        if not named:
            return spark.createDataFrame([], "path string, source string")
        files = spark.read.format("binaryFile").load(named)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))


def load_changed(corpus: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of the corpus that ``paths`` (path) names; missing ones are left out."""
    return corpus.join(paths.select("path").distinct(), "path", "left_semi")


def snapshot_diff(before: DataFrame, after: DataFrame, stamp: str = "modified") -> DataFrame:
    """path, change (added, changed, removed) between two scans."""
    b, a = before.select("path", F.col(stamp).alias("b")), after.select("path", F.col(stamp).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full_outer").withColumn("change", change).where("change is not null").select("path", "change")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Text sink: one row per page, partitioned by name (page_name, content)."""
    pages.select("content", "page_name").write.mode("overwrite").partitionBy("page_name").text(folder)


def manifest(root: str, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """path, files_indexed, symbols_extracted, edges_created and root: a row per indexed file under one root.

    Written as JSON lines it is the manifest of a scan; a row per file keeps it splittable.
    """
    facts = stats.select(F.lit(root).alias("root"), "files_indexed", "symbols_extracted", "edges_created")  # one row
    return corpus.select("path").join(F.broadcast(facts), F.lit(True))


def write_manifest(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, root string, files_indexed long, symbols_extracted long, edges_created long").json(folder)
