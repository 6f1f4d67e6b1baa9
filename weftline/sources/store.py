"""Parquet tables: versions for whole writes, buckets of keys for updates.

Every whole write makes a new version, and the newest complete one is read, so a failed write
leaves the old one in place. Large tables are also divided into buckets by a hash of the file (or
name) that their rows belong to: ``merge`` and ``upsert`` rewrite those buckets of the newest
version that hold a changed row, by dynamic partition overwrite, and leave the files of all other
buckets alone. A reader that was opened before a merge has to be opened again after it. The root
may be any path Spark can write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_of
from ..staging import numbered, staged

#: Keys of the tables.
KEYS = {
    "nodes": ["node_id"], "edges": ["source_id", "target_id", "kind"], "files": ["path"], "links": ["name", "target"], "communities": ["community_id"], "community_summaries": ["community_id"],
    "flows": ["entry"], "risk_index": ["path"], "graph_meta": ["key"], "repos": ["root"],
}

#: Tables that are divided into buckets.
DIVIDED = ("files", "nodes", "edges", "links")
BUCKETS = 64


def owner(name: str, columns: list[str]) -> Column:
    """What the rows of a divided table belong to: a file, or an import name."""
    if name == "links":
        return F.col("name")
    return next(F.col(c) if c.endswith("path") else file_of(F.col(c)) for c in ("path", "node_id", "source_id", "file_path") if c in columns)


#: Versions of the store: what each adds, as empty tables or as columns of tables there are.
MIGRATIONS: list[tuple[int, str, dict[str, str]]] = [
    (1, "files, nodes and edges", {
        "files": "path string, file_ord long, language string, token_estimate long, sha256 string",
        "nodes": "node_id string, kind string, name string, qualified_name string, file_path string, line_start int, line_end int",
        "edges": "source_id string, target_id string, kind string, weight double",
    }),
    (2, "flows", {"flows": "entry string, flow_name string, node_count long, file_count long, depth long, criticality double"}),
    (3, "communities", {"nodes": "community_id long", "communities": "community_id long, label string, node_count long, dominant_language string"}),
    (4, "risk", {"risk_index": "path string, risk_score double, reasons array<string>, callers long, hits long, has_test boolean"}),
    (5, "facts and repositories", {"graph_meta": "key string, value string", "repos": "root string, name string, db_path string"}),
]


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """``buckets`` belongs to the store: the same number has to be given whenever it is opened."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self, name: str) -> int:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.root}/{name}/{n}/_SUCCESS"))), default=0)

    def _newest(self, name: str) -> str:
        return f"{self.root}/{name}/v{self._version(name)}"

    def exists(self, name: str) -> bool:
        return self._version(name) > 0

    def _read(self, name: str) -> DataFrame:
        if name not in DIVIDED:
            return self.spark.read.parquet(self._newest(name))
        path = self._newest(name)
        if not any(s.getPath().getName().startswith("__bucket=") for s in self._fs.listStatus(self._path(path))):  # empty: only its schema is there
            return self.spark.read.parquet(f"{path}/_schema").withColumn("__bucket", F.lit(0))
        return self.spark.read.option("mergeSchema", True).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self._read(name).drop("__bucket")

    def nodes(self) -> DataFrame:
        """Stored symbols; malformed rows, without an id, a file, a kind or a name, are left out."""
        return self.read("nodes").where("node_id IS NOT NULL AND file_path IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL")

    def fact(self, key: str) -> str | None:
        """A value of ``graph_meta``."""
        row = self.read("graph_meta").where(F.col("key") == key).first() if self.exists("graph_meta") else None
        return row.value if row else None

    def _divided(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(owner(name, df.columns)), F.lit(self.buckets)).cast("int"))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new version; the one before the last is removed."""
        v = self._version(name) + 1
        path = f"{self.root}/{name}/v{v}"
        if name in DIVIDED:
            df.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")
            self._divided(name, df).repartition("__bucket").write.mode("append").partitionBy("__bucket").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        self._fs.delete(self._path(f"{self.root}/{name}/v{v - 2}"), True)
        return self.read(name)

    def merge(self, name: str, gone: DataFrame, keys: list[str], new: DataFrame) -> None:
        """Rows whose ``keys`` are among ``gone`` go, ``new`` ones come; only buckets with such rows are rewritten.

        ``gone`` needs the column that a row's bucket follows from. A key ``step`` of edges is
        computed and not kept.
        """
        if not self.exists(name):
            self.write(name, new.drop("step"))
            return
        gone, new = staged(gone.select(*keys).distinct(), "gone"), staged(self._divided(name, new), "new")
        hit = [r[0] for r in self._divided(name, gone).select("__bucket").unionByName(new.select("__bucket")).distinct().collect()]  # bucket numbers
        if not hit:
            return
        old = self._read(name).where(F.col("__bucket").isin(hit))
        if "step" in keys:
            old = old.withColumn("step", F.when(F.col("kind").isin("imports", "dynamic_import"), 0).otherwise(1))
        rows = staged(old.join(gone, keys, "left_anti").unionByName(new, allowMissingColumns=True).drop("step"), "merged")
        path = self._newest(name)
        rows.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
        for b in set(hit) - {r[0] for r in rows.select("__bucket").distinct().collect()}:  # nothing is left there
            self._fs.delete(self._path(f"{path}/__bucket={b}"), True)

    def upsert(self, name: str, df: DataFrame, order: str | None = None) -> DataFrame:
        """Merge by key: new rows replace old ones; of repeated keys the row with the largest ``order`` stays."""
        keys = KEYS[name]
        if order:
            rest = [c for c in df.columns if c not in keys]
            df = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        else:
            df = df.dropDuplicates(keys)
        if not self.exists(name):
            return self.write(name, df)
        if name in DIVIDED:
            self.merge(name, df, keys, df)
            return self.read(name)
        return self.write(name, df.unionByName(self.read(name).join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True))

    def migrations(self) -> DataFrame:
        """version, description of the migrations applied."""
        return self.read("schema_migrations") if self.exists("schema_migrations") else self.spark.createDataFrame([], "version int, description string")

    def schema_version(self) -> int:
        return self.migrations().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def migrate(self, migrations: list[tuple[int, str, dict[str, str]]] = MIGRATIONS) -> list[int]:
        """Applies what is newer than the store's version, in order; each is recorded once it is complete.

        A table that is missing is made empty; columns that a table lacks are added as nulls, so a
        migration cut short can be run again. Returns the versions applied.
        """
        now, done = self.schema_version(), []
        for version, description, tables in sorted(migrations, key=lambda m: m[0]):
            if version <= now:
                continue
            for name, schema in tables.items():
                empty = self.spark.createDataFrame([], schema)
                if not self.exists(name):
                    self.write(name, empty)
                elif set(empty.columns) - set(self.read(name).columns):
                    self.append(name, empty)
            self.append("schema_migrations", self.spark.createDataFrame([(version, description)], "version int, description string"))
            done.append(version)
        return done

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows; files that are there stay unless the columns differ."""
        if self.exists(name) and name not in DIVIDED and set(df.columns) == set(self.read(name).columns):
            df.write.mode("append").parquet(self._newest(name))
            return self.read(name)
        return self.write(name, self.read(name).unionByName(df, allowMissingColumns=True) if self.exists(name) else df)

    def assign_communities(self, assigned: DataFrame) -> DataFrame:
        """assigned: node_id, community_id."""
        return self.write("nodes", self.read("nodes").drop("community_id").join(assigned, "node_id", "left"))

    def risk_index(self, min_score: float = 0.0) -> DataFrame:
        return self.read("risk_index").where(F.col("risk_score") >= min_score).orderBy(F.desc("risk_score"), "path")

    def save_flows(self, flows: DataFrame) -> DataFrame:
        """Adds a snapshot (flow_name, entry, node_count, file_count, criticality and more); ids go on from the largest
        stored one, most critical first. Returns the rows with their ``id``."""
        last = self.read("flow_snapshots").agg(F.max("id")).first()[0] if self.exists("flow_snapshots") else 0
        rows = staged(numbered(flows, "id", F.desc("criticality"), "entry").withColumn("id", F.col("id") + F.lit((last or 0) + 1)), "snapshot")
        self.append("flow_snapshots", rows)
        return rows

    def list_flows(self, sort_by: str = "criticality", limit: int = 50) -> DataFrame:
        """Of the newest ``2 * limit`` snapshots, the first ``limit`` by criticality, node_count, file_count (largest
        first) or name; equal ones newest first."""
        newest = self.read("flow_snapshots").orderBy(F.desc("id")).limit(2 * limit)
        key = {"node_count": F.desc("node_count"), "file_count": F.desc("file_count"), "name": F.asc("flow_name")}.get(sort_by, F.desc("criticality"))
        return newest.orderBy(key, F.desc("id")).limit(limit)

    def save_summaries(self, summaries: DataFrame) -> DataFrame:
        """Replaces summaries of communities: community_id, summary_text, key_symbols and more."""
        return self.upsert("community_summaries", summaries)

    def communities(self, min_size: int = 0) -> DataFrame:
        """Stored communities, largest first."""
        return self.read("communities").where(F.col("node_count") >= min_size).orderBy(F.desc("node_count"), "community_id")

    def unregister_repo(self, root: str) -> bool:
        """Takes a repository out of the registry; whether it was there."""
        root, rows = root.rstrip("/"), self.repos()
        if not rows.where(F.col("root") == root).limit(1).count():
            return False
        self.write("repos", staged(rows.where(F.col("root") != root), "repos"))
        return True

    def register_repo(self, root: str, name: str | None = None, db_path: str = "") -> DataFrame:
        """Adds a repository to the registry, or replaces its row."""
        root = root.rstrip("/")
        row = [(root, name or root.rsplit("/", 1)[-1], db_path or f"{root}/.weftline")]
        return self.upsert("repos", self.spark.createDataFrame(row, "root string, name string, db_path string"))

    def repos(self) -> DataFrame:
        """root, name, db_path of registered repositories."""
        return self.read("repos") if self.exists("repos") else self.spark.createDataFrame([], "root string, name string, db_path string")

    def stats(self) -> DataFrame:
        """table, rows; schema_version stands among the tables once the store has been migrated."""
        out = self.migrations().agg(F.lit("schema_version").alias("table"), F.max("version").cast("long").alias("rows")).select("table", "rows") if self.exists("schema_migrations") else None
        for name in KEYS:
            if self.exists(name):
                one = self.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "table string, rows long")

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
