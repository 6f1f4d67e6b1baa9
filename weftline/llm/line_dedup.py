"""Line de-duplication over levelled sorted runs of line hashes. DataFrame functions only.

A run has one row per line key with its number of documents and largest document id, in sorted
buckets of the key's hashes. Every batch of documents is summed up by key and merge-joined with the
runs: a key that no run holds (the anti join) is new and enters the batch's run as it is, a known
one enters it with its totals so far. Totals only grow, so a key's state is its largest row. When a
level holds ``FANOUT`` runs they are merged into one run of the next level, so a key is rewritten a
logarithmic number of times. The runs are bucketed tables: only a batch's sums are shuffled to meet
them, never the runs. ``first_seen`` is the incremental form that returns a batch's new keys.

Lines are keyed by their text stripped of ASCII white space with A-Z lower-cased, as two
independent 64-bit hashes. Only keys of ``min_chars`` code points or more are considered, and
those found in ``min_docs`` documents or more lose every line but those in the largest
``doc_id`` that holds them.

Defined results: null or empty text is one empty line (kept text is empty; null becomes the
empty string); rows of one ``doc_id`` count as one document and each get a row; rows of null
``doc_id`` are one document, smaller than any other; lines with equal keys in one document count
once and stay or go together. Columns other than ``doc_id`` and ``text`` pass through, but for
columns named ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, drop_staged, let, new_path, staged, strip_ascii

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
_LEAST = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(strip_ascii(line))


def _hash(line: Column) -> Column:
    key = _key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("weftline"), key).alias("h2"))


class LineRuns:
    """Levelled runs (h1, h2, n_docs, max_doc), each in sorted buckets; a row holds its key's totals so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _written(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a run in the shared folder. The catalogue's entry goes at once: only its buckets are wanted."""
        name = f"weftline_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", new_path(self.spark, "line-run")).saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        return run

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (h1, h2, ...) that no run holds: merge anti join."""
        for r in self.runs():
            keys = keys.join(r.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def totals(self, keys: DataFrame) -> DataFrame:
        """A batch's (h1, h2, n_docs, max_doc) by key, with what the runs hold of known keys added.

        Every run is one left merge join: keys without a partner are those of the anti join.
        """
        out = keys.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        runs = self.runs()
        for k, r in enumerate(runs):
            out = out.join(r.select("h1", "h2", F.col("n_docs").alias(f"n{k}"), F.col("max_doc").alias(f"m{k}")).hint("merge"), ["h1", "h2"], "left")
        before = [F.coalesce(f"n{k}", F.lit(0)) for k in range(len(runs))]
        n_before = F.greatest(F.lit(0).cast("long"), *before) if before else F.lit(0)
        return out.select("h1", "h2", (F.col("n_docs") + n_before).alias("n_docs"), F.greatest("max_doc", F.lit(_LEAST).cast("long"), *(f"m{k}" for k in range(len(runs)))).alias("max_doc"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch's (h1, h2, n_docs, max_doc) as a run of level 0 and compact full levels."""
        fresh, level = self._written(self.totals(keys)), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(fresh)
            if len(self.levels[level]) < self.fanout:
                return
            old = self.levels[level]
            fresh, self.levels[level] = self._written(self._latest(old)), []
            level += 1
            for r in old:
                drop_staged(r)

    @staticmethod
    def _latest(runs: list[DataFrame], least: int = 0) -> DataFrame:
        """The last totals of every key of at least ``least`` documents."""
        parts = [r.where(F.col("n_docs") >= least) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if len(parts) == 1 else out.groupBy("h1", "h2").agg(F.max("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def compacted(self, least: int = 0) -> DataFrame | None:
        """One row per key over all runs, of keys found in ``least`` documents or more."""
        return self._latest(self.runs(), least) if self.runs() else None

    def drop(self) -> None:
        """Delete the runs' files."""
        for r in self.runs():
            drop_staged(r)
        self.levels = []


def first_seen(docs: DataFrame, runs: LineRuns, min_chars: int = MIN_CHARS) -> DataFrame:
    """Incremental use: new line keys of this batch (doc_id, h1, h2), then the batch joins the runs."""
    keys = staged(line_keys(docs, min_chars), "batch-keys")
    new = staged(runs.unseen(keys), "new-keys")
    runs.add(keys.select("h1", "h2", F.lit(1).cast("long").alias("n_docs"), F.col("doc").alias("max_doc")))
    return new


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, h1, h2: each document's distinct keys of at least ``min_chars`` code points."""
    long_lines = F.filter(_lines(F.col("text")), lambda x: F.length(x) >= min_chars)
    # Distinct as strings, which Spark does by a hash set; structures it would compare pair by pair.
    keys = F.transform(F.array_distinct(F.filter(F.transform(long_lines, _key), lambda k: F.length(k) >= min_chars)), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("weftline"), k).alias("h2")))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc")
    return docs.where(F.length("text") >= min_chars).select(doc, F.explode(keys).alias("k")).select("doc", "k.h1", "k.h2")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc, __gone: the key hashes that each document loses (documents that lose none are absent)."""
    spark = docs.sparkSession
    keys = line_keys(docs, min_chars)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():  # rows of one id are one document
        keys = keys.distinct()
    keys = keys.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    keys = staged(keys, "line-keys")
    runs = LineRuns(spark)
    for b in range(batches):
        batch = keys.where(F.col("batch") == b)
        runs.add(batch.select("h1", "h2", F.lit(1).cast("long").alias("n_docs"), F.col("doc").alias("max_doc")))
    common = staged(runs.compacted(min_docs), "common-lines")
    runs.drop()
    gone = keys.join(common, ["h1", "h2"]).where("doc <> max_doc")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("__gone"))


def _among(x: Column, ordered: Column, strides: Column) -> Column:
    """Whether ``x`` is in a sorted array: a binary search by strides, the greatest power of two first."""
    place = F.aggregate(strides, F.lit(-1), lambda at, by: F.when(F.get(ordered, at + by) <= x, at + by).otherwise(at))
    return F.coalesce(let(place, lambda at: (at >= 0) & (F.get(ordered, at) == x)), F.lit(False))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_lines, n_dropped (long) added."""
    gone = dropped_lines(docs, min_chars, min_docs).withColumnRenamed("doc", "__doc")
    rows = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)))
    out = rows.join(gone, rows["__key"] == gone["__doc"], "left")
    lines = _lines(F.col("text"))
    strides = F.transform(F.sequence(F.floor(F.log2(F.size("__gone"))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    out = out.withColumn("__strides", F.when(F.col("__gone").isNotNull(), strides))

    def stays(line: Column) -> Column:
        return ~((F.length(line) >= min_chars) & let(_hash(line), lambda h: _among(h, F.col("__gone"), F.col("__strides"))))

    out = out.withColumn("__left", F.when(F.col("__gone").isNotNull(), F.filter(lines, stays)))
    n_dropped = F.when(F.col("__gone").isNotNull(), F.size(lines) - F.size("__left")).otherwise(0)
    kept = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("__left", "\n"))
    out = out.withColumns({"__kept": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": n_dropped.cast("long")})
    return out.withColumn("text", F.col("__kept")).drop("__kept", "__key", "__doc", "__gone", "__strides", "__left")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND doc_id <> c.last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL OR doc_id = c.last), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
