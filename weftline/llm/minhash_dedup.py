"""Near-duplicate groups by MinHash with tensored banding.

A document's set holds its distinct five-word shingles (A-Z lower-cased). Two small families
of half keys, ``left`` and ``right``, are computed from ``2 * HALVES * ROWS`` minhashes; every
pair (left i, right j) forms one table's key, so ``HALVES ** 2`` tables cost about the square
root of the minhashes that independent tables would need. Candidates are confirmed on full
shingle sets taken from the texts, and only confirmed links form groups.

Rows with equal shingle sets collapse into one class before any candidate is formed, so a
group of thousands of copies costs one representative. In a table, members are compared with
the bucket's smallest id. Members of buckets that still hold several groups are looked at again
by an exact prefix filter: their shingles are ordered from the rarest to the most frequent, and
two sets can only link if they share one of the first ``n - ceil(percent * n) + 1`` of each. At
a shared shingle, what is left of both sets bounds their overlap from above, so most places are
ruled out before a pair is formed. Rounds compare every remaining place with the shingle's place
nearest to the front, which joins most of a group; when a round finds nothing new, the places of
different groups that the bound still allows are compared in full, so no link is missed and the
pairs formed stay few.

Defined results: null or wordless text has the empty set and links with nothing; fewer than
five words form one shingle; repeated rows of one ``doc_id`` appear once per row and share a
component (rows of one id with different texts are linked by any of them); null ``doc_id`` is treated as its own component (null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged

SHINGLE = 5
#: Minhashes in a half key, and half keys in each of the two families (49 tables from 28 minhashes).
#: A pair at Jaccard 0.85 shares a left and a right key with probability 0.9997.
ROWS, HALVES = 2, 7
#: Shingles that a worker holds before it hands them on, and pairs of one document in one salt.
_TOGETHER, HOT = 1_000_000, 4096
_MASK = (1 << 64) - 1


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, _MASK, size=n, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, _MASK, size=n, dtype=np.uint64, endpoint=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        acc = np.full(1, len(h), np.uint64)
        for x in h:
            acc = _mix(acc + x)
        return acc
    n = len(h) - SHINGLE + 1
    acc = np.full(n, SHINGLE, np.uint64)
    for i in range(SHINGLE):
        acc = _mix(acc + h[i : i + n])
    return np.unique(acc)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    a, b = _mixers(2 * ROWS * HALVES)
    for batch in batches:
        ids, out = batch.column(0), ([], [], [], [])
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            out[0].append(len(s))
            raw = s.tobytes()
            out[1].append(xxhash.xxh3_128_digest(raw).hex() if len(s) else None)
            if not len(s):
                out[2].append([])
                out[3].append([])
                continue
            low = np.full(len(a), _MASK, np.uint64)
            for at in range(0, len(s), 8192):
                low = np.minimum(low, (s[at : at + 8192, None] * a + b).min(axis=0))
            keys = _mix(low[0::2] * np.uint64(0x9E3779B97F4A7C15) + low[1::2]).view(np.int64)
            out[2].append(keys[:HALVES].tolist())
            out[3].append(keys[HALVES:].tolist())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_hash", "left", "right"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for the empty set) and both families of half keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _signatures, "doc_id long, n_shingles long, set_hash string, left array<long>, right array<long>"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets, size = [], [], 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc.as_py())
            sets.append(shingle_set(text.as_py()).view(np.int64))
            size += len(sets[-1])
            if size >= _TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])
                ids, sets, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])


def sets_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """rep, sid, n, shingles: the full sets of the documents in ``ids`` (rep), staged; texts are shuffled once, here."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    texts = texts.join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = texts.dropDuplicates() if repeated else texts
    sets = texts.mapInArrow(_sets, "rep long, shingles array<long>")
    return staged(sets.select("rep", F.xxhash64("shingles").alias("sid"), F.size("shingles").alias("n"), "shingles"), "candidate-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (src, dst), those whose full shingle sets have Jaccard >= percent / 100.

    A document that stands in many pairs as ``src`` is read once for each ``HOT`` of them: its
    pairs and its set are spread over that many salts.
    """
    hot = pairs.groupBy("src").agg(F.ceil(F.count("*") / HOT).alias("salts")).where("salts > 1")
    salted = pairs.join(hot, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).alias("salt"))
    a = sets.join(hot, sets["rep"] == hot["src"], "left").select(F.col("rep").alias("src"), F.col("shingles").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    b = sets.select(F.col("rep").alias("dst"), F.col("shingles").alias("t"))
    both = salted.join(b, "dst").join(a, ["src", "salt"])
    common = F.size(F.array_intersect("s", "t"))
    return both.where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("src", "dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest reachable id) for every node of the links.

    Alternating large-star and small-star rounds over staged link tables: every round is a
    few hash aggregations and joins, a hub's links are never gathered in one task, and the
    loop ends when the links no longer change.
    """

    def minima(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        return both, low.select("src", F.least("src", "low").alias("low"))

    edges = staged(links.where("src <> dst").select("src", "dst").distinct(), "links")
    before = None
    while True:
        both, low = minima(edges)
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        large = staged(large, "large-star")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            down.join(low, "src")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .unionByName(low.select("src", F.col("low").alias("dst")))
            .where("src <> dst")
            .distinct()
        )
        small = staged(small, "small-star")
        state = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        drop_staged(edges)
        drop_staged(large)
        edges = small
        if state == before:
            break
        before = state
    low = edges.groupBy("src").agg(F.min("dst").alias("component"))
    roots = edges.select(F.col("dst").alias("node")).distinct().join(low.select(F.col("src").alias("node")), "node", "left_anti")
    return low.select(F.col("src").alias("node"), "component").unionByName(roots.select("node", F.col("node").alias("component")))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, i, j, rep, c (its group) of the buckets that hold several groups."""
    known = members.join(comp, members["rep"] == comp["node"], "left").select("key", "i", "j", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    return known.join(mixed, "key")


def _prefixes(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, pos, s: places in the prefixes of the sets of ``ids``, of shingles that two sets hold or more.

    Shingles are ordered by the number of sets that hold them, then by hash. Those of one set
    alone take the first positions and can tie it to no other, so they get no rows.
    """
    own = sets.join(ids, "rep", "left_semi").select("rep", "sid", "n", F.explode("shingles").alias("s"))
    known = own.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = own.join(known, "s").groupBy("rep", "sid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    length = (F.floor((100 - percent) * F.col("n") / 100) + 1).cast("int")
    alone = F.col("n") - F.size("x")
    front = F.slice("x", F.lit(1), F.greatest(length - alone, F.lit(0)))
    return shared.select("rep", "n", alone.alias("alone"), F.posexplode(front).alias("at", "x")).select("rep", "n", (F.col("alone") + F.col("at")).alias("pos"), "x.s")


def _reaches(n: Column, pos: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether sets of n and n2 shingles that share those at pos and pos2 first can reach the threshold."""
    most = F.least(n - pos, n2 - pos2)
    return 100 * most >= percent * (n + n2 - most)


def _undecided(places: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Places of shingles that hold several groups (c), with the shingle's place nearest to the front (p_...).

    Places that could reach the threshold with no set of the shingle's least size are gone first.
    """
    e = places.join(comp, places["rep"] == comp["node"], "left").select("rep", "n", "pos", "s", F.coalesce("component", "rep").alias("c"))
    least = e.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("n").alias("n0")).where("c0 < c1").select("s", "n0")
    most = F.col("n") - F.col("pos")
    e = e.join(least, "s").where(100 * most >= percent * (F.col("n") + F.greatest("n0", most) - most)).drop("n0")
    front = e.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("pos", "rep", "n", "c")).alias("p")).where("c0 < c1")
    return staged(e.join(front.select("s", F.col("p.pos").alias("p_pos"), F.col("p.rep").alias("p_rep"), F.col("p.n").alias("p_n"), F.col("p.c").alias("p_c")), "s"), "undecided")


def _new_pairs(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    """Distinct (src, dst) in order of their ids, without those tested before."""
    out = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
    for t in tested:
        out = out.join(t, ["src", "dst"], "left_anti")
    return staged(out, "candidates")


def _settle(open_: DataFrame, sets: DataFrame, links: DataFrame, comp: DataFrame, tested: list[DataFrame], percent: int) -> DataFrame:
    """node, component after every pair of open members that the prefix filter allows is decided."""
    places = staged(_prefixes(open_, sets, percent), "prefixes")
    col = F.col
    while True:
        left = _undecided(places, comp, percent)
        star = left.where((col("c") != col("p_c")) & _reaches(col("n"), col("pos"), col("p_n"), col("p_pos"), percent))
        star = _new_pairs(star.select(col("rep").alias("src"), col("p_rep").alias("dst")), tested)
        found = staged(confirmed(star, sets, percent), "confirmed")
        tested.append(star)
        if not found.limit(1).count():
            break
        links = links.unionByName(found)
        comp = staged(components(links), "components")
        drop_staged(left)
    a = left.select("s", *(col(x).alias(y) for x, y in (("rep", "src"), ("c", "ca"), ("n", "na"), ("pos", "pa"))))
    b = left.select("s", *(col(x).alias(y) for x, y in (("rep", "dst"), ("c", "cb"), ("n", "nb"), ("pos", "pb"))))
    rest = a.join(b, "s").where((col("src") < col("dst")) & (col("ca") != col("cb")) & _reaches(col("na"), col("pa"), col("nb"), col("pb"), percent))
    found = staged(confirmed(_new_pairs(rest, tested), sets, percent), "confirmed")
    drop_staged(places)
    drop_staged(left)
    return staged(components(links.unionByName(found)), "components") if found.limit(1).count() else comp


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    sig = staged(signatures(docs), "minhash")
    # One representative for each shingle set; equal sets have equal half keys.
    reps = (
        sig.where("set_hash is not null and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    )
    reps = staged(reps, "classes")
    keyed = reps.select("rep", F.posexplode("left").alias("i", "l"), "right").select("rep", "i", "l", F.posexplode("right").alias("j", "r"))
    keyed = keyed.select("rep", F.xxhash64("i", "j", "l", "r").alias("key"))
    stats = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    # Members of buckets that hold several classes, with the bucket's smallest id.
    members = staged(keyed.join(stats.select("key", "low"), "key").select("key", "rep", "low"), "buckets")
    tested = _new_pairs(members.where("rep > low").select(F.col("low").alias("src"), F.col("rep").alias("dst")), [])
    repeated = bool(sig.groupBy("doc_id").count().where("count > 1").limit(1).count())
    sets = sets_of(docs, members.select("rep"), repeated)
    links = staged(confirmed(tested, sets, percent), "confirmed")
    comp = staged(components(links), "components")
    # Members of buckets that are not all in one group.
    known = members.join(comp, members["rep"] == comp["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    open_ = staged(known.join(mixed, "key", "left_semi").select("rep").distinct(), "open-members")
    if open_.limit(1).count():
        comp = _settle(open_, sets, links, comp, [tested], percent)
    for t in (members, tested, open_, sets):
        drop_staged(t)
    # Back to every row: a set's class, then the class's component.
    final = reps.join(comp, reps["rep"] == comp["node"], "left").select("set_hash", "copies", F.coalesce("component", "rep").alias("component"), "rep")
    # Only sets that are shared or linked need a lookup; hot sets are spread over 16 salts.
    lookup = final.where("copies > 1 or component <> rep").select("set_hash", "component", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    rows = sig.select("doc_id", "n_shingles", "set_hash", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("salt"))
    out = rows.join(lookup, ["set_hash", "salt"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
