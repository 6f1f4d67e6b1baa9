"""Centroid clustering of integer vectors: float32 screening with error intervals, exact decisions.

Vectors become integers floor(scale * x). In every round a task multiplies its batch with the
centroids in float32 and gives each squared distance (less the vector's own norm) an interval
that holds the true value: with u the unit round-off and gamma = m u / (1 - m u) for
m = dims + 2, a product computed in any order, from inputs rounded to float32, is off by at most
gamma |x| |c|. Centroids whose interval reaches below the smallest upper end are the shortlist;
where it has more than one, their distances are recomputed in integers, and the smallest number
wins a tie. So every assignment is exact, and nearly all cost one matrix product.

Tasks return sums by centroid in digits of base 2^32, at most one row for each centroid and
digit, so sums are exact whatever the values; Spark adds the rows, and the driver divides
``k`` x ``dims`` numbers. The centroids (``k`` x ``dims``) are the only thing that reaches all tasks.

Defined results: vectors that are null, of another length or hold a null or non-finite component
are left out; repeated rows are vectors of their own; a null ``vec_id`` is kept, but starts a
centroid only after all others; equal hashes start in the order of their components; fewer than
``k`` vectors start as many centroids; an empty table has no rows; distances and inertias beyond
a long are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

DIMS, K, ROUNDS, SCALE = 64, 40, 5, 256
#: Below this size of the components squared distances fit in 64 bits.
_LONG = 1 << 27
_BASE = 32


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers where all are below ``_LONG``, Python integers otherwise."""
    x = np.floor(np.asarray(values, np.float64) * scale) if np.abs(values).max(initial=0) < 2.0**900 else None
    if x is not None and np.abs(x).max(initial=0) < _LONG:
        return x.astype(np.int64)
    out = [int(v * scale // 1) if abs(v) < 2.0**900 else int(v) * scale for v in np.asarray(values, np.float64).ravel().tolist()]
    return np.array(out, object).reshape(np.shape(values))


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Boolean (vectors, centroids): whether a centroid's interval reaches below the smallest upper end."""
    widest = max([abs(int(v)) for a in (x, c) for v in (a.max(initial=0), a.min(initial=0))])
    if widest >= 1 << 480:  # squares go beyond any float
        return np.ones((len(x), len(c)), bool)
    kind, unit = (np.float32, 2.0**-24) if widest**2 * x.shape[1] < 1 << 126 else (np.float64, 2.0**-53)
    m = x.shape[1] + 2
    gamma = m * unit / (1 - m * unit)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    xx, cc = np.sqrt((xf * xf).sum(1))[:, None], (cf * cf).sum(1)
    s = cc - 2 * (xf.astype(kind) @ cf.astype(kind).T).astype(np.float64)
    # Norms and sums in float64 are off by far less than the margin of 2^-40.
    wide = 2 * xx * np.sqrt(cc) * (gamma + 2.0**-40) + 2.0**-40 * cc
    return s - wide <= (s + wide).min(1)[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the exact squared distance of every vector."""
    near = shortlist(x, c)
    exact = x.dtype != object and c.dtype != object
    at = near.argmax(1)
    rows = np.flatnonzero(near.sum(1) > 1)
    for k in range(0, len(rows), 4096):
        own = rows[k : k + 4096]
        r, cols = np.nonzero(near[own])
        d = ((x[own][r] - c[cols]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(r, prepend=-1))
        if exact:
            low = np.minimum.reduceat(d, first)
            hit = np.flatnonzero(d == low[r])
            at[own] = cols[hit[np.searchsorted(r[hit], np.arange(len(own)))]]
        else:
            for i, (a, b) in enumerate(zip(first, [*first[1:], len(d)], strict=True)):
                at[own[i]] = cols[a + min(range(b - a), key=lambda j, a=a, d=d: d[a + j])]
    return at, ((x - c[at]) ** 2).sum(1)


def _parts(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of a batch, those with wide components apart, so that the others stay fast."""
    values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    wide = (np.abs(values) >= _LONG / scale / 2).any(1)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        for k in range(0, len(rows), 8192):
            yield rows[k : k + 8192], integers(values[rows[k : k + 8192]], scale)


def _digits(total: list[int]) -> list[list[int]]:
    """Sums in digits of base 2^32, the last one signed."""
    out = []
    while True:
        if all(-(1 << _BASE) < v < 1 << _BASE for v in total):
            return [*out, total]
        out.append([v & ((1 << _BASE) - 1) for v in total])
        total = [v >> _BASE for v in total]


def _summer(c: np.ndarray, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
        for batch in batches:
            for _, x in _parts(batch, dims, scale):
                at, _ = nearest(x, c)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                sums[at[order][first]] += np.add.reduceat(x[order], first, axis=0).astype(object)
                counts += np.bincount(at, minlength=len(c))
        rows = [{"cluster": i, "digit": j, "n": int(counts[i]) if j == 0 else 0, "v": [int(v) for v in d]} for i in np.flatnonzero(counts).tolist() for j, d in enumerate(_digits(sums[i].tolist()))]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int32()), ("digit", pa.int32()), ("n", pa.int64()), ("v", pa.list_(pa.int64()))]))

    return run


def _labeller(c: np.ndarray, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, x in _parts(batch, dims, scale):
                at, d = nearest(x, c)
                d = pa.array(d) if d.dtype != object else pa.array([v if v < 1 << 63 else None for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(at.astype(np.int32)), d], names=["vec_id", "cluster", "distance"])

    return run


def _starts(rows: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The first ``k`` vectors in the order of the hash of ``salt:vec_id``."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return integers(np.array([r.v for r in first], np.float64), scale) if first else np.zeros((0, 0), np.int64)


def narrow(c: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers where they fit."""
    return np.array(c, np.int64 if all(abs(v) < _LONG for row in c for v in row) else object)


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "2") -> np.ndarray:
    """Final centroids of ``rows`` (vec_id, v: array of doubles)."""
    c = _starts(rows, k, salt, scale)
    ddl = "cluster int, digit int, n long, v array<long>"
    for _ in range(rounds if len(c) else 0):
        parts = rows.select("v").mapInArrow(_summer(c, dims, scale), ddl)
        total = parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dims)]).alias("v")).collect()
        new, counts = c.tolist(), {}
        sums: dict[int, list[int]] = {}
        for r in total:  # k rows for each digit
            counts[r.cluster] = counts.get(r.cluster, 0) + r.n
            sums[r.cluster] = [a + (b << _BASE * r.digit) for a, b in zip(sums.get(r.cluster, [0] * dims), r.v, strict=True)]
        for i, s in sums.items():
            new[i] = [a // counts[i] for a in s]
        c = narrow(new)
    return c


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every usable vector (vec_id, embedding), and the centroids."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(v, dims)).select("vec_id", v.alias("v"))
    c = fit(rows, k, rounds, dims, scale, salt)
    if not len(c):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), c
    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(_labeller(c, dims, scale), f"vec_id {kind}, cluster int, distance long"), c


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    rows, c = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = staged(rows, "assigned")
    exact = lambda: F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("long"))
    by = rows.groupBy("cluster").agg(exact().alias("cluster_inertia"))
    total = rows.agg(exact().alias("inertia"))
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for i, r in enumerate(c.tolist())], "cluster int, centroid_sha256 string")
    about = by.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total))  # a row a centroid, and one row
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Lloyd rounds over rows of (vector, component)."""
    near = """a{r} AS MATERIALIZED (
  SELECT v, min(cluster) AS cluster, any_value(d) AS d FROM (
    SELECT v, cluster, d, min(d) OVER (PARTITION BY v) AS least FROM (
      SELECT x.v, c.cluster, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c ON x.i = c.i GROUP BY x.v, c.cluster)
  ) WHERE d = least GROUP BY v
)"""
    move = """c{n} AS MATERIALIZED (
  SELECT c.cluster, c.i, coalesce((m.s - (m.s % m.n + m.n) % m.n) // m.n, c.x) AS x FROM c{r} c
  LEFT JOIN (SELECT a.cluster, x.i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} a ON x.v = a.v GROUP BY a.cluster, x.i) m ON c.cluster = m.cluster AND c.i = m.i
)"""
    steps = [s for r in range(ROUNDS) for s in (near.format(r=r), move.format(r=r, n=r + 1))] + [near.format(r=ROUNDS)]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS v, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND list_count(embedding) = {DIMS} AND len(list_filter(embedding, lambda t: NOT isfinite(t))) = 0
), x AS MATERIALIZED (
  SELECT v, unnest(range({DIMS})) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e
), c0 AS MATERIALIZED (SELECT v AS cluster, i, x FROM x WHERE v < {K}),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT e.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM e JOIN a{ROUNDS} a ON e.v = a.v JOIN h ON a.cluster = h.cluster
"""


OP12_SQL = _sql()
