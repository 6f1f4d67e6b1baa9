"""Ordered state machines over event logs: token bucket, circuit breaker, cache, retries.

Each key's events are folded in order of time over sorted partitions: a task holds one state and
one Arrow batch, whatever the length of a key's log. For unbounded streams use
``weftline.streaming``, which keeps only the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable, end: Callable) -> DataFrame:
    """Rows of ``schema`` from folding the rows of each key in an order.

    ``step(state, key, *other columns)`` returns (state, output rows), ``end(state, key)`` the last
    output rows of a key. A key's rows are sorted, not gathered, so they may exceed memory.
    """
    rows = rows.select(key, *[c for c in rows.columns if c != key])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (key, state) of the key at hand
        for batch in batches:
            out: list[tuple] = []
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != k:
                    if held is not None:
                        out += end(held[1], held[0])
                    held = (k, start())
                state, more = step(held[1], k, *rest)
                held = (k, state)
                out += more
            if out:
                yield batch_of(out)
        if held is not None and (out := end(held[1], held[0])):
            yield batch_of(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def token_bucket(events: DataFrame, rate: float = 5.0, capacity: float = 5.0) -> DataFrame:
    """key, granted, denied, tokens (left) for events (key, t in seconds, n, id)."""

    def step(state, key, t, _, n):
        tokens, last, granted, denied = state
        tokens = min(float(capacity), tokens + (t - (t if last is None else last)) * rate)
        return ((tokens - n, t, granted + 1, denied) if tokens >= n else (tokens, t, granted, denied + 1)), []

    rows = events.select("key", "t", "id", F.col("n").cast("double").alias("n"))
    kind = dict(rows.dtypes)["key"]
    return fold_sorted(rows, "key", ["t", "id"], f"key {kind}, granted long, denied long, tokens double", lambda: (float(capacity), None, 0, 0), step, lambda s, k: [(k, s[2], s[3], round(s[0], 6))])


def circuit_breaker(events: DataFrame, threshold: int = 5, reset: float = 60.0) -> DataFrame:
    """key, state, passed, rejected, opened for events (key, t, failed, id)."""
    rows = events.select("key", "t", "id", "failed")
    kind = dict(rows.dtypes)["key"]

    def step(s, key, t, _, failed):
        return breaker_step(s, t, failed, threshold, reset), []

    return fold_sorted(rows, "key", ["t", "id"], f"key {kind}, state string, passed long, rejected long, opened long", lambda: BREAKER_START, step, lambda s, k: [(k, s[0], *s[3:])])


#: state, failures in a row, time of opening, passed, rejected, opened.
BREAKER_START = ("closed", 0, 0.0, 0, 0, 0)


def breaker_step(s: tuple, t: float, failed: bool | None, threshold: int, reset: float) -> tuple:
    """The breaker's state after a call at time ``t``: open ones reject until ``reset`` seconds have gone by."""
    state, failures, since, passed, rejected, opened = s
    if state == "open" and t - since >= reset:
        state = "half_open"
    if state == "open":
        return state, failures, since, passed, rejected + 1, opened
    if not failed:
        return "closed", 0, since, passed + 1, rejected, opened
    if state == "half_open" or failures + 1 >= threshold:
        return "open", failures + 1, t, passed + 1, rejected, opened + 1
    return state, failures + 1, since, passed + 1, rejected, opened


def cache_hits(events: DataFrame, ttl: float | None = 600.0) -> DataFrame:
    """key, hits, misses of a cache that holds every key for ``ttl`` seconds after it was set."""
    rows = events.select("key", "t", "id")
    kind = dict(rows.dtypes)["key"]

    def step(s, key, t, _):
        held, hits, misses = s
        hit = held is not None and (not ttl or t - held <= ttl)
        return ((held, hits + 1, misses) if hit else (t, hits, misses + 1)), []

    return fold_sorted(rows, "key", ["t", "id"], f"key {kind}, hits long, misses long", lambda: (None, 0, 0), step, lambda s, k: [(k, *s[1:])])


def retry_delays(attempts: int = 3, base: float = 0.5, most: float = 30.0) -> Column:
    """Waits before each further attempt, without jitter."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 2)), lambda k: F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), k))) if attempts > 1 else F.expr("cast(array() as array<double>)")


def retry_outcomes(calls: DataFrame, attempts: int = 3, base: float = 0.5, most: float = 30.0, deadline: float | None = None, retry_on: tuple[str, ...] | None = None) -> DataFrame:
    """Calls (tries: array of (error, seconds), null error for success) with what a retry policy makes of them.

    Adds outcome (ok; refused: an error outside ``retry_on``; deadline: the next wait would pass it;
    exhausted), attempts, waited (seconds) and audit: an array of (attempt, error, delay) for each
    error that was routed to a retry. Waits double from ``base`` up to ``most``, without jitter; tries
    after the last allowed attempt are not looked at, and a call with fewer tries than that is pending.
    """
    start = F.struct(
        F.lit("pending").alias("outcome"), F.lit(0).alias("attempts"), F.lit(0.0).alias("waited"), F.lit(0.0).alias("clock"),
        F.expr("cast(array() as array<struct<attempt:int,error:string,delay:double>>)").alias("audit"),
    )

    def step(s: Column, x: Column) -> Column:
        n, delay = s["attempts"] + 1, F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), s["attempts"]))
        clock = s["clock"] + F.coalesce(x["seconds"], F.lit(0.0))
        routed = F.lit(True) if retry_on is None else x["error"].isin(*retry_on)
        late = F.lit(False) if deadline is None else clock + delay > F.lit(float(deadline))
        outcome = F.when(x["error"].isNull(), "ok").when(~routed, "refused").when(n >= attempts, "exhausted").when(late, "deadline").otherwise("pending")
        waits = outcome == "pending"
        entry = F.array(F.struct(n.cast("int").alias("attempt"), x["error"].alias("error"), delay.alias("delay")))
        audit = F.when(outcome.isin("ok", "refused"), s["audit"]).otherwise(F.concat(s["audit"], entry))
        new = F.struct(outcome.alias("outcome"), n.cast("int").alias("attempts"), (s["waited"] + F.when(waits, delay).otherwise(0.0)).alias("waited"), (clock + F.when(waits, delay).otherwise(0.0)).alias("clock"), audit.alias("audit"))
        return F.when(s["outcome"] != "pending", s).otherwise(new)

    folded = calls.withColumn("__r", F.aggregate(F.slice("tries", 1, attempts), start, step))
    return folded.select(*calls.columns, "__r.outcome", "__r.attempts", "__r.waited", "__r.audit")
