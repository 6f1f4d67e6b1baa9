"""Streams: live indexing of a folder, token buckets and circuit breakers per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ContextConfig
from ..operators.control import BREAKER_START, breaker_step
from ..plans.engine import Engine, update_store
from ..sources.files import EXCLUDED, EXTENSIONS, listing, snapshot_diff, sources_of
from ..sources.store import GraphStore
from ..staging import numbered, staged


def _known(store: GraphStore) -> DataFrame:
    return store.read("listing") if store.exists("listing") else store.spark.createDataFrame([], "path string, modified timestamp, length long")


def refresh(store: GraphStore, folder: str, extensions=EXTENSIONS, exclude=EXCLUDED, config: ContextConfig | None = None) -> tuple[int, int]:
    """Brings a stored graph up to date with a folder; how many files were read, and how many had gone.

    The folder's listing (no contents) is compared with that of the last time, so changes and
    deletions show. Only files that are new or have another time or length are read and parsed,
    and only buckets with rows that follow from them are rewritten. The new listing is stored
    last: an update that broke off is found again.
    """
    spark = store.spark
    now = staged(listing(spark, folder, extensions, exclude), "listing")
    moved = staged(snapshot_diff(_known(store).withColumn("stamp", F.struct("modified", "length")), now.withColumn("stamp", F.struct("modified", "length")), "stamp"), "moved")
    counts = {r["change"]: r["count"] for r in moved.groupBy("change").count().collect()}
    if not counts:
        return 0, 0
    read = moved.where("change <> 'removed'").select("path")
    sources = staged(sources_of(spark, folder, read, counts.get("added", 0) + counts.get("changed", 0)), "sources")
    if store.exists("files"):
        # A file that stays keeps its place; new ones follow in the order of their paths.
        places = store.read("files").select("path", "file_ord")
        last = places.agg((F.coalesce(F.max("file_ord"), F.lit(-1)) + 1).alias("next"))
        new = numbered(sources.join(places, "path", "left_anti"), "n", "path").join(F.broadcast(last), F.lit(True))  # last: one row
        rows = new.select("path", "source", (F.col("n") + F.col("next")).alias("file_ord")).unionByName(sources.join(places, "path").select("path", "source", "file_ord"))
        update_store(store, rows, moved.where("change = 'removed'").select("path"), config)
    else:
        Engine(numbered(sources, "file_ord", "path").select("path", "source", "file_ord"), config).save(store)
    store.write("listing", now)
    return counts.get("added", 0) + counts.get("changed", 0), counts.get("removed", 0)


def watch(store: GraphStore, folder: str, checkpoint: str, every: str = "2 seconds", extensions=EXTENSIONS, exclude=EXCLUDED, config: ContextConfig | None = None):
    """A stream that refreshes a stored graph ``every`` so often, until it is stopped. Returns the query.

    The stream's rows are the ticks of a clock; a tick that is run again after a failure finds
    what the first try left to do.
    """
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    step = lambda _batch, _number: refresh(store, folder, extensions, exclude, config)
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def rate_limited(events: DataFrame, rate: float = 5.0, capacity: float = 5.0, late: str = "10 minutes") -> DataFrame:
    """key, granted, denied per micro-batch for a stream of (key, ts); state is a key's bucket only.

    Events within a batch are taken in order of time; the watermark lets idle keys expire.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t.timestamp() for f in frames for t in f["ts"])
        tokens, last = state.get if state.exists else (capacity, times[0])
        granted = 0
        for t in times:
            tokens = min(capacity, tokens + max(0.0, t - last) * rate)
            last = max(last, t)
            if tokens >= 1:
                tokens, granted = tokens - 1, granted + 1
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + int(1000 * capacity / rate) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "granted": [granted], "denied": [len(times) - granted]})

    keyed = events.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(step, "key long, granted long, denied long", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def circuit_broken(events: DataFrame, threshold: int = 5, reset: float = 60.0, late: str = "10 minutes", idle: float = 86_400.0) -> DataFrame:
    """key, state, passed, rejected, opened (totals so far) per micro-batch for a stream of (key, ts, failed).

    Events within a batch are taken in order of time, failures after successes of the same instant;
    a key's breaker is forgotten ``idle`` seconds of event time after its last event.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = tuple(state.get) if state.exists else BREAKER_START
        log = sorted((t.timestamp(), bool(failed)) for f in frames for t, failed in zip(f["ts"], f["failed"], strict=True))
        for t, failed in log:
            s = breaker_step(s, t, failed, threshold, reset)
        state.update(s)
        state.setTimeoutTimestamp(max(int((log[-1][0] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "state": [s[0]], "passed": [s[3]], "rejected": [s[4]], "opened": [s[5]]})

    keyed = events.withWatermark("ts", late).groupBy("key")
    schema = "state string, failures long, since double, passed long, rejected long, opened long"
    return keyed.applyInPandasWithState(step, "key long, state string, passed long, rejected long, opened long", schema, "append", GroupStateTimeout.EventTimeTimeout)
