"""Schema evolution, audited pipelines and result caches: functions from DataFrame to DataFrame."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import WeftlineError
from ..staging import staged

VERSION = "__schema_version__"


class SchemaEvolution:
    """Chains registered steps from a version to the current one and stamps the rows."""

    def __init__(self, current: int = 1):
        self.current, self.steps = current, []

    def register(self, old: int, new: int, fn: Callable[[DataFrame], DataFrame], description: str = "") -> None:
        self.steps.append((old, new, fn, description))

    def migration(self, old: int, new: int, description: str = ""):
        def wrap(fn):
            self.register(old, new, fn, description)
            return fn

        return wrap

    def path(self, version: int) -> list[tuple[int, int, str]]:
        out = []
        while version < self.current:
            step = next((s for s in self.steps if s[0] == version), None)
            if step is None:
                raise WeftlineError(f"no step from version {version}")
            out.append((step[0], step[1], step[3]))
            version = step[1]
        return out

    def migrate(self, df: DataFrame, version: int) -> tuple[DataFrame, list[tuple[int, int, str]]]:
        audit = self.path(version)
        for old, new, _ in audit:
            df = next(s[2] for s in self.steps if s[:2] == (old, new))(df)
        return df.withColumn(VERSION, F.lit(self.current)), audit

    def compatible(self, version: int) -> bool:
        try:
            return version == self.current or bool(self.path(version))
        except WeftlineError:
            return False


class AnalysisPipeline:
    """Named steps over a DataFrame, each run as a job of its own whose result is written; a job that fails is run again.

    ``audit`` has a row for each attempt: step, attempt, milliseconds of the job, error, rows_in,
    rows_out and failed (rows whose ``error`` column is set). The counts of an attempt that
    succeeded are observed while its job runs, not by another one.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.retries, self.backoff, self.audit = 0, 0.5, []

    def add_step(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> AnalysisPipeline:
        self.steps.append((name, fn))
        return self

    def with_retry(self, n: int = 2, backoff: float = 0.5) -> AnalysisPipeline:
        self.retries, self.backoff = n, backoff
        return self

    def run(self, df: DataFrame) -> DataFrame:
        rows_in = None
        for name, fn in self.steps:
            for attempt in range(self.retries + 1):
                began = time.monotonic()
                spent = lambda began=began: round((time.monotonic() - began) * 1000, 3)
                try:
                    if rows_in is None:
                        rows_in = df.count()
                    out, seen = fn(df), Observation()
                    failed = F.count_if(F.col("error").isNotNull()) if "error" in out.columns else F.count_if(F.lit(False))
                    out = staged(out.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failed")), "step")
                    self.audit.append((name, attempt, spent(), None, rows_in, seen.get["rows"], seen.get["failed"]))
                    df, rows_in = out, seen.get["rows"]
                    break
                except Exception as e:
                    self.audit.append((name, attempt, spent(), str(e), rows_in, None, None))
                    if attempt == self.retries:
                        raise
                    time.sleep(self.backoff * 2**attempt)
        return df


_MISSING = object()


class PlanCache:
    """Least recently used DataFrames by key with a time to live, kept on the driver as plans."""

    def __init__(self, most: int = 128, ttl: float | None = 600.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl, self.clock, self.held = most, ttl, clock, OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, key: str, missing=None):
        if key in self.held:
            value, until = self.held[key]
            if until is None or self.clock() <= until:
                self.held.move_to_end(key)
                self.hits += 1
                return value
            del self.held[key]
            self.evictions += 1
        self.misses += 1
        return missing

    def invalidate(self, key: str | None = None) -> None:
        """Forgets one key, or all."""
        self.held.clear() if key is None else self.held.pop(key, None)

    def stats(self) -> dict[str, int]:
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses, "evictions": self.evictions}

    def set(self, key: str, value) -> None:
        self.held.pop(key, None)
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
            self.evictions += 1
        self.held[key] = (value, self.clock() + self.ttl if self.ttl else None)

    def memoize(self, fn):
        def wrap(*args, **kwargs):
            key = repr((fn.__qualname__, args, sorted(kwargs.items())))
            value = self.get(key, _MISSING)
            if value is _MISSING:
                self.set(key, value := fn(*args, **kwargs))
            return value

        return wrap
