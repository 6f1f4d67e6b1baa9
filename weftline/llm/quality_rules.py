"""Weak supervision of document quality: rules vote or abstain, EM weighs them.

Every rule looks at a whole text and votes good (+1), bad (-1) or abstains (0). Votes are
counted by pattern over all rows (at most ``3 ** len(RULES)`` patterns, whatever the corpus),
and expectation-maximisation on those counts estimates each rule's accuracy on good and on bad
documents and the share of good ones. A document's verdict is its posterior probability of
being good given its votes, in place of demanding that every rule passes.

Defined results: null text has no words, fails the base and abstains from most rules; repeated
rows each get a row; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Rule: (feature, bad when at most, bad when at least, good when between these two).
#: None: never. Shares are per word unless named otherwise.
RULES = (
    ("symbols", None, 0.1, (0.0, 0.02)),
    ("symbol_words", None, 0.1, (0.0, 0.02)),
    ("symbol_chars", None, 0.03, (0.0, 0.005)),
    ("runs", None, 0.1, (0.0, 0.02)),
    ("capitals", None, 0.3, (0.0, 0.12)),
    ("exclaim", None, 0.3, (0.0, 0.05)),
    ("dup_lines", None, 0.3, (0.0, 0.05)),
    ("repeats", None, 0.2, (0.0, 0.05)),
    ("bare_symbols", None, 0.1, (0.0, 0.01)),
    ("word_chars", 2.5, 12.0, (3.5, 9.5)),
    ("distinct", 0.08, None, (0.25, 1.0)),
    ("stops", None, 0.7, (0.01, 0.35)),
    ("length", 9.0, None, (30.0, 1e12)),
)
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_RUNS = re.compile(rb"([#*$%&|<>!?])\1+")


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rules' features."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0], [0.0] * len(RULES)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    letters = len(raw.translate(None, _SPACES))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    bare = sum(len(w) == 1 and w in _SYMBOLS for w in words) if n_symbols else 0
    marked = sum(len(w) != len(w.translate(None, _SYMBOLS)) for w in words) if n_symbols else 0
    features = [
        n_symbols / n,
        marked / n,
        n_symbols / word_chars,
        len(_RUNS.findall(raw)) / n,
        capitals / letters,
        raw.count(b"!") / n,
        n_dup / max(1, len(lines)),
        repeats / n,
        bare / n,
        word_chars / n,
        len(set(words)) / n if n >= 40 else 0.5,
        sum(raw.count(x) for x in (b".", b"?", b"!", b";")) / n,
        float(n),
    ]
    return [n, word_chars, n_symbols, n_dup, repeats], features


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    m = len(words) - width + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(m, np.uint64)
    for i in range(width):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    order = np.sort(acc)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(acc, twice))
    seen: dict[tuple[bytes, ...], int] = {}
    windows = [tuple(words[i : i + width]) for i in at.tolist()]
    for w in windows:  # equal hashes are only candidates
        seen[w] = seen.get(w, 0) + 1
    covered = np.zeros(len(words), bool)
    for i, w in zip(at.tolist(), windows, strict=True):
        if seen[w] > 1:
            covered[i : i + width] = True
    return int(covered.sum())


def votes(features: list[float]) -> str:
    """One character a rule: g, b or - (abstains)."""
    if not features[-1]:
        return "-" * (len(RULES) - 1) + "b"
    out = []
    for x, (_, low, high, (a, b)) in zip(features, RULES, strict=True):
        bad = low is not None and x <= low or high is not None and x >= high
        out.append("b" if bad else "g" if a <= x <= b else "-")
    return "".join(out)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, cast = [], []
        for text in batch.column(1):
            counts, features = measure(text.as_py())
            base.append(counts)
            cast.append(votes(features))
        cols = list(zip(*base, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.array(cast, pa.string())],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"],
        )


@dataclass
class LabelModel:
    """Accuracies of the rules given that they vote, on good and on bad documents."""

    good: np.ndarray
    bad: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """v: patterns by rules, +1, -1 or 0."""
        up, down = v == 1, v == -1
        s = np.log(self.prior / (1 - self.prior)) + up @ np.log(self.good / (1 - self.bad)) + down @ np.log((1 - self.good) / self.bad)
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(v: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM from a start at which rules rarely blame a good document and each catches a quarter of the bad.

    A bad document usually breaks one or two rules only, so a rule's accuracy on bad documents
    may be low; its accuracy on good ones stays above 0.6, which fixes the sense of the classes.
    """
    m = v.shape[1]
    model = LabelModel(np.full(m, 0.995), np.full(m, 0.25), 0.7)
    w = counts.astype(float)
    for _ in range(rounds):
        p = model.posterior(v)
        up, down = (v == 1).T, (v == -1).T
        good = (up @ (w * p) + 1.99) / ((up | down) @ (w * p) + 2)
        bad = (down @ (w * (1 - p)) + 0.5) / ((up | down) @ (w * (1 - p)) + 2)
        new = LabelModel(np.clip(good, 0.6, 0.999), np.clip(bad, 0.05, 0.999), float(np.clip((w @ p + 1.4) / (w.sum() + 2), 0.05, 0.99)))
        step = max(abs(new.good - model.good).max(), abs(new.bad - model.bad).max(), abs(new.prior - model.prior))
        model = new
        if step < 1e-9:
            break
    return model


def as_votes(patterns: list[str]) -> np.ndarray:
    return np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in p] for p in patterns], np.int8).reshape(len(patterns), len(RULES))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, votes, quality (posterior) per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = staged(rows.mapInArrow(_measured, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"), "measured")
    patterns = seen.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    names = sorted(r["votes"] for r in patterns)
    count = {r["votes"]: r["count"] for r in patterns}
    model = fit(as_votes(names), np.array([count[n] for n in names]))
    table = docs.sparkSession.createDataFrame(
        [(n, float(p)) for n, p in zip(names, model.posterior(as_votes(names)), strict=True)], "votes string, quality double"
    )
    out = seen.join(F.broadcast(table), "votes", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
