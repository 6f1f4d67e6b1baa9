"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Training uses a documented bounded sample: of the labelled documents, the ``MAX_LABELLED`` with
the smallest hash. From those texts a lexicon is learned (words and word beginnings that occur
mostly in toxic documents: ``MAX_LEXICON`` of them at most, by documents times weight, so the model
that every task holds stays bounded; what is cut are the rarest or weakest parts), then dense features are taken, boosted trees are fitted, and the
out-of-fold margins are calibrated to probabilities by pooling adjacent violators. Scoring is
one pass over all documents; whole texts are read and only the text feeds the score. The
calibrated probability is flat over each pooled block, so ``score`` is 0.98 of it plus 0.02 of the
trees' own probability, which keeps their order within a block; ``calibrated`` is the plain one.

Defined results: null text scores as an empty one; where labels are missing or of one class
every document gets the (smoothed) share of toxic labels; labels without a document are
ignored and a document labelled more than once is toxic if any label says so; repeated rows
each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged

#: Bounds of the training sample and of the lexicon.
MAX_LABELLED, MAX_LEXICON = 10_000, 3_000
STEMS = (4, 5, 6)
FOLDS = 4
_WORD = re.compile(r"[^\W_]+(?:[@$*0-9!]+[^\W_]+)*")
_SECOND = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tus vosotros".split())
_INSULTS = frozenset("idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb filthy vermin imbecile hate kill".split())
_LEET = str.maketrans("@$013457!", "asoieast" + "i")
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[@$*!0-9]+[^\W\d_]+")
_LONG = re.compile(r"(\w)\1\1")
FEATURES = (
    "lexicon_share", "lexicon_hits", "weight_share", "top_weight", "mean_top_weight", "seed_share", "near_second", "second_share",
    "capital_share", "shout_share", "exclaim_share", "question_share", "punct_share", "mixed_share", "long_share", "log_words",
)


def _parts(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


class Features:
    """Dense features of a text under a lexicon {'=word' or '^beginning': weight}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def weight(self, word: str) -> float:
        w = self.memo.get(word)
        if w is None:
            plain = word.translate(_LEET)
            w = max((self.lexicon.get(p, 0.0) for x in {word, plain} for p in _parts(x)), default=0.0)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = w
        return w

    def row(self, text: str | None) -> list[float]:
        return self.with_plain(*plain_features(text))

    def with_plain(self, words: list[str], rest: list[float]) -> list[float]:
        n = len(words) or 1
        hits = [(i, w) for i, w in enumerate(map(self.weight, words)) if w]
        seconds = [i for i, w in enumerate(words) if w in _SECOND] if hits else ()
        near = 0
        if hits and seconds:
            at = np.array(seconds)
            for i, _ in hits:
                k = np.searchsorted(at, i)
                near += any(0 <= j < len(at) and abs(int(at[j]) - i) <= 4 for j in (k - 1, k))
        top = sorted((w for _, w in hits), reverse=True)[:3]
        return [len(hits) / n, np.log1p(len(hits)), sum(w for _, w in hits) / n, top[0] if top else 0.0, sum(top) / 3, rest[0], near / n, *rest[1:]]


def plain_features(text: str | None) -> tuple[list[str], list[float]]:
    """Words of a text, and the features that no lexicon enters."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n = len(words) or 1
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    plain = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    shout = sum(w.isupper() and len(w) > 1 for w in text.split()) if upper or not text.isascii() else 0
    punct = len(raw) - len(raw.translate(None, b"!?.,;:#*$%&|<>@"))
    mixed = len(_MIXED.findall(text)) if len(raw) - len(raw.translate(None, b"@$*!0123456789")) else 0
    return words, [
        sum(w.translate(_LEET) in _INSULTS for w in set(words)) / n, sum(w in _SECOND for w in words) / n,
        upper / max(1, plain), shout / n, text.count("!") / n, text.count("?") / n, punct / n, mixed / n,
        len(_LONG.findall(text)) / n if text else 0.0, np.log1p(len(words)),
    ]


class Boosted:
    """Boosted regression trees on quantile bins, logistic loss, Newton leaves."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # A sparse feature has most quantiles at zero; cuts of its other values keep it visible.
        self.cuts = [np.unique(np.r_[c, np.quantile(v[v > v.min()], np.linspace(0, 1, 12)) - 1e-12]) if (v > v.min()).any() else c for c, v in zip(self.cuts, x.T, strict=True)]
        b = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)])
        width = max(len(c) for c in self.cuts) + 1
        margin = np.full(len(y), self.start)
        self.forest = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            tree: dict[int, tuple] = {}
            for d in range(self.depth):
                for k in range(2**d - 1, 2 ** (d + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2 * self.least:
                        continue
                    best = (1e-6, None)
                    gt, ht = g[rows].sum(), h[rows].sum()
                    for f in range(len(b)):
                        gs = np.bincount(b[f, rows], g[rows], width).cumsum()[:-1]
                        hs = np.bincount(b[f, rows], h[rows], width).cumsum()[:-1]
                        ns = np.bincount(b[f, rows], minlength=width).cumsum()[:-1]
                        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                        gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], (f, i))
                    if best[1]:
                        f, i = best[1]
                        tree[k] = (f, i)
                        node[rows] = np.where(b[f, rows] <= i, 2 * k + 1, 2 * k + 2)
            leaves = {}
            for k in np.unique(node):
                rows = node == k
                leaves[int(k)] = self.rate * float(g[rows].sum() / (h[rows].sum() + 1))
                margin[rows] += leaves[int(k)]
            self.forest.append((tree, leaves))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)])
        out = np.full(len(x), self.start)
        for tree, leaves in self.forest:
            node = np.zeros(len(x), np.int64)
            for k in sorted(tree):
                f, i = tree[k]
                rows = node == k
                node[rows] = np.where(b[f, rows] <= i, 2 * k + 1, 2 * k + 2)
            value = np.zeros(2 ** (self.depth + 1))
            value[list(leaves)] = list(leaves.values())
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing least-squares fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, first x, last x
    for v, t in zip(x[order], y[order], strict=True):
        blocks.append([1.0, float(t), float(v), float(v)])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            w = a[0] + b[0]
            blocks.append([w, (a[0] * a[1] + b[0] * b[1]) / w, a[2], b[3]])
    return np.array([k for b in blocks for k in (b[2], b[3])]), np.array([b[1] for b in blocks for _ in (0, 1)])


class Model:
    """Lexicon, trees and calibration; or a constant where nothing could be learned."""

    def __init__(self, prior: float, lexicon: dict[str, float] | None = None, trees: Boosted | None = None, knots=None):
        self.prior, self.lexicon, self.trees, self.knots = prior, lexicon or {}, trees, knots

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the calibrated probabilities they are made from."""
        if self.trees is None:
            return np.full(len(x), self.prior), np.full(len(x), self.prior)
        m = self.trees.margin(x)
        flat = np.interp(m, *self.knots)
        return np.clip(0.98 * flat + 0.02 / (1 + np.exp(-m)), 0.0, 1.0), flat

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.both(x)[0]


def _fold(doc_id: int) -> int:
    return ((doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40) % FOLDS


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each fold and class by word part, summed before any shuffle."""
    names = [f"{kind}{k}" for k in range(FOLDS) for kind in ("clean", "toxic")]

    def out(c: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *(pa.array([v[i] for v in c.values()], pa.int64()) for i in range(2 * FOLDS))], names=["part", *names])

    held: dict[str, list[int]] = {}
    for batch in batches:
        for doc_id, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            at = 2 * _fold(doc_id) + toxic
            for part in {p for w in set(_WORD.findall((text.as_py() or "").lower())) if len(w) > 2 for p in _parts(w)}:
                held.setdefault(part, [0] * 2 * FOLDS)[at] += 1
        if len(held) > 200_000:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def _lexicon(parts: DataFrame, known: list[tuple[int, int]], without: int | None, most: int) -> dict[str, float]:
    """The weights of word parts, learned without the documents of one fold."""
    folds = [k for k in range(FOLDS) if k != without]
    n = Counter(t for d, t in known if _fold(d) in folds)
    clean, toxic = (reduce(lambda a, b: a + b, (F.col(f"{kind}{k}") for k in folds)) for kind in ("clean", "toxic"))
    odds = F.log((toxic + 0.5) / (n[1] + 1)) - F.log((clean + 0.5) / (n[0] + 1))
    found = parts.select("part", toxic.alias("toxic"), odds.alias("weight")).where("toxic >= 4 and weight >= 2.3")
    found = found.orderBy(F.desc(F.col("toxic") * F.col("weight")), "part").limit(most).collect()
    return {"=" + w: 3.0 for w in _INSULTS} | {r["part"]: float(r["weight"]) for r in found}


def _feature_rows(lexicons: list[dict[str, float]]):
    """doc_id, toxic and the features under each lexicon, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [Features(x) for x in lexicons]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                plain = plain_features(text.as_py())
                rows.append([v for f in each for v in f.with_plain(*plain)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lexicon: int = MAX_LEXICON) -> Model:
    """Fit on at most ``max_labelled`` of the given labelled documents (rows of ``labels``: doc_id, toxic),
    with at most ``max_lexicon`` learned word parts.

    Margins for the calibration are out of fold altogether: neither the trees nor the lexicon
    behind a document's features have seen it.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = [(r["doc_id"], r["toxic"]) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()]  # two numbers a row, bounded by max_labelled
    n = Counter(t for _, t in sample)
    prior = (n[1] + 0.5) / (len(sample) + 1) if sample else 0.0
    if not n[0] or not n[1]:
        return Model(prior)
    chosen = docs.sparkSession.createDataFrame(sample, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # Of rows that share an id one text counts, so the sample stays within its bound.
    texts = staged(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled-texts")
    parts = texts.mapInArrow(_counter, "part string, " + ", ".join(f"clean{k} long, toxic{k} long" for k in range(FOLDS))).groupBy("part")
    parts = parts.agg(*(F.sum(f"{kind}{k}").alias(f"{kind}{k}") for k in range(FOLDS) for kind in ("clean", "toxic")))
    parts = staged(parts.where(" + ".join(f"toxic{k}" for k in range(FOLDS)) + " >= 4"), "word-parts")
    lexicons = [_lexicon(parts, sample, k, max_lexicon) for k in (*range(FOLDS), None)]
    rows = texts.mapInArrow(_feature_rows(lexicons), "doc_id long, toxic int, x array<double>").collect()  # dense features, bounded by max_labelled
    drop_staged(texts)
    drop_staged(parts)
    if not rows:
        return Model(prior)
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), FOLDS + 1, len(FEATURES)), np.array([r["toxic"] for r in rows], float)
    fold = np.array([_fold(r["doc_id"]) for r in rows])
    least = int(min(10, max(1, y.sum() // 2, 1)))  # few toxic labels still make a leaf
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and 0 < y[~own].mean() < 1:
            margins[own] = Boosted(least=least).fit(x[~own, k], y[~own]).margin(x[own, k])
    return Model(prior, lexicons[FOLDS], Boosted(least=least).fit(x[:, FOLDS], y), isotonic(margins, y)) if 0 < y.mean() < 1 else Model(prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, calibrated for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(model.lexicon)
        for batch in batches:
            rows = np.array([f.row(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.float64()) for v in model.both(rows))], names=["doc_id", "score", "calibrated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, calibrated double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all columns) whose score is below ``threshold``: one pass, no join."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(model.lexicon)
        for batch in batches:
            rows = np.array([f.row(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(rows) < threshold))

    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "calibrated")
