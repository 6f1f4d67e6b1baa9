"""Cross-tokenizer alignment by a dictionary of token groups.

A text is encoded by tokenizer A (byte-level) and B (pieces). Byte offsets where tokens of both
end cut it into groups; a group's links are all its pairs of an A and a B token. Corpora repeat
groups endlessly, so every task works on blocks of about ``BLOCK_CHARS`` characters: it interns
the distinct groups of a block, keeps a document as numbers of groups with their frequencies,
and expands links once for each distinct group of the block, where it also counts the documents
that hold a pair. Then, over tables:

1. pair counts of the blocks are added, and the highest count of each A id is found;
2. distinct groups of the corpus are expanded once, joined with the pair counts and summed;
3. blocks' dictionaries fetch these sums by group, and documents multiply them by frequencies.

Texts are cut into words with what stands before them (``token_units``); both tokenizers end a
token at each cut, so a worker keeps the groups of every word it has met. Texts of another form
are encoded whole.

Defined results: texts that are null, empty or that either tokenizer does not give back byte for
byte have no tokens: zeros and an empty ``groups_sha256``; rows with equal or null ``doc_id`` are
documents of their own; texts of any length stay whole (a block holds one document at least); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .token_units import CACHE_UNITS, ByteLevel, portions

BLOCK_CHARS = 4_000_000
#: Pairs of a document and an id pair that a task holds at a time; a block with more is counted in slices of A ids.
PAIRS_AT_ONCE = 8_000_000
_SHIFT = 32


class Pieces:
    """A sentence-piece model and its pieces' bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        # Words are apart unless a piece goes over a space or a line break.
        self.by_units = not any("\n" in t or "▁" in t[1:] and t.strip("▁") for t in names)
        self.space = self.model.piece_to_id("▁")

    def units(self, keys: list[str]) -> list[list[int]]:
        """Ids of units: a space goes before a word, and comes off again before a line break."""
        return [x[1:] if k[0] == "\n" else x for k, x in zip(keys, self.model.encode(keys, num_threads=1), strict=True)]


class Groups:
    """Groups of texts, interned: numbers stand for ``a1,a2|b1`` strings."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a, plain=True), Pieces(b)
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.sides: list[tuple[list[int], list[int]]] = []

    def turn(self) -> None:
        """Once the newer units are many they become the older ones, and groups of none of them are forgotten."""
        if len(self.cache) <= CACHE_UNITS and len(self.names) <= 2 * CACHE_UNITS:
            return
        kept = {k: v for k, v in self.cache.items() if v is not None}
        used, new = np.unique(np.frombuffer(b"".join(kept.values()), np.int32), return_inverse=True)
        raw, ends = new.astype(np.int32).tobytes(), np.cumsum([0, *map(len, kept.values())]).tolist()
        self.older = {k: raw[i:j] for k, i, j in zip(kept, ends[:-1], ends[1:], strict=True)}
        self.cache, self.names, self.sides = {}, [self.names[g] for g in used.tolist()], [self.sides[g] for g in used.tolist()]
        self.number = {n: k for k, n in enumerate(self.names)}

    def _cut(self, a: list[int], b: list[int], data: bytes) -> np.ndarray | None:
        """Group numbers of ids; None where the ids do not give the bytes back."""
        raw_a, raw_b = [self.a.bytes[i] for i in a], [self.b.bytes[i] for i in b]
        if b"".join(raw_a) != data or b"".join(raw_b) != data:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        both, i, j = np.intersect1d(ends_a, ends_b, return_indices=True)
        i, j = (i + 1).tolist(), (j + 1).tolist()
        text_a, text_b = list(map(str, a)), list(map(str, b))
        out = []
        for i0, i1, j0, j1 in zip([0, *i[:-1]], i, [0, *j[:-1]], j, strict=True):
            name = f"{text_a[i0]}|{text_b[j0]}" if i1 - i0 == 1 == j1 - j0 else f"{','.join(text_a[i0:i1])}|{','.join(text_b[j0:j1])}"
            k = self.number.get(name)
            if k is None:
                k = self.number[name] = len(self.names)
                self.names.append(name)
                self.sides.append((a[i0:i1], b[j0:j1]))
            out.append(k)
        return np.array(out, np.int32)

    def _learn(self, new: list[str]) -> None:
        for keys in portions(new):
            plain = [k if k[0] == "\n" else " " + k for k in keys]
            data = [p.encode() for p in plain]
            a, b = self.a.whole("".join(plain)), self.b.units(keys)
            sizes = self.a.lengths[a]
            cuts = [0, *(np.searchsorted(np.cumsum(sizes), np.cumsum([len(d) for d in data])) + 1).tolist()]
            a = a.tolist()
            # All at once, then cut again; unit by unit only where some unit does not come back.
            one = self._cut(a, list(chain.from_iterable(b)), b"".join(data))
            if one is None:
                for k, d, x, i, j in zip(keys, data, b, cuts[:-1], cuts[1:], strict=True):
                    g = self._cut(a[i:j], x, d)
                    self.cache[k] = None if g is None else g.tobytes()
                continue
            widths = np.array([len(self.sides[g][0]) for g in one.tolist()])
            ends = [0, *(np.searchsorted(np.cumsum(widths), cuts[1:]) + 1).tolist()]
            raw = one.tobytes()
            self.cache |= {k: raw[4 * i : 4 * j] for k, i, j in zip(keys, ends[:-1], ends[1:], strict=True)}

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Group numbers of each text."""
        by_units = self.a.by_units and self.b.by_units
        split = [self.a.units(t) if t and by_units else None for t in texts]
        new = set(filterfalse(self.cache.__contains__, chain.from_iterable(s for s in split if s)))
        back = new & self.older.keys()
        self.cache.update((k, self.older[k]) for k in back)
        self._learn(list(new - back))
        out, get = [], self.cache.__getitem__
        for t, s in zip(texts, split, strict=True):
            if not t:
                g = None
            elif s is None:
                g = self._cut(self.a.whole(" " + t).tolist(), self.b.model.encode(t), (" " + t).encode())
            else:
                parts = list(map(get, s))
                g = None if None in parts else np.frombuffer(b"".join(parts), np.int32)
            out.append(np.zeros(0, np.int32) if g is None else g)
        return out

    def pairs(self, g: int, part: int, parts: int) -> np.ndarray:
        """Distinct id pairs of a group, of those A ids that belong to a slice."""
        a, b = self.sides[g]
        if len(a) == 1 == len(b):
            return np.array([a[0] << _SHIFT | b[0]] if a[0] % parts == part else [], np.int64)
        a = np.unique(a)
        return ((a[a % parts == part] << _SHIFT)[:, None] | np.unique(b)).ravel()


@functools.lru_cache(1)
def _groups(a: str, b: str) -> Groups:
    """The worker process's dictionary; the next tasks of the process find its words known."""
    return Groups(a, b)


_DOC = [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("doc_id", pa.int64()), *_DOC, ("groups_sha256", pa.string()), ("numbers", pa.list_(pa.int32())), ("freqs", pa.list_(pa.int64())),
    ("number", pa.int32()), ("grp", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()),
])
_DDL = "kind string, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers array<int>, freqs array<long>, number int, grp string, a int, b int, n long"


def _table(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _count_pairs(model: Groups, docs: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many documents of a block hold each pair, from distinct (document, group)."""
    distinct, where = np.unique(held, return_inverse=True)
    sizes = np.array([len(set(model.sides[g][0])) * len(set(model.sides[g][1])) for g in distinct.tolist()], np.int64)
    parts = 1 + int(sizes[where].sum()) // PAIRS_AT_ONCE
    for part in range(parts):
        each = [model.pairs(g, part, parts) for g in distinct.tolist()]
        size = np.array([len(x) for x in each], np.int64)
        codes, local = np.unique(np.concatenate(each), return_inverse=True)
        if not len(codes):
            continue
        begin, rows = np.cumsum(size) - size, size[where]
        # Place of each pair of each (document, group): the group's first one, counted on.
        at = np.repeat(begin[where] - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
        both = np.unique(np.repeat(docs, rows) * len(codes) + local[at])
        n = np.bincount(both % len(codes), minlength=len(codes))
        yield _table(len(codes), kind=pa.array(["pair"] * len(codes)), a=pa.array((codes >> _SHIFT).astype(np.int32)), b=pa.array((codes & ((1 << _SHIFT) - 1)).astype(np.int32)), n=pa.array(n.astype(np.int64)))


def _block(model: Groups, block: int, names: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    model.turn()
    groups = model.many(texts)
    sizes = np.array([len(g) for g in groups], np.int64)
    everything, doc = np.concatenate(groups).astype(np.int64), np.repeat(np.arange(len(groups)), sizes)
    wide_a, wide_b = (np.array([len(s[side]) for s in model.sides], np.int64)[everything] for side in (0, 1))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(sizes)])])
    name = model.names.__getitem__
    digests = [hashlib.sha256(";".join(map(name, g.tolist())).encode()).hexdigest() if len(g) else "" for g in groups]
    held, freqs = np.unique(doc * len(model.names) + everything, return_counts=True)
    docs, held = np.divmod(held, max(1, len(model.names)))
    used, local = np.unique(held, return_inverse=True)
    offsets = pa.array(np.searchsorted(docs, np.arange(len(groups) + 1)).astype(np.int32))
    yield _table(
        len(groups), kind=pa.array(["doc"] * len(groups)), block=pa.array([block] * len(groups)), doc_id=pa.array(names, pa.int64()), n_a=pa.array(total(wide_a)), n_b=pa.array(total(wide_b)),
        n_groups=pa.array(sizes), n_links=pa.array(total(wide_a * wide_b)), groups_sha256=pa.array(digests, pa.string()),
        numbers=pa.ListArray.from_arrays(offsets, pa.array(local.astype(np.int32))), freqs=pa.ListArray.from_arrays(offsets, pa.array(freqs.astype(np.int64))),
    )
    if len(used):
        yield _table(len(used), kind=pa.array(["group"] * len(used)), block=pa.array([block] * len(used)), number=pa.array(np.arange(len(used), dtype=np.int32)), grp=pa.array([name(g) for g in used.tolist()]))
        yield from _count_pairs(model, docs, held)


def _encoder(a: str, b: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, block = _groups(a, b), TaskContext.get().partitionId() << 32
        names, texts, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if texts and size + len(text or "") > block_chars:
                    yield from _block(model, block, names, texts)
                    names, texts, size, block = [], [], 0, block + 1
                names.append(name.as_py())
                texts.append(text)
                size += len(text or "")
        if texts:
            yield from _block(model, block, names, texts)

    return run


def encode(docs: DataFrame, a: str, b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of kind doc, group (a block's dictionary) and pair (a block's document counts), staged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(_encoder(a, b, block_chars), _DDL), "alignment")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (the highest of its A id)."""
    pairs = staged(encoded.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))  # a row for each entry of A's vocabulary at most
    return pairs.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def group_sums(encoded: DataFrame, pairs: DataFrame) -> DataFrame:
    """grp, best, total: a group's links of the highest count, and the sum of its links' counts."""

    def side(k: int, name: str):
        ids = F.split(F.get(F.split("grp", r"\|"), F.lit(k)), ",")
        return F.transform(F.array_distinct(ids), lambda x: F.struct(x.cast("int").alias(name), F.size(F.filter(ids, lambda y: y == x)).cast("long").alias("n")))

    distinct = encoded.where("kind = 'group'").select("grp").distinct()
    links = distinct.select("grp", F.explode(side(0, "a")).alias("x")).select("grp", "x", F.explode(side(1, "b")).alias("y"))
    links = links.select("grp", "x.a", "y.b", (F.col("x.n") * F.col("y.n")).alias("m"))
    return links.join(pairs, ["a", "b"]).groupBy("grp").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("count")).alias("total"))


_OUT = pa.schema([("doc_id", pa.int64()), *_DOC, ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _multiply(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Documents of a block with the sums of its dictionary, times their frequencies."""
    order = np.argsort(sums.column("number").to_numpy())
    numbers, freqs = docs.column("numbers").combine_chunks(), docs.column("freqs").combine_chunks()
    at, times = numbers.flatten().to_numpy(), freqs.flatten().to_numpy()
    ends = np.cumsum(np.concatenate([[0], numbers.value_lengths().to_numpy()]))
    out = {}
    for name, source in (("n_best", "best"), ("count_sum", "total")):
        own = np.concatenate([[0], np.cumsum(sums.column(source).to_numpy()[order][at] * times)])
        out[name] = pa.array(np.diff(own[ends]))
    return pa.table([out[f.name] if f.name in out else docs.column(f.name) for f in _OUT], schema=_OUT)


def align(docs: DataFrame, a: str, b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    encoded = encode(docs, a, b, block_chars)
    sums = group_sums(encoded, pair_counts(encoded))
    known = encoded.where("kind = 'group'").select("block", "number", "grp").join(sums, "grp").select(F.col("block").alias("within"), "number", "best", "total")
    rows = encoded.where("kind = 'doc'").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "numbers", "freqs")
    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(known.groupBy("within")).applyInArrow(_multiply, ddl)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
