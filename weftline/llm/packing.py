"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups.

Documents are dealt to partitions by a hash of their id and, within a partition, to groups of
about ``GROUP_TOKENS`` tokens in hash order, so groups are random samples of the corpus and
each is packed by itself in bounded memory. A document longer than ``capacity`` fills whole
sequences first; the rest of every document is placed by first-fit decreasing, finding the
first bin with room in a tournament tree (each inner node holds the larger free capacity of
its children) in logarithmic time. Gaps of at least ``MIN_GAP`` tokens that remain are filled
by cutting pieces of the emptiest bins, and a group's last bin is cut into sequences whose
lengths are powers of two, which need no padding.

A document's ids are those of the tokenizer, then ``END``. Texts made of white-space separated
words are encoded word by word through a bounded cache, which gives the same ids because the
tokenizer's pre-tokenizer never joins words across white space; a text that holds a special
token's name or a control character that only Python counts as white space is encoded whole.

Defined results: null text is empty and has the id ``END`` alone; repeated rows are packed as
documents of their own; null ``doc_id`` is kept as null; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END = 4096, 2
GROUP_TOKENS, MIN_GAP = 2_000_000, 16
#: Words that a worker knows, in two halves, some 200 bytes each.
_CACHE_WORDS = 1_000_000
#: Commas and full stops that touch other punctuation.
_RUN = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s][.,])|(?<=_[.,]))")
_ODD = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: The tokenizer's own runs of a word that has no apostrophe: letters, single digits, the rest.
_PART = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_LETTER = re.compile(r"[^\W_]")
#: Texts are encoded together up to this many characters, so that their new words are learned at once.
_TOGETHER = 1_000_000


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Words are cached as bytes of their ids, so a text is a join of bytes. Commas and full stops
    are set apart first, which the tokenizer does too unless they touch other punctuation.
    """

    def __init__(self, path: str, words: int = _CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        # For runs that are set apart by spaces and normalised already, the same model without that work.
        quick = Tokenizer.from_file(path)
        quick.normalizer = None
        quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.quick = getattr(quick, "encode_batch_fast", quick.encode_batch)
        self.safe, self.odd = {chr(i) for i in range(128)}, set()  # characters that are cut as the tokenizer cuts them, and others
        self.words = words
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.end = struct.pack("<I", END)
        vocabulary = self.tok.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.encode([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Add words to the cache: their runs are encoded together and the ids cut at word ends."""
        parts = known = [w for w in new if w.isalpha()]
        counts = [1] * len(known)
        if len(known) < len(new):
            parts, known = parts.copy(), known.copy()
            for w in new:
                if not w.isalpha() and "'" not in w:
                    runs = _PART.findall(w)
                    if all(x.isalpha() or x.isdecimal() or not _LETTER.search(x) for x in runs):
                        known.append(w)
                        counts.append(len(runs))
                        parts += runs
        if parts:
            ids = self.quick([" ".join(parts)], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(parts):
                raw, cuts = ids.tobytes(), [0, *ends[np.cumsum(counts) - 1].tolist()]
                self.cache.update(zip(known, [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))
        for w in new:
            if w not in self.cache:
                self.cache[w] = self._whole(w)

    def _plain(self, c: str) -> bool:
        """Whether words around a character get the tokenizer's ids; its tables may be of another Unicode version."""
        probes = [f"a{c}a", f"{c},a", f"a.{c}", f"1{c}1", f"_{c}", f"q\u0301{c}\u0323"]
        self.safe.update(letters := set("".join(probes)) - self.safe)
        split = [self._words(p) for p in probes]
        self.safe -= letters - {"\u0301", "\u0323"}
        self._learn([w for w in set(chain.from_iterable(split)) if w not in self.cache])
        return all(b"".join(self.cache[w] for w in words) == self._whole(p) for p, words in zip(probes, split, strict=True))

    def _words(self, text: str | None) -> list[str] | None:
        """Words whose ids make up the text's ids; None for a text that is encoded whole."""
        if not text:
            return []
        if "<|" in text and _ODD.search(text) or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return None
        if not text.isascii():
            letters = set(text)
            for c in letters - self.safe:
                if c not in self.odd:
                    (self.safe if self._plain(c) else self.odd).add(c)
            if not letters <= self.safe:
                return None
            # As the tokenizer does it: composed, then lower case letter by letter.
            text = unicodedata.normalize("NFC", text).replace("\u0130", "i\u0307").replace("Σ", "σ")
        if not _RUN.search(text):
            text = text.replace(",", " , ").replace(".", " . ")
        text = text.lower()
        return text.split()

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, ``END`` included."""
        split = [self._words(t) for t in texts]
        new = set(filterfalse(self.cache.__contains__, chain.from_iterable(w for w in split if w)))
        if new:
            if self.cache and len(self.cache) + len(new) > self.words // 2:  # the older half goes, its frequent words come back
                self.old, self.cache = self.cache, {}
                new = set().union(*(w for w in split if w))
            old = self.old
            if old:
                back = new.intersection(old)
                self.cache.update((w, old[w]) for w in back)
                new = new - back
            self._learn(list(new))
        get = self.cache.__getitem__
        return [np.frombuffer((self._whole(t) if w is None else b"".join(map(get, w))) + self.end, "<u4") for t, w in zip(texts, split, strict=True)]

    def ids(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]


@functools.lru_cache(1)
def encoder(path: str, words: int = _CACHE_WORDS) -> Encoder:
    """The worker process's encoder; the next tasks of the process find its words known."""
    return Encoder(path, words)


class Tournament:
    """Bins in order of opening; finds the first with at least ``need`` free, opening one if none has."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, need: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``need`` tokens."""
        free, k = self.free, 1
        while k < self.leaves:
            k *= 2
            if free[k] < need:
                k += 1
        offset = self.capacity - free[k]
        free[k] -= need
        place = k - self.leaves
        while k > 1:
            k //= 2
            free[k] = max(free[2 * k], free[2 * k + 1])
        return place, offset


def pack(lengths: list[int], capacity: int = CAPACITY, min_gap: int = MIN_GAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    seq = 0
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        for at in range(0, whole, capacity):
            out.append((d, at, capacity, seq, 0))
            seq += 1
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(capacity, len(rest))
    bins: list[list[list[int]]] = []  # of [document, start, length]
    for n, d, at in rest:
        b, _ = tree.place(n)
        if b == len(bins):
            bins.append([])
        bins[b].append([d, at, n])
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: used[b])  # donors from the emptiest on
    donor = 0
    for b in reversed(order):  # fullest first: their gaps are small and many
        gap = capacity - used[b]
        while gap >= min_gap and donor < len(order) and order[donor] != b:
            give = order[donor]
            if not bins[give]:
                donor += 1
                continue
            piece = bins[give][-1]
            n = min(gap, piece[2])
            piece[2] -= n
            bins[b].append([piece[0], piece[1] + piece[2], n])
            used[give] -= n
            used[b] += n
            gap -= n
            if not piece[2]:
                bins[give].pop()
        if donor < len(order) and order[donor] == b:
            break
    for b in range(len(bins)):
        if not bins[b]:
            continue
        if capacity - used[b] < min_gap:
            sizes = [used[b]]
        else:  # a remainder: powers of two, largest first
            sizes = [1 << k for k in range(used[b].bit_length() - 1, -1, -1) if used[b] >> k & 1]
        left, offset = sizes.pop(0), 0
        for d, at, n in bins[b]:
            while n:
                if not left:
                    seq += 1
                    left, offset = sizes.pop(0), 0
                take = min(left, n)
                out.append((d, at, take, seq, offset))
                at, n, left, offset = at + take, n - take, left - take, offset + take
        seq += 1
    return out


_FIELDS = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def _portions(batch: pa.RecordBatch, together: int = _TOGETHER) -> Iterator[tuple[list, list]]:
    """Ids and texts of consecutive rows, about ``together`` characters (or one longer text) at a time."""
    names, texts, size = [], [], 0
    for d, text in zip(batch.column(0), batch.column(1), strict=True):
        names.append(d.as_py())
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= together:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def _packer(path: str, capacity: int, group_tokens: int, keep_ids: bool, words: int):
    schema = pa.schema([*_FIELDS, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, words)
        base = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            pieces = pack([len(x) for x in docs], capacity)
            cols: list[list] = [[] for _ in schema]
            for d, at, n, seq, offset in pieces:
                part = docs[d][at : at + n]
                for c, v in zip(cols, (ids[d], at, n, zlib.crc32(part), len(docs[d]), base + seq, offset), strict=False):
                    c.append(v)
                if keep_ids:
                    cols[-1].append(part.astype(np.int32))
            base += 1 + max((p[3] for p in pieces), default=0)
            ids.clear()
            docs.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for names, texts in _portions(batch, min(_TOGETHER, words)):
                for d, x in zip(names, enc.many(texts), strict=True):
                    if held and held + len(x) > group_tokens:
                        yield flush()
                    ids.append(d)
                    docs.append(x)
                    held += len(x)
        if docs:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, keep_ids: bool = False, words: int = _CACHE_WORDS) -> DataFrame:
    """A row per piece; with ``keep_ids`` also its token ids, which make the training sequences.

    ``words`` bounds what a worker keeps and encodes at once; fewer take less memory and more time, with the same pieces.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("doc_id", F.length("text"))).alias("h"))
    # By hash, in order: a task that is run again packs the same groups.
    rows = rows.repartition("h").sortWithinPartitions("h", "doc_id").select("doc_id", "text")
    ddl = ", ".join(f"{n} long" for n, _ in _FIELDS) + (", ids array<int>" if keep_ids else "")
    return rows.mapInArrow(_packer(tokenizer, capacity, group_tokens, keep_ids, words), ddl)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
