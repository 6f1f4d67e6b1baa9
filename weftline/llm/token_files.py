"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

``write_ids`` range-partitions documents by ``doc_id``, encodes each text, appends ``END`` and
writes files of about ``FILE_TOKENS`` ids in ascending order of ``doc_id``. A file is::

    ids         n_tokens little-endian integers of 2 bytes (4 where the vocabulary needs them)
    ends        Elias-Fano sequence: ids up to the end of each document
    names       Elias-Fano sequence: each document's doc_id less the file's smallest
    footer      FOOTER: counts, widths, section sizes, then MAGIC

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n)) bits: the low bits
of every value packed one after another, the high bits as a bit vector in which value i is the
one at high(i) + i, and the place of every ``SAMPLE``-th one (32 bits), from which ``select``
finds any value by reading a few bytes. No table of 64-bit offsets is kept.

The returned index has a row a file, with the ids of all earlier files, a running sum over the index
alone; ``read_ids`` opens the files at runs of ``RUN`` documents, ``READ_TOKENS`` ids or so a task.
Files carry the task's attempt in their name and the index is staged, so a task that is run again
leaves no trace. Hadoop's local file system starts processes for each file that Spark writes, which
share the executor's memory until they run: so the index is one file, and a task of reading has work.

Defined results: null or empty text is ``END`` alone; null ``doc_id`` comes first; repeated
``doc_id`` are documents of their own, in the order of their texts' hash; texts of any length
stay whole (a file holds one document at least); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import new_path, staged
from .token_units import UnitIds

END = 2
FILE_TOKENS, READ_TOKENS, RUN, SAMPLE = 16_000_000, 64_000_000, 2048, 256
MAGIC = b"WEFTIDS1"
#: Documents, of them without doc_id, tokens, bytes an id, smallest doc_id, then for ends and names: low bits a value, bytes of lows, highs, samples.
FOOTER = "<QQQBqBQQQBQQQ8s"
_TOGETHER = 1_000_000


class EliasFano:
    """A non-decreasing sequence of unsigned integers: ``pack`` writes it, ``get`` decodes a run of it."""

    def __init__(self, read, n: int, low_bits: int, sizes: tuple[int, int, int]):
        """``read(offset, size)`` gives bytes of the packed form; ``sizes`` are those of lows, highs, samples."""
        self.read, self.n, self.low_bits, self.sizes = read, n, low_bits, sizes

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """Low bits a value, then lows, highs and samples as bytes."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return 0, b"", b"", b""
        low = max(0, (int(values[-1]) // n).bit_length() - 1)
        lows = b"".join(EliasFano._lows(values[i : i + 65_536], low) for i in range(0, n, 65_536))
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros(int(places[-1]) + 1, np.uint8)
        highs[places] = 1
        return low, lows, np.packbits(highs, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes()

    @staticmethod
    def _lows(values: np.ndarray, low: int) -> bytes:
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()

    def _bits(self, section: int, first: int, last: int) -> np.ndarray:
        """Bits first to last (exclusive) of lows (0) or highs (1)."""
        at = first // 8
        size = min(-(-last // 8), self.sizes[section]) - at
        raw = np.frombuffer(self.read(sum(self.sizes[:section]) + at, size), np.uint8)
        return np.unpackbits(raw, bitorder="little")[first - 8 * at : last - 8 * at]

    def select(self, first: int, last: int) -> np.ndarray:
        """Places of the ones numbered first to last (exclusive) among the high bits."""
        k, upto = first // SAMPLE, -(-last // SAMPLE)
        known = np.frombuffer(self.read(self.sizes[0] + self.sizes[1] + 4 * k, 4 * (min(upto + 1, self.sizes[2] // 4) - k)), "<u4")
        begin = int(known[0])
        end = int(known[-1]) if upto < self.sizes[2] // 4 else 8 * self.sizes[1]
        ones = np.flatnonzero(self._bits(1, begin, end))
        return begin + ones[first - k * SAMPLE : last - k * SAMPLE]

    def get(self, first: int, last: int) -> np.ndarray:
        """Values first to last (exclusive)."""
        if first >= last:
            return np.zeros(0, np.uint64)
        high = (self.select(first, last) - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = self._bits(0, first * self.low_bits, last * self.low_bits).reshape(-1, self.low_bits).astype(np.uint64)
        return high | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


class IdFile:
    """Random access to the documents of one file."""

    def __init__(self, src, size: int):
        self.src = src
        n = struct.calcsize(FOOTER)
        f = struct.unpack(FOOTER, self._at(size - n, n))
        if f[-1] != MAGIC:
            raise ValueError("not a token-id file")
        self.n_docs, self.n_null, self.n_tokens, self.width, self.least = f[:5]
        ids = self.n_tokens * self.width
        self.ends = EliasFano(lambda at, n: self._at(ids + at, n), self.n_docs, f[5], f[6:9])
        self.names = EliasFano(lambda at, n: self._at(ids + sum(f[6:9]) + at, n), self.n_docs - self.n_null, f[9], f[10:13])

    def _at(self, offset: int, size: int) -> bytes:
        self.src.seek(offset)
        out = self.src.read(size)
        if len(out) != size:
            raise ValueError("a token-id file is cut short")
        return out

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the file and ids of documents first to last (exclusive)."""
        begin = int(self.ends.get(first - 1, first)[0]) if first else 0
        ends = self.ends.get(first, last).astype(np.int64)
        k = max(first, self.n_null)
        names = [None] * (k - first) + [int(x) + self.least for x in self.names.get(k - self.n_null, last - self.n_null)] if last > self.n_null else [None] * (last - first)
        ids = np.frombuffer(self._at(begin * self.width, (int(ends[-1]) - begin) * self.width), f"<u{self.width}")
        for name, start, end in zip(names, [begin, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield name, start, ids[start - begin : end - begin]


@functools.lru_cache(1)
def _encoder(path: str) -> UnitIds:
    """The worker process's encoder; the next tasks of the process find its words known."""
    return UnitIds(path)


def _writer(tokenizer: str, folder: str, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, task = _encoder(tokenizer), TaskContext.get()
        width = enc.dtype.itemsize
        end = np.array([END], enc.dtype).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, names, sizes, held, k = None, "", [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out, held, k
            known = [x for x in names if x is not None]
            least = known[0] if known else 0
            ends = EliasFano.pack(np.cumsum(sizes))
            ids = EliasFano.pack(np.array([x - least for x in known], np.uint64))
            for section in (*ends[1:], *ids[1:]):
                out.write(section)
            out.write(struct.pack(FOOTER, len(names), len(names) - len(known), held, width, least, ends[0], *map(len, ends[1:]), ids[0], *map(len, ids[1:]), MAGIC))
            out.close()
            row = pa.RecordBatch.from_pylist([{"part": task.partitionId(), "k": k, "file": path, "n_docs": len(names), "n_tokens": held}])
            out, held, k = None, 0, k + 1
            names.clear()
            sizes.clear()
            return row

        for batch in batches:
            for keys, texts in portions_of(batch):
                for name, raw in zip(keys, enc.many(texts), strict=True):
                    if out is None:
                        path = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k:04d}.ids"
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                    out.write(raw + end)
                    names.append(name)
                    sizes.append(len(raw) // width + 1)
                    held += sizes[-1]
                    if held >= file_tokens:
                        yield close()
        if out is not None:
            yield close()

    return run


def portions_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Names and texts of consecutive rows, about ``_TOGETHER`` characters (or one longer text) at a time."""
    names, texts, size = [], [], 0
    for name, text in zip(batch.column(0), batch.column(1), strict=True):
        names.append(name.as_py())
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= _TOGETHER:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def write_ids(docs: DataFrame, tokenizer: str, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files to ``folder`` (a URI all executors reach); the index: file, n_docs, n_tokens, base (ids in earlier files)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # The hash splits a repeated doc_id over partitions and orders its rows.
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h").select("doc_id", "text")
    index = rows.mapInArrow(_writer(tokenizer, folder, file_tokens), "part long, k long, file string, n_docs long, n_tokens long")
    earlier = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return staged(index.select("file", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base")), "ids-index")


def _reader(folder: str, keep_ids: bool):
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path, cols = f"{root}/{row['file']}", [[] for _ in kinds]
                with store.open_input_file(path) as src:
                    file = IdFile(src, store.get_file_info(path).size)
                    for name, start, ids in file.documents(row["first"], min(row["first"] + RUN, file.n_docs)):
                        ids = ids.astype("<u4")
                        for c, v in zip(cols, (name, row["base"] + start, len(ids), zlib.crc32(ids), *([ids.astype(np.int32)] if keep_ids else [])), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def read_ids(index: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, and its ids on demand, read from the files."""
    runs = index.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(RUN).cast("long"))).alias("first"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    # Told by number: by the index's few bytes, Spark would give all files to one task.
    tasks = 1 + (index.agg(F.sum("n_tokens")).first()[0] or 0) // READ_TOKENS
    return runs.repartition(tasks).mapInArrow(_reader(folder, keep_ids), ddl)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "ids")
    index = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(index, folder)
