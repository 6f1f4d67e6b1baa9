"""WARC records in seekable Zstandard bundles.

``write_bundles`` turns every page into a WARC/1.1 record. Records are grouped into frames of
about ``FRAME_BYTES`` that are compressed independently; a bundle is a run of frames followed
by a skippable frame that holds the seek table (compressed and plain size of every frame), so
standard tools can stream a bundle and ours can open any frame alone. The index maps each
record to its bundle, frame and offset within the plain frame. ``read_bundles`` goes the other
way: it opens bundles, checks the seek table, and returns the parsed records.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, those with the smallest
``page_id`` are ``response`` records and the others ``revisit`` records without a body that
name the response's id; smaller ones are all responses.

A response's block is an HTTP message (a fixed head, then the payload), a revisit's the head alone,
as WARC/1.1 has it; digests and lengths of payloads are those of the HTML. ``WARC-Date`` is a
parameter, since pages carry no time. Rows of one id share a record id.

Bundles go to a folder that all executors share (any store pyarrow can reach). Their names hold
the task's attempt, so a task that is run again writes new files and the index names only files
of attempts that succeeded.

Defined results: null html is an empty payload; a null ``page_id`` gets a record id
derived from its url and payload and is read back as null, and is a revisit where a page with an id has its payload; repeated rows of
the smallest id are all responses; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, staged

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 19, 1 << 26, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SALTS = 16
#: Time of the records where the caller gives none.
DATE = "1970-01-01T00:00:00Z"
_PAGE_ID = "<urn:page:"


def _payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) carries no payload."""
    digest = _payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = f"{_PAGE_ID}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url or ""} {digest}'.encode('utf-8', 'replace').decode())}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_PAGE_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Fields, length of the payload (a revisit's too) and the stored payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length and its block differ")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, int(http.rpartition(b"Content-Length: ")[2]), payload


class BundleWriter:
    """Frames of records, then the seek table; ``add`` returns (frame, offset, length)."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.buffer, self.table, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self._frame()
        at = (len(self.table), len(self.buffer), len(record))
        self.buffer += record
        return at

    def _frame(self) -> None:
        packed = self.zstd.compress(bytes(self.buffer))
        self.out.write(packed)
        self.table.append((len(packed), len(self.buffer)))
        self.written += len(packed)
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self._frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Random access to frames of a seekable file object."""

    def __init__(self, src, size: int):
        import zstandard

        self.src, self.zstd = src, zstandard.ZstdDecompressor()
        src.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", src.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        src.seek(size - 9 - 8 * n - 8)
        head = struct.unpack("<II", src.read(8))
        if head != (_SKIPPABLE, 8 * n + 9):
            raise ValueError("damaged seek table")
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", src.read(8 * n)):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.src.seek(at)
        return self.zstd.decompress(self.src.read(packed), max_output_size=plain)


def _roles(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """pages with refers_to. Only digests that several pages share are looked up, over salts."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    shared = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    lookup = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    joined = salted.join(lookup, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, name, k = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k:04d}.warc.zst"
                    writer, k = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes), k + 1
                rows.append((page_id, name, *writer.add(warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date))))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "bundle", "frame", "frame_offset", "record_bytes"])
        if writer is not None:
            writer.close()

    return run


def write_bundles(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """Write the archives to ``folder`` (a URI) and return their index, staged."""
    index = _roles(pages, min_revisit_bytes).mapInArrow(_writer(folder, frame_bytes, bundle_bytes, date), "page_id long, bundle string, frame long, frame_offset long, record_bytes long")
    return staged(index, "warc-index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        opened, source, reader, at, plain = None, None, None, -1, b""
        for batch in batches:
            rows = []
            for bundle, frame, offset, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle != opened:
                    if source is not None:
                        source.close()
                    path = f"{root}/{bundle}"
                    source = store.open_input_file(path)
                    reader, opened, at = BundleReader(source, store.get_file_info(path).size), bundle, -1
                if frame != at:
                    plain, at = reader.frame(frame), frame
                head, size, body = parse_record(plain[offset : offset + n])
                number = lambda k, head=head: int(head[k][len(_PAGE_ID) : -1]) if head.get(k, "").startswith(_PAGE_ID) else None
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (len(body), _payload_digest(body)) != (size, digest):
                    raise ValueError(f"damaged payload in {bundle}")
                rows.append((number("WARC-Record-ID"), size, digest, head["WARC-Type"], number("WARC-Refers-To"), head.get("WARC-Target-URI"), body.decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    return run


def read_bundles(index: DataFrame, folder: str, body: bool = False) -> DataFrame:
    """Records of the index, opened at their frames; ``body`` adds url and the stored payload."""
    rows = index.select("bundle", "frame", "frame_offset", "record_bytes").sortWithinPartitions("bundle", "frame", "frame_offset")
    out = rows.mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, body string")
    return out if body else out.drop("url", "body")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_bundles(index, folder)


#: Base32 of SHA-1: each five hexadecimal digits are four base32 digits.
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(p.h)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * CAST(floor(i / 4) AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
