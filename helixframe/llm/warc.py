"""A WARC writer that compresses each record by itself with a Zstandard dictionary built from the archive's own records.

The dictionary stands in a skippable frame at the head of the archive, so that a reader needs nothing else. Records whose
payload another record holds are revisits, which carry no payload."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, stash

SKIPPABLE = 0x184D2A5D
#: A dictionary is built from an archive's first records, as many as fit in so many bytes; longer records give their head.
SAMPLE_BYTES, SAMPLE_RECORD = 1_000_000, 32_768
DICTIONARY_BYTES = 16_384
#: The digests of payloads that occur more than once are broadcast up to so many, some 20 MB.
REPEATED = 100_000
#: An archive is closed when it has reached so many bytes.
ARCHIVE_BYTES = 1_000_000_000
_DATE = "2024-01-01T00:00:00Z"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records. Training wants more than a few small records hold: these are shown to it several times, and what
    is too little even then is the dictionary's content as it stands. Every archive has one."""
    shown = [x[:SAMPLE_RECORD] for x in records]
    for size, times in ((DICTIONARY_BYTES, 1), (DICTIONARY_BYTES, 8), (DICTIONARY_BYTES // 4, 64)):
        try:
            return zstandard.train_dictionary(size, shown * times, k=256, d=8)
        except zstandard.ZstdError:
            if sum(map(len, shown)) * times >= SAMPLE_BYTES:
                break
    return zstandard.ZstdCompressionDict(b"".join(shown)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _uri(url: str) -> str:
    return "".join(c for c in url if c not in "\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record. refers_to: the page whose response holds the same payload, None for a response; refers_url: its url."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head += [f"WARC-Payload-Digest: sha1:{_b32(digest)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(found["Content-Length"])]
    found["payload"] = block.partition(b"\r\n\r\n")[2] if found["WARC-Type"] == "response" else None
    return found


class ArchiveWriter:
    """Writes an archive to any file system that pyarrow reaches; a part of an archive never stands under its name."""

    def __init__(self, uri: str, level: int = 3) -> None:
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.uri, self.level = uri, level
        self.held: list[bytes] = []
        self.held_bytes = self.written = self.records = 0
        self.out = self.zstd = None
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.zstd:
            self._put(self.zstd.compress(data))
            return
        self.held.append(data)
        self.held_bytes += min(len(data), SAMPLE_RECORD)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        made = dictionary(self.held)
        stored = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
        self._put(struct.pack("<II", SKIPPABLE, len(stored)) + stored)
        self.zstd = zstandard.ZstdCompressor(level=self.level, dict_data=made, write_checksum=True)
        for x in self.held:
            self._put(self.zstd.compress(x))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.zstd:
            self._begin()
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri, self.records, self.written


def read_records(uri: str, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one by one; only the archive itself is needed."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as src:
        head = src.read(8)
        dctx = zstandard.ZstdDecompressor()
        if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
            dictionary = dctx.decompress(src.read(struct.unpack("<II", head)[1]))
            dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            head = b""
        obj, got = dctx.decompressobj(), []
        while data := head or src.read(chunk):
            head = b""
            while data:
                got.append(obj.decompress(data))
                data = b""
                if obj.eof:
                    yield b"".join(got)
                    data, obj, got = obj.unused_data, dctx.decompressobj(), []
        if any(got):
            raise ValueError(f"{uri} ends within a record")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of pages into archives below folder (a URI that all executors reach) and return the manifest:
    path, n_records, n_bytes, one row per archive.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least min_revisit bytes, that with the
    largest id is the response and the others revisit it; repeated rows with that id are all responses; a null id counts as
    the smallest. Payloads are never moved between executors unless there are more repeated payloads than a checked bound.
    Each partition streams its records; a retried task replaces its own archives whole. Every archive has its dictionary,
    however few records it holds. An empty table writes nothing."""
    small_batches(pages.sparkSession)
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(text, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= min_revisit
    kept = F.max(F.struct("page_id", "url")).alias("kept")
    again = rows.where(long).groupBy("digest").agg(kept, F.count(F.lit(1)).alias("n")).where("n > 1 and kept.page_id is not null")
    again = stash(again.select(F.col("digest").alias("_digest"), F.col("kept.page_id").alias("keeper"), F.col("kept.url").alias("keeper_url")), "payloads")
    rows = rows.join(bounded(again, REPEATED), (F.col("digest") == F.col("_digest")) & long, "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "keeper_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, writer, done = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for page_id, url, payload, digest, to, to_url in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if writer is None:
                    writer, n = ArchiveWriter(f"{folder}/part-{part:06d}-{n:04d}.warc.zst"), n + 1
                writer.add(record(page_id, url, payload, digest, to, to_url))
                if writer.written >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "n_records", "n_bytes"])

    return stash(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in manifest (column path): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null for revisits). A response whose payload doesn't have its stated digest fails."""
    n = max(1, manifest.select("path").count())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def rows(uri: str) -> Iterator[tuple]:
        number = lambda x: None if x is None else int(x)
        for data in read_records(uri):
            r = parse(data)
            digest = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            body, length = r["payload"], int(r["X-Payload-Length"])
            if body is not None and (hashlib.sha1(body).hexdigest() != digest or len(body) != length):
                raise ValueError(f"a record of {uri} doesn't have its stated digest")
            yield (number(r.get("X-Page-ID")), r.get("WARC-Target-URI"), length, digest, r["WARC-Type"], number(r.get("X-Refers-To-Page-ID")), body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                held, size = [], 0
                for r in rows(uri):
                    held.append(r)
                    size += 500 + (len(r[6] or b"") if with_payload else 0)
                    if size > 4_000_000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)
