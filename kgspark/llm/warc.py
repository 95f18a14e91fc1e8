"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is its frames and, as a last skippable frame, a seek table (magic
0x184D2A5E, entries of compressed and decompressed size, 9-byte footer with magic 0x8F92EAB1). The index maps each record id
to its bundle, its frame, and its offset and length inside the decompressed frame, so one record is read by one seek and one frame.

Of records with equal payloads (SHA-1) of at least ``min_bytes`` bytes, that with the largest id is a response with the payload,
and the others are revisit records that refer to it; smaller payloads are always stored.

Bundles are rows (name, content) that Spark's own committer writes, so a retried task leaves no half file and any store will
do; ``export_bundles`` puts them out as .warc.zst files.

Edge cases: a null payload is an empty one; a null id is written as ``null`` and read back as null (it ranks below all others); rows
that repeat an id and payload are all responses if that id is the largest; an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut, discard, sliced

FRAME_BYTES, BUNDLE_BYTES, MIN_BYTES, LEVEL = 1 << 20, 64 << 20, 0, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
URN = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, whose Content-Length is that of the full payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = " ".join((url or "").split()) or f"{URN}{'null' if page_id is None else page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest or payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, int]]:
    """(offset, headers, payload, full payload length) of each record in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        split = block.index(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in block[:split].decode().split("\r\n")[1:])
        yield at, headers, block[split + 4 :], int(http["Content-Length"])
        at = end + 4 + len(block) + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, decompressed offset, decompressed size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    size = 12 if flags & 0x80 else 8
    start = len(bundle) - 9 - n * size
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE, n * size + 9):
        raise ValueError("the seek table is damaged")
    out, at, raw = [], 0, 0
    for k in range(n):
        c, d = struct.unpack_from("<II", bundle, start + k * size)
        out.append((at, c, raw, d))
        at, raw = at + c, raw + d
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry: only its frame is decompressed."""
    import zstandard

    at, size, _, raw = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=raw)[offset : offset + length]


class _Bundle:
    def __init__(self, frame_bytes: int):
        import zstandard

        self.press, self.frame_bytes = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), frame_bytes
        self.done, self.sizes, self.held, self.held_size, self.total, self.index = [], [], [], 0, 0, []

    def add(self, page_id, record: bytes) -> None:
        self.index.append({"page_id": page_id, "frame": len(self.sizes), "offset": self.held_size, "length": len(record)})
        self.held.append(record)
        self.held_size += len(record)
        self.total += len(record)
        if self.held_size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            self.done.append(self.press.compress(raw))
            self.sizes.append((len(self.done[-1]), len(raw)))
            self.held, self.held_size = [], 0

    def close(self) -> bytes:
        self.flush()
        return b"".join(self.done) + seek_table(self.sizes)


INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Rows to write: ``page_id, url, payload, sha1, refers_to`` (null for responses).

    Only digests that occur more than once are joined back, and they come from a written table, so adaptive execution can split a
    payload that a third of all pages share.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    several = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    several = cut(several.select(F.col("sha1").alias("twice"), "first_id"), "payloads")
    joined = rows.join(several, (rows.sha1 == several.twice) & (F.octet_length("payload") >= min_bytes), "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_bundles(resolved: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(name, content, records): one row a bundle, cut at ``bundle_bytes`` of records; written to shared storage."""
    def run(batches):
        from pyspark import TaskContext

        part, n, bundle = TaskContext.get().partitionId(), 0, None

        def finish():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:04d}.warc.zst"]), pa.array([bundle.close()], pa.large_binary()).cast(pa.binary()), pa.array([bundle.index], INDEX)], names=["name", "content", "records"])

        for batch in sliced(batches, 200):
            for r in batch.to_pylist():
                bundle = bundle or _Bundle(frame_bytes)
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                bundle.add(r["page_id"], record_bytes(r["page_id"], r["url"], r["payload"], r["refers_to"], digest))
                if bundle.total >= bundle_bytes:
                    yield finish()
                    bundle, n = None, n + 1
        if bundle:
            yield finish()

    made = resolved.mapInArrow(run, "name string, content binary, records array<struct<page_id:bigint,frame:bigint,offset:bigint,length:bigint>>")
    return cut(made, "bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """(page_id, name, frame, offset, length): where each record lies."""
    return bundles.select("name", F.explode("records").alias("r")).select("r.page_id", "name", "r.frame", "r.offset", "r.length")


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read archives back frame by frame; every stored payload's digest is checked against its header."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] if with_payload else []
    schema = pa.schema(fields)

    def run(batches):
        import zstandard

        read = zstandard.ZstdDecompressor()
        number = lambda uri: None if uri is None or uri == f"<{URN}null>" else int(uri[len(URN) + 1 : -1])
        for batch in batches:
            for content in batch.column(0):
                bundle = memoryview(content.as_buffer())
                for at, size, _, raw in read_seek_table(bundle):
                    rows = []
                    for _, h, payload, full in parse_records(read.decompress(bundle[at : at + size], max_output_size=raw)):
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if kind == "response" and (payload_digest(payload) != digest or len(payload) != full):
                            raise ValueError(f"{h['WARC-Record-ID']}: the payload doesn't match its digest")
                        row = (number(h["WARC-Record-ID"]), h["WARC-Target-URI"], full, digest, kind, number(h.get("WARC-Refers-To")))
                        rows.append(row + ((payload if kind == "response" else None),) * with_payload)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return bundles.select("content").mapInArrow(run, ddl)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Put bundles out as files in a folder that all executors share; each appears whole, by a rename. Returns (name, bytes)."""
    import os

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in sliced(batches, 1):
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(part := f"{folder}/.{name}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)])], names=["name", "bytes"])

    return bundles.select("name", "content").mapInArrow(run, "name string, bytes bigint")
