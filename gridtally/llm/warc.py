"""WARC archives: written as whole-file gzip, normalised to one member per record with an offset index, read back.

Pages become response and revisit records in archives that are one gzip stream each, as some
crawlers leave them. The normaliser inflates such a stream once, front to back, and rewrites every
record as its own gzip member beside an index with a line per record (offset, length, type,
digest, id). Readers then seek to any record. One record at a time is held in memory.

Every attempt of a task writes files of its own name, and the stored manifest names those of the
attempts that counted; files of lost attempts are never read. Files go where the URI says: shared
folders, or the object stores that Arrow's file systems open.

Defined results: a null or empty html is an empty payload, and such payloads are equal; of rows
with one payload, all that carry the largest page_id are responses and the rest revisit it; a null
page_id is smaller than all others; a null url is empty; line breaks in a url are escaped. Payloads
below `least_bytes` are always responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import new_uri, stored

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Digits of the engine's base 32, and those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def digest_of(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five bytes are eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to) of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), digest_of(payload.cast("binary")).alias("digest"))
    narrow = stored(rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest"), "warc-digests")
    # Only payloads that occur more than once need a look.
    shared = stored(narrow.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    if shared.limit(100_001).count() <= 100_000:
        marked = rows.join(F.broadcast(shared), "digest", "left")
    else:
        # Ids first: the pages themselves are dealt by page_id, which no payload makes uneven.
        ids = narrow.join(shared, "digest").distinct().select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "top")
        marked = rows.join(ids, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    large = F.octet_length("html") >= least_bytes
    return marked.select("page_id", "url", "html", "digest", F.when(large & other, "revisit").otherwise("response").alias("record_type"), F.when(large & other, F.col("top")).alias("refers_to"))


def _id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(row: dict, date: str) -> bytes:
    """The bytes of one WARC record."""
    payload = (row["html"] or "").encode()
    block = HTTP + (payload if row["record_type"] == "response" else b"")
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_id(row['page_id'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Length: {len(payload)}",
    ]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(row['refers_to'])}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def writer(folder: str, date: str, archive_bytes: int):
    """Task: pages to archives of one gzip stream each; gives (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        system.create_dir(root)
        out = None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count, size, deflate = f"{uuid.uuid4()}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(row, date)
                out.write(deflate.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return run


def records_in(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a gzip stream, inflated once from front to back."""
    inflate, held = zlib.decompressobj(31), bytearray()
    ended = False

    def more() -> bool:
        nonlocal inflate, ended
        while not ended:
            raw = stream.read(chunk)
            if not raw:
                ended = True
                return False
            before = len(held)
            while raw:
                held.extend(inflate.decompress(raw))
                raw = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            if len(held) > before:
                return True
        return False

    at = 0
    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            del held[:at]
            at = 0
            if not more():
                if held.strip():
                    raise ValueError("the stream ends inside a record")
                return
        headers = parsed(bytes(held[at:end]))
        stop = end + 4 + int(headers["Content-Length"]) + 4
        while len(held) < stop:
            if not more():
                raise ValueError("the stream ends inside a record")
        yield headers, bytes(held[at:stop])
        at = stop
        if at > 8 * chunk:
            del held[:at]
            at = 0


def normaliser(source: str, target: str):
    """Task: (archive) to the rewritten archive and its index; gives (archive, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(source)
        sink, home = open_fs(target)
        sink.create_dir(home)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                name, offset, count = f"{uuid.uuid4()}", 0, 0
                with (
                    system.open_input_stream(f"{root}/{archive}", compression=None) as stream,
                    sink.open_output_stream(f"{home}/{name}.warc.gz", compression=None) as out,
                    sink.open_output_stream(f"{home}/{name}.idx", compression=None) as index,
                ):
                    for headers, raw in records_in(stream):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(raw) + deflate.flush()
                        out.write(member)
                        line = {"offset": offset, "length": len(member), "type": headers["WARC-Type"], "digest": headers["WARC-Payload-Digest"], "id": headers["WARC-Record-ID"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.idx"]), pa.array([count], pa.int64())], names=["archive", "index", "records"])

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def reader(folder: str):
    """Task: (archive, index) to the rows of READ, each record found by its offset and checked."""

    def page(urn: str | None) -> int | None:
        value = urn[len("<urn:page:") : -1] if urn else "null"
        return None if value == "null" else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        names = [c.split()[0] for c in READ.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "url") else pa.int64()) for n in names])
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows: list[tuple] = []
                with system.open_input_file(f"{root}/{archive}") as file, system.open_input_stream(f"{root}/{index}", compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        raw = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
                        end = raw.index(b"\r\n\r\n")
                        headers = parsed(raw[:end])
                        block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if entry["type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"the payload of {entry['id']} in {archive} is damaged")
                        rows.append((page(headers["WARC-Record-ID"]), size, digest, entry["type"], page(headers.get("WARC-Refers-To")), headers["WARC-Target-URI"]))
                        if len(rows) == 10_000:
                            yield _rows(rows, schema)
                            rows = []
                if rows:
                    yield _rows(rows, schema)

    return run


def _lines(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    held = b""
    while raw := stream.read(chunk):
        *whole, held = (held + raw).split(b"\n")
        yield from whole


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def write_whole(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Write the pages into archives of one gzip stream each below folder: the manifest (archive, records)."""
    return stored(planned(pages, least_bytes).mapInArrow(writer(folder, date, archive_bytes), "archive string, records long"), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive is one unit of work: names go out one by one, however small their table is."""
    count = max(1, manifest.count())
    return manifest.repartition(min(count, 100_000))


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite whole-stream archives as one member per record with an index: (archive, index, records)."""
    done = _spread(manifest).mapInArrow(normaliser(source, target), "archive string, index string, records long")
    return stored(done, "warc-index")


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """One row of READ for every record of the normalised archives."""
    return _spread(manifest).mapInArrow(reader(folder), READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back in the shared folder."""
    home = new_uri(pages.sparkSession, "warc")
    whole = write_whole(pages, f"{home}/whole", least_bytes)
    found = normalise(whole, f"{home}/whole", f"{home}/records")
    return read_back(found, f"{home}/records").drop("url")
