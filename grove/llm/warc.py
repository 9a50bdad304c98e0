"""WARC archives: a writer with revisit records, and a reader that salvages.

Writing: a first pass reads the payloads' SHA-1 natively and aggregates the
smallest page_id of each digest that occurs more than once; then each task
writes archives of bounded size, one gzip member a record, under a name of its
own attempt, and renames them when they are whole, so a repeated task replaces
equal files. Writers reach the folder through pyarrow.fs, by the URI of any
store it knows.

Reading: Spark's binaryFile source, so any store Spark reads will do. A record
must start with a version line, hold a parsable header, a block of the length
it states, the digests it states and, in a gzip archive, a member whose own
checksum holds. Where a check fails the reader looks for the next place where
a member or a version line begins and passes every check there, goes on from
it, and reports the bytes between as a gap.

Defined results: null html is an empty payload. All empty payloads are equal,
as any others (``least`` sets from how many bytes on payloads are compared).
Rows that repeat the smallest page_id of a payload are responses too. A null
page_id is never a revisit's target unless all of that payload are null. Extra
columns are ignored. An empty table writes and reads nothing. A very long page
is one record, held whole by the tasks that write and read it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.scratch import Scratch

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_GZIP = b"\x1f\x8b\x08"


def digest32(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    header = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = header if refers_to is not None else header + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, date: str, most: int, compressed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, file, size, n = [], None, 0, 0

        def close() -> None:
            nonlocal file
            if file is not None:
                file.close()
                name = f"{root}/part-{context.partitionId():06d}-{len(made):05d}.warc{'.gz' * compressed}"
                store.move(partial, name)
                made.append((name.rpartition("/")[2], n, size))
                file = None

        for batch in batches:
            for page, url, html, to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = record(page, url, (html or "").encode(), to, date)
                data = member(data) if compressed else data
                if file is None:
                    partial = f"{root}/_partial-{context.taskAttemptId()}-{len(made)}"
                    file, size, n = store.open_output_stream(partial), 0, 0
                file.write(data)
                size, n = size + len(data), n + 1
                if size >= most:
                    close()
        close()
        names, counts, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return run


def write_warc(
    pages: DataFrame, folder: str, least: int = 0, date: str = "2020-01-01T00:00:00Z", most: int = 16 << 20, compressed: bool = True
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``, a URI; returns file, records and bytes of each archive."""
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("sha", F.sha1(payload))
    same = (
        keyed.filter(F.octet_length(payload) >= least)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha", "first")
    )
    # Pages find their first copy without their text, which is dealt by page_id: a common payload fills no task.
    revisits = keyed.select("page_id", "sha").join(same, "sha").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to"))
    own = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha"))
    rows = keyed.join(revisits, own, "left").select("page_id", "url", "html", "refers_to")
    return scratch.write(rows.mapInArrow(_writer(folder, date, most, compressed), "file string, records long, bytes long"), "files")


def _header_end(data: bytes, start: int) -> int:
    """Where the header whose first line ends at ``start`` ends, however long it is; looks no further than twice the way to the next version line."""
    size = 1 << 16
    while True:
        body = data.find(b"\r\n\r\n", start - 2, start + size)
        if _VERSION.search(data, start, body + 2 if body >= 0 else start + size):
            raise ValueError("a version line inside a header")
        if body >= 0:
            return body
        if start + size >= len(data):
            raise ValueError("header without end")
        size *= 2


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and its end; ValueError says which check fails."""
    start = _VERSION.match(data, at)
    if not start:
        raise ValueError("no version line")
    body = _header_end(data, start.end())
    fields = {}
    for line in data[start.end() : body].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        raise ValueError("no content length")
    if not {"warc-type", "warc-record-id", "warc-date"} <= fields.keys():
        raise ValueError("a header without its mandatory fields")
    body, size = body + 4, int(fields["content-length"])
    block, end = data[body : body + size], body + size + 4
    if len(block) < size or data[end - 4 : end] != b"\r\n\r\n":
        raise ValueError("block of another length")
    if (stated := fields.get("warc-block-digest", "")).startswith("sha1:") and stated[5:] != digest32(block):
        raise ValueError("block digest differs")
    kind, payload, length = fields.get("warc-type"), None, None
    head, _, rest = block.partition(b"\r\n\r\n")
    if fields.get("content-type", "").startswith("application/http"):
        found = re.search(rb"(?mi)^content-length:\s*([0-9]+)\s*$", head)
        length = int(found[1]) if found else None
        if kind == "response":
            payload, length = rest, len(rest)
            if (stated := fields.get("warc-payload-digest", "")).startswith("sha1:") and stated[5:] != digest32(payload):
                raise ValueError("payload digest differs")
    elif kind in ("resource", "conversion"):
        payload, length = block, size
    row = {
        "type": kind,
        "id": fields.get("warc-record-id", "").strip("<>"),
        "uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest32(payload) if payload is not None else fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": length,
        "payload": payload,
    }
    return row, end


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A whole gzip member, its checksum verified, and its end."""
    unpacker = zlib.decompressobj(31)
    out = [unpacker.decompress(memoryview(data)[at : at + (1 << 16)])]
    if not out[0].startswith(b"WARC/"[: len(out[0])]):
        raise ValueError("member without version line")
    fed = min(at + (1 << 16), len(data))
    while not unpacker.eof and fed < len(data):
        out.append(unpacker.decompress(memoryview(data)[fed : fed + (1 << 20)]))
        fed = min(fed + (1 << 20), len(data))
    if not unpacker.eof:
        raise ValueError("member without end")
    return b"".join(out), fed - len(unpacker.unused_data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order; ``offset`` and ``length`` are bytes of the archive."""
    at, n = 0, len(data)
    lost, why = None, ""
    compressed = data[:3] == _GZIP or (data.find(_GZIP) >= 0 and not _VERSION.search(data))
    while at < n:
        try:
            if compressed:
                text, end = _inflate(data, at)
                rows, inner = [], 0
                while inner < len(text):
                    row, inner = parse(text, inner)
                    rows.append(row)
            else:
                row, end = parse(data, at)
                rows = [row]
        except (ValueError, zlib.error) as error:
            if lost is None:
                lost, why = at, str(error)
            if compressed:
                at = data.find(_GZIP, at + 1)
            else:
                found = _VERSION.search(data, at + 1)
                at = found.start() if found else -1
            if at < 0:
                break
            continue
        if lost is not None:
            yield {"kind": "gap", "offset": lost, "length": at - lost, "reason": why}
            lost = None
        for row in rows:
            yield {"kind": "record", "offset": at, "length": end - at, **row}
        at = end
    if lost is not None:
        yield {"kind": "gap", "offset": lost, "length": n - lost, "reason": why}


_SCHEMA = pa.schema(
    [
        ("file", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
        ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)


def _salvaged(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    held += len(row.get("payload") or b"") if payloads else 0
                    rows.append({"file": path.as_py(), **row, "payload": row.get("payload") if payloads else None})
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives at ``path``: file, kind, offset, length, reason and a record's fields."""
    schema = "file string, kind string, offset long, length long, reason string, type string, id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(_salvaged(payloads), schema)


def logged_gaps(read: DataFrame, scratch: Scratch) -> DataFrame:
    """The gaps among what was read, as a table of their own: file, offset, length and reason of each."""
    return scratch.write(read.filter("kind = 'gap'").select("file", "offset", "length", "reason"), "gaps")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    folder = scratch.path("warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    written = files.agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    # An archive of a lost attempt that was cut otherwise is none of those written.
    read = read_warc(spark, folder, payloads=False).withColumn("name", F.regexp_extract("file", "[^/]*$", 0))
    read = scratch.write(read.join(files.select(F.col("file").alias("name")), "name", "left_semi").drop("payload"), "read")
    gaps = logged_gaps(read, scratch)
    if lost := gaps.count():
        raise RuntimeError(f"{lost} gaps in archives just written, logged in {scratch.path('gaps')}")
    rows = read.filter("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(_ID) + 1}) AS bigint)")
    out = rows.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    if (n := out.count()) != written:
        raise RuntimeError(f"{written} records written, {n} read")
    return out
