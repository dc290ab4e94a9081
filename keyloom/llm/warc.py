"""WARC: a writer of gzipped archives, a record a member, and a splittable reader.

Reader. Tasks get byte ranges of the archives, whatever lies at their borders. A task scans its range
for gzip magic; a candidate counts as a member only if its first decoded bytes are a WARC header, so
magic that happens to stand inside compressed data is passed over. It owns the records whose members
start inside its range, decodes the last of them beyond the border, and continues after each member
at its end, not inside it. Memory holds a block of the file and one record.

Writer. Records go to tasks by payload digest. Of records with equal payloads of at least
`min_revisit` bytes, those with the smallest id are responses and the others revisits of it, which carry
headers only; a digest that fills a third of all rows is split by the join like any skewed key. Every
task writes one archive under a temporary name and renames it when complete, so a task that runs again
replaces the same file; the list of archives is itself written as a table.

The archives lie in a folder that the executors share, given as a URI that pyarrow.fs opens (file, hdfs,
s3, gs). Spark's own readers cannot start inside a .gz file, hence byte ranges and pyarrow.

Defined results: a null payload is empty; rows with the same smallest id and payload are all responses;
a null id sorts last and is kept; an empty table writes no archive and reads as no rows; a member that
ends early or is damaged, or a response whose payload has another digest than it states, is skipped and the
scan goes on behind its magic; payloads of any length are one record; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, own, run_dir, table

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
SPLIT = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:keyloom:page:{'' if page is None else page}>"


def member(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def writes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, path = place(folder)
        name = f"part-{task.partitionId():05d}.warc.gz"
        temporary = f"{path}/.{name}.{task.taskAttemptId()}"
        out, records = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(temporary)
                out.write(member(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"], row["revisit"]))
                records += 1
        if out is not None:
            out.close()
            system.move(temporary, f"{path}/{name}")
            size = system.get_file_info(f"{path}/{name}").size
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([records])], ["archive", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives into folder; returns the table of archives (archive, bytes, records)."""
    rows = own(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = rows.join(same.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    system, path = place(folder)
    system.create_dir(path)
    made = out.select("page_id", "url", "payload", F.col("first").alias("refers_to"), revisit.alias("revisit"))
    return materialize(made.mapInArrow(writes(folder), "archive string, bytes long, records long"), "archives")


class Window:
    """A forward window on a file: bytes from `at` on, read a block at a time. What is dropped stays in the buffer until as much again has been read."""

    def __init__(self, file, at: int):
        self.file, self.data, self.skip, self.base = file, bytearray(), 0, at
        file.seek(at)

    @property
    def at(self) -> int:
        return self.base + self.skip

    def more(self) -> bool:
        if 2 * self.skip > len(self.data):
            del self.data[: self.skip]
            self.base, self.skip = self.base + self.skip, 0
        block = self.file.read(BLOCK)
        self.data += block
        return bool(block)

    def left(self) -> int:
        return len(self.data) - self.skip

    def drop(self, n: int) -> None:
        self.skip += n


def decode(window: Window) -> tuple[bytes, int] | None:
    """The member at the window's start and its packed length; None if it isn't a whole member that holds a WARC record."""
    unpacker, out, used, known = zlib.decompressobj(31), [], 0, b""
    try:
        while not unpacker.eof:
            if used == window.left() and not window.more():
                return None
            piece = bytes(window.data[window.skip + used : window.skip + used + (64 << 10)])
            used += len(piece)
            out.append(unpacker.decompress(piece))
            if len(known) < 5:
                known += out[-1][:5]
                if known[:5] != b"WARC/"[: len(known)]:
                    return None
    except zlib.error:
        return None
    return b"".join(out), used - len(unpacker.unused_data)


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the members that start in [start, end)."""
    window = Window(file, start)
    while window.at < end:
        found = window.data.find(MAGIC, window.skip)
        if found < 0:
            window.drop(max(0, window.left() - 2))
            if not window.more():
                return
            continue
        window.drop(found - window.skip)
        if window.at >= end:
            return
        got = decode(window)
        if got:
            yield window.at, got[0]
        window.drop(got[1] if got else 1)


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (names in lower case), HTTP head, payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(headers.get("content-length", len(rest)))]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, b"", block
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


RECORD = "archive string, offset long, record_id string, type string, url string, refers_to string, digest string, http string, payload binary"


def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "offset", "record_id", "type", "url", "refers_to", "digest", "http", "payload"]
    types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.binary()]
    for batch in batches:
        for archive, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            system, path = place(archive)
            with system.open_input_file(path) as file:
                rows, size = [], 0
                for offset, record in members(file, start, end):
                    h, http, payload = parse(record)
                    digest = f"sha1:{base32_sha1(payload)}"
                    if h.get("warc-type") == "response" and h.get("warc-payload-digest", digest) != digest:
                        continue
                    rows.append((archive, offset, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), http.decode("utf-8", "replace"), payload))
                    size += len(payload)
                    if size > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives (archive, bytes), read by byte ranges of `split` bytes; columns as in RECORD."""
    ranges = archives.where("bytes > 0").select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("archive", "start", (F.col("start") + split).alias("end"))
    # a few bytes a row: dealt out so that every task scans its own ranges
    spread = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(spread, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive", "start").mapInArrow(reads, RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records as write_archives wrote them."""

    def page(column: str):
        return F.expr(f"try_cast(nullif(substring({column}, 19, length({column}) - 19), '') as bigint)")

    # a revisit holds no payload: its length and digest are those that its headers state
    stated = F.regexp_extract("http", r"(?i)Content-Length: (\d+)", 1).cast("long")
    length = F.when(F.col("type") == "response", F.octet_length("payload").cast("long")).otherwise(stated)
    return records.select(page("record_id").alias("page_id"), length.alias("payload_bytes"), F.expr("substring(digest, 6)").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), f"{run_dir(spark)}/warc-{uuid.uuid4().hex}")
    return page_records(read_archives(archives))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
