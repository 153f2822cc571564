"""WARC archives: a writer with revisit records, and a splittable reader.

An archive is a row of gzip members, one per record. The reader's tasks get byte ranges of files. A
task looks for gzip's magic bytes in its range, takes the first place whose decoded bytes begin with a
WARC version line, and from there goes member by member; it owns the records that start inside its
range and reads past its end only to finish the last. Files are opened through ``pyarrow.fs``, so any
store it knows will do; where Spark keeps its shared folder, archives can be kept too.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm.shared import arrow_map, fresh_path, materialise

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
BLOCK = 1 << 20
LEVEL = 4


# --- records ---------------------------------------------------------------------------------------


@dataclass
class Record:
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes


def _line(text: str) -> str:
    """A header value: line ends would start another header."""
    return re.sub(r"[\r\n]+", " ", text)


def encode_record(r: Record) -> bytes:
    """A response with its payload or a revisit without; both tell the payload's length and SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload if r.record_type == "response" else b"")
    name = "" if r.page_id is None else str(r.page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {r.record_type}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {_line(r.url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{r.payload_digest}",
    ]
    if r.refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{r.refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _length(headers: dict[str, str], missing: int) -> int:
    told = headers.get("content-length", "")
    return int(told) if told.isdecimal() and told.isascii() else missing


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def decode_record(data: bytes) -> Record | None:
    """The record in a member's bytes; None for kinds without an HTTP payload.

    A record without a length holds what the member holds; a revisit that does not tell its payload's length
    or digest has -1 or an empty one.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    kind = warc.get("warc-type", "").lower()
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: _length(warc, len(rest))].partition(b"\r\n\r\n")
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size, digest, payload = _length(_headers(http), -1), warc.get("warc-payload-digest", "").removeprefix("sha1:"), b""
    return Record(_page(warc.get("warc-record-id")), warc.get("warc-target-uri", ""), kind, _page(warc.get("warc-refers-to")), size, digest, payload)


# --- reading ---------------------------------------------------------------------------------------


class Members:
    """The gzip members of a file that start in [begin, end)."""

    def __init__(self, file, size: int, begin: int, end: int):
        self.file, self.size, self.begin, self.end = file, size, begin, min(end, size)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def _is_record(self, at: int) -> bool:
        """Whether a member that decodes to a WARC version line starts at this place."""
        inflate = zlib.decompressobj(31)
        try:
            return inflate.decompress(self._read(at, 4096), 64).startswith(VERSION)
        except zlib.error:
            return False

    def first(self, at: int) -> int | None:
        """The first record that starts at or after this place, inside the range."""
        while at < self.end:
            block = self._read(at, min(BLOCK, self.end - at) + len(MAGIC) - 1)  # magic may straddle the blocks and the range's end
            found = block.find(MAGIC)
            while found >= 0 and at + found < self.end:
                if self._is_record(at + found):
                    return at + found
                found = block.find(MAGIC, found + 1)
            at += BLOCK
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self.first(self.begin)
        while at is not None and at < self.end:
            inflate, parts, ahead = zlib.decompressobj(31), [], at
            try:
                while not inflate.eof and ahead < self.size:
                    block = self._read(ahead, 1 << 16)
                    ahead += len(block)
                    parts.append(inflate.decompress(block))
            except zlib.error:
                inflate, parts = None, []
            if inflate is not None and inflate.eof:
                yield at, b"".join(parts)
                at = ahead - len(inflate.unused_data)
                if at < self.end and not self._is_record(at):
                    at = self.first(at)
            else:  # a broken or cut member: look for the next one
                at = self.first(at + 1)


#: Schemes by which Hadoop names stores that pyarrow.fs names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def _store(path: str):
    from pyarrow import fs

    scheme, sep, rest = path.partition("://")
    if not sep:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


RECORDS = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every response and revisit record of the files (path and size each); no file gives no row.

    Broken members are skipped up to the next record. A record's payload_digest is computed from the bytes
    of a response and taken from the headers of a revisit.
    """
    table = spark.createDataFrame([(path, size) for path, size in files if size], "path string, size long")
    # ranges are made on the executors, however many there are
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("begin")
    count = sum(-(-size // range_bytes) for _, size in files)
    table = table.select("path", "size", begin).withColumn("end", F.col("begin") + range_bytes).repartition(max(1, min(count, 100_000)))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, place = _store(row["path"])
            rows, held = [], 0
            with store.open_input_file(place) as file:
                for at, data in Members(file, row["size"], row["begin"], row["end"]):
                    r = decode_record(data)
                    if r is None:
                        continue
                    rows.append((row["path"], at, r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload))
                    held += len(r.payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], types)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], types)

    return arrow_map(table, scan, RECORDS)


# --- writing ---------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: what each row of pages (page_id, url, html) becomes.

    Among equal payloads of revisit_bytes or more the largest page_id is the response; all rows with that id
    are. Rows without an id come after all others; if no row has one, all are responses. A null html is empty.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    heads = base.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("head"))
    # only digests that repeat; written out, so that the join knows how many there are
    heads = materialise(heads.where("n > 1 and head is not null").select("digest", "head"), "heads")
    joined = base.join(heads, "digest", "left")
    refers = F.when((F.col("size") >= revisit_bytes) & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> list[tuple[str, int]]:
    """Writes one archive per partition below path and returns the paths and sizes.

    A task writes under a name of its own attempt and renames it in the end, so repeated tasks leave one file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, place = _store(path)
        store.create_dir(place, recursive=True)
        name, size = f"part-{task.partitionId():06d}.warc.gz", 0
        draft = f"{place}/.{name}.{task.taskAttemptId()}"
        with store.open_output_stream(draft) as out:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
                for html, page_id, url, digest, refers in zip(pc.cast(batch.column("html"), pa.binary()).to_pylist(), *columns, strict=True):
                    data = encode_record(Record(page_id, url, "response" if refers is None else "revisit", refers, len(html), digest, html))
                    out.write(data)
                    size += len(data)
        store.move(draft, f"{place}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size])], ["file", "size"])

    return [(r[0], r[1]) for r in arrow_map(plan_records(pages, revisit_bytes), write, "file string, size long").collect()]  # one row per file


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM m
"""
