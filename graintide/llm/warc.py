"""WARC archives with a two-level capture index.

Tasks write gzip-membered WARC files into the shared folder, one a partition,
and return a capture line per record.  The lines are range-sorted by reversed-host
URL key into index shards; each shard file holds compressed blocks of lines and,
at its end, a sparse directory with the first key of every block.  A lookup finds
the shard by binary search over the shards' first keys (one row a shard, bounded
by the number of index partitions), the block by binary search in the shard's
directory, and the line by binary search in the block; records are then read by
their byte range, neighbouring ranges in one read.

Files get names of their own per attempt, so a task that runs again after a lost
executor leaves no half file in the index.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page_id is the response and the others revisit it.

Defined cases: null html is an empty payload; null url an empty one; a null
page_id is never the response if another row has the payload; rows that share
the largest page_id are all responses; equal captures (same url and page_id)
are all kept; an empty table gives an empty result.  Columns other than key, url
and html are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm.common import keep, new_path, table

LEAST, BLOCK_LINES, READ_BYTES = 1000, 1000, 4 << 20
_CAPTURE = "key string, file string, offset long, length long"
_SHARD = "first string, last string, file string, lines long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@functools.cache
def _store(base: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(base)


def url_key(url: str, page_id: int | None) -> str:
    """Reversed-host key of a capture: com,example,www)/path?query and the page's id."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, port, rest = [""], "", url
    return f"{','.join(reversed(host))}{port}){quote(rest, safe='/%:=&?~#+!$,;@()*[]')} {'-' if page_id is None else page_id}"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the payload's digest and length but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url, safe='/%:=&?~#+!$,;@()*[]')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'-' if page_id is None else page_id}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return fields, payload


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of every page."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = keep(rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    found = rows.join(first, ["digest", "size"], "left")
    revisit = F.col("largest").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("largest"), F.lit(False))
    return found.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(records: DataFrame, base: str) -> DataFrame:
    """Write typed pages as WARC files under ``base``; the captures, written once as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(base)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                rows = []
                for page, url, payload, revisit, refers in zip(*(c for c in batch.columns), strict=True):
                    page, url = page.as_py(), url.as_py()
                    raw = gzip.compress(record(page, url, payload.as_py(), refers.as_py(), revisit.as_py()), 6, mtime=0)
                    out.write(raw)
                    rows.append((url_key(url, page), name, at, len(raw)))
                    at += len(raw)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return keep(records.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, _CAPTURE), "captures")


def build_index(captures: DataFrame, base: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Range-sort the captures into index shards; one row a shard (first and last key, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(base)
        name, out, at, lines, ends, n = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], 0
        directory: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(lines).encode())
            out.write(raw)
            directory.append((lines[0].split("\t", 1)[0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    ends.append(key)
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                last, n = key, n + 1
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([ends[0]]), pa.array([last]), pa.array([name]), pa.array([n])], names=["first", "last", "file", "lines"])

    # binary order of the keys, as Python compares them
    spread = captures.repartitionByRange(*_parts(captures), "key").sortWithinPartitions("key", "file", "offset")
    return keep(spread.mapInArrow(run, _SHARD), "shards")


def _parts(df: DataFrame) -> tuple[int]:
    return (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),)


class IndexShard:
    """Reads an index shard by ranges: its directory, then single blocks."""

    def __init__(self, base: str, name: str) -> None:
        fs, root = _store(base)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(tail, size - 8 - tail)))
        self.firsts = [d[0] for d in self.directory]
        self.at, self.keys, self.lines = -1, [], []

    def _block(self, i: int) -> None:
        if self.at != i:
            _, offset, length = self.directory[i]
            self.lines = [x.split("\t") for x in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
            self.keys, self.at = [x[0] for x in self.lines], i

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File and byte range of every capture with the key."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            self._block(i)
            for k in range(bisect.bisect_left(self.keys, key), len(self.keys)):
                if self.keys[k] != key:
                    return
                yield self.lines[k][1], int(self.lines[k][2]), int(self.lines[k][3])
            i += 1


def lookup(wanted: DataFrame, shards: DataFrame, base: str) -> DataFrame:
    """Captures of the wanted (url, page_id): file and byte range."""
    known = sorted(tuple(r) for r in shards.select("first", "last", "file").collect())  # one row an index partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k[0] for k in known]
        name, shard = None, None
        for batch in batches:
            rows = []
            for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = url_key(url, page)
                i = max(0, bisect.bisect_left(firsts, key) - 1)
                while i < len(known) and known[i][0] <= key:
                    if known[i][1] >= key:
                        if name != known[i][2]:
                            name, shard = known[i][2], IndexShard(base, known[i][2])
                        rows += [(key, *x) for x in shard.find(key)]
                    i += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    # hosts of neighbouring rows share blocks
    order = F.reverse(F.split(F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1), r"\."))
    near = wanted.select(F.coalesce("url", F.lit("")).alias("url"), "page_id").distinct().withColumn("_o", F.concat_ws(",", order))
    near = near.repartitionByRange(*_parts(wanted), "_o", "url", "page_id").sortWithinPartitions("_o", "url", "page_id").select("url", "page_id")
    return near.mapInArrow(run, _CAPTURE)


def fetch(captures: DataFrame, base: str) -> DataFrame:
    """Read the captures' byte ranges, neighbouring ones together, and parse the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(base)
        name, file, held, start = None, None, b"", 0
        for batch in batches:
            rows = []
            _, files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            for i, (f, offset, length) in enumerate(zip(files, offsets, lengths, strict=True)):
                if f != name:
                    name, file, held, start = f, fs.open_input_file(f"{root}/{f}"), b"", 0
                if not start <= offset or offset + length > start + len(held):
                    k, end = i, offset + length
                    while k + 1 < len(files) and files[k + 1] == f and offsets[k + 1] <= end and end - offset < READ_BYTES:
                        k += 1
                        end = max(end, offsets[k] + lengths[k])
                    held, start = file.read_at(end - offset, offset), offset
                fields, payload = parse(gzip.decompress(held[offset - start : offset - start + length]))
                page = None if fields["X-Page-Id"] == "-" else int(fields["X-Page-Id"])
                if fields["WARC-Type"] == "response":
                    rows.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                else:
                    rows.append((page, int(fields["http-length"]), base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "revisit", int(fields["X-Refers-To-Page"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranged = captures.repartitionByRange(*_parts(captures), "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write every page, index the archives, look every page up and read it back.

    A revisit takes length and digest from the payload of the response that it refers to.
    """
    spark = pages.sparkSession
    archive, index = new_path(spark, "archive"), new_path(spark, "index")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    shards = build_index(write_archives(typed(pages, least), archive), index)
    back = keep(fetch(lookup(pages.select("url", "page_id"), shards, index), archive), "records")
    whole = back.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    needed = back.filter("record_type = 'revisit'").select("refers_to", F.col("payload_digest").alias("_digest")).distinct()
    whole = keep(whole.join(needed, ["refers_to", "_digest"], "left_semi").dropDuplicates(["refers_to", "_digest"]), "responses")
    joined = back.withColumn("_digest", F.when(F.col("record_type") == "revisit", F.col("payload_digest"))).join(whole, ["refers_to", "_digest"], "left")
    return joined.select("page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


#: The same rows in SQL, from the pages themselves.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS big FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
 CASE WHEN n >= 1000 AND page_id < big THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id < big THEN big END AS refers_to FROM m
"""
