"""WARC archives with an index: write records, select in the index, read back coalesced byte ranges.

Each task writes one archive of gzip members into the shared folder and returns an index row per record: file,
offset, length, URL and digest. The index is a table written before anything is read. A reader takes selected index
rows in order of file and offset, merges neighbouring ranges, and reads each merged range once. An archive's name
holds the attempt that wrote it, so an attempt that is lost or repeated leaves only a file that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, tidy

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Ranges with at most so many bytes between them are read at once, up to so many bytes.
GAP, MOST_READ = 64 << 10, 8 << 20
BATCH = 500


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target}"] * (target is not None) + [f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] * revisit
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> tuple:
    """The fields of RECORD, from one record's bytes; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what the header says")
    return _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], _number(fields.get("WARC-Refers-To")), size, digest, payload if fields["WARC-Type"] == "response" else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the index, a written table (see INDEX).

    The payload is html in UTF-8, null is empty. Of rows with equal payloads of at least least_revisit_bytes, those with
    the smallest page_id are responses (rows that repeat it all are), the others revisits; smaller payloads are always
    responses. A null page_id is never smallest, unless all of the group are null, then all are responses. A null url
    gives no target header; white space and control characters in a url are percent-encoded. An empty table gives an
    empty index. Other columns are not read.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # Written, so that the join's two sides are plain exchanges and a hot digest can be split at run time.
    first = materialize(rows.where(F.octet_length("payload") >= least_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "first-pages")
    joined = rows.join(first, "sha", "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                index = []
                for page_id, url, payload, first_id in zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns), strict=True):
                    if out is None:
                        files, path = _file_system(name)
                        files.create_dir(path.rpartition("/")[0], recursive=True)
                        out = files.open_output_stream(path, compression=None)
                    revisit = first_id is not None and first_id != page_id
                    data = _gzip(_record(page_id, url, payload, first_id, revisit, date))
                    out.write(data)
                    index.append((name, offset, len(data), page_id, url, digest_of(payload), "revisit" if revisit else "response"))
                    offset += len(data)
                yield _batch(index, INDEX)
        if out is not None:
            out.close()

    return materialize(joined.mapInArrow(tidy(write), INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, offset, length) of the reads that cover sorted (offset, length) ranges."""
    reads: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads and offset - (reads[-1][2] + reads[-1][3]) <= gap and offset + length - reads[-1][2] <= most:
            a, _, start, size = reads[-1]
            reads[-1] = (a, i + 1, start, max(size, offset + length - start))
        else:
            reads.append((i, i + 1, offset, length))
    return reads


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that these index rows name, as RECORD; payload is null for revisits, and for all without payloads.

    A row that the index repeats is read as often; an empty index gives no records. Further columns are not read. A
    payload that doesn't have the digest of its header, or a range that isn't a record, raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][0] == rows[at][0]:
                    end += 1
                if rows[at][0] != name:
                    name = rows[at][0]
                    files, path = _file_system(name)
                    source = files.open_input_file(path)
                ranges = [(offset, length) for _, offset, length in rows[at:end]]
                for a, b, start, size in coalesced(ranges):
                    data = source.read_at(size, start)
                    found = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in ranges[a:b]]
                    yield _batch(found if payloads else [(*f[:-1], None) for f in found], RECORD)
                at = end

    # The tasks' number follows the bytes to be read; the index rows that are shuffled say little about them.
    most = index.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // most))
    return index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(tidy(read), RECORD)
