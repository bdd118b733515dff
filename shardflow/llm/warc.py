"""WARC archives: write pages, normalise monolithic gzip files, read records back.

``write_archives`` writes a record per row into gzip files of one stream each.  ``normalise`` inflates each
whole-file stream once, rewrites every record as a gzip member of its own and writes a sidecar index
(``.idx``: offset, length, type, record id, digest; tab separated) beside it, so that a record can be read by
offset.  ``read_archives`` reads records back by that index.

Folders are given as URIs that Arrow's file systems can open (``file:``, ``hdfs:``, ``s3:``, ``gs:``), shared by
all executors.  A task that runs again writes files of new names, and only the files of the run that ended
well are listed, so lost executors leave unused files behind but no wrong records.

Null and empty html are payloads of no bytes; null urls give records without a target; a null page_id is an
empty id.  Rows that repeat a page_id with the same payload are all of the same type.  An empty table gives no
archives and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import bounded_batches, shared_dir, stored

#: A file is closed after so many bytes of records; a record is never split.
ROLL_BYTES, LEVEL = 64 << 20, 1
#: The most tasks that rewrite or read archives.
TASKS = 50_000
#: The most groups of equal payloads (36 bytes each) that are broadcast; beyond it payloads are shuffled to their group.
BROADCAST_GROUPS = 300_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, min_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Rows (page_id, url, payload, refers_to): of equal payloads of at least min_bytes all but that of the
    smallest page_id refer to it.  The groups are found by SHA-1 and length with a partial aggregate before the
    shuffle.  Groups of two or more are broadcast behind a check of their number, so that payloads stay where they
    are; beyond it the join back leaves large groups for Spark to split."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    keys = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).select("page_id", F.unhex(F.sha1("payload")).alias("k_sha"), F.octet_length("payload").cast("long").alias("k_size"))
    first = keys.filter(F.col("k_size") >= min_bytes).groupBy("k_sha", "k_size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stored(first, "warc-groups")
    first = F.broadcast(first) if first.count() <= broadcast_groups else first
    joined = rows.join(first, (F.col("sha") == F.col("k_sha")) & (F.col("size") == F.col("k_size")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """A WARC record; a revisit has the HTTP header only, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase):
    """Yield (headers, whole record, block) of the records of an inflated stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        raw, headers = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        raw.append(line)
        block = stream.read(size := int(headers["content-length"]))
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, b"".join(raw) + block + b"\r\n\r\n", block


def _paths(names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write each partition's records to monolithic gzip files; the paths written."""

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = sink = None
        size, names = 0, []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    names.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    sink = store.open_output_stream(f"{base}/{names[-1].rpartition('/')[2]}", compression=None)
                    out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                sink.write(out.compress(data := record(page_id, url, payload, refers_to, date)))
                size += len(data)
                if size >= roll_bytes:
                    sink.write(out.flush())
                    sink.close()
                    out = None
        if out is not None:
            sink.write(out.flush())
            sink.close()
        yield _paths(names)

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string")


def _a_task_each(archives: DataFrame) -> DataFrame:
    """Paths dealt out evenly, a task for each up to ``TASKS`` (their rows are tiny: left to itself, Spark would merge them)."""
    return archives.repartition(max(1, min(TASKS, archives.count())))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member for each record, and a sidecar index; the paths written."""

    def rewrite(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for path in b.column(0).to_pylist():
                source, at = fs.FileSystem.from_uri(path)
                name, offset = uuid.uuid4().hex + ".warc.gz", 0
                with (
                    source.open_input_file(at) as f, gzip.GzipFile(fileobj=f) as g, io.BufferedReader(g, 1 << 20) as stream,
                    store.open_output_stream(f"{base}/{name}", compression=None) as sink, store.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    for headers, raw, _ in parse(stream):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        sink.write(member)
                        row = (str(offset), str(len(member)), headers.get("warc-type", "-"), headers.get("warc-record-id", "-"), headers.get("warc-payload-digest", "-"))
                        index.write(("\t".join(row) + "\n").encode())
                        offset += len(member)
                yield _paths([f"{folder}/{name}"])

    return _a_task_each(archives).mapInArrow(rewrite, "path string")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each read at its offset in the sidecar index; digests and lengths of
    responses are those of the payload that was read, those of revisits are what their headers say."""

    def inside(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def scan(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(at + ".idx") as f, io.BufferedReader(f) as index, store.open_input_file(at) as archive:
                    for line in index:
                        offset, length = map(int, line.split(b"\t")[:2])
                        archive.seek(offset)
                        ((headers, _, block),) = parse(io.BytesIO(zlib.decompress(archive.read(length), 31)))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if headers["warc-type"] == "response":
                            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if headers["warc-payload-digest"] != f"sha1:{digest}":
                                raise ValueError(f"a payload of {path} differs from its digest")
                        else:
                            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((inside(headers["warc-record-id"]), size, digest, headers["warc-type"], inside(headers.get("warc-refers-to"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = [x.split()[0] for x in RECORDS.split(", ")]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names)

    return _a_task_each(archives).mapInArrow(scan, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages as archives, normalise them and read every record back."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark, "warc")
    raw = stored(write_archives(plan_records(pages, min_bytes), f"{folder}/raw", roll_bytes=roll_bytes), "warc-raw")
    return read_archives(stored(normalise(raw, f"{folder}/normal"), "warc-normal"))
