"""WARC archives written and read index first (operator 10).

Writing: records of a task go to one archive (a gzip member per record, so that any byte range of
whole members reads alone) under a folder that all executors share; each record gives an index row
(file, offset, length, url, digest). A retried task writes files of new names, and only the rows of
the attempt that succeeded are in the index: files of lost attempts are never read.

Reading: the index rows that are asked for are sorted by file and offset, split by blocks of
``BLOCK_BYTES``, and neighbours closer than ``GAP_BYTES`` share one range read; digests are verified.

Payloads that are equal and have ``min_revisit`` bytes or more are stored once, with the greatest id;
the others become revisit records that name it.

Defined cases: a null payload is empty; a null id ranks below all others and is returned as null; if
a group of equal payloads repeats its greatest id, all rows with that id are responses; a null url
gives a record without a target; line ends in a url are percent-encoded; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import scratch_path

from .common import pick, stored

MIN_REVISIT, BLOCK_BYTES, GAP_BYTES = 1000, 8 << 20, 64 << 10
INDEX = "file string, offset long, length long, page_id string, url string, digest string, record_type string"
RECORD = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _uri(page_id: str | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:id:{base64.b16encode(page_id.encode()).decode()}>"


def _page(uri: str) -> str | None:
    kind, _, value = uri.strip("<>").removeprefix("urn:page:").partition(":")
    return base64.b16decode(value).decode() if kind == "id" else None


def _safe(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def to_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None,
              revisit: bool) -> bytes:
    """One gzip member with a response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_uri(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def from_record(member: bytes) -> tuple:
    """Values of ``RECORD`` from a gzip member; raises if the payload does not have its digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    return (_page(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), None if revisit else payload, size, digest,
            field["WARC-Type"], _page(field["WARC-Refers-To"]) if revisit else None)


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all rows under ``folder``; returns the stored index (file, offset, length, page_id, url,
    digest, record_type)."""
    rows = pick(df, page_id=id_col, url=url_col, payload=payload_col).select(
        "page_id", F.col("url").cast("string"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # revisits are decided without payloads, per (page, digest, size); payloads then meet the decisions by page, so
    # a payload that many pages share is spread over the tasks
    light = stored(rows.select("page_id", "digest", "size"), "warc-digests")
    first = (light.where(F.col("size") >= min_revisit).groupBy("digest", "size")
             .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").drop("n"))
    decided = light.distinct().join(stored(first, "warc-kept"), ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("kept")))
    decided = stored(decided.select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), F.col("size").alias("of_size"), "kept"),
                     "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")) & (F.col("size") == F.col("of_size"))
    joined = rows.join(decided, same, "left")
    revisit = F.col("of_digest").isNotNull()
    records = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest",
                            F.when(revisit, F.col("kept").cast("string")).alias("refers_to"), revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        name, sink, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                out = []
                for r in zip(*(b.column(c).to_pylist() for c in (
                        "page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                    member = to_record(*r)
                    if sink is None:
                        sink = system.open_output_stream(f"{root}/{name}", compression=None)
                    sink.write(member)
                    out.append((name, at, len(member), r[0], r[1], r[3], "revisit" if r[5] else "response"))
                    at += len(member)
                if out:
                    yield pa.record_batch([pa.array(c) if i in (1, 2) else pa.array(c, pa.string())
                                           for i, c in enumerate(zip(*out, strict=True))],
                                          names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if sink is not None:
                sink.close()

    return stored(records.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows, by coalesced range reads (columns of ``RECORD``; ``payloads``:
    False leaves the payload out after its digest was verified)."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // BLOCK_BYTES))  # by the bytes to read, not those of the index
    chosen = (index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
              .repartition(tasks, "file", "block").sortWithinPartitions("file", "offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)

        def fetch(name: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            with system.open_input_file(f"{root}/{name}") as f:
                low, high = ranges[0][0], ranges[-1][0] + ranges[-1][1]
                f.seek(low)
                raw = f.read(high - low)
            rows = [from_record(raw[a - low:a - low + n]) for a, n in ranges]
            cols = list(zip(*rows, strict=True))
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
            if not payloads:
                cols[2] = [None] * len(rows)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                   names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type",
                                          "refers_to"])

        name, ranges = None, []
        for b in batches:
            for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                end = ranges[-1][0] + ranges[-1][1] if ranges else 0
                if ranges and (file != name or at - end > GAP_BYTES or at + n - ranges[0][0] > BLOCK_BYTES):
                    yield fetch(name, ranges)
                    ranges = []
                name = file
                ranges.append((at, n))
        if ranges:
            yield fetch(name, ranges)

    return chosen.mapInArrow(read, RECORD)


def archive_and_read(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the rows of ``df`` as archives under the shared folder and read them all back: page_id,
    payload_bytes, payload_digest (lower-case hex), record_type, refers_to."""
    folder = scratch_path(df.sparkSession, "warc")
    index = write_archives(df, folder, id_col, url_col, payload_col, min_revisit)
    id_type = pick(df, x=id_col).schema["x"].dataType
    return read_records(index, folder, payloads=False).select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))
