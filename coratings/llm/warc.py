"""WARC archives of pages: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from coratings.llm.staging import BROADCAST_TEXT_ROWS, cut, folder, sized

ARCHIVE = 256 << 20  # bytes after which a task begins another archive
READ = 8 << 20  # bytes read at once, a larger record excepted
TASK = 64 << 20  # bytes of archives that a task reads, about
GAP = 64 << 10  # bytes between two wanted records that are read along
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, number: str, url: str | None, payload: bytes, refers_to: object, date: str = DATE) -> tuple[bytes, str]:
    """One WARC record and its payload's digest. With ``refers_to`` a revisit, which leaves the payload out."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = f"page:{page_id}" if page_id is not None else f"nopage:{number}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n", digest


def parse(raw: bytes) -> dict:
    """page_id (text), type, digest, refers_to (text), payload bytes and full length. A payload that isn't its digest's is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    of_page = lambda x: m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", x or "")) else None
    return {
        "page_id": of_page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_digest": digest, "refers_to": of_page(fields.get("WARC-Refers-To")), "payload_bytes": length, "payload": payload,
    }


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _writer(where: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(where)
        files.create_dir(root, recursive=True)
        out, name, offset, count = None, "", 0, 0
        task = TaskContext.get().partitionId()
        try:
            for batch in batches:
                index: dict[str, list] = {c: [] for c in ("file", "offset", "length", "url", "payload_digest", "record_type")}
                columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    if out is None or offset >= ARCHIVE:
                        if out is not None:
                            out.close()
                        # A name of its own for each attempt: what a lost attempt left is in no index.
                        name, offset = f"{task:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    raw, digest = record(page_id.as_py(), f"{task}-{count}", url.as_py(), html.as_py().encode(), refers_to.as_py(), date)
                    member = gzip.compress(raw, 6, mtime=0)
                    out.write(member)
                    kind = "response" if refers_to.as_py() is None else "revisit"
                    for c, v in zip(index, (name, offset, len(member), url.as_py(), digest, kind), strict=True):
                        index[c].append(v)
                    offset += len(member)
                    count += 1
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(index.values(), types, strict=True)], list(index))
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, where: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Write a WARC record (a gzip member) per row of ``pages`` below ``where``; return the index.

    The index has file, offset, length, url, payload_digest and record_type.
    Of records with equal payloads of at least ``least`` bytes the one with the
    smallest page_id is the response and the others are revisits of it;
    rows that share that page_id are all responses, as are equal payloads
    that all lack a page_id. Null html is an empty payload; a null url is left out.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    size = F.octet_length("html")
    firsts = (
        rows.where(size >= least).select("page_id", F.sha2("html", 256).alias("same"))
        .groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    )
    firsts = sized(cut(firsts), BROADCAST_TEXT_ROWS)
    refers_to = F.when((size >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = rows.withColumn("same", F.sha2("html", 256)).join(firsts, "same", "left").select("page_id", "url", "html", refers_to.alias("refers_to"))
    return cut(
        joined.mapInArrow(_writer(where, date), "file string, offset long, length long, url string, payload_digest string, record_type string")
    )


def _reader(where: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(where)
        opened: tuple[str, object] = ("", None)

        def read(wanted: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal opened
            name, low = wanted[0][:2]
            if opened[0] != name:
                if opened[1] is not None:
                    opened[1].close()
                opened = (name, files.open_input_file(f"{root}/{name}"))
            raw = opened[1].read_at(max(o + n for _, o, n in wanted) - low, low)
            rows = [parse(gzip.decompress(raw[o - low : o - low + n])) for _, o, n in wanted]
            schema = pa.schema(
                [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64())]
                + ([("payload", pa.binary())] if with_payload else [])
            )
            return pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in rows], schema)

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for name, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                if held and (name != held[0][0] or offset - (held[-1][1] + held[-1][2]) > GAP or offset + length - held[0][1] > READ):
                    yield read(held)
                    held = []
                held.append((name, offset, length))
        if held:
            yield read(held)
        if opened[1] is not None:
            opened[1].close()

    return run


def read_records(selected: DataFrame, where: str, with_payload: bool = False) -> DataFrame:
    """The records of the index rows ``selected``: page_id and refers_to as text, url, record_type, payload_digest, payload_bytes.

    Rows are range partitioned and sorted by file and offset, and neighbours
    are read together. There are as many partitions as the archives' bytes
    ask for, whatever the size of the index. Every response's payload is held
    against its digest. Runs a job: the lengths are added up.
    """
    tasks = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // TASK))
    ordered = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    payload = ", payload binary" if with_payload else ""
    return ordered.mapInArrow(
        _reader(where, with_payload),
        f"page_id string, url string, record_type string, payload_digest string, refers_to string, payload_bytes long{payload}",
    )


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read all of them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Empty input: no archives, no rows.
    """
    where = folder(pages.sparkSession)
    kind = pages.schema["page_id"].dataType
    records = read_records(write_archives(pages, where, least), where)
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
