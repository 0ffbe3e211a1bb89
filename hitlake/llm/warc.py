"""WARC archives: write records, one gzip member each, and read them back with a sequential reader.

Writing: each task rolls archive files of about `file_bytes` into the shared folder, under names of its own attempt;
only the files that finished tasks report are part of the archive, so a lost executor leaves at most an unlisted file.
Of records with equal payloads of at least `least_bytes`, the one with the smallest page_id is a `response`, the others
are `revisit` records without payload that refer to it; smaller ones are all responses.

Reading: the files are dealt to tasks one by one; a file is read in chunks, inflated member by member with an
incremental zlib object, framed by Content-Length, and the payload's SHA-256 is held against the stated digest.

Defined cases: null html = empty payload (response); repeated rows with the smallest page_id are all responses; a null
page_id counts as larger than any other; an empty table writes no record; other columns than page_id, url and html are
ignored. A damaged member, a short record or a wrong digest raises `WarcError`.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, scratch

VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"  # fixed, so that equal input gives equal records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def _header(lines: list[tuple[str, str]], first: bytes) -> bytes:
    clean = [(k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in lines]
    return first + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in clean) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member that holds one record. A revisit keeps the HTTP header, and with it the payload's length."""
    kind = "response" if refers_to is None else "revisit"
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(payload_bytes))], b"HTTP/1.1 200 OK")
    block = http + (payload if refers_to is None else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    lines += [("WARC-Target-URI", url)] if url else []
    lines += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines += [] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_header(lines, VERSION) + block + b"\r\n\r\n") + pack.flush()


def members(read, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time; `read(n)` returns up to n bytes."""
    data = b""
    while True:
        data = data or read(chunk)
        if not data:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := read(chunk)):
                raise WarcError("the archive ends inside a gzip member")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as error:
                raise WarcError(f"damaged gzip member: {error}") from error
            data = inflate.unused_data if inflate.eof else b""
        yield b"".join(parts)


def fields(head: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = head.split(b"\r\n")
    return first, {k.strip().decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines if line)}


def parse(member: bytes) -> dict:
    """The record of a member, checked: version, Content-Length framing, HTTP length and payload digest."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, warc = fields(head)
    if version != VERSION or not gap or "content-length" not in warc:
        raise WarcError("not a WARC record")
    length = int(warc["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError("the record's length is not its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    _, web = fields(http)
    size, digest = int(web["content-length"]), warc["warc-payload-digest"].removeprefix("sha256:")
    if warc["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload does not match its digest or length")
    name = lambda key: int(n) if (n := warc.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": name("warc-record-id"), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": name("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload}


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return system, inner


def plan_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html as binary, digest, payload_bytes, refers_to (null for a response)."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("bigint")})
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("of")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # One digest may hold a third of the rows: the sort-merge join splits such a partition, as `first` has one row for it.
    joined = rows.join(first, (rows["payload_digest"] == first["of"]) & (rows["payload_bytes"] >= least_bytes), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = 64 << 20, least_bytes: int = 100) -> DataFrame:
    """Write the archives; returns a written table of their (path, records, bytes), the archive's list of files."""
    base = folder or f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    system, inner = _open(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner, compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"])
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, count, size))
                    out, count, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return materialise(plan_records(pages, least_bytes).mapInArrow(write, "path string, records bigint, bytes bigint"))


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the listed files: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload)."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if payloads else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], names=list(kinds))

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = _open(path)
                rows, seen = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for member in members(stream.read):
                        rows.append(parse(member))
                        seen += 1
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if seen != records:
                    raise WarcError(f"{path} holds {seen} records, not {records}")
                if rows:
                    yield batch_of(rows)

    tasks = max(1, min(files.count(), 10_000))
    return files.repartition(tasks, "path").mapInArrow(read, schema)
