"""WARC archives: write, normalise monolithic gzip files, read back by offset.

``write_archives`` gives each task's records as whole-file gzip streams (one
member spans the file), the shape that cannot be entered in the middle.
``normalise`` inflates each such stream once from front to back, rewrites every
record as its own gzip member and writes a sidecar index (one tab-separated
line per record: offset, length, type, record id).  ``read_archives`` seeks to
each member by its index line.

Files live in the cluster's shared folder.  A task attempt writes files of its
own name and returns them as rows; only files named by the saved manifest are
read, so a lost or repeated attempt leaves no duplicate records.  Tasks hold
one copy block at a time when inflating, one record when reading back.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, functions as F

from farewatch.llm.common import filesystem, save, shared_folder

# Payloads from this size are recorded once; later equal ones become revisits.
REVISIT_MIN_BYTES = 1000
# A monolithic file is closed after so many bytes of records.
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, index_path string, records long"
READ_BACK = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan_records(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to) to be written, one per page.

    Of equal payloads of at least ``REVISIT_MIN_BYTES`` the largest page_id is
    the response (rows that repeat that id are all responses); the others refer
    to it.  A null html is an empty payload.  Rows without page_id are
    responses and are never referred to.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = (rows.where((F.octet_length("payload") >= REVISIT_MIN_BYTES) & F.col("page_id").isNotNull())
              .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id"))
              .where("n > 1").select("digest", "first_id"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> Iterator[bytes]:
    """One WARC record in blocks: header, then (for a response) the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    record_id = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(http) + (0 if revisit else len(payload)))))
    yield VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http
    if not revisit:
        yield payload
    yield b"\r\n\r\n"


def _write_task(folder: str):
    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, records = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = gzip.GzipFile(fileobj=fs.open_output_stream(filesystem(path)[1], compression=None), mode="wb",
                                        mtime=0, compresslevel=6)
                for block in record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]):
                    out.write(block)
                    size += len(block)
                records += 1
                if size >= ARCHIVE_BYTES:
                    _close(out)
                    out = None
                    yield _manifest(path, None, records)
        if out is not None:
            _close(out)
            yield _manifest(path, None, records)
    return run


def _close(gz: gzip.GzipFile) -> None:
    stream = gz.fileobj
    gz.close()
    stream.close()


def _manifest(path, index_path, records):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(
        [{"path": path, "index_path": index_path, "records": records}],
        schema=pa.schema([("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64())]))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``plan_records`` rows as monolithic .warc.gz files; returns the saved manifest."""
    return save(records.mapInArrow(_write_task(folder), MANIFEST), "warc-manifest")


def read_header(stream) -> list[tuple[str, str]] | None:
    """Header fields of the next record, or None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        key, _, value = line.decode("utf-8").partition(":")
        fields.append((key.strip(), value.strip()))
    return fields


def rewrite(stream, write, index) -> int:
    """Copy every record of an inflated stream into a gzip member of its own.

    ``write`` takes compressed bytes; ``index`` takes (offset, length, type, id).
    """
    at = n = 0
    while (fields := read_header(stream)) is not None:
        field = dict(fields)
        packer, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        parts = [VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"]
        left = int(field["Content-Length"])
        while True:
            for part in parts:
                done = packer.compress(part)
                write(done)
                length += len(done)
            if left <= 0:
                break
            parts = [stream.read(min(BLOCK, left))]
            if not parts[0]:
                raise ValueError("truncated record")
            left -= len(parts[0])
        done = packer.compress(b"\r\n\r\n") + packer.flush()
        write(done)
        length += len(done)
        index(at, length, field["WARC-Type"], field["WARC-Record-ID"])
        at += length
        n += 1
    return n


def _normalise_task(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            target = path.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.members.warc.gz"
            fs, source = filesystem(path)
            members = filesystem(target)[1]
            with (fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(members, compression=None) as out,
                  fs.open_output_stream(members + ".idx", compression=None) as idx):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), BLOCK)
                n = rewrite(stream, out.write, lambda *line: idx.write(("\t".join(map(str, line)) + "\n").encode()))
            yield _manifest(target, target + ".idx", n)


def one_file_per_task(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrite each monolithic file of ``manifest`` record by record; returns the new saved manifest."""
    return save(one_file_per_task(manifest).mapInArrow(_normalise_task, MANIFEST), "warc-members")


def parse_record(record: bytes) -> dict:
    """A member's content as a row; the payload of a response is hashed again."""
    import hashlib

    stream = io.BytesIO(record)
    field = dict(read_header(stream))
    block = stream.read(int(field["Content-Length"]))
    head, _, body = block.partition(b"\r\n\r\n")
    declared = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    kept = field["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = field["WARC-Type"] == "revisit"
    digest = base64.b32decode(kept).hex() if revisit else hashlib.sha1(body).hexdigest()
    if not revisit and (len(body) != declared or base64.b32decode(kept).hex() != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")

    def page(name):
        value = field.get(name, "").strip("<>")
        return int(value.removeprefix("urn:page:")) if value.startswith("urn:page:") else None

    url = field.get("WARC-Target-URI")
    return {"page_id": page("WARC-Record-ID"), "url": None if url is None else unquote(url), "payload_bytes": declared,
            "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": page("WARC-Refers-To"),
            "payload": None if revisit else body}


def _read_task(with_payload: bool):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                fs, source = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(source) as members, fs.open_input_stream(filesystem(index_path)[1], compression=None) as idx:
                    for line in io.BufferedReader(idx):
                        offset, length = map(int, line.split(b"\t")[:2])
                        members.seek(offset)
                        row = parse_record(gzip.decompress(members.read(length)))
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if len(rows) >= 4096 or held >= BLOCK * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the normalised files, each read by its index line."""
    return one_file_per_task(manifest).mapInArrow(_read_task(with_payload), READ_BACK)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read them back.

    Columns: page_id, payload_bytes, payload_digest (hex SHA-1), record_type,
    refers_to, url.  See ``plan_records`` for nulls and ties; repeated rows give
    repeated records; an empty table gives no files and no rows.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    members = normalise(write_archives(plan_records(pages), folder))
    return read_archives(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
