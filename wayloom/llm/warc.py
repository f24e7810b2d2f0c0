"""WARC writing, the monolithic gzip normaliser, and reading back by index.

``write_archives`` stores pages as whole-file gzip streams (one stream for many records),
the form in which crawls often arrive.  ``normalise`` inflates each such stream once, from
front to end, rewrites every record as a gzip member of its own, and writes a sidecar index
of offsets beside the new archive.  ``read_archives`` seeks by that index.

Archives live in the shared folder and are opened through pyarrow's file systems, so any
store that it knows will do.  A task names its files uniquely and returns the names; only
returned names count, so a task that runs again after a lost executor does no harm.  The
table of names is written before it is used.

Payload duplicates: of records with equal payloads of at least ``min_bytes`` bytes, the one
of the smallest page id is a response, the others are revisits without the payload.

Defined results: null html is an empty payload, a null url leaves the target out; a record
of a null page id is a response, and no revisit refers to it; repeated rows of one page id are each a record of the same type; other columns are not
carried; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, materialise, table

#: Uncompressed bytes after which a task begins its next archive; zlib level; read size.
ARCHIVE_BYTES, LEVEL, READ_BYTES = 16 << 20, 3, 1 << 20
END = b"\r\n\r\n"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which has the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else urllib.parse.quote(str(page_id))}>")
    head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append(f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{urllib.parse.quote(str(refers_to))}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


#: Characters of a URL that cannot stand in a header; they are written as escapes.
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def records(chunks):
    """Whole records (bytes) and their header fields, from pieces of an inflated stream."""
    held, at = bytearray(), 0
    need = None
    found: dict[str, str] = {}
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(END, at)
                if end < 0:
                    break
                found = fields(bytes(held[at:end]))
                need = end + 4 + int(found["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[at:need]), found
            at, need = need, None
        if at:
            del held[:at]
            need = None if need is None else need - at
            at = 0
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(stream):
    """Pieces of a gzip stream of one or more members."""
    z = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            out = z.decompress(data, 4 * READ_BYTES)
            if out:
                yield out
            data = z.unconsumed_tail or z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    if out := z.flush():
        yield out


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, html, refers_to): payloads meet by their digests; then pages move once, to be marked."""
    p = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    both = F.concat_ws(":", F.sha1("html"), F.sha2("html", 256))  # colliding SHA-1 payloads are public
    digest = p.where(F.octet_length("html") >= min_bytes).select("id", both.alias("digest"))
    first = digest.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = digest.join(first, "digest").where(F.col("id") != F.col("refers_to")).distinct()
    return p.withColumn("digest", both).join(again, ["id", "digest"], "left").drop("digest")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """(path, n_records): whole-file gzip archives under ``folder``, written by this call."""

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out = z = None
        n = size = 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

        for b in batches:
            for i in range(b.num_rows):
                key, url, html, refers = (c[i].as_py() for c in b.columns)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                whole = record(key, url, html.encode(), refers, date)
                out.write(z.compress(whole))
                n, size = n + 1, size + len(whole)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    marked = mark_revisits(pages, id_col, url_col, html_col, min_bytes)
    return materialise(marked.mapInArrow(run, "path string, n_records long"), "warc-files")


def spread(manifest: DataFrame) -> DataFrame:
    """One archive a task."""
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, index_path, n_records): archives with a member for each record, and their index.

    The index has a JSON line for each record: offset and length of its member, type,
    record id, target and digest.
    """

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for path in b.column(0).to_pylist():
                new = f"{root}/{uuid.uuid4().hex}.warc.gz"
                index, offset = [], 0
                with fs.open_input_stream(path, compression=None) as src, fs.open_output_stream(new, compression=None) as out:
                    for whole, head in records(inflated(src)):
                        z = zlib.compressobj(LEVEL, wbits=31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        entry = {"offset": offset, "length": len(member), "type": head["WARC-Type"], "id": head["WARC-Record-ID"]}
                        index.append(entry | {"uri": head.get("WARC-Target-URI"), "digest": head.get("WARC-Payload-Digest")})
                        offset += len(member)
                with fs.open_output_stream(f"{new}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new]), pa.array([f"{new}.idx"]), pa.array([len(index)], pa.int64())],
                    names=["path", "index_path", "n_records"],
                )

    done = spread(manifest).select("path").mapInArrow(run, "path string, index_path string, n_records long")
    return materialise(done, "warc-normal")


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row for each record of normalised archives, read by offset from the index.

    (page_id string, url, payload_bytes, payload_digest, record_type, refers_to string[, payload]);
    a response whose payload does not have its digest is an error.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payload else 6]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def urn(x):
        return urllib.parse.unquote(x[len("<urn:page:") : -1]) or None if x else None

    def run(batches):
        fs, _ = file_system(folder)
        for b in batches:
            for path, index_path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(index_path, compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                with fs.open_input_file(path) as f:
                    rows, held = [], 0
                    for entry in index:
                        f.seek(entry["offset"])
                        whole = zlib.decompress(f.read(entry["length"]), 31)
                        head_end = whole.index(END)
                        head = fields(whole[:head_end])
                        http_end = whole.index(END, head_end + 4)
                        body = whole[http_end + 4 : head_end + 4 + int(head["Content-Length"])]
                        http = dict(x.split(": ", 1) for x in whole[head_end + 4 : http_end].decode().split("\r\n")[1:])
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(body) != digest:
                            raise ValueError(f"a payload of {path} at {entry['offset']} does not have its digest")
                        row = (urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, urn(head.get("WARC-Refers-To")), body)
                        rows.append(row[: len(names)])
                        held += len(body) if payload else 0
                        if len(rows) >= 5000 or held > READ_BYTES * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=False)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=False)], names=names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return spread(manifest).select("path", "index_path").mapInArrow(run, schema + ", payload binary" * payload)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = fresh_dir(spark, "warc")
    raw = write_archives(pages, f"{folder}/raw")
    got = read_archives(normalise(raw, f"{folder}/records"), f"{folder}/records", payload=False)
    kind = pages.schema["page_id"].dataType
    return got.select(
        F.col("page_id").cast(kind),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id,
      array_to_string(list_transform(string_split(hex, ''), lambda c: right(bin(strpos('0123456789abcdef', c) + 15), 4)), '') AS bits FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
