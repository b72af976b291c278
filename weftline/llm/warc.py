"""WARC archives in which equal payloads are written once (revisit resolution).

1. Headers only (page, payload digest, length) are shuffled by digest; the least page of a digest is the original.
2. Headers join their originals; what isn't its own original becomes a revisit, by page and digest, so that pages
   that share an id keep their own payloads. The hot digest of a much-copied page costs one header for each copy,
   never a payload. Of rows that share both, one is the original and the others revisit it.
3. The revisits join the pages by page and digest: by broadcast below Spark's own threshold, else by a shuffle.
4. Every page becomes one record with fresh headers, a gzip member of its own in an archive below the shared folder.
   A task names its archives by random names and reports them in manifest rows; what a lost or repeated task has
   left, no manifest names.

Reading takes an archive member by member, so a task holds one record at a time, and checks each response's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path

MIN_BYTES = 0
FILE_BYTES = 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
RECORD_NAMES = uuid.UUID("8c3bfb39-5d5e-4f0a-9c43-0b8f0f7f1d52")
CHUNK = 1 << 16


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resolve(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page, sha, refers_to, repeated): the pages with payloads that revisit, of rows (page, sha, bytes).

    A payload of fewer than min_bytes bytes isn't resolved. Null ids are no one's original and never revisit.
    repeated: the page is itself the original, but several rows have this id and payload."""
    headers = rows.filter((F.col("bytes") >= min_bytes) & F.col("page").isNotNull()).select("page", "sha")
    pages = materialize(headers.groupBy("page", "sha").agg(F.count(F.lit(1)).alias("n")), "headers")
    shared = pages.groupBy("sha").agg(F.min("page").alias("refers_to"), F.sum("n").alias("all")).filter("all > 1")
    originals = materialize(shared.select("sha", "refers_to"), "originals")
    own = F.col("page") == F.col("refers_to")
    return pages.join(originals, "sha").filter(~own | (F.col("n") > 1)).select("page", "sha", "refers_to", own.alias("repeated"))


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page, url, html, refers_to) for every row of pages; refers_to is null for responses."""
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    revisits = materialize(resolve(rows.select("page", "sha", F.octet_length("html").alias("bytes")), min_bytes), "revisits")
    joined = rows.join(revisits, ["page", "sha"], "left")
    out = ["page", "url", "html", "refers_to"]
    if not revisits.filter("repeated").limit(1).count():
        return joined.select(out)
    several = materialize(joined.filter("repeated").select("*", F.monotonically_increasing_id().alias("row")), "several")
    first = several.groupBy("page", "sha").agg(F.min("row").alias("first"))
    told = several.drop("refers_to").join(first, ["page", "sha"]).withColumn("refers_to", F.when(F.col("row") != F.col("first"), F.col("page")))
    return joined.filter("not coalesce(repeated, false)").select(out).union(told.select(out))


def _name(page: str, digest: str) -> str:
    """The record id of the response that revisits of this page and payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMES, f'{digest} {page}')}>"


def record(page: str | None, url: str | None, payload: bytes, refers: str | None, original: bool, date: str) -> bytes:
    """One record. original: others may refer to it. Ids travel percent-encoded in fields of their own."""
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", _name(page, digest) if original else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if page is not None:
        fields.append(("Page-ID", quote(page, safe="")))
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers, digest)), ("Refers-To-Page-ID", quote(refers, safe=""))]
    block = http if refers is not None else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace"), block)


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = MIN_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record for every row of pages into archives below folder; the manifest (file, records).

    A null html is an empty payload, a null url about:blank, a null id none. An archive ends once it has file_bytes
    bytes. No rows give no archives. Columns other than the three aren't read. folder is one that executors reach
    through pyarrow's file systems."""
    rows = resolved(pages, id_col, url_col, html_col, min_bytes)
    rows = rows.select(F.col("page").cast("string"), F.col("url").cast("string"), "html", F.col("refers_to").cast("string"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        out, name, files, counts = None, "", [], []
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    where.create_dir(base, recursive=True)
                    name, size, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                original = refers is None and page is not None and len(payload) >= min_bytes
                member = pack.compress(record(page, url, payload, refers, original, date)) + pack.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    files.append(name)
                    counts.append(n)
                    out = None
        if out is not None:
            out.close()
            files.append(name)
            counts.append(n)
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(counts, pa.int64())], names=["file", "records"])

    return materialize(rows.mapInArrow(run, "file string, records bigint"), "manifest")


def members(source) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    data = source.read(CHUNK)
    while data:
        unpack, held = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := source.read(CHUNK)):
                raise ValueError("an archive is cut short")
            held.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(held)
        data = data or source.read(CHUNK)


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive; raises ValueError if one is cut short."""
    for member in members(source):
        head, gap, rest = member.partition(b"\r\n\r\n")
        version, *fields = head.split(b"\r\n")
        if version != VERSION or not gap:
            raise ValueError(f"not the start of a record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (f.decode().partition(":") for f in fields)}
        size = int(headers["content-length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, rest[:size]


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in head.decode().split("\r\n") if x.lower().startswith("content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    page, refers = (None if x is None else unquote(x) for x in (headers.get("page-id"), headers.get("refers-to-page-id")))
    return page, headers["warc-target-uri"], size, digest, kind, refers


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to), one row for each record of the archives
    that the manifest names; ids are strings."""
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with where.open_input_stream(f"{base}/{file}", compression=None) as source:
                    for r in records(source):
                        rows.append(_parsed(*r))
                        if len(rows) == 1000:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    files = manifest.select("file").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def archive(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """(id_col, url, payload_bytes, payload_digest, record_type, refers_to) of each record: write pages into a new
    folder of the shared folder and read the archives back, ids with their own type."""
    folder = new_path(pages.sparkSession, "warc")
    found = read(pages.sparkSession, folder, write(pages, folder, id_col, **options))
    kind = pages.schema[id_col].dataType
    return found.select(F.col("page").cast(kind).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
