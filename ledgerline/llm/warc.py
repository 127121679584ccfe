"""WARC archives: written as one gzip stream, normalised to one gzip member per record.

A task writes its records into archives that are a single gzip member each, as plain ``gzip``
leaves them; such a file can only be read from its start. The normaliser inflates a file once from
front to back, rewrites every record as a member of its own and writes a sidecar index of
offsets, so that any record can be read alone. All files go through the filesystem that the
folder's address names; a task writes under a name of its own, and only files that a finished
task reported are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import durable, stage_folder

ARCHIVE_BYTES = 32 << 20
READ = 1 << 18
RECORD_ID = "urn:page:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>\"]")
INDEX = "path string, offset long, length long, record_id string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of a Spark path: Spark's names for S3 are one store, and dbfs:/ is mounted at /dbfs."""
    for name in ("s3a://", "s3n://"):
        path = path.replace(name, "s3://", 1) if path.startswith(name) else path
    path = "/dbfs/" + path.removeprefix("dbfs:").lstrip("/") if path.startswith("dbfs:/") else path
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, serial: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode("ascii") + (payload if refers_to is None else b"")
    own = "none" if page_id is None else str(page_id)
    name = f"<{RECORD_ID}{own}>" if refers_to is None and page_id is not None else f"<{RECORD_ID}{own}:{serial}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(body)}",
    ]
    if url:
        safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{RECORD_ID}{refers_to}>")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The plain bytes of a gzip file of any number of members, a bounded piece at a time."""
    engine, data, begun = zlib.decompressobj(31), b"", False
    while True:
        data = data or source.read(READ)
        if not data:
            # all is read, but the engine may still hold plain bytes
            plain = engine.decompress(b"", READ) if begun and not engine.eof else b""
            if plain:
                yield plain
                continue
            if begun and not engine.eof:
                raise EOFError("gzip stream is cut off")
            return
        if engine.eof:
            engine = zlib.decompressobj(31)
        begun = True
        plain = engine.decompress(data, READ)
        data = engine.unused_data if engine.eof else engine.unconsumed_tail
        if plain:
            yield plain


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a plain WARC stream; holds one record and one piece."""
    held = bytearray()
    wanted = 0
    for piece in pieces:
        held += piece
        while True:
            if not wanted:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                wanted = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < wanted:
                break
            yield bytes(held[:wanted])
            del held[:wanted]
            wanted = 0
    if held.strip():
        raise EOFError("WARC stream ends within a record")


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[tuple[int, int, str]]:
    """Rewrite a stream record by record; gives offset, length and id of each new member."""
    at = 0
    for whole in split_records(inflate(source)):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(whole) + packer.flush()
        target.write(member)
        yield at, len(member), headers(whole[: whole.index(b"\r\n\r\n")])["warc-record-id"]
        at += len(member)


def parse_record(whole: bytes) -> tuple[dict[str, str], int, str]:
    """(headers, bytes of the full payload, its digest): computed for responses, stated for revisits."""
    cut = whole.index(b"\r\n\r\n")
    head = headers(whole[:cut])
    body = whole[cut + 4 : cut + 4 + int(head["content-length"])]
    http_cut = body.index(b"\r\n\r\n")
    if head["warc-type"] == "response":
        payload = body[http_cut + 4 :]
        return head, len(payload), base32_sha1(payload)
    return head, int(headers(body[:http_cut])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows as WARC files of one gzip member; gives their paths."""

    def run(batches):
        place, root = filesystem(folder)
        place.create_dir(root, recursive=True)
        out, name, size, serial, paths = None, "", 0, 0, []

        def close():
            out.write(packer.flush())
            out.close()
            paths.append(f"{folder}/{name}")

        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = place.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                page = None if pd.isna(page_id) else int(page_id)
                first = None if pd.isna(refers_to) else int(refers_to)
                whole = record(page, url, bytes(payload), base32_sha1(bytes(payload)), first, f"{name[:12]}{serial}")
                out.write(packer.compress(whole))
                size, serial = size + len(whole), serial + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame({"path": paths})

    return pages.select("page_id", "url", "payload", "refers_to").mapInPandas(run, "path string")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Normalise each file at ``path``: gives the index rows (path, offset, length, record_id).

    The new file and its sidecar ``.idx`` of JSON lines lie beside the old one, under names that
    an attempt owns.
    """

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                place, old = filesystem(path)
                new = f"{old.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.records.warc.gz"
                address = f"{path.rpartition('/')[0]}/{new.rpartition('/')[2]}"
                rows = []
                with place.open_input_stream(old, compression=None) as source, place.open_output_stream(new, compression=None) as target:
                    rows = list(normalise(source, target))
                with place.open_output_stream(f"{new}.idx", compression=None) as index:
                    for at, length, name in rows:
                        index.write(json.dumps({"offset": at, "length": length, "record_id": name}).encode() + b"\n")
                yield pd.DataFrame(
                    {"path": address, "offset": [r[0] for r in rows], "length": [r[1] for r in rows], "record_id": [r[2] for r in rows]}
                )

    return archives.mapInPandas(run, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """Read each indexed record alone by its offset and check it against its digest header."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, part in batch.groupby("path", sort=False):
                place, name = filesystem(path)
                with place.open_input_file(name) as source:
                    for at, length in zip(part["offset"], part["length"]):
                        source.seek(int(at))
                        head, size, digest = parse_record(zlib.decompress(source.read(int(length)), 31))
                        if head["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"{path} at {at}: payload and digest differ")
                        page = head["warc-record-id"].removeprefix(f"<{RECORD_ID}").rstrip(">").partition(":")[0]
                        refers_to = head.get("warc-refers-to", "").removeprefix(f"<{RECORD_ID}").removesuffix(">")
                        rows.append((None if page == "none" else int(page), head.get("warc-target-uri"), size, digest,
                                     head["warc-type"], int(refers_to) if refers_to else None))
            frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.mapInPandas(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """One row per page, read back from archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The payload is html in UTF-8, null as empty. Of rows with equal payloads of at least
    ``min_bytes`` the one with the smallest page_id is a response and the others revisit it; rows
    that repeat that page_id with the same payload are responses too, and payloads known only from
    rows without page_id are responses. A null or empty url leaves its header out (control
    characters, spaces and brackets in one are percent-encoded). Other columns are not read. An
    empty table gives no rows. Archives stay in ``folder``, by default a stage folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{stage_folder(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("hash", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # only what a payload shares with others decides, so the join carries payloads of one side
    first = (
        rows.filter(F.col("size") >= min_bytes).groupBy("hash")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first IS NOT NULL")
    )
    marked = rows.join(first.select("hash", "first"), "hash", "left").withColumn(
        "refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    )
    archives = durable(write_archives(marked, folder), "archives")
    # one file a task: a task that is lost repeats one archive
    files = archives.repartition(max(1, min(archives.count(), 10_000)), F.xxhash64("path"))
    index = durable(normalise_archives(files), "index")
    return read_records(index)
