"""Operator 4: WARC archives, written through Spark's committer and read back sequentially.

Every record is a gzip member of its own. Payloads that occur again are ``revisit`` records: only their HTTP header
is stored, and the page that holds the payload is named. The reader goes through an archive member by member,
decompresses piece by piece, takes as many bytes as Content-Length says and verifies what digests there are. It reads
archives of other writers as well: versions 1.0 and 1.1, all types of records, digests in hexadecimal or base32 or
none, header names in any case, and archives that are not compressed.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import new_folder
from millrace.llm.batches import map_batches
from millrace.llm.registry import query

REVISIT_BYTES = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
VERSIONS = ("WARC/1.0", "WARC/1.1")
DIGESTS = ("md5", "sha1", "sha256", "sha512")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAME = "urn:millrace:page:"
END_NAME = f"<{RECORD_NAME}end>"
CAPTURED = "2024-01-01T00:00:00Z"
CHUNK_BYTES = 4 << 20
CHUNKS_PER_FILE = 8
READ_BYTES = 1 << 16


@dataclass(frozen=True)
class Record:
    """A record as read, header names in lower case. ``payload`` is what the block holds: without the HTTP header where
    there is one, None for revisits, whose length and digest are those of the full payload as far as told."""

    headers: dict[str, str]
    block: bytes
    payload_bytes: int | None
    payload: bytes | None

    @property
    def type(self) -> str:
        return self.headers["warc-type"].lower()


def page_name(page_id: int | None) -> str:
    return f"<{RECORD_NAME}{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The page a record is named after; records of other writers have none."""
    number = (name or "").strip("<>").removeprefix(RECORD_NAME)
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, compressed."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    compressor = zlib.compressobj(6, zlib.DEFLATED, 31)
    return compressor.compress("\r\n".join(lines).encode()) + compressor.compress(block) + compressor.compress(b"\r\n\r\n") + compressor.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_name(page_id)), ("WARC-Date", CAPTURED)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_name(refers_to))]
    headers += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(headers, block)


def closing_member() -> bytes:
    """A small record; its last byte, the highest of its length, is zero."""
    return member([("WARC-Type", "metadata"), ("WARC-Record-ID", END_NAME), ("WARC-Date", CAPTURED)], b"")


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` (``page_id, url, html``) below ``folder``; null html is an empty payload.

    Of rows with equal payloads of at least ``revisit_bytes``, those with the largest id are responses, the others
    revisits; a null id is smaller than any. Only ids and digests are grouped. The files are made by Spark's text
    sink, which takes any bytes and commits whole tasks, on every file system Spark can write to: a chunk ends in a
    zero byte, which is cut off and put back as the line separator, so a file is nothing but members.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")}
    )
    origins = (
        rows.where(F.col("size") >= revisit_bytes)
        .groupBy(F.col("digest").alias("same"), F.col("size").alias("same_size"))
        .agg(F.max("page_id").alias("origin"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    equal = (F.col("digest") == F.col("same")) & (F.col("size") == F.col("same_size"))
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("origin")), F.col("origin"))
    named = rows.join(origins, equal, "left").withColumn("refers_to", refers_to)
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")

    def start():
        def each(batch: pa.RecordBatch):
            held: list[bytes] = []
            size = 0
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(page_member(*row))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield (chunk(held),)
                    held, size = [], 0
            if held:
                yield (chunk(held),)

        return each

    written = map_batches(
        named, [F.col("page_id"), F.col("url"), kept, F.col("digest"), F.col("size"), F.col("refers_to")], "members binary", start
    )
    lines = written.select(F.col("members").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(folder)


def chunk(members: list[bytes]) -> bytes:
    """Members one after the other, without the last byte, which is zero."""
    if members[-1][-1]:
        members = [*members, closing_member()]
    return b"".join(members)[:-1]


def read_members(archive: bytes | memoryview) -> Iterator[bytes]:
    """The decompressed members of an archive, in order; damage is an error. One that isn't compressed is cut by its records."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if view[at : at + 5] == b"WARC/":
            end = _record_end(view, at)
            yield bytes(view[at:end])
            at = end
            continue
        stream, parts, begin = zlib.decompressobj(31), [], at
        while not stream.eof:
            if at >= len(view):
                raise ValueError(f"the archive ends within the member at byte {begin}")
            fed = view[at : at + READ_BYTES]
            parts.append(stream.decompress(fed))
            at += len(fed) - len(stream.unused_data)
        yield b"".join(parts)


def _record_end(view: memoryview, at: int) -> int:
    """Where the record at a place of an archive that isn't compressed ends, by its Content-Length."""
    size = READ_BYTES
    while b"\r\n\r\n" not in (head := bytes(view[at : at + size])) and at + size < len(view):
        size *= 2
    head, found, _ = head.partition(b"\r\n\r\n")
    length = _headers(head)[1].get("content-length", "")
    if not found or not length.isdigit():
        raise ValueError(f"the archive ends within the record at byte {at}")
    return min(len(view), at + len(head) + 4 + int(length) + 4)


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and named fields by their name in lower case; folded lines go on with the one before."""
    version, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    fields = (line.partition(":") for line in lines if line)
    return version, {name.strip().lower(): value.strip() for name, _, value in reversed(list(fields))}


def verified(data: bytes, digest: str | None) -> bool:
    """Whether data has the digest, ``algorithm:value`` in hexadecimal or base32. Unknown algorithms, and none, tell nothing."""
    if digest is None:
        return True
    name, _, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if name not in DIGESTS:
        return True
    found = hashlib.new(name, data, usedforsecurity=False).digest()
    if value.lower() == found.hex():
        return True
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)) == found
    except binascii.Error:
        return False


def payload_hex(digest: str | None) -> str | None:
    """A digest's value in lower-case hexadecimal, whichever way it is written."""
    name, _, value = (digest or "").partition(":")
    size = hashlib.new(found).digest_size if (found := name.lower().replace("-", "")) in DIGESTS else 0
    if size and len(value) == -(-size * 8 // 5):
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    return value.lower() or None


def read_record(content: bytes) -> Record:
    """One record, verified: framing, block digest, and length and digest of a payload that is all there."""
    head, found, rest = content.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if not found or version.strip() not in VERSIONS:
        raise ValueError("a member does not begin with a record")
    name = headers.get("warc-record-id", "a record without id")
    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        raise ValueError(f"{name}: no type or Content-Length")
    length = int(headers["content-length"])
    block, after = rest[:length], rest[length:]
    if len(block) != length or after != b"\r\n\r\n":
        raise ValueError(f"{name}: Content-Length and the record differ")
    if not verified(block, headers.get("warc-block-digest")):
        raise ValueError(f"{name}: the block's digest differs")
    size, payload = length, block
    if headers.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        size = int(told[1]) if told else len(payload)
        # A transfer coding changes what Content-Length counts; the payload digest is then of what was stored.
        if re.search(rb"(?im)^transfer-encoding:", http):
            size = len(payload)
    if headers["warc-type"].lower() == "revisit":
        return Record(headers, block, size if payload != block else None, None)
    whole = "warc-truncated" not in headers and "warc-segment-number" not in headers
    if whole and (len(payload) != size or not verified(payload, headers.get("warc-payload-digest"))):
        raise ValueError(f"{name}: the payload's length or digest differs")
    return Record(headers, block, len(payload), payload)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, types: tuple[str, ...] | None = ("response", "revisit")) -> DataFrame:
    """Records of all archives below ``folder``: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id`` and, if asked for, ``payload`` (null for revisits). Anything that does not verify ends the job with an error.

    ``types`` are the record types wanted, by default those that hold pages; None is all. ``page_id`` and ``refers_to``
    are null where an archive of another writer names its records otherwise. Digests come in lower-case hexadecimal, null
    where a record has none. An archive is a row for Spark, so it must fit an executor's memory (and 2 GB); of what is
    decompressed one record is held at a time.
    """
    archives = spark.read.format("binaryFile").load(folder)

    def start():
        def each(batch: pa.RecordBatch):
            for content in batch.column(0):
                for record in map(read_record, read_members(memoryview(content.as_buffer()))):
                    headers = record.headers
                    if headers.get("warc-record-id") == END_NAME or (types is not None and record.type not in types):
                        continue
                    row = (
                        page_of(headers.get("warc-record-id")),
                        headers.get("warc-target-uri"),
                        record.payload_bytes,
                        payload_hex(headers.get("warc-payload-digest")),
                        record.type,
                        page_of(headers.get("warc-refers-to")),
                        headers.get("warc-record-id"),
                    )
                    yield (*row, record.payload) if payloads else row

        return each

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"
    return map_batches(archives, [F.col("content")], schema + ", payload binary" * payloads, start)


OP4_SQL = f"""
  select page_id, size payload_bytes, digest payload_digest,
         case when revisit then 'revisit' else 'response' end record_type, case when revisit then largest end refers_to
  from (select page_id, size, digest, largest,
               size >= {REVISIT_BYTES} and largest is not null and page_id is distinct from largest revisit
        from (select page_id, strlen(payload)::bigint size, sha1(payload) digest,
                     max(page_id) over (partition by payload) largest
              from (select page_id, coalesce(html, '') payload from pages)))"""


@query("op4_warc", OP4_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back."""
    folder = new_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, payloads=False).drop("url", "record_id")
