"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blobs
from waymark.llm.files import create, open_read
from waymark.sources.warehouse import scratch, staged

READ_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 27
#: The profile of the format's standard for records whose payload an earlier record holds.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names a page without an id; those of other pages begin with urn:page: and so never equal it.
NO_ID = "urn:nopage"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page) -> str:
    return NO_ID if page is None else f"urn:page:{quote(str(page), safe='')}"


def page_of(uri: str) -> str | None:
    name = uri.strip("<>")
    return None if name == NO_ID else unquote(name.removeprefix("urn:page:"))


def _head(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode()


def record(page, url: str | None, payload: bytes, digest: str, refers_to: tuple | None, date: str) -> Iterator[bytes]:
    """The gzip member of one page: a response, or a revisit of the page in ``refers_to`` without the payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    body = b"" if refers_to else payload
    block = hashlib.sha1(http)
    block.update(body)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "about:blank")
    lines = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_uri(page)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(block.digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body))),
    ]
    if refers_to:
        lines[5:5] = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{record_uri(refers_to[0])}>")]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    yield squeeze.compress(b"WARC/1.1\r\n" + _head(lines) + b"\r\n" + http)
    for at in range(0, len(body), 1 << 20):
        yield squeeze.compress(body[at : at + (1 << 20)])
    yield squeeze.compress(b"\r\n\r\n") + squeeze.flush()


class Broken(ValueError):
    """A record that is cut short, badly framed, or not what its digests say."""


def members(source) -> Iterator[Iterator[bytes]]:
    """The plain bytes of each gzip member of a file, in small pieces; memory does not grow with file or member."""
    raw = source.read(READ_BYTES)
    while raw:
        left = [b""]

        def pieces(data=raw, left=left):
            expand = zlib.decompressobj(31)
            while True:
                out = expand.decompress(data, READ_BYTES)
                if out:
                    yield out
                if expand.eof:
                    left[0] = expand.unused_data or source.read(READ_BYTES)
                    return
                data = expand.unconsumed_tail or source.read(READ_BYTES)
                if not data and not out:
                    raise Broken("a gzip member ends early")

        member = pieces()
        yield member
        for _ in member:
            pass
        raw = left[0]


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


def _head_of(buffer: bytearray, pieces: Iterator[bytes], what: str) -> bytes:
    """Takes the bytes before the next empty line off the buffer, which is filled as needed."""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        more = next(pieces, None)
        if more is None:
            raise Broken(f"no end of the {what}")
        buffer += more
    head = bytes(buffer[:end])
    del buffer[: end + 4]
    return head


def read_record(pieces: Iterator[bytes]) -> dict:
    """One record's fields, its payload's length and digest, checked against its frame and digests as the bytes pass by."""
    buffer = bytearray()
    version, fields = _fields(_head_of(buffer, pieces, "record's head"))
    if not version.startswith("WARC/"):
        raise Broken(f"not a record: {version[:40]}")
    length = int(fields["content-length"])
    http_head = _head_of(buffer, pieces, "HTTP head")
    block = hashlib.sha1(http_head + b"\r\n\r\n")
    left = length - len(http_head) - 4
    payload, size = hashlib.sha1(), left
    while True:
        take = bytes(buffer[:left]) if len(buffer) > left else bytes(buffer)
        payload.update(take)
        block.update(take)
        left -= len(take)
        del buffer[: len(take)]
        if not left:
            break
        more = next(pieces, None)
        if more is None:
            raise Broken("the block is shorter than its content length")
        buffer += more
    for more in pieces:
        buffer += more
        if len(buffer) > 4:
            break
    if bytes(buffer) != b"\r\n\r\n":
        raise Broken("the block is longer than its content length")
    if base64.b32encode(block.digest()).decode() != fields["warc-block-digest"].removeprefix("sha1:"):
        raise Broken("the block differs from its digest")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        size = int(_fields(http_head)[1]["content-length"])
    elif base64.b32encode(payload.digest()).decode() != stated:
        raise Broken("the payload differs from its digest")
    return {
        "page": page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": stated, "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "url": fields["warc-target-uri"],
    }


def read_archive(source) -> Iterator[dict]:
    for member in members(source):
        yield read_record(member)


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0,
) -> DataFrame:
    """Writes every page to archives below ``folder``; returns their ``path`` and ``n_records``.

    Of pages with equal payloads of ``least_bytes`` or more the one with the smallest
    id is a response, the others revisit it; smaller payloads are all responses.
    Rows that repeat the smallest id are all responses. Null payloads are empty;
    a null id is never the smallest unless all are null, then all are responses.
    A task writes under names of its own and only files of finished tasks are listed.
    """
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("sha", F.sha2(F.col("payload").cast("binary"), 256)).withColumn(
        "sha", F.when(F.octet_length("payload") >= least_bytes, F.col("sha"))
    )
    firsts = rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    told = rows.where("sha is not null").join(firsts.select("sha", "first"), "sha", "left").select(
        "id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )
    if least_bytes > 0:  # small payloads are no key to meet on
        told = told.unionByName(rows.where("sha is null").select("id", "url", "payload", F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to")))

    def per_part(batches):
        out, paths, size = None, [], 0
        for batch in batches:
            columns = (batch.column("id").to_pylist(), batch.column("url").to_pylist(), blobs(batch.column("payload")), batch.column("refers_to").to_pylist())
            for page, url, payload, refers_to in zip(*columns):
                if out is None or size > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    paths.append([f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = create(paths[-1][0]), 0
                for piece in record(page, url, payload, base32_sha1(payload), None if refers_to is None else (refers_to,), date):
                    out.write(piece)
                    size += len(piece)
                paths[-1][1] += 1
        if out:
            out.close()
            names, counts = zip(*paths)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["path", "n_records"])

    return staged(told.mapInArrow(per_part, "path string, n_records bigint"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(``page``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``) of every record of the files in ``path``.

    Ids are strings. A broken record, or an archive with another number of records
    than ``n_records``, fails the read.
    """
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def per_file(batches):
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                held, n = [], 0
                with open_read(path) as source:
                    for found in read_archive(source):
                        held.append([found[k] for k in names])
                        n += 1
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held = []
                if n != expected:
                    raise Broken(f"{path}: {n} records, {expected} were written")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    schema = "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    return archives.repartition(max(1, archives.count())).mapInArrow(per_file, schema)


def _typed(column: str, kind: str) -> Column:
    return F.col(column).cast(kind)


def archived(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes ``pages`` to archives below the shared folder and reads them back, see ``write_archives`` and ``read_archives``."""
    kind = pages.schema[id_column].dataType.simpleString()
    files = write_archives(pages, scratch(pages.sparkSession, "warc"), id_column, url_column, payload_column)
    return read_archives(files).select(
        _typed("page", kind).alias(id_column), "payload_bytes", "payload_digest", "record_type", _typed("refers_to", kind).alias("refers_to")
    )
