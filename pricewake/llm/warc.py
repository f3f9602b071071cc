"""WARC archives: a writer of gzip members, and a reader that salvages what is intact.

The writer makes one gzip member per record and lets Spark's text writer put them down, so
files are committed as any Spark output is, on any store, and a task that runs twice leaves one
file. The text writer sets a separator after each value, a block of members; every member ends with
a zero byte (the top byte of a length below 16 MB, or that of an empty member added behind a longer
record), and that byte is the separator.

The reader checks every record: the member's checksum, the version line, the headers, the lengths,
and the payload digest. After a failed check it looks for the next valid member or version
line, goes on there, and logs the bytes in between as a quarantined gap. Plain archives are read alike.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.session import scratch_path

VERSION = b"WARC/1.1"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A record's date is no property of a page; a fixed one keeps archives the same when written again.
DATE = "2000-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"
CHUNK = 1 << 20
# Values of the text writer in a file; a value is many members.
BLOCKS = 8

_START = re.compile(rb"WARC/1\.[01]\r\n")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column, in expressions: five hex digits are four of base32."""
    hexed = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def record(
    key: str | None, uri: str | None, kind: str, digest: str, size: int, refers_to: str | None, payload: bytes
) -> bytes:
    """One record: HTTP headers and, in a response, the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    ).encode()
    block = http + payload if kind == RESPONSE else http
    lines = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(key)}",
        f"WARC-Date: {DATE}",
    ]
    if uri:
        lines.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == REVISIT:
        lines.append(f"WARC-Profile: {PROFILE}")
        lines.append(f"WARC-Refers-To: {_urn(refers_to)}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(key: str | None) -> str:
    return "<urn:page-without-id>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def member(content: bytes) -> bytes:
    """The content as gzip members of which the last byte is zero."""
    packed = _gzip(content)
    return packed if packed.endswith(b"\0") else packed + _gzip(b"")


def _gzip(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def with_digests(pages: DataFrame, id_col: str, uri_col: str, text_col: str) -> DataFrame:
    """(id, uri, payload, size, digest) of each page; a null text is an empty payload."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(uri_col).cast("string").alias("uri"),
        payload.alias("payload"),
    )
    return rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": payload_digest(F.col("payload"))})


def with_record_types(rows: DataFrame, largest: DataFrame) -> DataFrame:
    """Rows with ``type`` and ``refers_to``: of equal payloads the page with the largest id is the response."""
    joined = rows.join(
        largest, (F.col("digest") == F.col("same")) & (F.col("size") == F.col("same_size")), "left"
    )
    # Rows without an id are revisits of one that has; with no id in the group all are responses.
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return joined.drop("same", "same_size").withColumns(
        {
            "type": F.when(again, REVISIT).otherwise(RESPONSE),
            "refers_to": F.when(again, F.col("first")).cast("string"),
        }
    ).drop("first")


def _surely_revisits(ids: list, digests: list[str], sizes: list[int], least: int) -> list[bool]:
    """Which rows have a row of equal payload and larger id beside them in the batch."""
    top: dict[tuple[str, int], object] = {}
    keys = list(zip(digests, sizes, strict=True))
    for key, page in zip(keys, ids, strict=True):
        # What is equal to itself is no NaN.
        if page is not None and page == page and key[1] >= least and (key not in top or top[key] < page):
            top[key] = page
    return [key in top and (page is None or page < top[key]) for key, page in zip(keys, ids, strict=True)]


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    text_col: str = "html",
    least: int = 0,
    file_bytes: int = 64 << 20,
) -> None:
    """Write one record per page into gzip archives below ``path``.

    A file is closed at ``file_bytes``, in ``BLOCKS`` parts that each end with a whole record, so it is larger by at
    most ``BLOCKS`` records: long pages make more files, not larger ones. A null page text is an empty payload. A null id is written as one.
    Pages equal in id and payload are all responses if theirs is the largest id. Other columns are not read. An
    empty table writes no records. A very long page is one record, held whole by a task.

    Payloads are packed before the shuffle that finds the revisits, and those whose larger twin stands in the same
    batch stay behind.
    """
    rows = with_digests(pages, id_col, uri_col, text_col)
    largest = (
        rows.filter(F.col("size") >= least)
        .groupBy(F.col("digest").alias("same"), F.col("size").alias("same_size"))
        .agg(F.max("id").alias("first"))
    )
    names = ["id", "key", "uri", "size", "digest", "packed"]
    shaped = rows.withColumn("key", F.col("id").cast("string")).select(*names[:-1], "payload")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            spare = _surely_revisits(*(whole.column(i).to_pylist() for i in (0, 4, 3)), least)
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                packed = [
                    None
                    if skip
                    else member(record(r["key"], r["uri"], RESPONSE, r["digest"], r["size"], None, r["payload"]))
                    for r, skip in zip(batch.to_pylist(), spare[start:], strict=False)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(packed, pa.binary())], names=names
                )

    kind = rows.schema["id"].dataType.simpleString()
    members = shaped.mapInArrow(pack, f"id {kind}, key string, uri string, size long, digest string, packed binary")
    typed = with_record_types(members, largest)
    block = max(1, file_bytes // BLOCKS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    again = r["type"] == REVISIT
                    part = (
                        member(record(r["key"], r["uri"], REVISIT, r["digest"], r["size"], r["refers_to"], b""))
                        if again
                        else r["packed"]
                    )
                    held.append(part)
                    size += len(part)
                    if size >= block:
                        yield _block(held)
                        held, size = [], 0
        if held:
            yield _block(held)

    values = typed.mapInArrow(gather, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = values.write.option("lineSep", "\0").option("compression", "none")
    writer.option("maxRecordsPerFile", BLOCKS).text(path)


def _block(members: list[bytes]) -> pa.RecordBatch:
    """Members as one value, less the last byte, which the text writer sets."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])


class Record:
    """A record that passed its checks."""

    def __init__(self, offset: int, headers: dict[str, str], block: bytes):
        self.offset, self.headers, self.block = offset, headers, block
        head, _, self.payload = block.partition(b"\r\n\r\n")
        self.http = _headers(head.split(b"\r\n")[1:]) or {}


def _headers(lines: list[bytes]) -> dict[str, str] | None:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            return None
        found[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return found


def parse(content: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at a place, or what is wrong with it."""
    version = _START.match(content, at)
    if not version:
        return "no version line"
    stop = content.find(b"\r\n\r\n", version.end())
    if stop < 0:
        return "headers do not end"
    headers = _headers(content[version.end() : stop].split(b"\r\n"))
    if headers is None or not {"warc-type", "warc-record-id", "content-length"} <= set(headers):
        return "bad headers"
    size = headers["content-length"]
    if not size.isascii() or not size.isdigit():
        return "bad length"
    start, end = stop + 4, stop + 4 + int(size)
    if content[end : end + 4] != b"\r\n\r\n":
        return "block has another length"
    block = content[start:end]
    wanted = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == RESPONSE and wanted.startswith("sha1:"):
        payload = block.partition(b"\r\n\r\n")[2]
        if digest_of(payload) != wanted[5:]:
            return "payload has another digest"
    return headers, block, end + 4


def _member_at(data: bytes, at: int) -> tuple[bytes, int] | str:
    """Content and end of the gzip member at a place, or what is wrong with it."""
    unpack, parts, place, size = zlib.decompressobj(31), [], at, 1 << 12
    try:
        while not unpack.eof:
            piece = data[place : place + size]
            if not piece:
                return "member is cut off"
            parts.append(unpack.decompress(piece))
            place, size = place + len(piece), min(2 * size, CHUNK)
    except zlib.error:
        return "member fails its checks"
    return b"".join(parts), place - len(unpack.unused_data)


def _decodable(data: bytes, at: int) -> bytes:
    """What can be decoded of a damaged gzip member, in small steps so that little before the damage is lost."""
    unpack, parts = zlib.decompressobj(31), []
    try:
        while not unpack.eof and at < len(data):
            parts.append(unpack.decompress(data[at : at + 64]))
            at += 64
    except zlib.error:
        pass
    return b"".join(parts)


def _inside(content: bytes) -> Iterator[tuple[str, int, int, tuple | str]]:
    """(kind, start, stop, parsed or reason) of the records in a decoded member and the gaps between them."""
    at, gap, reason = 0, None, ""
    while at < len(content):
        found = parse(content, at)
        if isinstance(found, str):
            if gap is None:
                gap, reason = at, found
            later = _START.search(content, at + 1)
            at = later.start() if later else len(content)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, found[2], found
        at = found[2]
    if gap is not None:
        yield "gap", gap, len(content), reason


def _proved(parsed: tuple) -> bool:
    """Whether the record's own digest vouches for it, as its member's checksum does not."""
    headers = parsed[0]
    return headers["warc-type"] == RESPONSE and headers.get("warc-payload-digest", "").startswith("sha1:")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """(kind, first byte, end byte, record or reason) over a whole archive, in order.

    ``record`` entries hold a ``Record``; ``gap`` entries are the quarantined bytes between
    records, with the reason of the first failed check. Together they cover all bytes but empty members.

    A member with several records gives them one after the other; the first entry has the member's bytes, later ones
    stand at its end, and a gap inside says in its reason which decoded bytes it quarantines. Of a damaged member the
    records in front of the damage are given if their own digest proves them; all its bytes are a gap all the same.
    """
    at, gap, reason = 0, None, ""
    places = {"member": -1, "version": -1}  # the next place of each kind that is not behind

    def next_start(after: int) -> int:
        if places["member"] < after:
            places["member"] = found if (found := data.find(MEMBER, after)) >= 0 else len(data)
        if places["version"] < after:
            places["version"] = found.start() if (found := _START.search(data, after)) else len(data)
        return min(places.values())

    while at < len(data):
        content, end = b"", at
        if data.startswith(MEMBER, at):
            opened = _member_at(data, at)
            if isinstance(opened, str):
                found: tuple | str | None = opened
                front = _decodable(data, at)
                for kind, _, stop, what in _inside(front):
                    # The last one may be what the damage has left of it.
                    if kind == "record" and stop < len(front) and _proved(what):
                        place = at if gap is None else gap
                        yield "record", place, place, Record(at, what[0], what[1])
            else:
                content, end = opened
                found = parse(content, 0) if content else None
                whole = isinstance(found, tuple) and found[2] == len(content)
                parts = [] if whole or not content else list(_inside(content))
                if any(part[0] == "record" for part in parts):
                    if gap is not None:
                        yield "gap", gap, at, reason
                        gap = None
                    first = at
                    for kind, start, stop, what in parts:
                        if kind == "gap":
                            yield "gap", first, end, f"{what}, bytes {start} to {stop} of the member"
                        else:
                            yield "record", first, end, Record(at, what[0], what[1])
                        first = end
                    at = end
                    continue
        else:
            found = parse(data, at)
            end = found[2] if isinstance(found, tuple) else at
        if isinstance(found, str):
            if gap is None:
                gap, reason = at, found
            at = next_start(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        if found is not None:
            yield "record", at, end, Record(at, found[0], found[1])
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def read_archives(spark, path: str) -> DataFrame:
    """All records and gaps below ``path``: ``archive``, ``kind``, ``first_byte``, ``end_byte``,
    ``reason``, ``type``, ``record_id``, ``uri``, ``digest``, ``refers_to``, ``payload_bytes``, ``payload``.

    A record that was overwritten, cut off or garbled is never returned; its bytes are one gap row and
    later records follow. ``payload_bytes`` is that of the full payload, in a revisit as its
    HTTP headers say. An archive is read whole by one task; the writer bounds its size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 6 + [pa.int64(), pa.binary()]
    names = (
        "archive kind first_byte end_byte reason type record_id uri digest refers_to payload_bytes payload"
    ).split()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                name, data = batch.column(0)[number].as_py(), batch.column(1)[number].as_py() or b""
                held, size = [], 0
                for kind, first, end, what in salvage(data):
                    row = [name, kind, first, end] + [None] * 8
                    if kind == "gap":
                        row[4] = what
                    else:
                        h = what.headers
                        length = what.http.get("content-length", "")
                        full = len(what.payload) if h["warc-type"] == RESPONSE else int(length) if length.isdigit() else None
                        row[5:] = [
                            h["warc-type"],
                            h["warc-record-id"],
                            h.get("warc-target-uri"),
                            h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            h.get("warc-refers-to"),
                            full,
                            what.payload if h["warc-type"] == RESPONSE else None,
                        ]
                        size += len(what.payload)
                    held.append(row)
                    if size > CHUNK:
                        yield _batch(held, kinds, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, kinds, names)

    schema = (
        "archive string, kind string, first_byte long, end_byte long, reason string, type string, "
        "record_id string, uri string, digest string, refers_to string, payload_bytes long, payload binary"
    )
    return files.mapInArrow(rows, schema)


def _batch(rows: list[list], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def id_of(column: Column) -> Column:
    """The page id inside a record id, null where the page had none."""
    return F.url_decode(F.nullif(F.regexp_extract(column, r"^<urn:page:(.*)>$", 1), F.lit("")))


def archive_round_trip(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", least: int = 0
) -> DataFrame:
    """Write the pages to fresh archives below ``spark.checkpoint.dir`` and read those back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, uri_col, text_col, least)
    return read_archives(pages.sparkSession, path)
