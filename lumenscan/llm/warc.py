"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.llm.tables import by_bytes
from lumenscan.session import work_dir

VERSION, GZIP_MAGIC = b"WARC/1.1", b"\x1f\x8b\x08"
#: An empty gzip member. It stands between records, where the line break of a text file would.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
_URN = "urn:page:"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")

RECORDS = (
    "file string, offset bigint, length bigint, kind string, warc_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_length bigint, payload binary, reason string"
)
_RECORDS = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("warc_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_length", pa.int64()), ("payload", pa.binary()), ("reason", pa.string()),
])


def record(kind: str, record_id: str | None, uri: str | None, refers_to: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record; a header whose value is null is left out."""
    clean = re.sub(r"[\r\n]+", " ", uri) if uri is not None else None
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id and f"<{record_id}>"), ("WARC-Target-URI", clean),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("X-Payload-Length", size),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload)),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers if v is not None)
    return b"".join((VERSION, b"\r\n", lines, b"\r\n", payload, b"\r\n\r\n"))


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    """What fails a check at one place of an archive."""


def same_sha1(claimed: str, block: bytes) -> bool:
    """Whether a digest header agrees with ``block``: SHA-1 in hex or Base32 of either case; other forms are not judged."""
    name, colon, value = claimed.partition(":")
    value = value.strip().lower()
    if not colon or name.strip().lower() not in ("sha1", "sha-1"):
        return True
    digest = hashlib.sha1(block).digest()
    if re.fullmatch("[0-9a-f]{40}", value):
        return value == digest.hex()
    if re.fullmatch("[a-z2-7]{32}", value):
        return value == base64.b32encode(digest).decode().lower()
    return True


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one begins; raises Damaged."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header has no colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (length := headers.get("content-length", "")).isdigit():
        raise Damaged("no length")
    begin, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where it should")
    block = data[begin:stop]
    if not same_sha1(headers.get("warc-block-digest", ""), block):
        raise Damaged("the block's digest differs")
    return headers, block, stop + 4


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """The records of an archive and the gaps between them, in file order: offset, length, headers, block, reason.

    A gzip archive is read member by member, a plain one record by record. After a failed check
    the search goes on at the next gzip magic or version line; bytes passed over up to the next
    sound record are one gap, which has a reason and no headers. Every byte is in one record, one
    gap or one empty member; but records of one member share its place, and where one of them is
    damaged a gap has that place too. Records before and after damage in a member are kept, if the
    member is whole, so that its content can be unpacked.
    """
    at, gap, reason = 0, None, ""
    packed = data[:3] == GZIP_MAGIC or (GZIP_MAGIC in data and not _VERSION_LINE.search(data))
    while at < len(data):
        bad = None
        try:
            if packed:
                if data[at : at + 3] != GZIP_MAGIC:
                    raise Damaged("no gzip member")
                inner, end = _read_member(data, at)
                found, bad = _records_of(inner)
                if bad and not found:
                    raise Damaged(bad)
            else:
                headers, block, end = parse_record(data, at)
                found = [(headers, block)]
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            if packed:
                following = data.find(GZIP_MAGIC, at + 1)
            else:
                line = _VERSION_LINE.search(data, at + 1)
                following = line.start() if line else -1
            at = following if following >= 0 else len(data)
            continue
        if gap is not None and found:
            yield gap, at - gap, None, b"", reason
            gap = None
        if gap is None:
            yield from ((at, end - at, headers, block, None) for headers, block in found)
        if bad:
            yield at, end - at, None, b"", bad
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", reason


def _records_of(inner: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The sound records of an unpacked member, and the reason of its first failed check."""
    found, place, bad = [], 0, None
    while place < len(inner):
        try:
            headers, block, place = parse_record(inner, place)
            found.append((headers, block))
        except Damaged as error:
            bad = bad or str(error)
            line = _VERSION_LINE.search(inner, place + 1)
            place = line.start() if line else len(inner)
    return found, bad


#: Compressed bytes given to the unpacker at a time.
_STEP = 1 << 16


def _read_member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, checked by its CRC, and where it ends."""
    unpacker, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and place < len(data):
            out.append(unpacker.decompress(data[place : place + _STEP]))
            place += _STEP
    except zlib.error as error:
        raise Damaged(f"gzip: {error}") from None
    if not unpacker.eof:
        raise Damaged("gzip: the member is cut off")
    return b"".join(out), min(place, len(data)) - len(unpacker.unused_data)


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All records and gaps of the archives below ``path`` whose names fit ``pattern``; gzip or plain, sound or damaged.

    A row is a record (kind ``record``) or a quarantined run of bytes (kind ``gap``, with the
    reason of the first failed check), with its place in the file. One task reads a file at a
    time, so archives should be of the usual size (1 GB at most). An empty file gives no row.
    Folders below ``path`` are read too; names that begin with a dot or an underscore are Spark's own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for offset, length, headers, block, reason in salvage(data.as_py()):
                    get = (headers or {}).get
                    claimed, told = get("warc-payload-digest"), get("x-payload-length", "")
                    rows.append((
                        name, offset, length, "gap" if headers is None else "record", get("warc-type"),
                        _bare(get("warc-record-id")), get("warc-target-uri"), _bare(get("warc-refers-to")),
                        claimed and claimed.removeprefix("sha1:"), int(told) if told.isdigit() else None, block, reason,
                    ))
                    size += len(block)
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, RECORDS)


def _bare(uri: str | None) -> str | None:
    return uri and uri.strip("<>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_RECORDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS)], schema=_RECORDS)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the page whose record holds the payload, or null).

    Only digests are grouped, with sums on the map side, so many copies of one payload are no
    large group; the payloads themselves move once, by page_id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.filter(F.length("payload") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = keys.join(first, "digest").filter("not page_id <=> refers_to").distinct()
    revisits = revisits.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    on = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    return rows.join(revisits, on, "left").select("page_id", "url", "payload", "digest", "refers_to")


# Payload that a row of the sink holds, and rows of an archive: 128 MB of payload before it is compressed, or a
# single payload that is longer than a row's share.
_ROW_BYTES, ROWS_PER_ARCHIVE = 4 << 20, 32


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """A gzip record per row of ``pages`` in ``path``, in archives of at most ROWS_PER_ARCHIVE times 4 MB of payload.

    A task begins a new archive when one is full, so their size does not depend on the number of tasks.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is a
    response and the others revisit it. Spark's own text sink writes the bytes, so ``path`` may
    be in any store; an empty gzip member stands between records.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload", _ROW_BYTES):
            out = []
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                again = refers is not None
                urn = None if page is None else f"{_URN}{page}"
                body = b"" if again else payload
                kind = "revisit" if again else "response"
                out.append(member(record(kind, urn, url, f"{_URN}{refers}" if again else None, digest, len(payload), body)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([EMPTY_MEMBER.join(out)], pa.binary())], names=["value"])

    rows = with_revisits(pages, least).mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    sink = rows.write.option("maxRecordsPerFile", ROWS_PER_ARCHIVE)
    sink.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` as archives, read them back and give one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url. Length and digest of a
    response are taken from the payload that was read; a revisit has none and carries both in its
    headers. A null html is an empty payload. A null page_id is kept (its record has no id) and is
    the smallest of its group; if all of a group are null, all are responses. Rows with the same
    page_id and payload are alike, so all or none of them are responses. An empty table gives an
    empty one; other columns are ignored. A damaged run of bytes in the archives stops the job, as
    its pages would be missing.
    """
    spark = pages.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return whole_records(read_archives(spark, path, "part-*"))


def whole_records(found: DataFrame) -> DataFrame:
    """The pages of ``read_archives`` of archives written here; an error if there is a gap among them."""
    lost = F.raise_error(F.concat(F.lit("damaged archive "), "file", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "reason"))
    found = found.filter(F.when(F.col("kind") == "record", F.lit(True)).otherwise(lost.cast("boolean")))
    number = lambda c: F.substring_index(c, ":", -1).cast("bigint")
    response = F.col("warc_type") == "response"
    return found.select(
        number("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
