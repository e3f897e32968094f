"""WARC archives: written with revisit records for repeated payloads, read by byte ranges.

*Writing.* Pages become response records, each a gzip member of its own. Of equal payloads one row stays a
response; which one is known from an aggregate by digest (a maximum, summed up in each task before the
shuffle), and a hot payload's rows are spread over tasks when they learn it. The members of a task are put
together to pieces of a few megabytes, which the plain text writer stores byte by byte on any file system,
with its commit protocol; the writer's line end is a whole ``warcinfo`` member, so the files are valid archives.

*Reading.* Files are cut into byte ranges, whatever their records. A task searches its range for gzip's
magic number, and takes a place for the beginning of a record only if a member can be decoded there that
begins with a WARC header and ends where the header says. It owns the records that begin in its range and
reads on beyond the range for the last of them. A member that lies inside another record (an archive as
payload, stored as it is) is recognised by a scan over the ranges' ends and left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import dealt, file_system, spread_join, stored

#: Bytes of members that are written as one row of the text writer, and of a range of the reader.
PIECE, RANGE = 1 << 22, 1 << 24
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Bytes that are read, decoded or searched at a time.
STEP = 1 << 18
SALTS = 32
MAGIC = b"\x1f\x8b\x08"
#: The longest header that the reader looks for the end of.
HEADER = 1 << 16
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MEMBERS = "row bigint, page_id bigint, url string, key binary, digest string, n_bytes bigint, member binary"
_RECORDS = (
    "file string, offset bigint, end bigint, record_type string, record_id string, refers_to_id string, "
    "target_uri string, payload_digest string, payload_bytes bigint, payload binary, intact boolean"
)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member without a time stamp, so that equal records are equal bytes."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def record_id(page_id: int | None, row: int) -> str:
    """Unique for each row, also where page_ids repeat or are null."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_id_of(column: str) -> Column:
    """The page_id in a record_id; null where that is null or has none."""
    return F.regexp_extract(column, r"^<urn:page:(-?[0-9]*):", 1).try_cast("bigint")


def _headers(kind: str, own_id: str, url: str | None, digest: str, n_bytes: int) -> list[tuple[str, str]]:
    # line ends and other control characters cannot stand in a header
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "urn:unknown")
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(n_bytes)),  # a revisit holds no payload; this tells how long it is
        ("Content-Type", "application/http; msgtype=response"),
    ]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(row, page_id, url, key, digest, n_bytes, member): each page as a response record. ``row`` is unique
    as soon as the result is stored; ``key`` is a 256-bit digest by which payloads are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            urls, ids = batch.column("url").to_pylist(), batch.column("page_id").to_pylist()
            for page_id, url, body in zip(ids, urls, batch.column("payload").cast(pa.binary())):
                body = body.as_buffer().to_pybytes() if body.is_valid else b""
                digest = base32_sha1(body)
                record = _member(
                    _headers("response", record_id(page_id, row), url, digest, len(body)), _http(len(body)) + body
                )
                out.append((row, page_id, url, hashlib.sha256(body).digest(), digest, len(body), record))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[c.split()[0] for c in _MEMBERS.split(", ")]
            )

    columns = [F.col("page_id").cast("bigint"), F.col("url"), F.col(f"`{payload}`").alias("payload")]
    return pages.select(*columns).mapInArrow(run, _MEMBERS)


#: Stands behind each piece: describes the records that follow it in the file.
INFO = _member(
    [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", "<urn:marginalia:warcinfo>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/warc-fields"),
    ],
    b"format: WARC File Format 1.1\r\n",
)


def write_archives(pages: DataFrame, folder: str, payload: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, ``payload``) to archives in ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is a
    response and the others revisit it (null ids are smaller than all; of rows that repeat the largest id one is
    the response). Smaller payloads are all responses. A null payload is empty, a null url ``urn:unknown``;
    blanks and control characters of urls are percent-encoded. Other columns play no part. No rows give
    archives without records, or none.
    """
    made = stored(members(pages, payload), "warc-members")
    row = F.struct("page_id", "row")  # a null orders before all numbers
    tops = made.where(F.col("n_bytes") >= least_bytes).groupBy("key").agg(F.max(row).alias("top"), F.count("*").alias("n"))
    tops = tops.where("n > 1").select("key", "top")
    told = spread_join(made, tops, ["key"], SALTS, F.col("row"))
    first = F.col("top").isNull() | (F.col("top.row") == F.col("row"))
    told = told.select(
        "row", "page_id", "url", "digest", "n_bytes",
        F.col("top.row").alias("top_row"), F.col("top.page_id").alias("top_id"),
        F.when(first, F.col("member")).alias("member"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size = [], 0
        for batch in batches:
            for record, r in zip(batch.column("member"), batch.drop_columns(["member"]).to_pylist()):
                if record.is_valid:
                    record = record.as_buffer().to_pybytes()
                else:
                    own = _headers("revisit", record_id(r["page_id"], r["row"]), r["url"], r["digest"], r["n_bytes"])
                    first_id = record_id(r["top_id"], r["top_row"])
                    record = _member([*own, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", first_id)], _http(r["n_bytes"]))
                if piece and size + len(record) > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(piece)], pa.binary())], names=["piece"])
                    piece, size = [], 0
                piece.append(record)
                size += len(record)
        if piece:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(piece)], pa.binary())], names=["piece"])

    pieces = told.mapInArrow(run, "piece binary").select(F.col("piece").cast("string").alias("value"))
    pieces.write.option("lineSep", INFO.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


class _Window:
    """Bytes of a file from any place on, read forwards a step at a time."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at`` on; fewer only at the file's end."""
        stop = min(at + n, self.size)
        if at < self.start or stop > self.start + len(self.data):
            self.start, self.data = at, self.source.read_at(max(min(at + max(n, 4 * STEP), self.size) - at, 0), at)
        return self.data[at - self.start : stop - self.start]


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields of a WARC header (names in lower case) and its length; None if it is none."""
    if not data.startswith(b"WARC/1."):
        return None
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in data[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields:
        return None
    return fields, stop + 4


def decode_member(source: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, end) of the record whose gzip member begins at ``at``; None if none does.

    What does not begin with a WARC header is given up after its first bytes. Gzip's own checksum
    and length have to be right, and the record as long as its header says.
    """
    inflate, out, head, pos, step = zlib.decompressobj(31), bytearray(), None, at, 1 << 12
    try:
        while not inflate.eof:
            data = source.get(pos, step)
            step = min(2 * step, STEP)
            if not data:
                return None
            out += inflate.decompress(data)
            pos += len(data)
            if head is None and (b"\r\n\r\n" in out[:HEADER] or len(out) >= HEADER or inflate.eof):
                head = parse_header(bytes(out[:HEADER]))
                if head is None:
                    return None
            elif head is None and not b"WARC/1.".startswith(bytes(out[:7])):
                return None
    except zlib.error:
        return None
    fields, begin = head
    block_end = begin + int(fields["content-length"])
    if bytes(out[block_end:]) != b"\r\n\r\n":
        return None
    return fields, bytes(out[begin:block_end]), pos - len(inflate.unused_data)


def records_of_range(source: _Window, start: int, end: int) -> Iterator[tuple]:
    """(offset, end, fields, block) of the records that begin in [start, end)."""
    at, step = start, 1 << 12
    while at < end:
        data = source.get(at, min(step, end - at) + len(MAGIC) - 1)
        step = min(2 * step, STEP)
        found = data.find(MAGIC)
        if found < 0:
            at += max(len(data) - len(MAGIC) + 1, 1)
            continue
        at += found
        if at >= end:
            return
        record = decode_member(source, at)
        if record is None:
            at += 1
        else:
            fields, block, behind = record
            yield at, behind, fields, block
            at, step = behind, 1 << 12  # the next record most likely begins right here


def _digest_of(fields: dict[str, str]) -> str | None:
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    return value.upper() if name.lower() == "sha1" else None


def _row(file: str, record: tuple) -> tuple:
    offset, end, fields, block = record
    kind = fields["warc-type"]
    payload = None
    if kind == "response" and fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind != "revisit":
        payload = block
    stated, length = _digest_of(fields), fields.get("x-payload-length", "")
    digest = stated if payload is None else base32_sha1(payload)
    n_bytes = len(payload) if payload is not None else int(length) if length.isdigit() else None
    return (
        file, offset, end, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"),
        fields.get("warc-target-uri"), digest, n_bytes, payload, stated is None or digest == stated,
    )


def read_archives(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """One row per record of the archives in ``folder``: where it lies (file, offset, end), record_type, record_id,
    refers_to_id, target_uri, payload_digest (base32 SHA-1), payload_bytes, payload, intact.

    Digest and size are those of the payload as it was read; ``intact`` tells whether the digest is the stated one.
    A revisit's payload is null, and its digest and size (null unless ``X-Payload-Length`` is stated) are the
    header's. Records of other kinds have their block as payload. What is no valid record is passed over. An
    empty folder gives no rows. A record may be longer than ``size`` and span any number of ranges.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # no content is read
    ranges = files.where("length > 0").select(
        F.col("path").alias("file"),
        "length",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("range"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.bool_()]
        names = [c.split()[0] for c in _RECORDS.split(", ")]

        def some(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                system, path = file_system(r["file"])
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    window, start = _Window(source, r["length"]), r["range"] * size
                    for record in records_of_range(window, start, min(start + size, r["length"])):
                        rows.append(_row(r["file"], record))
                        held += len(record[3]) + 512
                        if held > PIECE:
                            yield some(rows)
                            rows, held = [], 0
                if rows:
                    yield some(rows)

    return dealt(ranges).mapInArrow(run, _RECORDS)


def outermost(records: DataFrame, size: int = RANGE) -> DataFrame:
    """Of ``read_archives`` rows (stored) those that do not begin inside another record.

    The ranges' furthest ends are a few numbers a file, and their running maximum tells each range how far
    the records before it reach.
    """
    at = F.floor(F.col("offset") / size)
    ends = records.groupBy("file", at.alias("range")).agg(F.max("end").alias("reach"))
    before = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("file", "range", F.max("reach").over(before).alias("reach")).where(F.col("reach") > F.col("range") * size)
    # few ranges begin inside a record of another: only those have to be looked at
    inside = (records["file"] == ends["file"]) & (at == ends["range"]) & (F.col("offset") < F.col("reach"))
    return records.join(ends, inside, "left_anti")
