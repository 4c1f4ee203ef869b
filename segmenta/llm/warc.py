"""WARC archives: a writer of gzip members, and a reader that salvages what is whole from damaged files.

The reader checks every record: the member's checksum, the version line, the declared length, the closing line ends and the
payload digest. After a failed check it looks for the next byte that starts a valid member or version line, goes on from
there, and logs the bytes between as a quarantined gap; nothing after a damaged place is lost with it. What comes out of a
damaged member is searched for version lines in the same way; where its checksum fails, only responses whose payload digest
is right are taken from it. Bytes of a file can't be told apart within a member, so its records and gaps have the member's range
there, and their own range in what it holds beside. Work is linear in the file: each mark of a member or record is looked for
once, and a member's header must end within ``HEADER`` bytes.

Contract of ``write_pages``: of rows with equal payloads those with the smallest page_id are responses (a null id only where
no row has an id), the others revisits, so repeated rows are as many records of one kind; a null html is empty; an empty table
gives no archives; extra columns, whatever their names, are ignored. Of ``read_archives``: field names in any case; a member is
read up to ``MOST`` bytes, as no row can hold more.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.store import atomic_file, new_folder, stored
from segmenta.llm.text import slices

ARCHIVE_BYTES = 8 << 20
#: Payload hashes up to this number are broadcast (40 bytes each); beyond it the same join is shuffled.
SMALL = 1 << 18
VERSION_LINE = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
_STEP = 1 << 15
#: Bytes that a member's header and that a member's content may have.
HEADER, MOST = 1 << 14, (1 << 31) - 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record. A revisit has the HTTP head alone; its Content-Length there is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Target-URI": target}
    if revisit:
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that begins at a byte and where it ends, or None if any check fails."""
    if data[at : at + len(VERSION_LINE)] != VERSION_LINE:
        return None
    fields, line = {}, data.find(b"\r\n", at, at + 16) + 2  # the version line is short
    if line == 1:
        return None
    try:
        # Line by line, so that what isn't a head is left at its first line without a colon: another version line at the latest.
        while (stop := data.find(b"\r\n", line)) != line:
            name, colon, value = data[line:stop].decode().partition(":") if stop > 0 else ("", "", "")
            if not colon:
                return None
            fields[name.strip().lower()] = value.strip()
            line = stop + 2
        begin, size = stop + 2, int(fields["content-length"])
    except (ValueError, KeyError):
        return None
    end = begin + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    http, gap, payload = block.partition(b"\r\n\r\n")
    kind, declared = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = None
    if kind in ("response", "revisit"):
        if not gap:
            return None
        length = len(payload)
        if kind == "revisit":
            sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            length = int(sizes[0]) if sizes and sizes[0].strip().isdigit() else None
        elif declared and digest(payload) != declared:
            return None
    return {"type": kind, "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": declared, "length": length, "payload": payload}, end + 4


def _header_end(data: bytes, at: int) -> int | None:
    """Where a gzip member's compressed bytes begin, or None if no whole header of up to HEADER bytes is there."""
    flags, end = data[at + 3 : at + 4], at + 10
    if not flags or flags[0] & 0xE0:
        return None
    if flags[0] & 4:  # extra field
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for flag in (8, 16):  # name, comment
        if flags[0] & flag:
            end = data.find(b"\0", end, at + HEADER) + 1
            if not end:
                return None
    end += 2 * bool(flags[0] & 2)
    return end if end <= min(at + HEADER, len(data)) else None


def inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What a gzip member holds and where the member ends; if it is damaged, what comes out before that and None."""
    if _header_end(data, at) is None:
        return b"", None
    z, out, here, size = zlib.decompressobj(31), [], at, 0
    while not z.eof:
        chunk = data[here : here + _STEP]
        if not chunk or size > MOST:
            return b"".join(out)[:MOST], None
        before = z.copy()
        try:
            out.append(z.decompress(chunk))
            size += len(out[-1])
        except zlib.error:
            try:
                for k in range(len(chunk)):  # a failed call gives nothing of its chunk
                    out.append(before.decompress(chunk[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), None
        here += len(chunk)
    return b"".join(out), here - len(z.unused_data)


def _inside(content: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(begin, end, record) of the whole records of a member's content, and of the gaps between; looks for version lines after
    a failed one."""
    at = gap = 0
    while at < len(content):
        if one := parse_record(content, at):
            if gap < at:
                yield gap, at, None
            yield at, one[1], one[0]
            at = gap = one[1]
            continue
        at = content.find(b"\n" + VERSION_LINE, at) + 1 or len(content)
    if gap < len(content):
        yield gap, len(content), None


class _Marks:
    """The places of a mark in a file, each looked for once."""

    def __init__(self, data: bytes, mark: bytes, line_start: bool):
        self.data, self.mark, self.line_start, self.at = data, mark, line_start, -1

    def next(self, at: int) -> int:
        """The first place from ``at`` on, else the end; calls come with rising places."""
        while self.at < at:
            found = self.data.find(self.mark, at)
            if found < 0:
                self.at = len(self.data)
            elif self.line_start and found and self.data[found - 1] != 10:
                at = found + 1
            else:
                self.at = found
        return self.at


def spans(data: bytes) -> Iterator[tuple[int, int, int | None, int | None, dict | None]]:
    """(begin, end, inner begin, inner end, record), the record None for a quarantined gap; inner ranges are those within the
    content of a member that holds more than one whole record. Outer ranges cover the file in order, the inner ones their member."""
    at = gap = 0
    marks = [_Marks(data, MEMBER, False), _Marks(data, VERSION_LINE, True)]
    saved: list[tuple] = []  # of the damaged member at the gap's begin

    def closed(end: int) -> Iterator[tuple]:
        if saved:
            yield from ((gap, end, *x) for x in saved)
        elif gap < end:
            yield gap, end, None, None, None

    while at < len(data):
        if data[at : at + 3] == MEMBER:
            content, stop = inflate(data, at)
            found = list(_inside(content))
            if stop is not None and any(x for *_, x in found):
                yield from closed(at)
                saved = []
                yield from ((at, stop, None, None, x) if len(found) == 1 else (at, stop, a, b, x) for a, b, x in found)
                at = gap = stop
                continue
            # No checksum: only what has a digest.
            found = [(a, b, x if x and x["type"] == "response" and x["digest"] else None) for a, b, x in found]
            if stop is None and any(x for *_, x in found):
                yield from closed(at)
                whole = len(content)
                gap, saved = at, [*found, (whole, None, None)]  # and what didn't come out
        elif one := parse_record(data, at):
            yield from closed(at)
            saved = []
            yield at, one[1], None, None, one[0]
            at = gap = one[1]
            continue
        at = min(x.next(at + 1) for x in marks)
    yield from closed(len(data))


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(begin, end, record) of what is whole, then (begin, end, None) once for a range with a quarantined gap."""
    bad = None
    for begin, end, _, _, x in spans(data):
        if bad and bad != (begin, end):
            yield *bad, None
            bad = None
        if x is None:
            bad = begin, end
        else:
            yield begin, end, x
    if bad:
        yield *bad, None


def write_pages(pages: DataFrame) -> tuple[str, DataFrame]:
    """Archives of all pages; (folder, manifest with a row per archive)."""
    root = new_folder(pages.sparkSession, "warc")
    kinds = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"p{part:06d}-{seq:06d}-{uuid.uuid4().hex}.warc.gz"
            with atomic_file(f"{root}/{name}") as out:
                for x in held:
                    out.write(x)
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)], "n_bytes": [size]}, schema=kinds)

        for batch in batches:
            for rows in slices(batch, "html"):
                for page, url, html, response in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html", "response_id")), strict=True):
                    held.append(member(record(page, url, (html or "").encode(), response, page != response)))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield flush()
                        seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("payload_sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    # Only payloads that occur again need the join; html stays where it is if their hashes are few, else both sides are plain
    # shuffles, which AQE can split for a payload with a third of all pages.
    again = stored(page.groupBy("payload_sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("payload_sha1", "first_id", F.lit(True).alias("again")), "payloads-again")
    rows = page.join(F.broadcast(again) if again.count() <= SMALL else again, "payload_sha1", "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("again"), F.col("first_id")).otherwise(F.col("page_id")).alias("response_id"))
    return root, stored(rows.mapInArrow(write, "file string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """A row per record or gap: file, begin, end_at, inner_begin, inner_end, is_gap, record_type, record_id, target_uri, refers_to, payload_digest,
    payload_bytes, payload."""
    names = ["file", "begin", "end_at", "inner_begin", "inner_end", "is_gap", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def read(batches):
        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for *place, x in spans(content.as_py()):
                    x = x or {}
                    rows.append((path.rpartition("/")[2], *place, not x, x.get("type"), x.get("id"), x.get("uri"), x.get("refers_to"), x.get("digest"), x.get("length"), x.get("payload")))
                    size += len(x.get("payload") or b"")
                    if size > 4 << 20:
                        yield sent(rows)
                        rows, size = [], 0
                if rows:
                    yield sent(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(root).select("path", "content")
    return files.mapInArrow(read, "file string, begin long, end_at long, inner_begin long, inner_end long, is_gap boolean, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return a row per page without its payload."""
    root, manifest = write_pages(pages)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') as bigint)")
    rows = read_archives(pages.sparkSession, root).filter(~F.col("is_gap")).drop("payload").join(manifest.select("file"), "file", "left_semi")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "file", "begin", "end_at")
