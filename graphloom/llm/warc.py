"""Legacy archive converter: ARC streams become WARC archives, and WARC archives are read back.

An ARC stream starts with a version block whose third line names the header fields; version 1 lines have five fields,
version 2 lines ten.  A record is its header line, as many bytes as the line declares, and a newline.  The converter
synthesises what WARC wants and ARC lacks: record identifiers, ISO timestamps, record types, block and payload digests.

Blocks are bytes throughout: binary payloads and foreign charsets pass unchanged.  A record is a gzip member of its own, as the
format asks, so that archives can be entered at any record; the reader goes from member to member and also takes archives that
are one member or not compressed.  Files are written by Spark, wherever it can write, and are bounded by their bytes.

Defined results: a null html is an empty payload, a null url an empty target; records with equal payloads refer to the
smallest page_id among them, repeated rows of that id are each a response; null ids refer to the smallest id if there is
one, else they are responses; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, scratch, written

#: Header fields of the two ARC versions, in order; fixed by the formats.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
FIELD_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Compressed bytes after which an archive file ends, with the record that passes them.
FILE_BYTES = 16_000_000
#: Bytes that are expanded at once.
INFLATE_BYTES = 1 << 16
#: Payload bytes that a reader gathers before it hands them on.
READ_BYTES = 4_000_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
#: Payloads shorter than this are always responses.
MIN_PAYLOAD = 0


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key.encode('utf-8', 'surrogateescape').decode('latin-1'))}>"


def arc_head(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 graphloom\n{FIELD_NAMES[version]}\n"
    values = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(block))}
    return (" ".join(values[f] for f in FIELDS[version]) + "\n" + block + "\n").encode()


def arc_record(version: int, url: str, date: str, block: bytes, ip="0.0.0.0", kind="text/html", name="-", offset=0) -> bytes:
    url = "".join("%%%02X" % b if b <= 32 or b == 127 else chr(b) for b in url.encode("utf-8")).encode("latin-1")  # no blanks in a field
    values = {"url": url or b"-", "ip": ip.encode(), "date": date.encode(), "type": kind.encode(), "result": b"200", "checksum": b"-", "location": b"-", "offset": b"%d" % offset, "filename": name.encode(), "length": b"%d" % len(block)}
    return b" ".join(values[f] for f in FIELDS[version]) + b"\n" + block + b"\n"


def arc_records(stream: bytes) -> Iterator[dict]:
    """The records of an ARC stream, each with its header fields by name and its block."""
    at = stream.index(b"\n")
    version = int(stream[at + 1 : stream.index(b"\n", at + 1)].split()[0])
    fields, at = FIELDS[version], 0
    while at < len(stream):
        if stream[at : at + 1] == b"\n":  # blank lines between records
            at += 1
            continue
        end = stream.index(b"\n", at)
        values = stream[at:end].decode("utf-8", "surrogateescape").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"ARC version {version} header line with {len(values)} fields at byte {at}")
        head, size = dict(zip(fields, values, strict=True)), int(values[-1])
        if end + 1 + size > len(stream):
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, more than are left")
        if not head["url"].startswith("filedesc://"):
            yield head | {"block": stream[end + 1 : end + 1 + size], "version": version}
        at = end + 1 + size


def iso_date(date: str) -> str:
    """ARC's digits, 8 to 14 of them, as a WARC timestamp."""
    d = (date + "000000")[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_split(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields, body of an HTTP response block; blocks of other kinds are all body."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, sep, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head + sep, fields, body


def warc_record(kind: str, key: str, date: str, fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record with the separator that follows it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date), *fields, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogateescape") + block + END


def convert(record: dict, refers_to: str | None = None) -> bytes:
    """An ARC record as a WARC response, or as a revisit of the record with the key refers_to.

    The key of a record is its X-Archive-Key header, else what identifies it in ARC: url, date and payload digest.
    """
    head, http, body = http_split(record["block"])
    digest = sha1_base32(body)
    key = http.get("X-Archive-Key", f"{record['url']} {record['date']} {digest}")
    fields = [("WARC-Target-URI", record["url"]), ("WARC-IP-Address", record["ip"]), ("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response" if head else record["type"])]
    if refers_to is None:
        return warc_record("response" if head else "resource", key, iso_date(record["date"]), fields, head + body)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Key", refers_to)]
    return warc_record("revisit", key, iso_date(record["date"]), fields, head)


def member(data: bytes) -> bytes:
    """A gzip member; one that does not end in a zero byte (its length is 16 MB or more) is followed by an empty one."""
    out = gzip.compress(data, 1, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 1, mtime=0)


def inflated(data) -> Iterator[bytes]:
    """The content of an archive, member after member, in pieces; what is not compressed as it is."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[k : k + INFLATE_BYTES]) for k in range(0, len(data), INFLATE_BYTES))
        return
    at, one = 0, None
    while at < len(data):
        one = one or zlib.decompressobj(31)
        piece = data[at : at + INFLATE_BYTES]
        yield one.decompress(piece)
        at += len(piece) - len(one.unused_data)
        if one.eof:
            one = None
    if one is not None:
        raise ValueError("the last member of an archive is cut off")


class Stream:
    """Pieces of an archive, read by line and by length."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def until(self, end: bytes) -> bytes | None:
        """What comes before `end`, which is passed over; None if nothing is left."""
        begin = 0
        while (k := self.held.find(end, self.at + begin)) < 0:
            begin = max(0, len(self.held) - self.at - len(end) + 1)
            if not self._more():
                if len(self.held) > self.at:
                    raise ValueError("an archive ends within a header")
                return None
        out = bytes(self.held[self.at : k])
        self.at = k + len(end)
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size and self._more():
            pass
        out = bytes(self.held[self.at : self.at + size])
        self.at += len(out)
        return out


def warc_records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, compressed or not."""
    stream = Stream(inflated(data))
    while (head := stream.until(END)) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record but {lines[0][:40]!r}")
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["Content-Length"])
        block = stream.take(size)
        if len(block) != size or stream.take(4) != END:
            raise ValueError(f"WARC record {fields.get('WARC-Record-ID')} is not as long as it declares")
        yield fields, block


def digest_column(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits at a time through base 32 digits."""
    hex40 = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


WARCINFO = [("Content-Type", "application/warc-fields")], b"software: graphloom\r\nformat: WARC File Format 1.1\r\n"


def _files(records: Iterable[bytes]):
    """Records as the contents of archive files; the zero byte that ends a member is left to the writer's line separator."""
    parts, size = [], 0
    for r in records:
        if not parts:
            parts.append(member(warc_record("warcinfo", f"warcinfo {sha1_base32(r)}", "2020-01-01T00:00:00Z", *WARCINFO)))
        parts.append(member(r))
        size += len(parts[-1])
        if size >= FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])
            parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])


def _write(files: DataFrame, path: str) -> None:
    """A file for each row of `value`."""
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _pages_to_arc(t: dict) -> Iterator[tuple[bytes, str | None]]:
    """Pages as records of two ARC streams, one of each version, parsed back and converted."""
    streams = {v: [arc_head(v, f"pages-v{v}.arc", "20200101000000")] for v in FIELDS}
    refers: dict[int, list[str | None]] = {v: [] for v in FIELDS}
    for i, url, html, ref in zip(t["page_id"], t["url"], t["html"], t["first"], strict=True):
        version = 1 + (i or 0) % 2
        key = "null" if i is None else str(i)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Archive-Key: {key}\r\n\r\n"
        date = (EPOCH + timedelta(seconds=(i or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
        streams[version].append(arc_record(version, url or "", date, head.encode() + html))
        refers[version].append(None if ref is None or ref == i else str(ref))
    for v, parts in streams.items():
        yield from (convert(r, ref) for r, ref in zip(arc_records(b"".join(parts)), refers[v], strict=True))


def write_pages(pages: DataFrame, path: str) -> None:
    """Write a WARC record per row of page_id, url, html to archives under path."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), digest_column(html).alias("digest"))
    firsts = rows.where(F.octet_length("html") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "payloads")
    rows = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "first")
    _write(rows.mapInArrow(lambda batches: _files(r for b in batches for r in _pages_to_arc(b.to_pydict())), "value binary"), path)
    dropped(firsts)


def convert_archives(spark: SparkSession, arcs: str, path: str) -> None:
    """Convert the ARC files at `arcs`, gzipped or not, into archives under path: every record a response or resource."""

    def run(batches):
        def records():
            for batch in batches:
                for content in batch.column(0):
                    yield from (convert(r) for r in arc_records(b"".join(inflated(content.as_buffer()))))

        return _files(records())

    _write(spark.read.format("binaryFile").load(arcs).select("content").mapInArrow(run, "value binary"), path)


READ = "page_id long, uri string, date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
READ_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _number(key: str | None) -> int | None:
    return int(key) if key and key.lstrip("-").isdigit() else None


def _read(fields: dict[str, str], block: bytes) -> tuple:
    _, http, body = http_split(block)
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    told = (_number(http.get("X-Archive-Key")), fields.get("WARC-Target-URI"), fields.get("WARC-Date"), fields.get("WARC-Record-ID"))
    if fields["WARC-Type"] == "revisit":
        return *told, _number(http.get("Content-Length")), digest or None, "revisit", _number(fields.get("WARC-Refers-To-Key")), None
    if digest and sha1_base32(body) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return *told, len(body), digest or sha1_base32(body), fields["WARC-Type"], None, body


def _from_warc(batches):
    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), READ_KINDS, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for fields, block in warc_records(content.as_buffer()):
                if fields["WARC-Type"] in ("response", "revisit", "resource"):
                    rows.append(_read(fields, block))
                    held += len(block)
                if held > READ_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response, resource and revisit records of the archives under path (files under 2 GB); payload is null for revisits."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_from_warc, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_warc(pages.sparkSession, path)
