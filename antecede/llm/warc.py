"""Legacy archives to WARC: ARC files are parsed by their version and declared lengths, then rewritten.

``arc_archives`` packs pages into ARC archives (version 1 and 2 in turn), ``arc_records`` reads ARC archives, ``write_warc`` gives
each record a WARC identifier, timestamp, type and digests and writes WARC files, ``read_warc`` reads such files.

An ARC archive starts with a version block whose body names the fields of the record header lines: five in version 1, ten in
version 2. A record is a header line, then exactly as many bytes as its last field declares, then a line feed.

Payloads of at least ``LEAST`` bytes that are equal (SHA-1 and length) are written once: the record with the largest page_id is the
response, the others are revisits that refer to its record id and hold the HTTP header only. Which one is decided by a partial
aggregate of digests; the payloads are then shuffled once by digest in a join that adaptive execution can split, so a payload
that a third of all pages share fills no single task.

Files are written and listed by Spark, so any file system will do. A record is one value of Spark's text writer and the two empty
lines that end a WARC record are its separator; files are gzip streams of at most ``RECORDS`` records and, by the mean length of the
pages, about ``FILE_BYTES`` of payload. They are read record by record, so a worker holds one compressed file and one record.

Defined cases: a null html is an empty payload; a null or empty url becomes urn:page:<id>, white space in a url is percent-encoded;
rows with equal page_id and html are all responses if one is; a null page_id is never the one that stays unless all of its
group are null, which are then all responses; extra columns are ignored; no pages give no records.
Payloads are UTF-8 text, as the html column is; an archive with another encoding raises.
"""

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

from antecede.llm.common import map_batches, stage
from antecede.session import scratch_path

ARCHIVE_BYTES, FILE_BYTES, RECORDS, LEAST = 1 << 20, 64 << 20, 20_000, 1000
FETCHED = "20200101000000"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
SPACE = re.compile(r"[\x00-\x20\x7f]")

# The header fields of the two ARC versions, and the WARC profile of a revisit.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def arc_archive(name: str, version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC archive of (url, HTTP response) records."""
    body = f"{version} 0 antecede\n{FIELDS[version]}\n".encode() + b"\n"
    out, at = [], 0

    def put(url: str, mime: str, content: bytes) -> None:
        nonlocal at
        head = [url, "0.0.0.0", FETCHED, mime]
        if version == 2:
            head += ["200", "-", "-", str(at), name]
        record = " ".join([*head, str(len(content))]).encode() + b"\n" + content + b"\n"
        out.append(record)
        at += len(record)

    put(f"filedesc://{name}", "text/plain", body)
    for url, content in records:
        put(url, "text/html", content)
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record after the version block."""
    at, names = 0, None
    while at < len(content):
        line_end = content.index(b"\n", at)
        values = content[at:line_end].decode().split(" ")
        size = int(values[-1])
        body = content[line_end + 1 : line_end + 1 + size]
        if len(body) != size:
            raise ValueError(f"record at {at} declares {size} bytes, {len(body)} are left")
        if names is None:
            version, fields = body.decode().split("\n")[:2]
            names = fields.split(" ")
            if int(version.split(" ")[0]) not in FIELDS or len(values) != len(names):
                raise ValueError("not an ARC version block")
        else:
            yield dict(zip(names, values, strict=True)), body
        at = line_end + 2 + size


def http_response(page_id, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}{END}".encode() + payload


def address(page_id, url) -> str:
    return SPACE.sub(lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page_id}"


def arc_archives(pages: DataFrame, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content) of ARC archives that hold the pages."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{number:08d}.arc"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([arc_archive(name, number % 2 + 1, held)], pa.binary())], ["archive", "content"]
            )

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k) for k in range(3))):
                page_id, payload = page_id.as_py(), (html.as_py() or "").encode()
                held.append((address(page_id, url.as_py()), http_response(page_id, payload)))
                held_bytes += len(payload)
                if held_bytes >= size:
                    yield flush()
                    held, held_bytes, number = [], 0, number + 1
        if held:
            yield flush()

    return map_batches(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), pack, "archive string, content binary")


RECORD = pa.schema([
    ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("http", pa.string()), ("payload", pa.string()),
    ("digest", pa.binary()), ("payload_bytes", pa.int64()),
])


def arc_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row per ARC record; ``payload`` false leaves the bulky columns null."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, body in parse_arc(content.as_py()):
                    head, _, data = body.partition(b"\r\n\r\n")
                    number = re.search(rb"X-Page-Id: (-?\d+)", head)
                    rows.append((
                        int(number.group(1)) if number else None, fields["URL"], fields["Archive-date"],
                        head.decode() if payload else None, data.decode() if payload else None,
                        hashlib.sha1(data).digest(), len(data),
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)

    return map_batches(
        archives.select("content"), unpack, "page_id bigint, uri string, date string, http string, payload string, digest binary, payload_bytes bigint"
    )


def record_id(page_id, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest.hex()}')}>"


def warc_record(page_id, uri: str, date: str, http: str, payload: str, digest: bytes, keeper) -> str:
    """A WARC record without the separator that ends it; a revisit if ``keeper`` is another page."""
    again = keeper is not None and keeper != page_id
    block = http + END + ("" if again else payload)
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    encoded = block.encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {uri}", f"WARC-Date: {stamp}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(encoded).digest()).decode()}",
    ]
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(keeper, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(encoded)}"]
    return "\r\n".join(head) + END + block


def keepers(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, keeper): the largest page_id of every payload that is long enough to be written once."""
    return records.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"))


def write_warc(records: DataFrame, kept: DataFrame, path: str, per_file: int = RECORDS) -> None:
    """Writes the records as gzipped WARC files below a path, at most ``per_file`` in each."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([warc_record(*(x.as_py() for x in row)) for row in zip(*batch.columns)], pa.large_string())
            yield pa.RecordBatch.from_arrays([values.cast(pa.string())], ["value"])

    joined = records.join(kept, "digest", "left").select("page_id", "uri", "date", "http", "payload", "digest", "keeper")
    (
        map_batches(joined, render, "value string").write.option("lineSep", END).option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)
    )


def inflated(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The text of an archive in pieces: gzip members one after the other, or the bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(content):
            taken = view[at : at + piece]
            yield member.decompress(taken)
            at += len(taken) - len(member.unused_data)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by the declared lengths; one record and one piece are held at a time."""
    pieces, held, done = inflated(content), bytearray(), 0

    def filled(size: int) -> bool:
        """Whether ``size`` bytes are held, after reading on as far as needed."""
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while filled(1):
        head_end, looked = held.find(b"\r\n\r\n"), 0
        while head_end < 0:
            looked = max(len(held) - 3, 0)
            if not filled(len(held) + 1):
                raise ValueError(f"no end of the header at {done}")
            head_end = held.find(b"\r\n\r\n", looked)
        version, *lines = held[:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {done}")
        fields = dict(line.split(": ", 1) for line in lines)
        end = head_end + 4 + int(fields["Content-Length"])
        if not filled(end):
            raise ValueError(f"record at {done} is cut short")
        yield fields, bytes(held[head_end + 4 : end])
        filled(end + 4)
        del held[: end + 4]
        done += end + 4


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, record_id, record_type, refers_to_id, payload_digest (hex), payload_bytes, and payload of every record.

    Payloads are held against their digests; ``payload`` false does not hand them on.
    """
    names = ["page_id", "record_id", "record_type", "refers_to_id", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    head, _, data = block.partition(b"\r\n\r\n")
                    number = re.search(rb"X-Page-Id: (-?\d+)", head)
                    full = int(re.search(rb"Content-Length: (\d+)", head).group(1))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    whole = fields["WARC-Type"] == "response"
                    if whole and (len(data) != full or hashlib.sha1(data).digest() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    rows.append((
                        int(number.group(1)) if number else None, fields["WARC-Record-ID"], fields["WARC-Type"],
                        fields.get("WARC-Refers-To"), digest.hex(), full, data.decode() if whole and payload else None,
                    ))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, record_id string, record_type string, refers_to_id string, payload_digest string, payload_bytes bigint, payload string"
    return map_batches(spark.read.format("binaryFile").load(path).select("content"), unpack, schema)


def convert(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages to ARC to WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    archives = arc_archives(pages)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = int(max(1, min(RECORDS, FILE_BYTES // max(mean, 1))))
    write_warc(arc_records(archives), keepers(arc_records(archives, payload=False)), path, per_file)
    back = stage(read_warc(spark, path, payload=False).drop("payload"), "warc-records")
    responses = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    return back.join(responses, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
