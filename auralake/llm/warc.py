"""WARC archives of gzip members: a deduplicating writer and a splittable reader.

Both ends go through Spark's text source, so archives may lie in any store that Spark reads, and writes commit as any other.

The writer makes one gzip member a record. A member's last byte is the highest byte of its length, zero below 16 MiB, and a
zero byte is also the writer's line separator; a longer record keeps its own last byte and is followed by one byte of the
zero padding that gzip allows.

The reader takes the gzip magic as line separator. So Spark cuts files into byte ranges, each task scans its range for the
magic and owns the lines that start inside it. The magic may also occur inside compressed data: a candidate counts only
when it inflates to a WARC header, and a member that a false magic cut is put together again from the lines that follow,
across ranges too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.session import shared_dir

MAGIC = b"\x1f\x8b\x08"
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, "
    "digest_ok boolean, payload binary"
)
FOUND = f"file string, block long, place long, line binary, {RECORD}"
#: Hadoop looks a name's codec up as the last suffix, spelt backwards, that sorts before the name. This one sorts right
#: behind .gz and before all names that end so, but ends none of them: so .gz files have no codec and are split like others. Hadoop's shaded client,
#: which Spark ships, has the second option under another name.
RAW_GZ = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
RAW_GZ |= {f"{root}io.compress.passthrough.extension": "x\x01.gz" for root in ("", "org.apache.hadoop.shaded.")}
#: Bytes of a member, its own header included, within which the record's header must begin.
BEGIN_WITHIN = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def header_value(text: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), text)


def member(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str, level: int) -> bytes:
    """The gzip member of a page: a response, or a revisit of the page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    lines = [
        "WARC/1.0", f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {header_text(url)}"]), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([] if first is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", level, mtime=0)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """One record per row of (page_id, url, html) below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest page_id are responses and all
    others revisit it. A null html is an empty payload. A row without page_id is a response, as nothing can refer to it
    and it has no place in the order; a null url leaves its header out. Repeated rows are repeated records. An empty table
    gives an archive without records. Other columns are left out.
    """
    shared_dir(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    # Only payloads that occur twice send rows here, one a payload.
    firsts = pages.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n"))
    firsts = firsts.filter("n > 1").select("digest", "first").checkpoint()
    pages = pages.join(firsts, "digest", "left").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                record = member(page_id, url, payload, first if page_id is not None and first is not None and page_id > first else None, date, level)
                out.append(record[:-1] if record[-1] == 0 else record)
            yield pa.record_batch([pa.array(out, type=pa.binary())], names=["record"])

    members = pages.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    members.write.option("lineSep", "\x00").text(path)


def parsed(data: bytes) -> dict | None:
    """The fields of one record, or nothing where the bytes are no WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers.get("content-length", len(rest)))]
    http, length = {}, None
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind == "revisit":
        length, ok, payload = int(http["content-length"]) if http.get("content-length", "").isdigit() else None, None, None
    else:
        own = base32_sha1(payload)
        length, ok, digest = len(payload), digest is None or digest == own, own
    uri = headers.get("warc-target-uri")
    return {
        "record_id": headers.get("warc-record-id"), "record_type": kind, "target_uri": None if uri is None else header_value(uri),
        "refers_to": headers.get("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "digest_ok": ok, "payload": payload,
    }


class Member:
    """A gzip member as far as its bytes have come."""

    def __init__(self) -> None:
        self.inflate, self.head, self.parts, self.taken = zlib.decompressobj(31), b"", [], 0

    def feed(self, data: bytes) -> bool | None:
        """Whether the member is complete; nothing where these bytes cannot belong to a WARC record's member."""
        try:
            part = self.inflate.decompress(data)
        except zlib.error:
            return None
        self.head, self.taken = (self.head + part[:5])[:5], self.taken + len(data)
        if not b"WARC/".startswith(self.head) or (len(self.head) < 5 and (self.inflate.eof or self.taken > BEGIN_WITHIN)):
            return None
        self.parts.append(part)
        return self.inflate.eof

    def content(self) -> bytes:
        return b"".join(self.parts)


def scan(lines: Iterator[bytes], last: bool = False) -> Iterator[tuple[str, object]]:
    """What one byte range holds, from the lines that follow its magics: ``record`` fields, and each ``line`` left over.

    A line opens a member if what it begins inflates to a WARC record, with as many lines behind it as that takes; if it
    does not, it is left over and the next line is tried. Left over are also the lines of a candidate that these
    lines do not end; where they are the ``last`` of their file, it is none, and the line behind its first is tried. No more
    is held than one candidate's lines.
    """
    held: list[bytes] = []
    fed, candidate = 0, None
    while True:
        done = False
        if fed < len(held) or (line := next(lines, None)) is not None:
            if fed == len(held):
                held.append(MAGIC + line)
            candidate = candidate or Member()
            done = candidate.feed(held[fed])
            fed += 1
        elif last and held:
            done = None
        else:
            break
        if done is None:
            yield "line", held.pop(0)
            fed, candidate = 0, None
        elif done:
            yield "record", parsed(candidate.content())
            held, fed, candidate = held[fed:], 0, None
    yield from (("line", x) for x in held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at ``path``.

    Payloads are what follows the HTTP header. A revisit has no payload of its own: its ``payload_bytes`` is the length its
    HTTP header gives. Bytes that belong to no WARC record are passed over. Files that end in .gz are split like any other.
    What ranges leave over of a file passes through one task in order, which holds one record at a time.
    """
    reader = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").options(**RAW_GZ)
    lines = reader.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = lines.mapInArrow(scanned, FOUND)
    fields = [x.split()[0] for x in RECORD.split(", ")]
    records = found.filter("line is null").select(*fields)

    # Few lines: a record's end behind a false magic, or what is no record.
    left = found.filter("line is not null").select("file", "block", "place", "line")
    left = left.repartition("file").sortWithinPartitions("file", "block", "place")
    return records.unionByName(left.mapInArrow(continued, RECORD))


def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that go on over ranges, from each file's lines left over in order."""
    fields = [x.split()[0] for x in RECORD.split(", ")]
    rows = ((file, line.as_py()) for batch in batches for file, line in zip(batch.column("file").to_pylist(), batch.column("line")))
    for _, lines in groupby(rows, key=lambda r: r[0]):
        for kind, found in scan((line[len(MAGIC) :] for _, line in lines), last=True):
            if kind == "record" and found is not None:
                yield batch_of([tuple(found[f] for f in fields)], RECORD)


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each byte range, and the lines left over with their place in it."""
    fields = [x.split()[0] for x in RECORD.split(", ")]
    for (file, block), lines in ranges(batches):
        rows, held = [], 0
        for place, (kind, found) in enumerate(scan(lines)):
            if kind == "line":
                rows.append((file, block, place, found, *[None] * len(fields)))
                held += len(found)
            elif found is not None:
                rows.append((file, block, place, None, *(found[f] for f in fields)))
                held += len(found["payload"] or b"") + 500
            if held > 8 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """The lines of each byte range, one range after the other, without what stands before a file's first magic."""
    def rows() -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            for line, file, block in zip(batch.column("line"), batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                yield (file, block), line.as_py()

    for key, group in groupby(rows(), key=lambda r: r[0]):
        lines = (line for _, line in group)
        if key[1] == 0 and next(lines).startswith(b"WARC/") and key[0].endswith(".gz"):
            raise ValueError(f"{key[0]} was decompressed on its way here, so that its members cannot be told apart")
        yield key, lines


def batch_of(rows: list[tuple], schema: str = FOUND) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, type=types[t]) for c, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])


def page_id_of(record_id: str) -> Column:
    """The page's id in a record id that :func:`write_warc` made."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
