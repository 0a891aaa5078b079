"""Legacy archive converter: ARC records become WARC records, written and read back.

An ARC file opens with a version block whose body says which fields the header
line of each record has.  Version 1 lines have five fields, version 2 lines ten;
both end with the declared length of the body, which alone delimits a record.
The converter reads header lines from the right, so blanks in a URL do no harm,
and synthesises what WARC needs and ARC lacks: record id, ISO timestamp, record
type and digests.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, narrow, work_dir

# Fixed values of the formats.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
CRLF = b"\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Equal payloads of fewer bytes are all kept as responses.
REVISIT_FROM = 100
#: Bytes of payload in a file, and records, at most: a file is read back whole, one record of more bytes alone.
FILE_BYTES, FILE_RECORDS = 64 << 20, 50_000


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str | None
    ip: str | None
    date: str | None
    mime: str
    status: int | None
    body: bytes
    offset: int


def arc_version_block(version: int, name: str = "pages.arc") -> bytes:
    """The record that opens an ARC file."""
    body = f"{version} 0 webgrain\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "19960101000000", "mime": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, body: bytes, date: str = "-", mime: str = "text/html") -> bytes:
    """One record; blanks of the URL are escaped as the format wants."""
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    fields = {"url": address, "ip": "0.0.0.0", "date": date, "mime": mime, "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "-", "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block, each as long as its header declares.

    Raises ValueError for a header line that doesn't fit the version, a length
    that isn't a number, or a body that ends before its length.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the blank line after a body
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at {at}")
        line = data[at:end].decode("utf-8", "surrogateescape")
        names = ARC_FIELDS[version or (1 if len(line.split(" ")) <= 5 else 2)]
        fields = line.rsplit(" ", len(names) - 1)
        if len(fields) != len(names) or not fields[-1].isdigit():
            raise ValueError(f"bad header line at {at}: {line[:100]!r}")
        got = dict(zip(names, fields))
        length = int(got["length"])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"body at {end + 1} ends {length - len(body)} bytes early")
        if not version and line.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"version {version} isn't known")
        else:
            none = lambda s: None if s in ("-", "") else s
            status = got.get("status", "-")
            yield ArcRecord(version or 1, none(got["url"]), none(got["ip"]), none(got["date"]), got["mime"], int(status) if status.isdigit() else None, body, at)
        at = end + 1 + length


def iso_date(date: str | None) -> str:
    """WARC-Date of a 14-digit ARC date; short ones are filled up, bad ones are 1970."""
    digits = date if date and date.isdigit() and len(date) >= 4 else "1970"
    full = digits[:14] + "00000101000000"[len(digits[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str | None, date: str | None, digest: str, salt: str = "") -> str:
    """A urn that the same record always gets."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{url}|{date}|{digest}|{salt}'.encode('utf-8', 'surrogateescape')).digest()[:16], version=4)}>"


def to_records(df: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Rows as legacy records, converted: key, uri, date, mime, id, digest, bytes, payload.

    Each row is rendered as a small ARC file (version 1 or 2 by its key) and read
    by the converter, so what goes on is what the legacy format carries.
    """
    source = narrow(df, key, url, body).select(F.col(key), F.col(url).cast("string").alias(url), F.col(body).cast("string").alias(body))
    schema = f"{key} {source.schema[key].dataType.simpleString()}, uri string, date string, mime string, id string, digest string, bytes long, payload binary"
    names = [key, "uri", "date", "mime", "id", "digest", "bytes", "payload"]
    heads = {v: arc_version_block(v) for v in ARC_FIELDS}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = []
                for k, u, b in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                    version = 1 + zlib.crc32(str(k).encode()) % 2
                    (r,) = read_arc(heads[version] + arc_record(version, u, (b or "").encode()))
                    digest = hashlib.sha256(r.body).hexdigest()
                    rows.append((k, r.url, iso_date(r.date), r.mime, record_id(r.url, r.date, digest, str(k)), digest, len(r.body), r.body))
                cols = zip(*rows)
                kinds = [whole.column(0).type, *[pa.string()] * 5, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return source.mapInArrow(lean(convert), schema)


def with_revisits(records: DataFrame, *, key: str = "page_id", least: int = REVISIT_FROM) -> DataFrame:
    """record_type and refers_to beside each record.

    Only groups with several keys are joined back; counting them needs one small
    row for each digest and task.  The record side of the join is the one that a
    hot digest makes long, and Spark may split it there.
    """
    shared = (
        records.where(F.col("bytes") >= least).groupBy("digest")
        .agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.min_by("id", key).alias("first_id"))
        .where(F.col("first_key") < F.col("last_key"))
        .select(F.col("digest").alias("shared_digest"), "first_key", "first_id")
    )
    again = F.col("first_key").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_key"))
    return records.join(shared, (F.col("digest") == F.col("shared_digest")) & (F.col("bytes") >= least), "left").select(
        *records.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_key")).alias("refers_to"),
        F.when(again, F.col("first_id")).alias("refers_to_id"),
    )


def warc_text(key: str = "page_id") -> Column:
    """A record without its closing blank lines, which the writer puts between rows.

    Payload bytes go through a string column unread: the text writer copies them.
    """
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    escaped = lambda c: F.replace(F.url_encode(F.col(c).cast("string")), F.lit("+"), F.lit("%20"))
    maybe = lambda name, value: F.when(value.isNull(), "").otherwise(line(name, value))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("id")), line("WARC-Date", F.col("date")),
        maybe("WARC-Target-URI", F.col("uri")), maybe("WARC-Page-ID", escaped(key)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        maybe("WARC-Refers-To", F.col("refers_to_id")), maybe("WARC-Refers-To-Page-ID", escaped("refers_to")),
        F.when(revisit, f"WARC-Profile: {REVISIT_PROFILE}\r\n").otherwise(""),
        line("Content-Type", F.col("mime")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("payload").cast("string")),
    )


def records_per_file(records: DataFrame) -> int:
    """So many records that no file is larger than stated, unless one record is."""
    most = records.agg(F.max("bytes")).first()[0] or 0
    return max(1, min(FILE_RECORDS, FILE_BYTES // (most + 1024)))


def write_warc(records: DataFrame, path: str, *, key: str = "page_id", records_per_file: int = FILE_RECORDS) -> None:
    """Gzipped WARC files in a folder on any file system that Spark knows."""
    (
        records.select(warc_text(key).alias("value")).write.mode("overwrite")
        .option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    )


def read_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream of bytes.

    Raises ValueError where a record doesn't begin with a version line or ends
    before its Content-Length.
    """
    have, at, source, done = bytearray(), 0, iter(pieces), False

    def more() -> bool:
        nonlocal done, at
        if at > 1 << 20:
            del have[:at]
            at = 0
        piece = next(source, None)
        if piece is None:
            done = True
        else:
            have.extend(piece)
        return not done

    while True:
        while True:  # blank lines between records
            while at < len(have) and have[at] in CRLF:
                at += 1
            if at < len(have) or not more():
                break
        if at >= len(have):
            return
        while (end := have.find(RECORD_END.encode(), at)) < 0:
            if not more():
                raise ValueError("headers without end")
        first, *lines = have[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no version line: {first[:60]!r}")
        headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        at, n = end + 4, int(headers["content-length"])
        while len(have) - at < n:
            if not more():
                raise ValueError("record ends early")
        yield headers, bytes(have[at : at + n])
        at += n


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file of any number of members, a piece at a time."""
    while data:
        z = zlib.decompressobj(31)
        while data and not z.eof:
            yield z.decompress(data, size)
            data = z.unconsumed_tail or z.unused_data
        yield z.flush()


def scan_warc(spark: SparkSession, path: str, *, key: str = "page_id", key_type: str = "long") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to, uri, date of each record.

    A response's length and digest are those of the block that was read; a block
    that contradicts its headers raises ValueError.
    """
    schema = "key string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string, date string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in read_warc(inflated(data.as_py())):
                    said, n = h["warc-payload-digest"].removeprefix("sha256:"), int(h["warc-payload-length"])
                    if h["warc-type"] == "response" and (len(block) != n or hashlib.sha256(block).hexdigest() != said):
                        raise ValueError(f"{h['warc-record-id']}: the block contradicts its headers")
                    text = lambda name: urllib.parse.unquote(h[name]) if name in h else None  # noqa: B023, E731
                    rows.append((text("warc-page-id"), n, said, h["warc-type"], text("warc-refers-to-page-id"), h.get("warc-target-uri"), h["warc-date"]))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    found = files.select("content").mapInArrow(lean(parse), schema)
    as_key = lambda c: F.col(c).cast(key_type)
    return found.select(as_key("key").alias(key), "payload_bytes", "payload_digest", "record_type", as_key("refers_to").alias("refers_to"), "uri", "date")


def convert_pages(df: DataFrame, path: str, *, key: str = "page_id", url: str = "url", body: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """Writes a WARC record for each row to ``path`` and returns what the archives say.

    Keys may be of any type that a text can be cast back to; null bodies are empty
    payloads; null urls are records without a target; rows that repeat are records that repeat, each row of the smallest key being a
    response; a null key never is the one that others refer to; an empty table
    gives an empty folder and table; other columns are dropped.
    """
    sizes = narrow(df, body).select(F.octet_length(F.col(body).cast("string")).alias("bytes"))
    records = to_records(df, key=key, url=url, body=body)  # converted twice: kept payloads would take more disk than the archives
    write_warc(with_revisits(records, key=key, least=least), path, key=key, records_per_file=records_per_file(sizes))
    return scan_warc(df.sparkSession, path, key=key, key_type=records.schema[key].dataType.simpleString())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{work_dir(spark)}-warc")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
