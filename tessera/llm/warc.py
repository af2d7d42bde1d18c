"""Legacy archives to WARC.

``read_arc`` reads ARC archives, plain or gzipped (one or many members), of
version 1 or 2, by their version-specific header lines and declared lengths.
``convert_archives`` turns them into WARC files: each record becomes an
equivalent WARC record with a synthesised identifier, timestamp, type and digest.
For pages of a table, ``warc_records`` and ``write_archives`` write ARC archives
in memory and convert those.  A payload met before becomes a revisit of the
record with the smallest id.  Records are bytes from end to end.

Archives are written and read by Spark: the records of a file are one row of a
text sink whose line separator is the blank line that ends a WARC record, so
``write_archives`` makes WARC files (each one gzip member) on any file system
Spark knows, and ``read_archives`` splits them by declared content lengths.  A
file ends with the record that fills it: it holds ``FILE_BYTES`` and one record
at most before packing.

Payloads that several pages share are found by digest and length; only their
first pages are joined back, by broadcast up to ``MOST_BROADCAST_ROWS`` of them
(their ids and urls, with ``MOST_BROADCAST_BYTES`` in all at most), else by a
salted shuffle, so a payload of a third of all pages is split.

Defined cases: null html is an empty payload, null url is ``about:blank``;
white space in a url is percent-encoded; equal payloads with the same smallest
id are all responses; a null id comes after all others; ids may be of any type
and hold any characters (they are percent-encoded in a header, which a null id
lacks), and repeated with other urls or payloads (a record's identifier has its
payload's digest); pages of any length are kept whole, each a file of its own at
least from ``FILE_BYTES`` on; other columns take no part.  In archives, blank
lines between records are passed over, spaces in a url belong to it, header lines
that are no UTF-8 are read as Latin-1, a last record shorter than declared is
kept as it is, and a damaged header line raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable, fresh_path, text_batches

CRAWL_DATE = "20240101000000"
FILE_BYTES = 16 << 20
ARC_BYTES = 1 << 20
MOST_BROADCAST_ROWS, MOST_BROADCAST_BYTES = 300_000, 64 << 20
_SALTS = 32

#: The fields of an ARC record line by version of the archive.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
#: Fixed value: the profile of a revisit with equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_header(version: int, date: str = CRAWL_DATE) -> bytes:
    """The version block that opens an ARC archive."""
    body = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    line = {1: f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(body)}", 2: f"filedesc://pages.arc 0.0.0.0 {date} text/plain 200 - - 0 pages.arc {len(body)}"}[version]
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, block: bytes, date: str = CRAWL_DATE, offset: int = 0) -> bytes:
    line = {1: f"{url} 0.0.0.0 {date} text/html {len(block)}", 2: f"{url} 0.0.0.0 {date} text/html 200 - - {offset} pages.arc {len(block)}"}[version]
    return line.encode() + b"\n" + block + b"\n"


def _text(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _line_end(data: bytes, at: int) -> int:
    end = data.find(b"\n", at)
    return len(data) if end < 0 else end


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of every record of an ARC archive after its version block; ``fields`` has the ``version``, too."""
    end = _line_end(data, 0)
    length = int(_text(data[:end]).split(" ")[-1])
    body = data[end + 1 : end + 1 + length]
    version = int(body.split(b" ", 1)[0])
    names, at = ARC_FIELDS[version], end + 1 + length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = _line_end(data, at)
        values = _text(data[at:end]).rstrip("\r").split(" ")
        spare = len(values) - len(names)
        if spare < 0 or not values[-1].isdigit():
            raise ValueError(f"no ARC version {version} record line at byte {at}: {len(values)} fields of {len(names)}")
        fields = dict(zip(names, [" ".join(values[: spare + 1]), *values[spare + 1 :]])) | {"version": str(version)}
        length = int(fields["length"])
        yield fields, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def _uuid(hexadecimal: str) -> str:
    h = hexadecimal
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def record_id(url: str, date: str, page: str | None, sha: str) -> str:
    """Of a record by all it is told apart by; ``sha``: the SHA-1 of its payload in hexadecimal."""
    own = "" if page is None else f"={page}"
    return _uuid(hashlib.md5(f"{url} {date} {own} {sha}".encode()).hexdigest())


def _record_id_column(url: Column, date: Column, page: Column, sha: Column) -> Column:
    own = F.coalesce(F.concat(F.lit("="), page.cast("string")), F.lit(""))
    h = F.md5(F.concat_ws(" ", url, date, own, sha).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page_id(http: dict[str, str]) -> str | None:
    return unquote(http["x-page-id"]) if "x-page-id" in http else None


def _payload(block: bytes) -> bytes:
    """What follows the HTTP headers of a block; all of a block without any."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def to_warc(fields: dict[str, str], block: bytes, refers_to: str | None, page: str | None = None) -> bytes:
    """The WARC record (without the blank line that ends it) of an ARC record; ``page``: what tells it apart, if its HTTP headers don't say."""
    http = block.startswith(b"HTTP/")
    payload = _payload(block)
    head = block[: len(block) - len(payload)] if http else b""
    page = _page_id(_http_fields(head)) if page is None else page
    d = (fields["date"] + "00000000000000")[:14]
    kind, content = ("response", "application/http; msgtype=response") if http else ("resource", fields["content_type"])
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if refers_to else kind}", f"WARC-Target-URI: {fields['url']}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-IP-Address: {fields['ip']}",
        f"WARC-Record-ID: <urn:uuid:{record_id(fields['url'], fields['date'], page, hashlib.sha1(payload).hexdigest())}>", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Type: {content}",
    ]
    body = block
    if refers_to:
        body = head
        lines += [f"WARC-Refers-To: <urn:uuid:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record of an unpacked WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = _text(data[at:end]).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Pages through ARC archives of about a megabyte to WARC records; the version alternates."""
    version = 1
    for batch in batches:
        pages, urls, htmls, refs = (batch.column(i) for i in range(4))
        at = 0
        while at < batch.num_rows:
            arc, owner = [arc_header(version)], []
            size = 0
            while at < batch.num_rows and size < ARC_BYTES:
                own = "" if pages[at].as_py() is None else f"X-Page-Id: {quote(pages[at].as_py(), safe='')}\r\n"
                block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode() + htmls[at].as_py().encode()
                arc.append(arc_record(version, urls[at].as_py(), block, offset=size))
                owner.append(refs[at].as_py())
                size += len(arc[-1])
                at += 1
            for (fields, block), ref in zip(parse_arc(b"".join(arc)), owner, strict=True):
                yield to_warc(fields, block, ref)
            version = 3 - version


def _first_pages(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Of payloads that more than one page has: digest, length and the first page."""
    key = F.struct(F.col("id").isNull().alias("last"), "id", "url", "date")
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return durable(shared.select(F.col("sha").alias("first_sha"), F.col("bytes").alias("size"), "first"), "payloads")


def _with_revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` (``id, url, date, sha, bytes`` and others) with ``refers``, the identifier of the first record with the payload, null for itself."""
    first = _first_pages(rows, least_bytes)
    same = (F.col("sha") == F.col("first_sha")) & (F.col("bytes") == F.col("size"))
    n, size = first.agg(F.count(F.lit(1)), F.sum(F.octet_length("first.url") + F.coalesce(F.octet_length(F.col("first.id").cast("string")), F.lit(0)))).first()
    if n <= MOST_BROADCAST_ROWS and (size or 0) <= MOST_BROADCAST_BYTES:
        both = rows.join(F.broadcast(first), same, "left")
    else:
        salted = first.withColumn("first_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS))).join(salted, same & (F.col("salt") == F.col("first_salt")), "left")
    later = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return both.withColumn("refers", F.when(later, _record_id_column(F.col("first.url"), F.col("first.date"), F.col("first.id"), F.col("sha"))))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(id, url, html, refers)`` a page, ready to be written.  Equal payloads of at least ``least_bytes`` revisit the one with the smallest id."""
    html = F.coalesce(pages[f"`{html_col}`"], F.lit(""))
    url = F.regexp_replace(F.coalesce(pages[f"`{url_col}`"], F.lit("about:blank")), r"\s", "%20")
    rows = pages.select(
        pages[f"`{id_col}`"].alias("id"), F.when(url == "", "about:blank").otherwise(url).alias("url"), F.lit(CRAWL_DATE).alias("date"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("bytes"),
    )
    return _with_revisits(rows, least_bytes).select(F.col("id").cast("string").alias("id"), "url", "html", "refers")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the ARC archives under ``path``: archive, place (from 0), version, url, ip, date, content_type, block (bytes), and its payload's SHA-1 and length.

    An archive is read whole by one task, as its gzip members are; archives are split by file.
    """
    names = ("url", "ip", "date", "content_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = cell.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for place, (fields, block) in enumerate(parse_arc(data) if data else ()):
                    payload = _payload(block)
                    columns = [pa.array([name]), pa.array([place], pa.int64()), pa.array([int(fields["version"])], pa.int32()), *(pa.array([fields[n]]) for n in names), pa.array([block], pa.binary())]
                    columns += [pa.array([hashlib.sha1(payload).hexdigest()]), pa.array([len(payload)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["archive", "place", "version", *names, "block", "sha", "bytes"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, place long, version int, url string, ip string, date string, content_type string, block binary, sha string, bytes long")


def convert_archives(spark: SparkSession, source: str, target: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """ARC archives under ``source`` as WARC files under ``target``.

    A record is told apart by its archive's name and its place there; of equal
    payloads of ``least_bytes`` or more the first in that order stays, the others
    revisit it.  What is no HTTP response becomes a ``resource``.
    """
    text_batches(spark)
    records = durable(read_arc(spark, source), "arc")
    name = F.concat(F.element_at(F.split("archive", "/"), -1), F.lit("#"), F.lpad(F.col("place").cast("string"), 12, "0"))
    rows = records.select(name.alias("id"), "url", "date", "ip", "content_type", "block", "sha", "bytes")

    def warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for row in batch.to_pylist():
                yield to_warc(row, row["block"], row["refers"], row["id"])

    _write(_with_revisits(rows, least_bytes).select("id", "url", "date", "ip", "content_type", "block", "refers"), warcs, target, file_bytes)


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files under ``path``, each of ``file_bytes`` and one record at most before packing."""
    text_batches(records.sparkSession)
    _write(records, _converted, path, file_bytes)


def _write(records: DataFrame, convert, path: str, file_bytes: int) -> None:
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for record in convert(batches):
            held.append(record)
            size += len(record)
            if size >= file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["value"])

    # A cast of bytes to text leaves them as they are, and so does the sink.
    made = records.mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record: record_id, record_type, page_id (text), target_uri, payload_bytes, payload_digest, stored_digest, refers_to_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rows = []
                for headers, block in parse_warc(gzip.decompress(cell.as_py())):
                    own = headers["warc-type"] != "revisit"
                    head, _, payload = (b"", b"", block) if headers["warc-type"] == "resource" else block.partition(b"\r\n\r\n")
                    ident = lambda v: v and v.removeprefix("<urn:uuid:").removesuffix(">")
                    rows.append((
                        ident(headers["warc-record-id"]), headers["warc-type"], _page_id(_http_fields(head)), headers["warc-target-uri"],
                        len(payload) if own else None, digest(payload) if own else None, headers["warc-payload-digest"].removeprefix("sha1:"), ident(headers.get("warc-refers-to")),
                    ))
                columns = list(zip(*rows)) or [()] * 8
                kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f"c{i}" for i in range(8)])

    names = ["record_id", "record_type", "page_id", "target_uri", "payload_bytes", "payload_digest", "stored_digest", "refers_to_id"]
    kinds = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"c{i} {k.split()[1]}" for i, k in enumerate(kinds.split(", ")))).toDF(*names)


def resolved(records: DataFrame, id_type: str = "string") -> DataFrame:
    """Per record the page it is of, its whole payload's length and digest, and the page a revisit refers to; ids of ``id_type`` (null where one is no such value)."""
    page = lambda c: F.col(c).try_cast(id_type)
    own = records.where("refers_to_id is null").select(page("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    revisits = records.where("refers_to_id is not null").select("page_id", "refers_to_id", "record_type")
    whole = records.where("refers_to_id is null").groupBy("record_id").agg(F.first(F.struct("page_id", "payload_bytes", "payload_digest")).alias("r"))
    found = revisits.join(whole, F.col("refers_to_id") == F.col("record_id"), "left")
    return own.unionAll(found.select(page("page_id").alias("page_id"), "r.payload_bytes", "r.payload_digest", "record_type", page("r.page_id").alias("refers_to")))


def op10_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = fresh_path(spark, "warc")
    write_archives(warc_records(pages), path)
    records = durable(read_archives(spark, path), "records")  # the archives are unpacked once
    return resolved(records, pages.schema["page_id"].dataType.simpleString())


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""
