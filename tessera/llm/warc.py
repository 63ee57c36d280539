"""ARC to WARC: legacy archives are parsed by their version and declared lengths, and WARC records synthesised from them.

``write_arc`` puts pages into ARC files (version 1 and 2 by turns), ``read_arc``
parses them, ``convert_archives`` writes the equivalent WARC 1.1 records with
identifiers, timestamps, types and digests made from the legacy fields, and
``read_warc`` parses those.  Files are written by Spark's text writer and read by its binary reader, so
any file system that Spark knows will do; each holds one archive of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, release, small

#: Payload bytes from which an equal payload is a revisit.
LEAST = 100
#: Archive size at which a new file begins; a larger record has a file of its own.
ARCHIVE = 8 << 20

# Header lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
_STAMP = "20240101000000"
_END = "\r\n\r\n"


def record_id(page_id: int) -> str:
    """A version 8 UUID that carries the 64 bits of ``page_id``."""
    bits = page_id & (1 << 64) - 1
    head = _NAMESPACE.int >> 80
    return f"urn:uuid:{uuid.UUID(int=head << 80 | 8 << 76 | (bits >> 62) << 64 | 2 << 62 | bits & (1 << 62) - 1)}"


def page_of(identifier: str) -> int:
    value = uuid.UUID(identifier.removeprefix("urn:uuid:")).int
    bits = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return bits - (1 << 64) if bits >> 63 else bits


# -- ARC -----------------------------------------------------------------------


def _field(value: str | None) -> str:
    """A value of an ARC header line: percent-encoded white space and controls, - for none."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value) if value else "-"


def arc_file_header(version: int, name: str) -> str:
    body = f"{version} 0 tessera\n{ARC_FIELDS[version]}\n\n"
    line = ["filedesc://" + name, "0.0.0.0", _STAMP, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return " ".join(line) + "\n" + body + "\n"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, html: str) -> str:
    size = len(html.encode())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + f"Content-Length: {size}\r\n\r\n" + html  # noqa: F541
    raw = block.encode()
    line = [_field(url), "0.0.0.0", _STAMP, "text/html"] + (["200", f"{zlib.crc32(raw):08x}", "-", str(offset), name] if version == 2 else []) + [str(len(raw))]
    return " ".join(line) + "\n" + block + "\n"


def parse_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; a filedesc record says which fields the following ones have.

    Raises ValueError if a line has other fields, or a block is shorter, than declared.
    """
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.index(b"\n", at)
        line = raw[at:end].decode()
        desc = line.startswith("filedesc://")
        parts = line.split(" ")
        size = int(parts[-1])
        block = raw[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"ARC record at byte {at} declares {size} bytes and has {len(block)}")
        at = end + 1 + size
        if desc:
            version, names = (block.split(b"\n")[k].decode() for k in (0, 1))
            fields = names.split()
            if int(version.split()[0]) not in ARC_FIELDS:
                raise ValueError(f"ARC version line {version!r}")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line {line!r} has not the fields {fields}")
        yield dict(zip(fields, parts, strict=True)), block


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), header bytes with their blank line, and payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, b"", block
    head = block[: end + 4]
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, head, block[end + 4 :]


def _archives(make: Callable[[Iterator[pa.RecordBatch]], Iterator[str]], limit: int, ending: str):
    """Rows of whole archives: record texts gathered up to ``limit`` characters, the last ``ending`` left to the writer."""

    def row(held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["".join(held).removesuffix(ending)], pa.string())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for text in make(batches):
            held.append(text)
            size += len(text)
            if size >= limit:
                yield row(held)
                held, size = [], 0
        if held:
            yield row(held)
        release()

    return run


def _write(rows: DataFrame, path: str, ending: str) -> None:
    """An archive a file, gzipped whole: Spark's writers take text, not the bytes of single members.  The writer adds ``ending``."""
    rows.write.option("lineSep", ending).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def _unzipped(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:  # members one after another
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def write_arc(pages: DataFrame, path: str, limit: int = ARCHIVE) -> None:
    """``pages`` (page_id, url, html) as gzipped ARC files in ``path``, versions 1 and 2 by turns."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        size, turn, name = limit, 0, ""
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if size >= limit:
                    turn, size = turn + 1, 0
                    name = f"{turn}.arc"
                    head = arc_file_header(1 + turn % 2, name)
                else:
                    head = ""
                text = head + arc_record(1 + turn % 2, name, size, page_id, url, html or "")
                size += len(text)
                yield text

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_archives(make, limit, "\n"), "value string")
    _write(rows, path, "\n")


_ARC_ROWS = "page_id long, url string, stamp string, http string, payload binary, payload_bytes long, digest string"
_ARC_INDEX = "path string, place long, page_id long, payload_bytes long, digest string"


def _records(content: bytes) -> Iterator[tuple[int | None, str | None, str, bytes, bytes, str]]:
    """page_id, url, stamp, HTTP header, payload and digest (SHA-256, hex) of each record of an ARC file."""
    for fields, block in parse_arc(_unzipped(content)):
        http, head, payload = split_http(block)
        page, url = http.get("x-page-id"), fields["URL"]
        yield int(page) if page else None, None if url == "-" else url, fields["Archive-date"], head, payload, hashlib.sha256(payload).hexdigest()


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out, size = [], 0
            for page, url, stamp, head, payload, digest in _records(content.as_py()):
                out.append((page, url, stamp, head.decode("latin-1"), payload, len(payload), digest))
                size += len(payload)
                if size > 4 << 20:
                    yield _batch(out, _ARC_ROWS)
                    out, size = [], 0
            yield _batch(out, _ARC_ROWS)


def _arc_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            yield _batch([(path, k, page, len(payload), digest) for k, (page, _, _, _, payload, digest) in enumerate(_records(content.as_py()))], _ARC_INDEX)
    release()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, stamp, http (header), payload, payload_bytes and digest (SHA-256, hex) of each record of the ARC files in ``path``."""
    return _files(spark, path).select("content").mapInArrow(_arc_rows, _ARC_ROWS)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """path, place (number in the file), page_id, payload_bytes and digest of each record of the ARC files in ``path``."""
    return _files(spark, path).mapInArrow(_arc_index, _ARC_INDEX)


# -- WARC ----------------------------------------------------------------------


def iso_date(stamp: str) -> str:
    """The 14-digit ARC date as WARC writes it; the epoch if it is none."""
    try:
        return datetime.strptime(stamp, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(page_id: int | None, url: str | None, stamp: str, http: str, payload: str, digest: str, refers_to: int | None) -> str:
    """A response with its payload, or a revisit with the HTTP header alone."""
    block = http if refers_to is not None else http + payload
    identifier = record_id(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url}{stamp}{digest}')}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {iso_date(stamp)}"]
    if url:
        lines.append(f"WARC-Target-URI: {url}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is None:
        lines.append("X-Page-Id: null")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + _END + block + _END


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record; raises ValueError where the framing breaks."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[at:end].decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} declares {size} bytes")
        at = end + 8 + size
        yield fields, block


def revisits(index: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """path, place and refers_to of each record of ``index`` (of :func:`arc_index`) that repeats a payload of ``least`` bytes or more.

    refers_to is the smallest page_id among equal payloads, whose own record is none.
    Digests are counted before they are moved, and the counts written before the join,
    so that rows of a very common payload can be split.
    """
    long = index.filter(F.col("payload_bytes") >= least)
    first = long.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    first = scratch.keep(first.select("digest", "payload_bytes", "first"), "first")
    found = long.join(small(first, 96), ["digest", "payload_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    return found.select("path", "place", F.col("first").alias("refers_to"))


def convert_archives(spark: SparkSession, arcs: str, path: str, scratch: Scratch, limit: int = ARCHIVE, least: int = LEAST) -> None:
    """The ARC files in ``arcs`` as gzipped WARC files in ``path``.

    Payloads are not dealt out: each file is read again beside the list of its own
    revisits, so what meets in a join is one row a file.
    """
    index = scratch.keep(arc_index(spark, arcs), "index")
    by_file = scratch.keep(revisits(index, scratch, least).groupBy("path").agg(F.collect_list("place").alias("places"), F.collect_list("refers_to").alias("refers")), "by-file")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        for batch in batches:
            for content, places, refers in zip(batch.column("content"), batch.column("places").to_pylist(), batch.column("refers").to_pylist(), strict=True):
                of = dict(zip(places or [], refers or [], strict=True))
                for k, (page, url, stamp, head, payload, digest) in enumerate(_records(content.as_py())):
                    yield warc_record(page, url, stamp, head.decode("latin-1"), payload.decode(), digest, of.get(k))

    rows = _files(spark, arcs).join(by_file, "path", "left").select("content", "places", "refers")
    _write(rows.mapInArrow(_archives(make, limit, _END), "value string"), path, _END)


_WARC_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for fields, block in parse_warc(_unzipped(content.as_py())):
                http, _, payload = split_http(block)
                said = fields["warc-payload-digest"].removeprefix("sha256:")
                page = None if fields.get("x-page-id") == "null" else page_of(fields["warc-record-id"].strip("<>"))
                if fields["warc-type"] == "revisit":  # the payload is the referred record's
                    out.append((page, fields.get("warc-target-uri"), int(http["content-length"]), said, "revisit", page_of(fields["warc-refers-to"].strip("<>"))))
                else:
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    out.append((page, fields.get("warc-target-uri"), len(payload), digest, "response", None))
            yield _batch(out, _WARC_ROWS)
    release()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record of the WARC files in ``path``; digests of responses are verified."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_warc_rows, _WARC_ROWS)


def convert_pages(pages: DataFrame, limit: int = ARCHIVE, least: int = LEAST) -> DataFrame:
    """Pages through ARC files into WARC files, and what those hold: a row for each row of ``pages``.

    Null html is an empty payload; a null or blank url has no target URI.  Rows that
    repeat a page_id are records each, and none refers to its own id.  A null page_id
    is kept, and referred to by none unless all equal payloads have none.  An empty
    table gives no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    write_arc(pages, scratch.path("arc"), limit)
    convert_archives(spark, scratch.path("arc"), scratch.path("warc"), scratch, limit, least)
    scratch.drop("arc")
    scratch.tidy()
    return read_warc(spark, scratch.path("warc"))
