"""Legacy archives to WARC: ARC files are parsed by their versions' header lines and declared lengths.

*Writing ARC.* Pages become records of ARC files of bounded size, in version 1 (five header fields) or
version 2 (ten fields). The network document of a record is an HTTP response with the page's id as a
header field and the page's bytes as its body.

*Converting.* A file's first line is its version block, whose body declares the version and so the fields of
every later header line. A record's document is cut by the declared length, never by searching. From it
come the WARC fields: an identifier that is a name-based UUID of archive, offset and target, a W3C date
from the 14-digit one, the type, and block and payload digests. Records with equal payloads of
``revisit_from`` bytes and more are one response, that with the smallest id (the first written among
equal ids), and revisits that refer to it. Revisits keep the HTTP header and drop the body.

*Reading back.* WARC files are parsed by version line, named fields and ``Content-Length``; digests and
lengths come from the records.

Files are written by Spark in the shared folder, one bounded group of records per file, gzip-compressed.
A null page counts as empty. A null or unprintable URL is written as ``-`` or percent-encoded; a null id has no
id field and stays null, and its record is always a response. Repeated rows give a record each; with equal ids
and payloads all but one of them are revisits of it. Empty tables give empty archives. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.functions.frames import stage_root, write_stage
from rangebreak.llm.text import plain_strings

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID_FIELD = "X-Page-Id"
#: Bytes of records in one file; a longer single record has a file of its own.
FILE_BYTES = 4_000_000
DATE = "20240101000000"


def arc_record(version: int, url: str | None, page_id: int | None, html: bytes) -> bytes:
    """Header line, network document and the newline that separates records."""
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        lines.append(f"{ID_FIELD}: {page_id}")
    lines.append(f"Content-Length: {len(html)}")
    document = "\r\n".join(lines).encode() + b"\r\n\r\n" + html
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "-"
    fields = [target, "0.0.0.0", DATE, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", "0", "-"]
    return " ".join([*fields, str(len(document))]).encode() + b"\n" + document + b"\n"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", DATE, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\n", at)
    end = len(data) if end < 0 else end
    return data[at:end].rstrip(b"\r"), end + 1


def read_arc(data: bytes):
    """``(offset, fields by name, document)`` of every record after the version block."""
    if not data:  # Spark writes an empty file for an empty table
        return
    first, at = _line(data, 0)
    length = int(first.rsplit(b" ", 1)[1])
    body = data[at : at + length].decode()
    version, names = int(body.split(" ", 1)[0]), body.split("\n")[1].split(" ")
    if names != ARC_FIELDS[version].split(" "):
        raise ValueError(f"version {version} block with fields {names}")
    at += length
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        offset = at
        line, at = _line(data, at)
        values = line.decode().split(" ")
        if len(values) != len(names):
            raise ValueError(f"header line of {len(values)} fields in version {version}: {line[:200]!r}")
        fields = dict(zip(names, values, strict=True))
        length = int(fields["Archive-length"])
        if at + length > len(data):
            raise ValueError(f"record at {offset} declares {length} bytes beyond the file")
        yield offset, fields, data[at : at + length]
        at += length


def _http(document: bytes) -> tuple[bytes, bytes, int | None]:
    """Header with its blank line, body, page id."""
    cut = document.index(b"\r\n\r\n") + 4
    for line in document[:cut].split(b"\r\n"):
        name, _, value = line.partition(b": ")
        if name == ID_FIELD.encode():
            return document[:cut], document[cut:], int(value)
    return document[:cut], document[cut:], None


def warc_record(archive: str, offset: int, fields: dict[str, str], document: bytes, refers_to: str | None) -> bytes:
    """A response, or with ``refers_to`` (an identifier) a revisit, of an ARC record."""
    header, body, _ = _http(document)
    block = header if refers_to else document
    d = fields["Archive-date"]
    lines = [
        WARC_VERSION,
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(archive, offset, fields['URL'])}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}", "WARC-Truncated: length"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def record_id(archive: str, offset: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}#{url}')}>"


def read_warc(data: bytes):
    """``(fields by lower-case name, block)`` of every record."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        line, at = _line(data, at)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no version line: {line[:80]!r}")
        fields = {}
        while True:
            line, at = _line(data, at)
            if not line:
                break
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        if at + length > len(data):
            raise ValueError(f"record declares {length} bytes beyond the file")
        yield fields, data[at : at + length]
        at += length


def _grouped(records, most: int = FILE_BYTES):
    """Lists of byte strings of about ``most`` bytes."""
    group, size = [], 0
    for record in records:
        if group and size + len(record) > most:
            yield group
            group, size = [], 0
        group.append(record)
        size += len(record)
    if group:
        yield group


def _file(parts: list[bytes]):
    """A batch of one row: a file's content."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts).decode()], pa.large_string()).cast(pa.string())], names=["value"])


def _write(files: DataFrame, path: str, end: str) -> str:
    """One file per row: the text writer ends each row with ``end`` and starts a file after each."""
    files.write.option("lineSep", end).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def _read(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def write_arcs(pages: DataFrame, path: str) -> str:
    """ARC files of both versions in turn."""

    def run(batches):
        def records():
            for batch in batches:
                ids = batch.column("page_id").to_pylist()
                urls = batch.column("url").to_pylist()
                htmls = plain_strings(batch.column("html"))
                for i in range(len(ids)):
                    yield ids[i], urls[i], htmls[i].as_py().encode()

        group, size, version, count = [], 0, 1, 0
        for page_id, url, html in records():
            record = arc_record(version, url, page_id, html)
            if group and size + len(record) > FILE_BYTES:
                yield _file([arc_version_block(version, f"{count}.arc"), *group])
                group, size, version, count = [], 0, 3 - version, count + 1
                record = arc_record(version, url, page_id, html)
            group.append(record)
            size += len(record)
        if group:
            yield _file([arc_version_block(version, f"{count}.arc"), *group])

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return _write(read.mapInArrow(run, "value string"), path, "\n")


def _arc_index(batches):
    """``archive, offset, url, page_id, digest, bytes`` of every ARC record."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for offset, fields, document in read_arc(gzip.decompress(content.as_py())):
                _, body, page_id = _http(document)
                rows.append((_name(path), offset, fields["URL"], page_id, hashlib.sha256(body).hexdigest(), len(body)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["archive", "offset", "url", "page_id", "digest", "bytes"],
            )


def revisits(index: DataFrame, revisit_from: int) -> DataFrame:
    """``archive, offset, first_archive, first_offset, first_url`` of the records that repeat a payload."""
    place = F.struct("page_id", "archive", "offset", "url")
    alike = index.where((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull())
    first = alike.groupBy("digest").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("digest", "f")
    return (
        alike.join(first, "digest")
        .where((F.col("archive") != F.col("f.archive")) | (F.col("offset") != F.col("f.offset")))
        .select("archive", "offset", F.col("f.archive").alias("first_archive"), F.col("f.offset").alias("first_offset"), F.col("f.url").alias("first_url"))
    )


def _convert(batches):
    for batch in batches:
        for path, content, marks in zip(
            batch.column("path").to_pylist(), batch.column("content"), batch.column("marks").to_pylist(), strict=True
        ):
            again = {m["offset"]: record_id(m["first_archive"], m["first_offset"], m["first_url"]) for m in marks or ()}
            records = read_arc(gzip.decompress(content.as_py()))
            made = (warc_record(_name(path), o, f, d, again.get(o)) + b"\r\n\r\n" for o, f, d in records)
            for group in _grouped(made):
                group[-1] = group[-1][:-4]  # the writer ends the file with the last record's separator
                yield _file(group)


def convert(spark, arcs: str, path: str, revisit_from: int = 100) -> str:
    """WARC files of the ARC files in a folder."""
    files = _read(spark, arcs)
    index = write_stage(files.mapInArrow(_arc_index, "archive string, offset long, url string, page_id long, digest string, bytes long"), "arc-index")
    # A file has a bounded number of records, so its marks are a bounded list.
    marks = revisits(index, revisit_from).groupBy("archive").agg(
        F.collect_list(F.struct("offset", "first_archive", "first_offset", "first_url")).alias("marks")
    )
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1))
    marked = named.join(marks, "archive", "left").select("path", "content", "marks")
    return _write(marked.mapInArrow(_convert, "value string"), path, "\r\n\r\n")


def _warc_index(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in read_warc(gzip.decompress(content.as_py())):
                _, body, page_id = _http(block)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
                rows.append((page_id, fields["warc-record-id"], len(body), digest, kind, fields.get("warc-refers-to")))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["page_id", "record_id", "body_bytes", "payload_digest", "record_type", "refers_to_id"],
            )


def read_warcs(spark, path: str) -> DataFrame:
    """``page_id, record_id, body_bytes, payload_digest, record_type, refers_to_id`` of every record in a folder."""
    return _read(spark, path).mapInArrow(
        _warc_index,
        "page_id long, record_id string, body_bytes long, payload_digest string, record_type string, refers_to_id string",
    )


def archive_pages(pages: DataFrame, revisit_from: int = 100) -> DataFrame:
    """Pages through ARC and WARC files and back: a row per page with the columns of the read records.

    A revisit's length and the id that it refers to are those of the response it names.
    """
    spark = pages.sparkSession
    folder = f"{stage_root(spark)}/archives-{uuid.uuid4().hex}"
    arcs = write_arcs(pages, f"{folder}/arc")
    read = write_stage(read_warcs(spark, convert(spark, arcs, f"{folder}/warc", revisit_from)), "warc-index")
    named = read.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    response = (
        read.where("record_type = 'response'")
        .join(named, "record_id", "left_semi")
        .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("body_bytes").alias("full_bytes"))
    )
    return read.join(response, "refers_to_id", "left").select(
        "page_id", F.coalesce("full_bytes", "body_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
