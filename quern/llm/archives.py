"""Legacy ARC archives: writing, reading, and conversion to WARC with revisit records.

An archive is a gzip file with a member per record, ending in an empty member, of about
``archive_bytes`` at most (a longer record has an archive of its own). Archives are written and
read by Spark itself, so any store that the cluster shares will do.

``convert`` parses ARC records by the header line of the archive's version (1: five fields, 2: ten)
and their declared lengths, and synthesises WARC records: identifiers (name-based UUIDs), timestamps
(from the 14-digit dates), types and digests. Of records with equal payloads of at least
``min_bytes``, the one with the largest page id becomes the response; the others become revisits that
refer to it, without payload. Payloads are never shuffled: what is decided per record comes back as
(archive, offset) rows, broadcast up to ``broadcast_rows`` and joined to the archives beyond.

Defined cases: null html is an empty payload; a null page id is lowest and comes back null; a null
or empty url is written as ``about:blank``, white space in urls is percent-encoded; repeated rows are
records of their own, one of which is the response; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import delete, discard, join_hot, new_path, persist, slices, to_bytes

ARCHIVE_BYTES = 16 << 20
#: The last byte of an empty gzip member, which Spark's writer adds as the end of a line.
END = "\x00"
EMPTY = gzip.compress(b"", 1, mtime=0)
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, page_id long, payload_bytes long, payload_digest string"
RECORD = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, target_uri string, date string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    return gzip.compress(record, 1, mtime=0)


class Inflater:
    """Inflates one member from pieces, so that the rest of the archive isn't copied for each."""

    def __init__(self, view: memoryview, at: int):
        z, parts, start, step = zlib.decompressobj(31), [], at, 1 << 14
        while not z.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(piece))
            at += len(piece)
        self.record, self.taken = b"".join(parts), at - len(z.unused_data) - start


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the gzip members of an archive, the empty last one left out."""
    at, view = 0, memoryview(data)
    while at < len(data):
        got = Inflater(view, at)
        if got.record:
            yield at, got.record
        at += got.taken



# --- ARC -----------------------------------------------------------------------------------------


def arc_file_header(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 quern\n{FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    return f"{line} {len(body)}\n".encode() + body


def arc_record(url: str | None, page_id: int | None, payload: bytes, version: int, date: str, name: str, offset: int) -> bytes:
    url = "%20".join((url or "").split()) or "about:blank"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + payload
    line = f"{url} 0.0.0.0 {date} text/html" + (f" 200 {hashlib.md5(payload).hexdigest()} - {offset} {name}" if version == 2 else "")
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_version(record: bytes) -> int:
    """The version that an archive's first record declares."""
    line, _, body = record.partition(b"\n")
    if not line.startswith(b"filedesc://"):
        raise ValueError("not the first record of an ARC archive")
    return int(body.split(b" ", 1)[0])


def parse_arc(record: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """Header fields and body of a record, by the version's fields and the declared length."""
    line, _, rest = record.partition(b"\n")
    names, values = FIELDS[version].split(" "), line.decode("utf-8", "surrogateescape").split(" ")
    if len(values) != len(names):
        raise ValueError(f"an ARC {version} header line has {len(names)} fields, this one {len(values)}")
    fields = dict(zip(names, values, strict=True))
    length = int(fields["Archive-length"])
    if len(rest) < length:
        raise ValueError("an ARC record is shorter than its declared length")
    return fields, rest[:length]


def split_http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head (with the empty line), payload, and the head's fields."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head + gap, payload, fields


def write_archives(blobs: DataFrame, path: str) -> None:
    """One file per row of the binary column ``archive``, each of which ends with an empty member."""
    body = F.expr("cast(substring(archive, 1, length(archive) - 1) as string)")
    blobs.select(body.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", END).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("archive"), "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20200101000000", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write (page_id, url, html) rows as ARC archives of a version."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, blob, held = TaskContext.get().partitionId(), 0, bytearray(), 0
        for batch in slices(batches, "html"):
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                name = f"{part:06}-{n:04}.arc.gz"
                if not blob:
                    blob += member(arc_file_header(name, version, date))
                record = arc_record(url, page, to_bytes(html), version, date, name, len(blob))
                blob += member(record)
                held += len(record)
                if held >= archive_bytes:
                    yield pa.record_batch([pa.array([bytes(blob) + EMPTY], pa.binary())], names=["archive"])
                    n, blob, held = n + 1, bytearray(), 0
        if blob:
            yield pa.record_batch([pa.array([bytes(blob) + EMPTY], pa.binary())], names=["archive"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    write_archives(rows.mapInArrow(packed, "archive binary"), path)


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, body) of an ARC archive's documents."""
    found = members(content)
    version = arc_version(next(found)[1])
    for offset, record in found:
        yield offset, *parse_arc(record, version)


def arc_index(archives: DataFrame) -> DataFrame:
    """archive, offset, page_id, payload_bytes, payload_digest of every ARC record."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, _, body in arc_records(content.as_py()):
                    _, payload, http = split_http(body)
                    rows.append((name, offset, int(http["X-Page-Id"]) if "X-Page-Id" in http else None, len(payload), digest(payload)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["archive", "offset", "page_id", "payload_bytes", "payload_digest"])

    return archives.mapInArrow(indexed, INDEX)


# --- WARC ----------------------------------------------------------------------------------------


def timestamp(date: str) -> str:
    """A WARC date from an ARC date of up to 14 digits."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def response_id(page_id: int | None, payload_digest: str, place: str) -> str:
    return record_id("response", page_id, payload_digest, place)


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items())
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def to_warc(fields: dict[str, str], body: bytes, place: str, refers: tuple[int | None, str] | None) -> bytes:
    """The WARC record of an ARC one. refers: page id and place of the response that a revisit refers to."""
    head, payload, http = split_http(body)
    page, sha = http.get("X-Page-Id"), digest(payload)
    own = {"WARC-Type": "revisit" if refers else "response", "WARC-Record-ID": record_id("revisit", page, sha, place) if refers else response_id(page, sha, place), "WARC-Date": timestamp(fields["Archive-date"]), "WARC-Target-URI": fields["URL"], "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": f"sha1:{sha}"}
    if refers:
        own |= {"WARC-Profile": PROFILE, "WARC-Refers-To": response_id(refers[0], sha, refers[1])}
    block = head if refers else body
    return warc_record(own | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response"}, block)


def revisits(index: DataFrame, min_bytes: int) -> DataFrame:
    """archive, offset, refers_page, refers_place of the records that repeat another's payload."""
    place = F.concat_ws(":", "archive", F.col("offset").cast("string"))
    rows = index.where(F.col("payload_bytes") >= min_bytes).withColumn("place", place)
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "place")).alias("w")
    groups = persist(rows.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("d"), "w", "n"), "groups")
    return join_hot(rows, groups, {"payload_digest": "d"}, "n").where("place <> w.place").select("archive", "offset", F.col("w.page_id").alias("refers_page"), F.col("w.place").alias("refers_place"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, broadcast_rows: int = 200_000) -> None:
    """Convert a folder of ARC archives to one of WARC archives."""
    archives = read_archives(spark, arc_path)
    index = persist(arc_index(archives), "index")
    repeated = persist(revisits(index, min_bytes), "revisits")
    discard(index)
    per_archive = repeated.groupBy("archive").agg(F.collect_list(F.struct("offset", "refers_page", "refers_place")).alias("found"))  # a bounded archive's records
    if repeated.count() <= broadcast_rows:
        shared = spark.sparkContext.broadcast({r.archive: r.found for r in per_archive.collect()})
        rows = archives
    else:
        shared, rows = None, archives.join(per_archive, "archive", "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, content) in enumerate(zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True)):
                found = shared.value.get(name, ()) if shared else [(x["offset"], x["refers_page"], x["refers_place"]) for x in batch.column("found")[i].as_py() or ()]
                refers = {offset: (page, place) for offset, page, place in found}
                blob = bytearray(member(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", name), "WARC-Date": timestamp(""), "Content-Type": "application/warc-fields"}, b"software: quern\r\nformat: WARC File Format 1.1\r\n")))
                for offset, fields, body in arc_records(content.as_py()):
                    blob += member(to_warc(fields, body, f"{name}:{offset}", refers.get(offset)))
                yield pa.record_batch([pa.array([bytes(blob) + EMPTY], pa.binary())], names=["archive"])

    write_archives(rows.mapInArrow(written, "archive binary"), warc_path)


def warc_index(archives: DataFrame) -> DataFrame:
    """The responses and revisits of WARC archives, one row per record."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for _, record in members(content.as_py()):
                    fields, block = parse_warc(record)
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    _, payload, http = split_http(block)
                    if fields["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    page = http.get("X-Page-Id")
                    rows.append((fields["WARC-Record-ID"], int(page) if page else None, int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"]))
                kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return archives.mapInArrow(indexed, RECORD)


def archive_round_trip(pages: DataFrame, version: int = 1, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the WARC archives."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, version, archive_bytes=archive_bytes)
    convert(spark, arc, warc, min_bytes, broadcast_rows)
    records = persist(warc_index(read_archives(spark, warc)), "records")
    delete(spark, arc, warc)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = records.where("record_type = 'response'")
    found = records.where("record_type = 'revisit'")
    # the responses that revisits refer to, with the number of those
    asked = found.groupBy(F.col("refers_to_id").alias("asked")).agg(F.count("*").alias("n"))
    named = persist(responses.join(asked, F.col("record_id") == F.col("asked")).select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to"), "n"), "referred")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(join_hot(found, named, {"refers_to_id": "id"}, "n").select(*columns))
