"""Legacy ARC archives: writing, reading, and conversion to WARC.

An ARC file starts with a version block (``filedesc://``) that tells which
header line its records have: five fields in version 1, ten in version 2. Each
record is that line and as many bytes as its last field declares. Conversion
synthesises what WARC asks for: a record id from archive name and offset, an ISO
time from the 14-digit date, a record type from the address and content, and
SHA-1 digests of block and payload. A record whose payload stands elsewhere
becomes a revisit of the first one.

Archives are streamed record by record inside tasks, so the memory of a task is
bounded by one record. A task writes to a name of its own and renames when
done; a task that runs again writes the same names with the same bytes. Only
files that a finished job lists are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import sorted_groups, written
from quarry.session import scratch_dir

#: Bytes of records after which a task begins its next archive.
ARCHIVE_BYTES = 256 << 20

# Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
UNKNOWN_DATE = "1970-01-01T00:00:00Z"


class ArchiveWriter:
    """Gzip members, one per record, into numbered files of about ``ARCHIVE_BYTES``."""

    def __init__(self, folder: str, stem: str, suffix: str, opening=None):
        self.folder, self.stem, self.suffix, self.opening = folder, stem, suffix, opening
        self.files, self.out, self.done = fs.FileSystem.from_uri(folder)[0], None, []
        self.root = fs.FileSystem.from_uri(folder)[1]
        context = TaskContext.get()
        self.own = context.taskAttemptId() if context else 0

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.records = f"{self.stem}-{len(self.done):04d}{self.suffix}", 0, 0
            self.files.create_dir(self.root, recursive=True)
            self.out = self.files.open_output_stream(f"{self.root}/.{self.name}.{self.own}", compression=None)
            if self.opening:
                self._member(self.opening(self.name))
        self._member(record)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _member(self, record: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(pack.compress(record) + pack.flush())
        self.size += len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            final = f"{self.root}/{self.name}"
            if self.files.get_file_info(final).type != fs.FileType.NotFound:
                self.files.delete_file(final)
            self.files.move(f"{self.root}/.{self.name}.{self.own}", final)
            self.done.append((f"{self.folder}/{self.name}", self.records, self.size))
            self.out = None

    def listing(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in self.done], pa.string()),
                                           pa.array([d[1] for d in self.done], pa.int64()),
                                           pa.array([d[2] for d in self.done], pa.int64())],
                                          names=["path", "records", "bytes"])


LISTING = "path string, records long, bytes long"


def open_archive(path: str):
    files, name = fs.FileSystem.from_uri(path)
    raw = files.open_input_stream(name, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def spread(archives: DataFrame) -> DataFrame:
    """The listing with a task for each archive."""
    return archives.repartition(max(1, archives.count()))


def listed(spark: SparkSession, folder: str, pattern: str = "*.arc*") -> DataFrame:
    """(path) of the archives of a folder, listed by Spark without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 quarry\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = ["text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return f"filedesc://{name} 0.0.0.0 {date} {' '.join(tail)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, name: str) -> bytes:
    url = re.sub(r"\s", "%20", url or "about:blank")
    fields = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return f"{' '.join(fields)} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """Write ``page_id, url, html`` as HTTP responses into ARC files, versions 1 and 2 by turns; returns their listing.

    NULL html is an empty payload, a NULL address becomes about:blank; the
    page's id goes into the HTTP header ``X-Page-Id``.
    """
    folder = scratch_dir(pages.sparkSession, "arc")

    def run(batches):
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        writer = ArchiveWriter(folder, f"legacy-{part:06d}", ".arc.gz", lambda n: version_block(version, n, date))
        for batch in batches:
            for i, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = h or b""
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n"
                        f"X-Page-Id: {i}\r\n\r\n").encode()
                writer.write(arc_record(version, u, date, head + body, "page"))
        yield writer.listing()

    return written(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, LISTING),
                   "arcs")


def arc_records(stream) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, block) of every record after the version block.

    The version block decides how many fields a header line has; they are taken
    from the right, so an address with blanks stays whole. Blank lines between
    records are passed over. A line with too few fields or a length that is no
    number, or a block that ends early, raises ValueError.
    """
    at, fields, opened = 0, ARC_FIELDS[1], False
    while True:
        line = stream.readline()
        if not line:
            return
        start, at = at, at + len(line)
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        # only the first record of a file is a version block; later ones are pages, whatever their address
        first, opened = not opened and text.startswith("filedesc://"), True
        names = fields
        if first and len(text.split(" ")) >= len(ARC_FIELDS[2]):
            names = ARC_FIELDS[2]
        values = text.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {start}: {text[:200]!r}")
        length = int(values[-1])
        block = stream.read(length)
        while len(block) < length and (more := stream.read(length - len(block))):
            block += more
        if len(block) < length:
            raise ValueError(f"the record at byte {start} declares {length} bytes and has {len(block)}")
        at += length
        header = dict(zip(names, values))
        if first:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = ARC_FIELDS[version]
            header["version"] = str(version)
        yield start, header, block


def warc_date(date: str) -> str:
    """ISO time of a 14-digit date; shorter ones are filled up, others give the epoch."""
    if not re.fullmatch(r"[0-9]{4,14}", date) or len(date) % 2:
        return UNKNOWN_DATE
    d = date + "00000101000000"[len(date):]
    if not ("01" <= d[4:6] <= "12" and "01" <= d[6:8] <= "31" and d[8:10] < "24" and d[10:12] < "60" and d[12:] < "61"):
        return UNKNOWN_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(path: str, offset: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"arc:{path.rsplit('/', 1)[-1]}:{offset}").urn


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes, bool]:
    """HTTP head with its blank line, payload, and whether there is a head."""
    if block.startswith(b"HTTP/"):
        end = re.search(rb"\r?\n\r?\n", block)
        if end:
            return block[:end.end()], block[end.end():], True
    return b"", block, False


def http_number(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(-?[0-9]+)[ \t]*\r?$", head)
    return int(found[1]) if found else None


def index_arc(archives: DataFrame, order_header: str = "X-Page-Id") -> DataFrame:
    """One row per record: where it is, its WARC identity, and size and digest of its payload."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                cols = [[] for _ in range(8)]
                with open_archive(path) as stream:
                    for offset, h, block in arc_records(stream):
                        if "version" in h:
                            continue
                        head, payload, _ = split_http(block)
                        for c, v in zip(cols, (path, offset, record_id(path, offset), h["URL"],
                                               warc_date(h["Archive-date"]), http_number(head, order_header.encode()),
                                               digest(payload), len(payload))):
                            c.append(v)
                        if len(cols[0]) == 4096:
                            yield _rows(cols)
                            cols = [[] for _ in range(8)]
                yield _rows(cols)

    return spread(archives.select("path")).mapInArrow(run, INDEX)


INDEX = "path string, offset long, id string, uri string, date string, ord long, digest string, payload long"


def _rows(cols) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=[x.split()[0] for x in INDEX.split(", ")])


def warc_record(kind: str, rid: str, uri: str, date: str, content_type: str, block: bytes, extra: list) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}",
             *([f"WARC-Target-URI: {uri}"] if uri else []), *(f"{k}: {v}" for k, v in extra),
             f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Type: {content_type}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def to_warc(path: str, offset: int, h: dict, block: bytes, first: tuple | None) -> bytes:
    """The WARC record of an ARC record; ``first`` is (id, uri, date) of the record it repeats, if any."""
    rid, uri, date = record_id(path, offset), h["URL"], warc_date(h["Archive-date"])
    if "version" in h:
        note = f"software: quarry\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {h['version']}\r\n".encode()
        return warc_record("warcinfo", rid, "", date, "application/warc-fields", note,
                           [("WARC-Filename", uri.removeprefix("filedesc://"))])
    head, payload, http = split_http(block)
    extra = [("WARC-IP-Address", h["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if first is not None:
        extra += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{first[0]}>"),
                  ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", first[2])]
        return warc_record("revisit", rid, uri, date, "application/http; msgtype=response", head, extra)
    if http:
        return warc_record("response", rid, uri, date, "application/http; msgtype=response", block, extra)
    return warc_record("resource", rid, uri, date, h["Content-type"], block, extra)


def convert(archives: DataFrame, revisits: bool = True) -> DataFrame:
    """Convert the listed ARC files to WARC files, one to one; returns the listing of the WARC files.

    Of records with equal payloads the first one, by ``X-Page-Id`` and then by
    place, keeps the payload; the others become revisits of it. An archive is
    named once in ``archives``. Without archives there is no file and no row.
    """
    spark = archives.sparkSession
    folder = scratch_dir(spark, "warc")
    index = written(index_arc(archives), "index")
    order = F.struct(F.col("ord").isNull().alias("z"), "ord", "path", "offset", "id", "uri", "date")
    firsts = (index.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n"))
              .where(F.lit(revisits) & (F.col("n") > 1)).select("digest", "f"))
    again = (index.select("path", "offset", "id", "digest").join(firsts, "digest").where("id <> f.id")
             .select("path", "offset", F.col("f.id").alias("rid"), F.col("f.uri").alias("ruri"),
                     F.col("f.date").alias("rdate")))
    # one leading row for each archive, so that archives without revisits are converted too
    work = again.unionByName(archives.select("path", F.lit(-1).cast("long").alias("offset"),
                                             *(F.lit(None).cast("string").alias(c) for c in ("rid", "ruri", "rdate"))))

    def run(batches):
        for group in sorted_groups(batches, ["path"]):
            for lo, hi in zip(group["__start"], np.r_[group["__start"][1:], len(group["path"])]):
                path = group["path"][lo]
                first = {int(group["offset"][i]): tuple(group[c][i] for c in ("rid", "ruri", "rdate"))
                         for i in range(lo, hi)}
                stem = re.sub(r"\.arc(\.gz)?$", "", path.rsplit("/", 1)[-1])
                writer = ArchiveWriter(folder, stem, ".warc.gz")
                with open_archive(path) as stream:
                    for offset, h, block in arc_records(stream):
                        writer.write(to_warc(path, offset, h, block, first.get(offset)))
                yield writer.listing()

    return written(work.repartition(max(1, archives.count()), "path").sortWithinPartitions("path", "offset").mapInArrow(run, LISTING), "warcs")


def warc_records(stream) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of every WARC record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:80]!r}")
        header = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            header[name.strip()] = value.strip()
        block = stream.read(int(header["Content-Length"]))
        if len(block) < int(header["Content-Length"]):
            raise ValueError(f"record {header.get('WARC-Record-ID')} ends early")
        yield header, block


WARC_ROW = ("id string, type string, uri string, date string, refers string, payload_digest string, "
            "payload_bytes long, page_id long, intact boolean")


def read_warc(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of all records but warcinfo; ``intact``: the digests in the header are those of the bytes read.

    ``payload_bytes`` is the size of the full payload, which a revisit keeps in
    its HTTP header; with ``payloads``, the bytes themselves (none in revisits).
    """
    schema = WARC_ROW + (", payload binary" if payloads else "")

    def run(batches):
        def rows(cols):
            kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * payloads
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=[x.split()[0] for x in schema.split(", ")])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                cols = [[] for _ in range(9 + payloads)]
                with open_archive(path) as stream:
                    for h, block in warc_records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, payload, _ = split_http(block)
                        revisit = h["WARC-Type"] == "revisit"
                        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        intact = (h["WARC-Block-Digest"] == f"sha1:{digest(block)}"
                                  and (revisit or said == digest(payload)))
                        values = [h["WARC-Record-ID"].strip("<>"), h["WARC-Type"], h.get("WARC-Target-URI"),
                                  h["WARC-Date"], h.get("WARC-Refers-To", "").strip("<>") or None, said,
                                  http_number(head, b"Content-Length") if revisit else len(payload),
                                  http_number(head, b"X-Page-Id"), intact]
                        for c, v in zip(cols, values + ([payload] if payloads else [])):
                            c.append(v)
                        if len(cols[0]) == (64 if payloads else 4096):
                            yield rows(cols)
                            cols = [[] for _ in range(9 + payloads)]
                yield rows(cols)

    return spread(archives.select("path")).mapInArrow(run, schema)


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Write pages as ARC, convert to WARC, read back: one row per page with its record's facts.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Page ids
    are unique; NULL html is an empty payload, and empty payloads are equal ones
    too. Extra columns are ignored; an empty table gives an empty result.
    """
    warcs = convert(write_arc(pages.select("page_id", "url", "html")))
    rows = written(read_warc(warcs), "records")
    target = rows.where("type <> 'revisit'").select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"))
    revisits = rows.where("type = 'revisit'").join(target, "refers", "left")
    rest = rows.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return revisits.unionByName(rest).select("page_id", "payload_bytes", "payload_digest",
                                             F.col("type").alias("record_type"), "refers_to", "intact")
