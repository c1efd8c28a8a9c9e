"""WARC archives packed in ZIP files: a writer, and a reader that never extracts.

An archive holds two stored members: the records, each a gzip member of its own, and an index line for each
record. The reader fetches a file's end, follows the end record (ZIP64's where there is one) to the central
directory, finds the stored members, reads the index, and then reads ranges of records.

Files are written and read on the executors through pyarrow's file systems, so the folder must be one that all
of them reach; the default is the session's shared folder. Each task writes files under names of its own; only
those in the written list of archives count, so a task that runs again leaves no double records.

Defined cases: a null payload is empty; a null url is written as the record's own id; a null page_id is written
as ``none`` and counts as the largest; rows that repeat the smallest page_id of their payload are responses;
an empty table gives no archive and no record; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import dropped_at_exit, scratch_path, spread, stash

#: Payloads from this size on are written once.
LEAST_SHARED = 100
#: Bytes of records after which a task starts another archive, and that one range read asks for at most (about).
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Bytes of records that a task of the reader reads, about.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

END, END64, LOCATOR64, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a Hadoop-style URI or a plain absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


# --- ZIP ---------------------------------------------------------------------------------------------------


class Member:
    """A directory entry: name, method, size, where its local header starts."""

    def __init__(self, name: str, method: int, size: int, header: int):
        self.name, self.method, self.size, self.header = name, method, size, header


Read = Callable[[int, int], bytes]


def central_directory(read: Read, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes; read(offset, length) gives its bytes."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        where = tail_at + at - 20
        magic, _, end64, _ = struct.unpack("<IIQI", read(where, 20))
        if magic != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read(end64, 56)
        if struct.unpack_from("<I", record)[0] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory = read(offset, length)
    members, at = [], 0
    for _ in range(count):
        magic, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_comment, disk, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if magic != ENTRY:
            raise ValueError("a broken directory entry")
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the fields that do not fit, in this order
                wide, k = extra[4 : 4 + n], 0
                if plain == 0xFFFFFFFF:
                    plain, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if packed == 0xFFFFFFFF:
                    packed, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", wide, k)[0]
            extra = extra[4 + n :]
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_at(read: Read, member: Member) -> int:
    """Where a stored member's bytes start."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; ranges need stored members")
    magic, n_name, n_extra = struct.unpack("<I22xHH", read(member.header, 30))
    if magic != LOCAL:
        raise ValueError("a broken local header")
    return member.header + 30 + n_name + n_extra


# --- WARC --------------------------------------------------------------------------------------------------


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to``, as a gzip member."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else name(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the payload of one plain record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def page_of(name: str | None) -> int | None:
    text = (name or "").strip("<>").rpartition(":")[2]
    return int(text) if text not in ("", "none") else None


# --- operators ---------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the page that holds an equal payload, else null.

    Payloads are compared by SHA-256 over a narrow table; the pages themselves move once.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = stash(pages.select("page_id", F.sha2(body, 256).alias("digest"), F.length(body).alias("n")).where(F.col("n") >= LEAST_SHARED), "digests")
    shared = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    again = digests.join(spread(shared, "digest"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to").distinct()
    full = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))
    return full.join(again, (F.coalesce(F.col("page_id"), F.lit(-1)) == F.coalesce(F.col("again_id"), F.lit(-1))) & F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").drop("again_id", "again_digest")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record; (path, n_records, n_bytes) of the archives.

    Archives in a folder that the caller names stay; the default one is deleted when the program ends, with what
    failed tasks left in it.
    """
    folder = folder or dropped_at_exit(pages.sparkSession, scratch_path(pages.sparkSession, "archives"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        archive = out = sink = None
        index: list[str] = []
        size, path = 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            with archive.open(INDEX, "w") as lines:
                lines.write("".join(index).encode())
            archive.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    path = f"{folder.rstrip('/')}/{name}"
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root.rstrip('/')}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    out = archive.open(RECORDS, "w", force_zip64=True)
                    index, size = [], 0
                record = warc_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(record)
                index.append(json.dumps({"page": row["page_id"], "offset": size, "length": len(record)}) + "\n")
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return stash(with_revisits(pages).mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of records from each archive's index: (path, at, length, lengths of the records)."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, local = open_store(path)
            with store.open_input_file(local) as file:
                read = lambda at, n: file.read_at(n, at)  # noqa: B023, E731
                members = {m.name: m for m in central_directory(read, file.size())}
                first = stored_at(read, members[RECORDS])
                lines = read(stored_at(read, members[INDEX]), members[INDEX].size)
            rows: list[list] = []
            for line in lines.splitlines():
                entry = json.loads(line)
                at = first + entry["offset"]
                if not rows or rows[-1][1] + rows[-1][2] != at or rows[-1][2] + entry["length"] > RANGE_BYTES:
                    rows.append([path, at, 0, []])
                rows[-1][2] += entry["length"]
                rows[-1][3].append(entry["length"])
            for i in range(0, len(rows), 1000):
                some = list(zip(*rows[i : i + 1000]))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(some, kinds)], ["path", "at", "length", "lengths"])


READ = "page_id long, record_type string, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string())
    names = ["page_id", "record_type", "refers_to", "url", "payload", "payload_bytes", "payload_digest"]
    for batch in batches:
        for row in batch.to_pylist():
            store, local = open_store(row["path"])
            with store.open_input_file(local) as file:
                data = file.read_at(row["length"], row["at"])
            rows, at = [], 0
            for n in row["lengths"]:
                fields, payload = parse_record(zlib.decompress(data[at : at + n], 31))
                at += n
                revisit = fields["warc-type"] == "revisit"
                rows.append((page_of(fields["warc-record-id"]), fields["warc-type"], page_of(fields.get("warc-refers-to")), fields["warc-target-uri"], None if revisit else payload, int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the ``archives`` (path, n_bytes); a revisit's payload is null, its size and digest are the full payload's."""
    total = archives.agg(F.sum("n_bytes")).first()[0] or 0
    n_tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    ranges = archives.select("path").mapInArrow(_ranges, "path string, at long, length long, lengths array<long>")
    # ranges are pointers: their own size says nothing about the work, so the number of tasks is fixed here
    return ranges.repartition(n_tasks, "path", "at").mapInArrow(_records, READ)
