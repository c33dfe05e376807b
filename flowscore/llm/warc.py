"""WARC archives of pages: writing, gzip normalising with an offset index, reading.

``write_archives`` makes archives that are one gzip stream each, as many crawls
leave them. ``normalise`` inflates each stream once, writes every record as a
gzip member of its own and a sidecar with the offset of each member, so that
``read_records`` can fetch any record by itself.

Files go to the folder given (any store pyarrow's file systems name: local,
hdfs, s3, gcs), under a task's own name first and renamed when complete, so a
task that runs again replaces its files.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm.scratch import BATCH_BYTES, bounded_batches, delete_folder, discard, returning, stored
from flowscore.session import run_path

REVISIT_BYTES = 100
# Payload bytes after which a task begins the next archive.
ARCHIVE_BYTES = 64 << 20
_PIECE = 1 << 20
_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "<>")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "archive string, offset bigint, length bigint, record_id string, record_type string"
RECORD_SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, html string, archive string, offset bigint"
)


class _Output:
    """A file that gets its name only when it is complete."""

    def __init__(self, path: str) -> None:
        self.files, self.path = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        self.draft = f"{self.path}.{context.taskAttemptId()}.draft"
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.files.open_output_stream(self.draft, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        if self.files.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.draft, self.path)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str
) -> bytes:
    """One WARC record, a response with its payload or a revisit without it."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=_PRINTABLE)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    fields = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in fields}


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members, piece by piece."""
    inflate = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield inflate.decompress(piece, _PIECE)
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece = inflate.unused_data
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes; holds one record at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(parse_head(bytes(held[:end]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def with_origins(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: the page that a repeated payload is read from.

    Payloads (null is empty) of at least REVISIT_BYTES bytes that occur again
    refer to the smallest page_id that has them; it, and all rows that repeat
    that page_id, do not.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), html.alias("html"))
    # Smaller payloads get a key of their own: nothing joins it, no task gathers them.
    digest = F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha2("html", 256))
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string"))
    rows = rows.withColumn("digest", F.coalesce(digest, own))
    origins = (
        rows.where("digest NOT LIKE '-%'")
        .groupBy("digest")
        .agg(F.min("page_id").alias("origin"), F.max("page_id").alias("last"))
        .where("origin < last")
        .select("digest", "origin")
    )
    joined = rows.join(origins, "digest", "left")
    refers_to = F.when(F.col("page_id") > F.col("origin"), F.col("origin"))
    return joined.select("page_id", "url", "html", refers_to.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6
) -> DataFrame:
    """Write a record for each row of ``pages``; the archives' paths, stored."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, packed, size, paths = None, None, 0, []
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    paths.append(f"{folder}/part-{part:06d}-{len(paths):04d}.warc.gz")
                    out, packed, size = _Output(paths[-1]), zlib.compressobj(level, wbits=31), 0
                payload = html.as_py().encode()
                record = record_bytes(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), date)
                out.write(packed.compress(record))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    out.write(packed.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packed.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["archive"])

    return stored(with_origins(pages).mapInArrow(run, "archive string"), "archives")


def _by_archive(rows: DataFrame) -> DataFrame:
    """Rows dealt by archive, over as many tasks as there are archives.

    The rows are small and the files behind them are not, so the number is
    given: left to itself, Spark would put them all into one task.
    """
    count = rows.select("archive").distinct().count()
    return rows.repartition(max(1, count), "archive")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive with a gzip member per record; the sidecars' rows, stored.

    Beside each new archive ``x.warc.gz`` a text file ``x.index`` has one json
    line per record: archive, offset and length of its member, id and type.
    """

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                files, path = pafs.FileSystem.from_uri(source)
                target = f"{folder}/{path.rsplit('/', 1)[1]}"
                rows, offset, out = [], 0, _Output(target)
                with files.open_input_stream(path, compression=None) as stream:
                    pieces = iter(lambda stream=stream: stream.read(_PIECE), b"")
                    for record in split_records(inflated(pieces)):
                        pack = zlib.compressobj(level, wbits=31)
                        member = pack.compress(record) + pack.flush()
                        head = parse_head(record[: record.find(b"\r\n\r\n")])
                        rows.append((target, offset, len(member), head["warc-record-id"], head["warc-type"]))
                        out.write(member)
                        offset += len(member)
                out.close()
                names = ["archive", "offset", "length", "record_id", "record_type"]
                sidecar = _Output(target.removesuffix(".warc.gz") + ".index")
                for row in rows:
                    sidecar.write(json.dumps(dict(zip(names, row, strict=True))).encode() + b"\n")
                sidecar.close()
                if rows:
                    columns = [pa.array(column) for column in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored(_by_archive(archives).mapInArrow(run, INDEX_SCHEMA), "index")


def read_sidecars(spark, folder: str) -> DataFrame:
    """The offset index of a folder of normalised archives, from its sidecar files."""
    files = spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.index")
    return files.json(folder)


@returning
def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of RECORD_SCHEMA for rows of the index; they end after BATCH_BYTES of payload."""
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        values = zip(*rows, strict=True) if rows else [[]] * len(names)
        columns = [pa.array(column, kind) for column, kind in zip(values, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    opened = (None, None)
    for batch in batches:
        rows, held = [], 0
        columns = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
        for archive, offset, length in zip(*columns, strict=True):
            if opened[0] != archive:
                files, path = pafs.FileSystem.from_uri(archive)
                opened = (archive, files.open_input_file(path))
            opened[1].seek(offset)
            record = zlib.decompress(opened[1].read(length), 31)
            head, block = record.split(b"\r\n\r\n", 1)
            field = parse_head(head)
            payload = block[: int(field["content-length"])].split(b"\r\n\r\n", 1)[1]
            digest = hashlib.sha256(payload).hexdigest()
            stated = field["warc-payload-digest"].removeprefix("sha256:")
            size, html = len(payload), payload.decode()
            page = field["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
            origin = field.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
            held += size
            if field["warc-type"] == "revisit":
                size, digest, html = int(field["warc-payload-length"]), stated, None
            elif digest != stated:
                raise ValueError(f"payload of {page} in {archive} differs from its digest")
            page_id = None if page == "none" else int(page)
            rows.append(
                (page_id, field["warc-target-uri"], size, digest, field["warc-type"],
                 int(origin) if origin else None, html, archive, offset)
            )
            if held >= BATCH_BYTES:
                yield made(rows)
                rows, held = [], 0
        yield made(rows)


def read_records(index: DataFrame) -> DataFrame:
    """Records of RECORD_SCHEMA by the offsets of the index, each member by itself.

    Length and digest are counted over the payload read; a revisit has none, so
    for it they are those its head states, and ``html`` is null.
    """
    placed = _by_archive(index.select("archive", "offset", "length"))
    return placed.sortWithinPartitions("archive", "offset").mapInArrow(_records, RECORD_SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``), normalise the archives, read them back.

    One record for each row, repeated rows included. Null html is empty, a null
    url is ``about:blank``, a null page_id is named ``none`` and read as null;
    such a row refers to no page and no page to it. Other columns are ignored;
    an empty table gives no rows. Characters that a WARC head cannot hold are
    percent-encoded in the url.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = run_path(spark, "warc")
    raw = write_archives(pages, f"{folder}/raw")
    index = normalise(raw, f"{folder}/members")
    discard(raw)
    delete_folder(spark, f"{folder}/raw")
    if index.isEmpty():
        return read_records(index)
    return read_records(read_sidecars(spark, f"{folder}/members"))
