"""WARC archives written from and read into a table of chunks.

A payload is rows (record, chunk_no, data) of at most CHUNK bytes, each with the size and the
SHA-1 of the payload so far; the last row has those of the whole. Writers and readers stream
chunk by chunk, so no task holds an oversized record. Records with equal payloads are written
once; the others are revisits. Archives are files of one gzip member per record. A task
writes under a name of its own and reports it in the manifest, so what a lost task left behind
is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.registry import query, table
from corepart.llm.saving import save_lean
from corepart.store import Store

CHUNK = 1 << 16  # bytes of payload in one row
ROWS = 128  # chunk rows in one Arrow batch
LEAST = 1000  # payload bytes from which equal payloads are revisits
LEVEL = 3  # of gzip
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = pa.schema(
    [
        ("record", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("chunk_no", pa.int64()),
        ("data", pa.binary()),
        ("size", pa.int64()),
        ("sha1", pa.string()),
        ("last", pa.bool_()),
    ]
)
CHUNK_COLUMNS = "record bigint, page_id bigint, url string, chunk_no bigint, data binary, size bigint, sha1 string, last boolean"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def split_chunks(pieces: Iterator[bytes], chunk: int) -> Iterator[tuple[int, bytes, int, str, bool]]:
    """(chunk_no, data, size so far, SHA-1 so far, last) of a payload that comes in any pieces."""
    digest, size, number, rest = hashlib.sha1(), 0, 0, b""

    def row(data: bytes, last: bool) -> tuple[int, bytes, int, str, bool]:
        digest.update(data)
        return number, data, size + len(data), digest.hexdigest(), last

    for piece in pieces:
        rest += piece
        while len(rest) > chunk:  # what is left may be the last
            yield row(rest[:chunk], False)
            size, number, rest = size + chunk, number + 1, rest[chunk:]
    yield row(rest, True)


def chunk_table(pages: DataFrame, payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of every page; a null payload is empty and has one empty chunk.

    `record` numbers the rows of `pages`; it changes from run to run until the table is written.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("bigint"), "url", F.col(payload).alias("payload")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            for batch in batches:
                for record, page, url, body in zip(*batch.columns, strict=True):
                    text = body.as_py() or ""
                    pieces = (text[at : at + chunk].encode("utf-8", "replace") for at in range(0, len(text), chunk))
                    for part in split_chunks(pieces, chunk):
                        yield record.as_py(), page.as_py(), url.as_py(), *part

        yield from _batches(chunks(), CHUNKS)

    return rows.mapInArrow(cut, CHUNK_COLUMNS)


def record_types(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(record, page_id, url, size, sha1, record_type, refers_to, refers_record): one row per record.

    Of equal payloads of at least `least` bytes the greatest (page_id, record) is the response;
    a null page_id is the least. All others are revisits of it. Smaller ones are responses.
    """
    records = chunks.where("last").select("record", "page_id", "url", "size", "sha1")
    keep = (
        records.where(F.col("size") >= least)
        .groupBy("sha1", "size")
        .agg(F.max(F.struct("page_id", "record")).alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("sha1").alias("k_sha1"), F.col("size").alias("k_size"), "keep")
    )
    revisit = F.coalesce(F.col("keep.record") != F.col("record"), F.lit(False))
    return records.join(keep, (F.col("sha1") == F.col("k_sha1")) & (F.col("size") == F.col("k_size")), "left").select(
        *records.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keep.page_id")).alias("refers_to"),
        F.when(revisit, F.col("keep.record")).alias("refers_record"),
    )


def _urn(run: str, record: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{record}').urn}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def header(run: str, row: dict) -> bytes:
    """The WARC header and the HTTP header of a record, from its row of `record_types`."""
    http = HTTP % row["size"]
    revisit = row["record_type"] == "revisit"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _urn(run, row["record"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _field(row["url"] or "")),
        ("WARC-Payload-Digest", f"sha1:{row['sha1']}"),
        ("X-Payload-Length", str(row["size"])),
        ("X-Page-ID", "" if row["page_id"] is None else str(row["page_id"])),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _urn(run, row["refers_record"])),
            ("X-Refers-To-Page", "" if row["refers_to"] is None else str(row["refers_to"])),
        ]
    length = len(http) + (0 if revisit else row["size"])
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(length))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http


def write_archives(chunks: DataFrame, types: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """(archive, records, bytes): write each record to one archive, its chunks in order.

    `folder` is a path or URI that pyarrow.fs can write to and all executors share. One shuffle
    brings a record's header row (chunk -1) and chunks together, sorted; revisits have no chunk.
    """
    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base, recursive=True)
    run = folder.rstrip("/").rsplit("/", 1)[-1]
    about = F.struct("record", "page_id", "url", "size", "sha1", "record_type", "refers_to", "refers_record")
    heads = types.select("record", F.lit(-1).cast("bigint").alias("chunk_no"), about.alias("about"), F.lit(None).cast("binary").alias("data"))
    bodies = chunks.select("record", "chunk_no", F.lit(None).cast(heads.schema["about"].dataType).alias("about"), "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, packer, records, revisit = None, None, 0, False
        for batch in batches:
            for _, number, about, data in zip(*batch.columns, strict=True):
                out = out or files.open_output_stream(name, compression=None)
                if number.as_py() < 0:
                    if packer:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    row = about.as_py()
                    revisit = row["record_type"] == "revisit"
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(header(run, row)))
                    records += 1
                elif not revisit:
                    out.write(packer.compress(data.as_py()))
        if out:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], ["archive", "records", "bytes"])

    rows = heads.unionByName(bodies).repartition("record").sortWithinPartitions("record", "chunk_no")
    return rows.mapInArrow(write, "archive string, records bigint, bytes bigint")


def _fields(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's header fields in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def read_chunks(stream: io.BufferedIOBase, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], tuple]]:
    """(header fields, chunk row) of all records of an archive, never more than a chunk at once."""
    while (fields := _fields(stream)) is not None:
        left = int(fields["content-length"])
        if "application/http" in fields.get("content-type", ""):
            while left and (line := stream.readline()):  # the HTTP header
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break

        def pieces(n: int = left) -> Iterator[bytes]:
            while n:
                piece = stream.read(min(chunk, n))
                if not piece:
                    raise ValueError("the archive ends within a record")
                n -= len(piece)
                yield piece

        for part in split_chunks(pieces(), chunk):
            yield fields, part


READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk_no", pa.int64()),
        ("data", pa.binary()),
        ("size", pa.int64()),
        ("sha1", pa.string()),
        ("last", pa.bool_()),
    ]
)
READ_COLUMNS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint,"
    " chunk_no bigint, data binary, size bigint, sha1 string, last boolean"
)


def read_archives(manifest: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of the records in the archives that the (written) manifest names.

    Size and SHA-1 of responses are those of the bytes read, and the digest of a whole payload
    must be that of its header, else the task fails. A revisit has one row with the size and
    digest of the payload it refers to. `with_data` False leaves the bytes out, but reads them.
    """
    tasks = max(1, manifest.count())

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for archive in batch.column(0).to_pylist():
                    with files.open_input_stream(archive, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                        for fields, (no, data, size, sha1, last) in read_chunks(stream, chunk):
                            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "revisit":
                                size, sha1 = int(fields["x-payload-length"]), digest
                            elif last and sha1 != digest:
                                raise ValueError(f"{archive}: {fields['warc-record-id']} is damaged")
                            yield (
                                fields["warc-record-id"],
                                number(fields.get("x-page-id")),
                                fields.get("warc-target-uri"),
                                kind,
                                number(fields.get("x-refers-to-page")),
                                no,
                                data if with_data else None,
                                size,
                                sha1,
                                last,
                            )

        yield from _batches(rows(), READ)

    return manifest.select("archive").repartition(tasks).mapInArrow(read, READ_COLUMNS)


def archive_pages(pages: DataFrame, store: Store, payload: str = "html") -> tuple[DataFrame, str]:
    """Write pages (page_id, url, payload) as archives: the manifest and the folder of the files.

    An empty table gives an empty manifest. Repeated rows are records of their own.
    """
    chunks = save_lean(store, chunk_table(pages, payload), "chunks")
    types = save_lean(store, record_types(chunks), "types")
    folder = store.path("archives")
    manifest = save_lean(store, write_archives(chunks, types, folder), "manifest")
    store.drop("chunks")
    store.drop("types")
    return manifest, folder


@query(
    "op9_warc_chunks",
    """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM p
""",
)
def op9_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    store = Store(spark, "warc")
    manifest, folder = archive_pages(table(spark, sf, "pages"), store)
    return (
        read_archives(manifest, folder, with_data=False)
        .where("last")
        .select("page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    )
