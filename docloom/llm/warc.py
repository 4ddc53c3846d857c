"""WARC archives: records written as monolithic gzip streams, normalised, and read by offset.

1. ``write_streams`` writes records as WARC text through Spark's text sink, compressed: each file
   is one gzip stream over all its records.
2. ``normalise`` inflates each such file once, front to back, and writes every record as a gzip
   member of its own, with an offset index beside it (one line a record: id, offset, length).
3. ``read_records`` takes the index and reads member by member.

Files are replaced as a whole under their final name, so a task that runs again after a loss ends
in the same files.  Files are bounded by ``RECORDS_PER_FILE``; a task holds one compressed file
and one record.

Defined cases: a null payload is empty; pages with equal payloads under ``LEAST_REVISIT`` bytes
are all responses; pages without an id are responses and name no original; several pages with the
least id of a payload are all responses.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise, new_folder

Batches = Iterator[pa.RecordBatch]

LEAST_REVISIT = 100
RECORDS_PER_FILE = 2000
LEVEL = 6

# --- fixed values: the WARC format ----------------------------------------------
VERSION = "WARC/1.1"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and size of each page, and what kind of record it becomes."""
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    known = known.withColumn("digest", F.sha2("payload", 256)).withColumn(
        "size", F.octet_length("payload").cast("long")
    )
    originals = (
        known.where(F.col("size") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
        .select("digest", "original")
    )
    return known.join(originals, "digest", "left").withColumn(
        "original", F.when(F.col("page_id") > F.col("original"), F.col("original"))
    )


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))


def _page_uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\r\n]+", " ")


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """A planned record as WARC text without the closing blank lines."""
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("payload"))
    nothing = F.lit("")
    return F.concat(
        F.lit(VERSION + LINE),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(_header("WARC-Record-ID", _page_uri(F.col("page_id"))), nothing),
        F.coalesce(_header("WARC-Target-URI", _one_line(F.col("url"))), nothing),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, _header("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(nothing),
        F.coalesce(_header("WARC-Refers-To", _page_uri(F.col("original"))), nothing),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(LINE),
        body,
    )


def write_streams(records: DataFrame, folder: str) -> None:
    """Planned records as whole-file gzip streams."""
    (
        records.select(record_text().alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(folder)
    )


class Inflated:
    """Front-to-back reading of a gzip stream, one record at a time."""

    def __init__(self, compressed: bytes):
        self.compressed, self.at = compressed, 0
        self.stream, self.pending = zlib.decompressobj(wbits=31), b""
        self.held = bytearray()

    def more(self) -> bool:
        """Inflate the next piece; where the file has a further member, a new stream goes on."""
        while True:
            if self.stream.eof:
                self.stream, self.pending = zlib.decompressobj(wbits=31), self.stream.unused_data
            piece, self.pending = self.pending, b""
            if not piece:
                piece = self.compressed[self.at : self.at + (1 << 14)]
                self.at += len(piece)
            if not piece:
                return False
            if got := self.stream.decompress(piece):
                self.held += got
                return True

    def record(self) -> tuple[dict[str, str], bytes, bytes] | None:
        """Headers, payload and whole bytes of the next record."""
        gap = (LINE + LINE).encode()
        while (end := self.held.find(gap)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        headers = parse_headers(bytes(self.held[:end]))
        start = end + len(gap)
        stop = start + int(headers["Content-Length"])
        while len(self.held) < stop + len(RECORD_END):
            if not self.more():
                raise ValueError("the archive ends within a record")
        whole = bytes(self.held[: stop + len(RECORD_END)])
        del self.held[: stop + len(RECORD_END)]
        return headers, whole[start:stop], whole


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split(LINE)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:])


def _replace(path: str, parts: Iterator[bytes], attempt: str) -> None:
    """Write a file beside its final name and move it there."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_output_stream(f"{name}.{attempt}", compression=None) as out:
        for part in parts:
            out.write(part)
    system.move(f"{name}.{attempt}", name)


def normalise(streams: str, folder: str, spark) -> DataFrame:
    """Rewrite the archives below ``streams`` into ``folder``; one row (archive, index, records) a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(streams).select("path", "content")

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py().rsplit("/", 1)[1].split(".")[0]
                archive, index = f"{folder}/{name}.warc.gz", f"{folder}/{name}.index"
                source, lines = Inflated(content.as_py()), []

                def members(source=source, lines=lines) -> Iterator[bytes]:
                    offset = 0
                    while (record := source.record()) is not None:
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(record[2]) + packer.flush()
                        lines.append(
                            json.dumps(
                                {"id": record[0].get("WARC-Record-ID"), "offset": offset, "length": len(member)}
                            )
                        )
                        offset += len(member)
                        yield member

                _replace(archive, members(), attempt)
                _replace(index, iter(["\n".join(lines).encode()]), attempt)
                yield pa.RecordBatch.from_pydict({"archive": [archive], "index": [index], "records": [len(lines)]})

    _make_folder(folder)
    return materialise(files.mapInArrow(run, "archive string, index string, records long"), "warc-manifest")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(folder: str, spark) -> DataFrame:
    """All records of normalised archives, each inflated by its entry in the offset index."""
    entries = (
        spark.read.format("text")
        .option("pathGlobFilter", "*.index")
        .load(folder)
        .select(
            F.regexp_replace(F.input_file_name(), "\\.index$", ".warc.gz").alias("archive"),
            F.from_json("value", "id string, offset long, length long").alias("entry"),
        )
        .select("archive", "entry.offset", "entry.length")
    )

    def run(batches: Batches) -> Batches:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive not in opened:
                    for file in opened.values():
                        file.close()
                    system, name = fs.FileSystem.from_uri(archive)
                    opened = {archive: system.open_input_file(name)}
                member = opened[archive].read_at(length, offset)
                rows.append(_record_row(zlib.decompress(member, wbits=31)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, type=kind) for column, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                if rows
                else [pa.array([], type=kind) for kind in _KINDS],
                names=[part.split()[0] for part in RECORD.split(", ")],
            )

    return entries.mapInArrow(run, RECORD)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _page_of(uri: str | None) -> int | None:
    return int(uri.removeprefix("<urn:page:").removesuffix(">")) if uri else None


def _record_row(record: bytes) -> tuple:
    block, _, rest = record.partition((LINE + LINE).encode())
    headers = parse_headers(block)
    return (
        _page_of(headers.get("WARC-Record-ID")),
        int(headers["X-Payload-Length"]),
        headers["WARC-Payload-Digest"].removeprefix("sha256:"),
        headers["WARC-Type"],
        _page_of(headers.get("WARC-Refers-To")),
        rest[: int(headers["Content-Length"])],
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages, normalise the archives, and read the records back."""
    spark = pages.sparkSession
    streams, folder = new_folder(spark, "warc-streams"), new_folder(spark, "warc")
    write_streams(plan_records(pages), streams)
    normalise(streams, folder, spark)
    return read_records(folder, spark)


def _make_folder(folder: str) -> None:
    system, name = fs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)
