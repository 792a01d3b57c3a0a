"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME``
bytes; an archive ends with a skippable frame that holds the seek table (sizes
of every frame, stored and unpacked, then their number, a descriptor byte and
the magic of the seekable format), so any frame can be found and unpacked
alone. An index maps each record's id to archive, frame, and the record's
offset inside the unpacked frame.

Of records with equal payloads of at least ``LEAST`` bytes the one with the
smallest page_id is a response, the others are revisits that refer to it and
store no payload. Smaller payloads are always responses.

A task writes archives of its own, under names that no other attempt of it
uses, to a folder that all executors share; the index rows of the attempt that
counts are committed by Spark's writer, so an attempt that is lost or repeated
leaves files that nothing refers to. Reading goes by what the archives hold:
the seek tables give frames, frames are dealt over all tasks, and a revisit's
payload is fetched by the id it refers to, with one seek to frame and offset.

Defined results: a null html is an empty payload, any other is stored byte by
byte, UTF-8 or not; a null page_id sorts last,
and its record has an id drawn from url and payload; rows that repeat the
smallest page_id of a group are responses each; a null url gives no target
line, line breaks in one are percent-encoded; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, texts_of

LEAST = 100
FRAME = 1 << 20
ARCHIVE = 256 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SPACE = uuid.UUID("6f1d3c52-6c0b-5c54-9a55-4f0c7c2c3b1e")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, str(page_id) if page_id is not None else f'{url}\n{digest}')}"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; ``refers_to`` is the page_id of the response that a revisit repeats."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{record_id(page_id, url, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, None, digest)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = body + int(headers["Content-Length"])
    return headers, data[data.index(b"\r\n\r\n", body) + 4 : end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (stored, unpacked) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, stored, unpacked) of every frame of an open archive."""
    size = f.size()
    f.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * count)
    sizes = struct.iter_unpack("<II", f.read(8 * count))
    out, at = [], 0
    for stored, unpacked in sizes:
        out.append((at, stored, unpacked))
        at += stored
    return out


def _open(path: str):
    """File system and path of an archive, in any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:")
                                  else f"file://{path}")


class _Writer:
    """Archives of one task attempt; ``add`` gives a record's place once its frame is closed."""

    def __init__(self, folder: str, frame: int, archive: int, level: int):
        self.folder, self.frame, self.archive = folder, frame, archive
        self.pack = zstandard.ZstdCompressor(level=level)
        self.file, self.open_rows, self.buffer = None, [], bytearray()

    def add(self, data: bytes, row: tuple) -> list[tuple]:
        out = []
        if self.buffer and len(self.buffer) + len(data) > self.frame:
            out = self.flush()
        self.open_rows.append((*row, len(self.buffer), len(data)))
        self.buffer += data
        return out

    def flush(self) -> list[tuple]:
        if not self.buffer:
            return []
        if self.file is None:
            self.name, self.frames, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", [], 0
            system, path = _open(self.name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.file = system.open_output_stream(path, compression=None)
        packed = self.pack.compress(bytes(self.buffer))
        self.file.write(packed)
        out = [(*row[:-2], self.name, len(self.frames), self.at, len(packed), *row[-2:]) for row in self.open_rows]
        self.frames.append((len(packed), len(self.buffer)))
        self.at += len(packed)
        self.open_rows, self.buffer = [], bytearray()
        if self.at >= self.archive:
            self.close()
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None


INDEX = ("record_id string, page_id long, archive string, frame long, frame_offset long, frame_size long, "
         "record_offset long, record_size long")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, frame: int = FRAME, archive: int = ARCHIVE,
                   level: int = LEVEL) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``; the stored index."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    # only digests are shuffled to find copies; a group of any size is one row
    copies = (p.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
              .select(F.col("digest").alias("_g"), "first"))
    copies = materialize(copies, "warc-copies")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first"))
    rows = p.join(copies, p["digest"] == copies["_g"], "left").select("page_id", "url", "html", "digest", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, frame, archive, level)
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)
        for batch in batches:
            found = []
            ids, url_, payload, *rest = batch.columns
            for page_id, url, html, digest, refers_to in zip(
                    ids.to_pylist(), texts_of(url_), payload.cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in rest)):
                data = record(page_id, url, html, digest, refers_to)
                found += out.add(data, (record_id(page_id, url, digest), page_id))
            if found:
                yield batch_of(found)
        if found := out.flush():
            yield batch_of(found)
        out.close()

    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


READ = "page_id long, record_id string, record_type string, payload_digest string, refers string, payload binary"


def _record_row(headers: dict[str, str], payload: bytes) -> tuple:
    revisit = headers["WARC-Type"] == "revisit"
    page = headers.get("X-Page-ID")
    return (None if page is None else int(page), headers["WARC-Record-ID"].strip("<>"), headers["WARC-Type"],
            headers["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
            headers["WARC-Refers-To"].strip("<>") if revisit else None, None if revisit else payload)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[x.split()[0] for x in READ.split(", ")])


def frames_of(archives: DataFrame) -> DataFrame:
    """(archive, offset, size, unpacked) of every frame, from the archives' seek tables."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = _open(name)
                with system.open_input_file(path) as f:
                    table = read_seek_table(f)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(table), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*table))],
                    names=["archive", "offset", "size", "unpacked"])

    return archives.select("archive").mapInArrow(run, "archive string, offset long, size long, unpacked long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of ``archives`` (archive: path), frame by frame over all tasks."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, offset, size, unpacked in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _open(name)
                with system.open_input_file(path) as f:
                    data = unpack.decompress(f.read_at(size, offset), max_output_size=unpacked)
                found, at = [], 0
                while at < len(data):
                    headers, payload, at = parse(data, at)
                    found.append(_record_row(headers, payload))
                yield _rows(found)

    return frames_of(archives).repartition("archive", "offset").mapInArrow(run, READ)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records named by ``ids`` (record_id), each by a seek to its frame and an offset in it."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        held, data = None, b""
        for batch in batches:
            found = []
            for name, offset, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (name, offset):
                    system, path = _open(name)
                    with system.open_input_file(path) as f:
                        data = unpack.decompressobj().decompress(f.read_at(size, offset))
                    held = (name, offset)
                found.append(_record_row(*parse(data, at)[:2]))
            if found:
                yield _rows(found)

    places = index.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    return (places.select("archive", "frame_offset", "frame_size", "record_offset")
            .repartition("archive", "frame_offset").sortWithinPartitions("archive", "frame_offset").mapInArrow(run, READ))


def archive_folder(spark: SparkSession) -> str:
    """A folder of its own for one run's archives, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def resolved(records: DataFrame, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, each by the record that holds the payload.

    A revisit's target is fetched by its id: ``index`` gives archive, frame and the offset in it.
    """
    lean = materialize(records.select("page_id", "record_id", "record_type", "payload_digest", "refers",
                                      F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-read")
    # one row per referred-to id, however many revisits it has; rows that repeat a page_id share theirs
    targets = lean.where("record_type = 'revisit'").select(F.col("refers").alias("record_id")).distinct()
    held = (fetch(index, targets).groupBy(F.col("record_id").alias("_id"))
            .agg(F.min("page_id").alias("_page"), F.min(F.octet_length("payload").cast("long")).alias("_bytes"),
                 F.min("payload_digest").alias("_digest")))
    held = materialize(held, "warc-targets")   # a table of its own: the join then splits a target of very many revisits
    first = lean.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = (lean.where("record_type = 'revisit'").join(held, F.col("refers") == F.col("_id"), "left")
             .select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type",
                     F.col("_page").alias("refers_to")))
    return first.unionByName(again)
