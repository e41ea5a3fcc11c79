"""WARC archives compressed with Zstandard: one frame for each record, and a dictionary before the first.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, plain or itself compressed. Archives are written
by Spark's own text writer, so that they can be on any file system and a lost task is simply run again: a record is a row whose
string holds the bytes of its frame, and the line separator is an empty skippable frame, which every
reader of the format passes over. The writer begins a file after RECORDS rows, and so does an archive; one that gets large
is filled up with empty rows. They are read as whole binary files, archives of other writers too.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, discard, need, shared_dir

# Fixed values of the formats.
DICTIONARY_MAGIC, FIRST_SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, b"\x28\xb5\x2f\xfd"
SEPARATOR = struct.pack("<II", FIRST_SKIPPABLE, 0)
#: Revisits are made for payloads of at least this size.
LEAST = 100
#: A dictionary is trained from so many bytes of the first pages of an archive.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
#: Rows of an archive, the dictionary's included, and the bytes after which it gets no further record.
RECORDS, ARCHIVE_BYTES = 4096, 512 << 20
#: Equal payloads are dealt to so many groups, as any one may be that of a large share of the pages.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"


def _plain(value: str | None) -> str | None:
    """A header value without line breaks and other controls."""
    return None if value is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{kind}/{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _plain(url)),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Refers-To-Page-ID", refers_to),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of archives, RECORDS each: the dictionary, and the frames of records. Nothing where the partition is empty."""

    def frames(rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])

    held: list[bytes] = []
    compressor, rows, written, size = None, 0, 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal compressor, rows, written
        if compressor is None:
            try:
                words = zstandard.train_dictionary(DICTIONARY_BYTES, held)
            except zstandard.ZstdError:  # too few records to train from: the first one itself
                words = zstandard.ZstdCompressionDict(held[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data = words.as_bytes()
            compressor = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
            rows, written = 1, len(data)
            yield frames([struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data])
        done = [compressor.compress(x) for x in held]
        rows += len(done)
        written += sum(map(len, done))
        yield frames(done)
        if written > ARCHIVE_BYTES and rows < RECORDS:
            yield frames([b""] * (RECORDS - rows))
            rows = RECORDS
        if rows == RECORDS:
            compressor, rows = None, 0

    for batch in batches:
        columns = batch.to_pydict()
        for page_id, url, payload, digest, kind, refers_to in zip(*(columns[c] for c in ("page_id", "url", "payload", "digest", "kind", "refers_to"))):
            row = record(page_id, url, payload, digest, kind, refers_to)
            held.append(row)
            size += len(row)
            if size > SAMPLE_BYTES or max(1, rows) + len(held) == RECORDS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> None:
    """Writes a record for every row of pages as archives under path, one or more for each task.

    A null html is an empty payload. Of rows with equal payloads of at least `least` bytes those with the smallest id are
    responses and the others revisits without payload; rows with a null id are revisits if any row has an id, else responses.
    Repeated rows each get a record.
    """
    rows = need(pages, id_col, url_col, html_col).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Counted and reduced before the shuffle; only digests that more than one page has are joined.
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))
    frames = rows.mapInArrow(_archive, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(path)


class Broken(ValueError):
    """An archive or a record that isn't as the format says."""


def split_frames(data: bytes) -> tuple[bytes | None, list[bytes]]:
    """The dictionary, if the archive begins with one, and the frames of its records."""
    place, dictionary, frames = 0, None, []
    while place < len(data):
        if len(data) - place < 8:
            raise Broken(f"{len(data) - place} bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, place)
        if magic & 0xFFFFFFF0 == FIRST_SKIPPABLE:
            if place + 8 + size > len(data):
                raise Broken("a skippable frame that is cut short")
            if magic == DICTIONARY_MAGIC:
                if place:
                    raise Broken("a dictionary after the first frame")
                dictionary = data[8 : 8 + size]
            place += 8 + size
            continue
        if data[place : place + 4] != FRAME:
            raise Broken(f"no frame at byte {place}")
        end = place + _frame_length(data, place)
        if end > len(data):
            raise Broken("a frame that is cut short")
        frames.append(data[place:end])
        place = end
    return dictionary, frames


def _frame_length(data: bytes, place: int) -> int:
    """Bytes of the frame: header, blocks by their own sizes, checksum."""
    flags = data[place + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at = place + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise Broken("a frame that is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * checksum - place


def parse(data: bytes) -> dict:
    """Headers and payload of a record, checked: version, needed fields, lengths and digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise Broken("a header that isn't UTF-8") from e
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Broken("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken(f"a header line without colon: {line[:40]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Broken(f"no {name}")

    def number(name: str) -> int | None:
        value = fields.get(name)
        if value is not None and not re.fullmatch("-?[0-9]{1,19}", value):
            raise Broken(f"{name} is no number: {value[:40]}")
        return None if value is None else int(value)

    length = number("content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Broken(f"a block of {max(0, len(rest) - 4)} bytes, not {length}")
    block = rest[:length]
    if (want := fields.get("warc-block-digest", "")).startswith("sha256:") and want[7:] != hashlib.sha256(block).hexdigest():
        raise Broken("the block's digest is another")
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)
    if fields["warc-type"] == "response":
        if not gap or said and int(said[1]) != len(payload):
            raise Broken("the payload's length is another")
        if (want := fields.get("warc-payload-digest", "")).startswith("sha256:") and want[7:] != hashlib.sha256(payload).hexdigest():
            raise Broken("the payload's digest is another")
    return {
        "page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": number("warc-refers-to-page-id"), "payload": payload if fields["warc-type"] == "response" else None,
    }


def dictionary_of(data: bytes | None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary, which may be a compressed frame itself."""
    if not data:
        return None
    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def records(data: bytes) -> Iterator[dict]:
    """The records of an archive. Errors say which frame they are in."""
    number = 0
    try:
        dictionary, frames = split_frames(data)
        reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary))
        for number, frame in enumerate(frames, 1):
            stream = reader.decompressobj()  # frames may lack the size of their content
            row = parse(stream.decompress(frame))
            yield row | {"payload_bytes": None if row["payload"] is None else len(row["payload"])}
    except (Broken, zstandard.ZstdError) as e:
        raise Broken(f"frame {number}: {e}" if number else str(e)) from e


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64()}
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), as_bytes(batch.column("content"))):
            try:
                rows = records(data)
                while some := list(islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in kinds.items()], names=list(kinds))
            except Broken as e:
                raise Broken(f"{path}: {e}") from e


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, payload, payload_bytes) for every record of the archives under path, whatever their names.

    Revisits have no payload; the digest is that of the full one. Records of other writers have a null page_id. An archive that is cut short, a header
    that lacks a field or isn't as it should be, or a length or digest that differs raises, with the file and the frame's number. An archive of no records gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary, payload_bytes long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives into the shared folder, reads them, and gives revisits the size of the payload that they refer to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    rows = cut(read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    full = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")).distinct()
    out = rows.where("record_type = 'revisit'").join(full, ["refers_to", "payload_digest"], "left")
    out = out.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    discard(spark, path)
    return rows.where("record_type <> 'revisit'").unionByName(out)
