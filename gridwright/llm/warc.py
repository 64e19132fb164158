"""Web archives of a sheet's rows: Zstandard-compressed WARC files with a shared dictionary.

An archive is one file: a leading skippable frame with the dictionary, then a
Zstandard frame for every record. Between frames stand empty skippable frames,
which decoders pass over; Spark's text writer puts them there as line ends, so
archives are written by Spark's own commit protocol to any file system.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import bounded, named, stored

# Fixed values of the file formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTANDARD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
ADDRESS_SAFE = "".join(map(chr, range(0x21, 0x7F)))

#: Rows and leading characters of each from which the dictionary is made.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 32 << 10


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; empty where they are too few or too short to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(row_id, address: str | None, payload: bytes, length: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:row:{'' if row_id is None else row_id}>"), ("WARC-Date", date)]
    if address is not None:
        head.append(("WARC-Target-URI", quote(address, safe=ADDRESS_SAFE)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head.append(("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:row:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("ascii")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that begins at ``at``, from its block headers alone."""
    head = data[at:at + 18]
    end = at + zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[end:end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * zstandard.get_frame_parameters(head).has_checksum
    if end > len(data):
        raise ValueError(f"archive is cut off in the frame at byte {at}")
    return end


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    data, at, plain = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
            if end > len(data):
                raise ValueError("archive is cut off in a skippable frame")
            if magic == DICTIONARY_FRAME and at == 0 and end > at + 8:
                content = bytes(data[at + 8:end])
                if int.from_bytes(content[:4], "little") == ZSTANDARD_FRAME:
                    content = plain.decompress(content)
                plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at = end
        elif magic == ZSTANDARD_FRAME:
            end = frame_end(data, at)
            yield plain.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame begins at byte {at}")


def parse_record(raw: bytes) -> tuple[str, str | None, int, str, str, str | None, bytes]:
    """Row id, address, payload length and digest, record type, referred row and payload of a checked record."""
    top, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.split(b"\r\n")
    if version != VERSION or not found:
        raise ValueError(f"not a {VERSION.decode()} record: {raw[:40]!r}")
    head = {k.lower(): v for k, _, v in (line.decode("ascii").partition(": ") for line in lines)}
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - set(head)
    if missing or len(head) != len(lines):
        raise ValueError(f"record lacks {sorted(missing)} or repeats a header")
    size = int(head["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {head['warc-record-id']} does not have the {size} bytes it says")
    if head["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"block of {head['warc-record-id']} does not match its digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")]
    if not found or len(lengths) != 1:
        raise ValueError(f"record {head['warc-record-id']} has no complete HTTP header")
    digest, kind, refers = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], head.get("warc-refers-to")
    if kind == "response" and (len(payload) != lengths[0] or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit") != (refers is not None) or kind == "revisit" and payload:
        raise ValueError(f"record {head['warc-record-id']} has type {kind} but not its parts")
    bare = lambda uri: uri.removeprefix("<urn:row:").removesuffix(">") if uri else None
    return bare(head["warc-record-id"]), head.get("warc-target-uri"), lengths[0], digest, kind, bare(refers), payload


def write_archives(
    sheet: DataFrame, path: str, row_id: str = "row_id", address: str = "url", column: str = "value",
    least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3,
) -> None:
    """Write a WARC record for every row of ``sheet``; ``path`` is a new folder all executors share.

    The payload is the cell of ``column`` in UTF-8 (null: empty). Among rows
    with equal payloads of at least ``least_bytes``, the one with the largest
    row id is a response and the others are revisits of it; smaller payloads
    are all responses. Rows without an id, and repeated rows of the largest
    id, are responses. A null address gives no target header; characters that
    a URI can not have are percent-encoded. An empty sheet gives no archive.

    Equal payloads are found by their SHA-1, combined before the shuffle; only
    digests that repeat are joined back, so payloads are moved only where that
    table is too large to broadcast. Each task writes the rows of its
    partition to one archive, record by record. The dictionary is trained on
    the first ``SAMPLE_CHARS`` characters of ``SAMPLE_ROWS`` rows, chosen by hash.
    """
    text = F.coalesce(named(column).cast("string"), F.lit(""))
    rows = sheet.select(named(row_id).alias("row_id"), named(address).cast("string").alias("address"), text.cast("binary").alias("payload"))
    # Rows are chosen by hash alone; only the chosen ones' beginnings leave their tasks, and equal rows as one.
    marked = sheet.select(F.substring(text, 1, SAMPLE_CHARS).alias("s"), F.xxhash64(named(row_id).cast("string"), text).alias("h"))
    chosen = [r.h for r in marked.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).collect()]
    sample = marked.filter(F.col("h") <= chosen[-1]).groupBy("h").agg(F.min("s").alias("s")).orderBy("h").collect() if chosen else []
    dictionary = train_dictionary([r.s.encode() for r in sample if r.s])

    sized = rows.select("row_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).filter(F.col("size") >= least_bytes)
    repeats = sized.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("holder")).filter("n > 1").select("digest", "holder")
    repeats = bounded(stored(repeats, "warc-repeats"), 96)
    joined = rows.withColumn("digest", F.sha1("payload")).join(repeats, "digest", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & (F.col("holder") != F.col("row_id"))
    plan = joined.select("row_id", "address", "payload", "digest", F.when(revisit, F.col("holder")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
        first = True
        for batch in batches:
            frames = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary] if first and batch.num_rows else []
            first = first and not batch.num_rows
            held = 0
            for key, uri, data, digest, holder in zip(*batch.columns):
                data = data.as_py()
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode("ascii")
                frames.append(packer.compress(record(key.as_py(), uri.as_py(), data, len(data), name, holder.as_py(), date)))
                held += len(frames[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                    frames, held = [], 0
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = plan.mapInArrow(archive, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


RECORDS = "row_id string, address string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The checked records of all archives in a folder, a row each.

    ``row_id`` and ``refers_to`` are as text; the row id is null where the row
    had none. ``payload_bytes`` and ``payload_digest`` are those of the full
    payload, also for revisits, whose ``payload`` is null. A damaged archive,
    header, length or digest fails the job with the record's name.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_id", "address", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for raw in records_of(content.as_py()):
                    key, uri, size, digest, kind, refers, payload = parse_record(raw)
                    rows.append((key or None, uri, size, digest, kind, refers, payload if kind == "response" else None))
                    held += len(raw)
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(parse, RECORDS)
