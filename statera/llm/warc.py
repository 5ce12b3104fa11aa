"""WARC archives in Zstandard, with a shared dictionary.

An archive starts with a skippable frame that carries the dictionary; each record is one frame of its
own, so a reader can start at any record and a damaged one costs only itself. The reader loads the
dictionary from the leading frame, finds each frame's end from its block headers, decodes the frame,
and checks version line, header lines, content length, trailing line ends and payload digest.

Pages with equal payloads are one group: the page with the smallest id is written as a response, the
others as revisits that name it. Groups are found from digests with partial aggregation.

Archives are written by tasks into the shared folder under a name of their own and take effect only
through the table of archives that the finished job returns; what a lost task left behind is never read.

Defined results: a null payload is empty; equal ids with equal payloads are all responses; a null id is
written as an empty one and read back as null, and larger than any other; control characters and blanks
of an address are percent-encoded, a null address is an empty one; an empty table gives no records;
columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.common import filesystem, new_dir, small_batches, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of the sample that the dictionary is made from; it changes sizes of files, never a result.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 16_384, 32_768
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def made_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the plain start of the samples where they are too few to train on."""
    samples = [s[:SAMPLE_BYTES] for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1 response"


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The bytes of one record; a revisit holds the response's header alone, with the payload's full length."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise ArchiveError(f"not a header line: {line[:80]!r}")
        try:
            out[name.decode().lower()] = value.strip().decode()
        except UnicodeDecodeError as e:
            raise ArchiveError(f"a header line that isn't UTF-8: {line[:80]!r}") from e
    return out


def _length(value: str) -> int:
    """A length in ASCII digits; -1 if it is none."""
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else -1


def _page(value: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+|)>", value)
    if not found:
        raise ArchiveError(f"not a record id of a page: {value[:80]}")
    return int(found[1]) if found[1] else None


def parsed(raw: bytes) -> dict[str, Any]:
    """The checked content of a record: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest."""
    top, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = top.partition(b"\r\n")
    if not blank or version != VERSION:
        raise ArchiveError("no version line, or headers without an end")
    headers = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"no header {name}")
    if len(rest) != _length(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError("the content length differs from the block's length")
    head, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    inner = _headers(head.partition(b"\r\n")[2])
    kind, stated = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not blank or kind not in ("response", "revisit") or _length(inner.get("content-length", "")) < 0:
        raise ArchiveError("neither a response nor a revisit with its header")
    size = _length(inner["content-length"])
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ArchiveError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or not stated):
        raise ArchiveError("a revisit with a payload or without a digest")
    return {
        "page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(headers.get("warc-refers-to", "")) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": stated,
    }


def frame_end(data: bytes, at: int) -> int | None:
    """Where the frame that starts at ``at`` ends; None if ``data`` ends before."""
    if len(data) - at < 6:
        return None
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0] if len(data) - at >= 8 else None
        return end if end is not None and end <= len(data) else None
    if magic != FRAME_MAGIC:
        raise ArchiveError("no frame where one should start")
    flags = data[at + 4]
    single, size_flag = flags >> 5 & 1, flags >> 6
    place = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
    while True:
        if place + 3 > len(data):
            return None
        block = int.from_bytes(data[place : place + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ArchiveError("a reserved block type")
        place += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            place += 4 * (flags >> 2 & 1)
            return place if place <= len(data) else None


def read_archive(stream: Any, chunk: int = 8 << 20) -> Iterator[dict[str, Any]]:
    """The records of an open archive in order."""
    data, at, reader = b"", 0, None
    while True:
        end = frame_end(data, at)
        if end is None:
            more = stream.read(chunk)
            if not more:
                if at < len(data):
                    raise ArchiveError("the archive ends inside a frame")
                return
            data, at = data[at:] + more, 0
            continue
        frame, at = data[at:end], end
        if reader is None:
            magic, size = struct.unpack_from("<II", frame)
            if magic != DICTIONARY_MAGIC or size != len(frame) - 8:
                raise ArchiveError("the archive doesn't start with a dictionary")
            raw = frame[8:]
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
            continue
        try:
            content = reader.decompress(frame, max_output_size=0) if _has_size(frame) else reader.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a frame that doesn't decode: {e}") from e
        yield parsed(content)


def _has_size(frame: bytes) -> bool:
    return frame[4] >> 6 != 0 or frame[4] >> 5 & 1 == 1


def _written(batches: Iterable[pa.RecordBatch], folder: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
    out, name, size, records = None, "", 0, 0

    def close() -> Iterator[pa.RecordBatch]:
        out.close()
        files.move(f"{root}/{name}.part", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([records], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    for batch in batches:
        for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
            if out is None:
                name, size, records = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                out = files.open_output_stream(f"{root}/{name}.part", compression=None)
                out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            frame = packer.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
            out.write(frame)
            size, records = size + len(frame), records + 1
            if size >= ARCHIVE_BYTES:
                yield from close()
                out = None
    if out is not None:
        yield from close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every row; returns the table of archives (archive, records, n_bytes)."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("same"))
    sample = [r[0].encode() for r in rows.select(F.substring("payload", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()]
    dictionary = made_dictionary(sample)
    groups = rows.groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "first")
    joined = rows.join(groups, "same", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return written(joined.mapInArrow(lambda b: _written(b, folder, dictionary), "archive string, records long, n_bytes long"), "warc-archives")


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _read(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload)
    for batch in batches:
        for archive in batch.column(0):
            files, path = filesystem(archive.as_py())
            held: list[dict[str, Any]] = []
            with files.open_input_stream(path, compression=None) as stream:
                for found in read_archive(stream):
                    held.append({n: found[n] for n in schema.names})
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in the table's column ``archive``; one task per archive."""
    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(lambda b: _read(b, with_payload), READ + ", payload binary" * with_payload)


def archived(spark: SparkSession, pages: DataFrame, **names: str) -> DataFrame:
    """Write the pages as archives in the shared folder and read the records back."""
    return read_archives(write_archives(pages, new_dir(spark, "warc"), **names))
