import base64
import hashlib
import io
import struct

import pytest
import zstandard

from statera.llm import warc

PAGES = [(1, "http://a/ b\r\n", "<p>é</p>"), (2, None, "same"), (3, "u", "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (6, "u", "x" * 300_000)]


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.archived(spark, pages(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    first = {"same": 2, "": 4}
    expected = []
    for i, _, html in PAGES:
        ref = first.get(html or "")
        revisit = ref is not None and i != ref
        expected.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", ref if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.archived(spark, pages(spark, [])).collect() == []


def test_payloads_come_back(spark, tmp_path):
    archives = warc.write_archives(pages(spark), f"file://{tmp_path}/w")
    back = {r["page_id"]: r["payload"] for r in warc.read_archives(archives, with_payload=True).collect() if r["record_type"] == "response"}
    assert back[1] == "<p>é</p>".encode() and back[6] == b"x" * 300_000 and back[2] == b"same"


def archive(*records, dictionary=b"WARC/1.1 WARC-Type: response", head=None):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    start = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary if head is None else head
    return start + b"".join(packer.compress(r) for r in records)


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_reader_finds_frames_in_any_chunks(chunk):
    data = archive(warc.record(1, "u", b"abc"), warc.record(2, "u", b"abc", refers_to=1))
    found = list(warc.read_archive(io.BytesIO(data), chunk))
    assert [(f["page_id"], f["record_type"], f["refers_to"], f["payload_bytes"]) for f in found] == [(1, "response", None, 3), (2, "revisit", 1, 3)]


def test_a_compressed_dictionary(spark):
    dictionary = b"WARC/1.1 WARC-Type: response" * 3
    packed = zstandard.ZstdCompressor().compress(dictionary)
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    assert len(list(warc.read_archive(io.BytesIO(archive(warc.record(1, "u", b"x"), dictionary=dictionary, head=head))))) == 1


GOOD = warc.record(1, "u", b"payload")


@pytest.mark.parametrize(
    "bad",
    [
        archive(GOOD)[:-3],
        archive(GOOD, head=b""),
        archive(GOOD.replace(b"payload", b"payloaD")),
        archive(GOOD.replace(b"WARC/1.1", b"WARC/9.9")),
        archive(GOOD[:-2]),
        archive(GOOD.replace(b"WARC-Date", b"WARC Date no colon\r\nX")),
        archive(GOOD.replace(b"response", b"request!", 1)),
        archive(GOOD) + b"trailing bytes",
        archive(GOOD.replace(b"WARC-Date: 2", b"WARC-Date: \xff")),
        archive(GOOD.replace(b"Content-Length: 7", "Content-Length: ²".encode())),
        archive(GOOD.replace(b"urn:page:1", b"urn:page:-")),
        archive(warc.record(2, "u", b"abc", refers_to=1).replace(b"WARC-Refers-To", b"WARC-Refers-X!")),
    ],
)
def test_broken_archives_are_refused(bad):
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(bad)))


def test_clashing_columns(spark):
    rows = [(1, "u", "same", "p", "s", 9, "i"), (2, "u", "same", "p", "s", 9, "i")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, same string, first int, id string")
    got = sorted((r["page_id"], r["record_type"]) for r in warc.archived(spark, frame).collect())
    assert got == [(1, "response"), (2, "revisit")]
