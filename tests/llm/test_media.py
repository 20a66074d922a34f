"""Transport streams: exact round trips, faults, and the digests."""

import hashlib
import zlib

import pytest

from candlewick.llm import media


@pytest.mark.parametrize("n", [64, 128, 192, 1024, 8128, 8192, 8256, 64 * 1000, 64 * 5003])
def test_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    stream = media.multiplex(payload)
    assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    found = media.demultiplex(stream)
    assert b"".join(u.data for u in found.units) == payload
    assert found.programs == {1: 0x1000} and found.streams == {0x100: 6} and not found.gaps and not found.bad
    assert [u.pts for u in found.units] == [3600 * k for k in range(-(-n // 8192))]
    assert [u.random_access for u in found.units] == [k % 4 == 0 for k in range(len(found.units))]


def test_every_stuffing_length():
    for n in range(1, 400):
        assert b"".join(u.data for u in media.demultiplex(media.multiplex(b"x" * n)).units) == b"x" * n


def test_faults():
    stream = media.multiplex(b"a" * 40_000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    lost = media.demultiplex(b"".join(packets[:10] + packets[11:]))
    assert lost.gaps == 1 and lost.bad == 1
    assert media.demultiplex(b"".join(packets[:10] + [packets[9]] + packets[10:])).gaps == 0
    broken = media.demultiplex(packets[0][:20] + b"?" + packets[0][21:] + b"".join(packets[1:]))
    assert broken.bad == 1 and broken.units[0].pts == 4 * 3600  # known again from the next tables on
    assert media.demultiplex(b"").units == [] and media.demultiplex(b"\0" * 188).bad == 1
    assert media.section_crc(b"123456789") == 0x0376E6E7


def test_digests(spark):
    texts = [None, "", "é", "a" * 63, "a" * 64, "a" * 65, "x" * 200_000, "é"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "é", 2)], "doc_id long, text string, media int")
    found = media.media_digests(df).collect()
    assert len(found) == 9
    for r in found:
        data = (texts[r.doc_id] if r.doc_id is not None else "é") or ""
        payload = data.encode() + b"\0" * (-len(data.encode()) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r[1:] for r in found if r.n_bytes == 2}) == 1
    table = media.media_table(df)
    units = media.access_units(table).filter("doc_id = 6").orderBy("unit").collect()
    assert b"".join(u.data for u in units).rstrip(b"\0") == b"x" * 200_000 and units[4].random_access
    assert {r.doc_id: len(r.media) for r in table.collect()} == {r.doc_id: r.media_bytes for r in found}
    assert media.media_digests(df.limit(0)).collect() == []


def test_tables_that_span_packets():
    # a map of 60 streams (over 300 bytes) in two packets, and a second section behind the end of the first
    entries = b"".join(bytes([0x06]) + (0xE000 | 0x200 + i).to_bytes(2, "big") + b"\xf0\x00" for i in range(60))
    long = media._section(0x02, 1, b"\xe2\x00\xf0\x00" + entries)
    more = media._section(0x02, 1, b"\xe2\x00\xf0\x00" + bytes([0x1B]) + (0xE000 | 0x400).to_bytes(2, "big") + b"\xf0\x00")

    def packet(pid, start, counter, body):
        return (bytes([0x47, start << 6 | pid >> 8, pid & 255, 0x10 | counter]) + body).ljust(188, b"\xff")

    head = packet(0, 1, 0, media.PAT)
    first, rest = packet(0x1000, 1, 0, b"\0" + long[:183]), long[183:]
    second = packet(0x1000, 1, 1, bytes([len(rest)]) + rest + more)
    want = {0x200 + i: 6 for i in range(60)}
    assert media.demultiplex(head + first + packet(0x1000, 0, 1, rest)).streams == want
    found = media.demultiplex(head + first + second)
    assert found.streams == want | {0x400: 0x1B} and found.programs == {1: 0x1000} and (found.gaps, found.bad) == (0, 0)
    lost = media.demultiplex(head + first + packet(0x1000, 0, 2, rest))
    assert lost.streams == {} and (lost.gaps, lost.bad) == (1, 1)
    assert media.demultiplex(head + first).bad == 1


def test_query_reads_the_stored_column(spark, tmp_path):
    rows = [(1, "some text " * 9000), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = media.media_table(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    flipped = table.selectExpr("doc_id", "n_bytes", "concat(substring(media, 1, 600), x'00', substring(media, 602)) AS media")
    whole = {r.doc_id: r for r in media.op4_media(spark, str(tmp_path)).collect()}
    assert {r.doc_id: r for r in media.read_back(table).collect()} == whole
    damaged = {r.doc_id: r for r in media.read_back(flipped).collect()}
    assert damaged[1].payload_sha256 != whole[1].payload_sha256 and damaged[1].n_bytes == whole[1].n_bytes == 90_000
