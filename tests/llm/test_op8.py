import hashlib
import zlib

import pytest

from tidemark.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    assert all(ogg.checksum(x) == slow_crc(x) for x in (b"", b"a", b"OggS" * 9, bytes(range(256))))


@pytest.mark.parametrize("n", [1, 191, 1536, 1537, 70_000, 200_000])
def test_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    got = ogg.read_ogg(ogg.write_ogg(payload))
    assert got["payload"] == payload and got["streams"] == 2
    assert sum(got["stream_ms"]) == pytest.approx(n / 8, abs=0.01)


def test_damage():
    media = bytearray(ogg.write_ogg(b"x" * 5000))
    for at in (0, 5, 30, 200, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_ogg(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.read_ogg(bytes(media[:-3]))


def test_continued_packet():
    """A packet over two pages, as other writers make them."""
    head = ogg.HEAD.pack(ogg.NAME, ogg.RATE, ogg.PACKET, 0, 1)
    data = b"q" * 300
    media = b"".join([ogg._page(ogg.BOS, 0, 9, 0, ogg._lacing(len(head)), head), ogg._page(0, -1, 9, 1, b"\xff", data[:255]), ogg._page(ogg.CONTINUED | ogg.EOS, 300, 9, 2, bytes([45]), data[255:])])
    assert ogg.read_ogg(media)["payload"] == data


def test_query(spark):
    rows = [(1, "Größe"), (2, None), (3, ""), (4, "x" * 192), (4, "x" * 192), (None, "y" * 300_000)]
    got = {(r.doc_id, r.n_bytes): r for r in ogg.op8_ogg(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i, len(raw)]
        media = ogg.write_ogg(padded)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_damaged_and_extra_columns(spark):
    df = spark.createDataFrame([(1, b"junk", 5), (2, None, 6)], "doc_id long, media binary, pages long")
    got = ogg.demux(df).orderBy("doc_id").collect()
    assert [r.ogg_error for r in got] == ["a page's header is cut", "null"] and got[0].payload is None
