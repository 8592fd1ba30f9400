import zlib
from hashlib import sha256

import pytest

from palimpsest.llm import ogg

from .helpers import AWKWARD, table


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum_is_the_bitwise_division():
    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[0], [255], [1, 254, 255, 256, 510, 0, 0, 3], [70000, 1, 65025, 65026], [10] * 700])
def test_packets_of_two_streams_come_back(sizes):
    a = [(bytes([k % 251]) * n, (k + 1) * 10) for k, n in enumerate(sizes)]
    b = [(b"second" + bytes([k % 256]), k) for k in range(5)]
    read = ogg.demux(ogg.mux([ogg.Stream(7, a), ogg.Stream(9, b)]))
    assert read.bad_pages == 0
    assert read.streams[7].packets == [p for p, _ in a] and read.streams[9].packets == [p for p, _ in b]
    assert read.streams[7].ended and not read.streams[7].lost
    assert read.streams[7].granules[-1] == a[-1][1]
    assert [g for g in read.streams[9].granules if g >= 0][-1] == 4


def test_damage_is_found_and_the_rest_is_read():
    packets = [(bytes([k]) * 3000, k) for k in range(60)]
    data = bytearray(ogg.mux([ogg.Stream(1, packets)]))
    third = [k for k in range(len(data)) if data[k : k + 4] == b"OggS"][2]
    data[third + 400] ^= 1
    read = ogg.demux(b"noise" + bytes(data))
    s = read.streams[1]
    assert read.bad_pages >= 1 and 0 < len(s.packets) < 60 and s.lost >= 1
    assert all(p in [x for x, _ in packets] for p in s.packets)
    with pytest.raises(ValueError):
        ogg.fetch(bytes(data))
    assert ogg.demux(b"").pages == 0 and ogg.demux(b"OggS").pages == 0


def cut_pages(data):
    """The pages one after the other, by their headers alone."""
    at, out = 0, []
    while at < len(data):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        out.append(data[at:end])
        at = end
    return out


def test_missing_pages_are_counted():
    packets = [(b"head", 0)] + [(bytes([k % 251]) * 100, k) for k in range(600)]
    pages = cut_pages(ogg.mux([ogg.Stream(1, packets)]))
    assert len(pages) > 3
    for k in range(len(pages)):
        read = ogg.demux(b"".join(pages[:k] + pages[k + 1 :])).streams[1]
        assert read.missing == (k < len(pages) - 1) and not read.whole and len(read.packets) < 601
        assert all(p in [x for x, _ in packets] for p in read.packets)
    media = ogg.store(b"x" * 64 * 2000)
    pages = cut_pages(media)
    assert ogg.fetch(media)[0] == b"x" * 64 * 2000
    for k in range(len(pages)):
        with pytest.raises(ValueError):
            ogg.fetch(b"".join(pages[:k] + pages[k + 1 :]))


def slow_feature(payload, media):
    x = [b - 128 for b in payload]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    count = lambda n: -(-len(payload) // n)
    return f"streams=2;pages={len(cut_pages(media))};packets={count(4000)};ticks={count(8000)};duration_us={len(payload) * 125};sum={sum(x)};energy={sum(v * v for v in x)};peak={max(map(abs, x))};crossings={crossings}"


def test_documents(spark):
    rows = AWKWARD + [(40, "long " * 30000)]
    got = sorted(map(tuple, ogg.store_documents(table(spark, rows)).collect()), key=lambda r: (r[0], r[1]))
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0], len(x[1] or ""))), got):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r[:5] == (i, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r[7] == slow_feature(payload, bytes(r[8]))
        assert bytes(r[9]) == payload and r[6] == sha256(bytes(r[8])).hexdigest() and r[5] == len(r[8])
    media = ogg.store_documents(table(spark, rows))
    rows_of = ogg.pages_of(media, "doc_id", "media").filter("doc_id = 40").collect()
    assert {r.serial for r in rows_of} == {0x534F554E, 0x434C434B}
    assert max(r.seconds for r in rows_of if r.seconds is not None) == pytest.approx(150016 / 8000)
    assert ogg.store_documents(table(spark, []).limit(0)).count() == 0
