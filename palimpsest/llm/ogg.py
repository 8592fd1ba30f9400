"""Operator 6: Ogg bitstreams as binary columns.

``mux`` writes packets of several logical streams as Ogg pages; ``demux`` reads
any Ogg bytes: it finds pages, verifies their checksums, reassembles packets from
lacing values (also across pages), separates the logical streams by serial number
and derives a time for each page from its granule position.

Null bodies are read as empty. Damaged pages are left out and counted; pages that
a stream's numbers show to be missing are counted, too (from its first page on, which has
number 0); a packet that had a part in one is dropped and counted, so the rest stays
readable. Rows are independent: equal bytes give equal results, with no shuffle.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import narrow, slices

CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 0xFFFFFFFFFFFFFFFF
#: Byte values with their bits in reverse order.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The page CRC (polynomial 0x04C11DB7, most significant bit first, from 0, nothing inverted).

    The usual CRC-32 is the same division on bits in the opposite order, so it does the work.
    """
    c = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    c = checksum(head + body)
    return head[:22] + struct.pack("<I", c) + head[26:] + body


@dataclass
class Stream:
    """Writer of one logical stream: packets with the granule position at which each ends."""

    serial: int
    packets: list[tuple[bytes, int]]

    def pages(self) -> list[bytes]:
        """At most 255 lacing values a page; the first packet has a page of its own."""
        out, lacing, body, granule, flags, number = [], bytearray(), bytearray(), NO_GRANULE, FIRST, 0

        def flush(last: bool, continues: bool):
            nonlocal lacing, body, granule, flags, number
            out.append(page(flags | (LAST if last else 0), granule, self.serial, number, bytes(lacing), bytes(body)))
            lacing, body, granule, number = bytearray(), bytearray(), NO_GRANULE, number + 1
            flags = CONTINUED if continues else 0

        for k, (data, end) in enumerate(self.packets):
            values, at = [255] * (len(data) // 255) + [len(data) % 255], 0
            for j, v in enumerate(values):
                if len(lacing) == 255:
                    flush(False, j > 0)
                lacing.append(v)
                body += data[at : at + v]
                at += v
            granule = end
            if k == 0 and len(self.packets) > 1:
                flush(False, False)
        flush(True, False)
        return out


def mux(streams: list[Stream]) -> bytes:
    """First pages of all streams, then their pages in turn."""
    queues = [s.pages() for s in streams]
    out = [q.pop(0) for q in queues]
    while any(queues):
        out += [q.pop(0) for q in queues if q]
    return b"".join(out)


@dataclass
class Logical:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    #: Pages left out by the numbering, and packets of which a part is gone.
    missing: int = 0
    lost: int = 0
    ended: bool = False

    @property
    def whole(self) -> bool:
        return self.ended and not self.missing and not self.lost


@dataclass
class Read:
    streams: dict[int, Logical]
    pages: int
    bad_pages: int


def demux(data: bytes) -> Read:
    streams: dict[int, Logical] = {}
    open_part: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    at = pages = bad = 0
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        version, flags, granule, serial, number, crc, n = struct.unpack_from("<BBQIIIB", data, at + 4)
        body_at = at + 27 + n
        lacing = data[at + 27 : body_at]
        end = body_at + sum(lacing)
        whole = version == 0 and len(lacing) == n and end <= len(data)
        if not whole or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        s = streams.setdefault(serial, Logical(serial))
        pages, s.pages = pages + 1, s.pages + 1
        gap = (number - expected.get(serial, 0)) % (1 << 32)
        s.missing += gap
        expected[serial] = number + 1
        part = open_part.pop(serial, None)
        if gap and part is not None:
            s.lost, part = s.lost + 1, None
        skipping = bool(flags & CONTINUED) and part is None
        part = part if flags & CONTINUED and part is not None else bytearray()
        done = len(s.packets)
        for v in lacing:
            part += data[body_at : body_at + v]
            body_at += v
            if v < 255:
                if skipping:
                    s.lost, skipping = s.lost + 1, False
                else:
                    s.packets.append(bytes(part))
                part = bytearray()
        if lacing and lacing[-1] == 255 and not skipping:
            open_part[serial] = part
        # The granule position is that of the last packet that ends on the page.
        s.granules += [-1] * (len(s.packets) - done)
        if len(s.packets) > done and granule != NO_GRANULE:
            s.granules[-1] = granule
        s.ended |= bool(flags & LAST)
        at = end
    for serial in open_part:
        streams[serial].lost += 1
    return Read(streams, pages, bad)


#: The sound stream's first packet: magic, version, sample bytes, channels, samples a second.
SOUND, CLOCK = b"PCM8", b"CLCK"
RATE, PACKET, TICK = 8000, 4000, 8000


def store(payload: bytes) -> bytes:
    """A payload as 8-bit samples in an Ogg file: a sound stream, and a clock stream with a packet a second."""
    sound = [(SOUND + struct.pack("<BBBI", 1, 1, 1, RATE), 0)]
    for k in range(0, len(payload), PACKET):
        piece = payload[k : k + PACKET]
        sound.append((piece, k + len(piece)))
    clock = [(CLOCK + struct.pack("<BI", 1, RATE), 0)]
    clock += [(struct.pack("<IB", k // TICK, max(payload[k : k + TICK])), min(len(payload), k + TICK)) for k in range(0, len(payload), TICK)]
    return mux([Stream(0x534F554E, sound), Stream(0x434C434B, clock)])


def fetch(media: bytes) -> tuple[bytes, str]:
    """The samples of the sound stream and a line of features; raises ValueError if anything is damaged."""
    read = demux(media)
    named = {s.packets[0][:4]: s for s in read.streams.values() if s.packets}
    sound, clock = named.get(SOUND), named.get(CLOCK)
    if sound is None or clock is None or len(sound.packets[0]) < 11 or read.bad_pages or not all(s.whole for s in read.streams.values()):
        raise ValueError("damaged Ogg bytes")
    rate = struct.unpack_from("<I", sound.packets[0], 7)[0]
    payload = b"".join(sound.packets[1:])
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = max(sound.granules)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    feature = f"streams={len(read.streams)};pages={read.pages};packets={len(sound.packets) - 1};ticks={len(clock.packets) - 1};duration_us={last * 1000000 // rate};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={crossings}"
    return payload, feature


def pages_of(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Packets of any column of Ogg bytes: id, serial, packet, size, granule (null: none), seconds, and counts of lost packets, missing and bad pages.

    ``seconds`` needs the sound header's rate and is null for other streams.
    """
    id_type = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                read = demux(body or b"")
                rows = []
                for s in read.streams.values():
                    rate = struct.unpack_from("<I", s.packets[0], 7)[0] if s.packets and s.packets[0][:4] == SOUND and len(s.packets[0]) >= 11 else None
                    rows += [(key, s.serial, k, len(p), None if g < 0 else g, g / rate if rate and g >= 0 else None, s.lost, s.missing, read.bad_pages) for k, (p, g) in enumerate(zip(s.packets, s.granules))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()))], ["id", "serial", "packet", "size", "granule", "seconds", "lost", "missing", "bad_pages"])

    out = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("body")).mapInArrow(run, f"id {id_type}, serial long, packet int, size int, granule long, seconds double, lost int, missing long, bad_pages int")
    return out.withColumnRenamed("id", id_col)


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text padded to a positive multiple of 64 bytes, stored as Ogg, read back and measured.

    ``with_media`` also returns the Ogg bytes and the payload as it was read back.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
    fields += [("media", pa.binary(), "binary"), ("payload", pa.binary(), "binary")] if with_media else []

    def one(text: bytes):
        size = max(64, -(-len(text) // 64) * 64)
        media = store(text.ljust(size, b"\0"))
        payload, feature = fetch(media)
        row = (len(text), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature)
        return row + ((media, payload) if with_media else ())

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [one(b or b"") for b in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), fields))], ["id", *(n for n, _, _ in fields)])

    schema = f"id {id_type}, " + ", ".join(f"{n} {t}" for n, _, t in fields)
    return narrow(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
