"""Media columns: Ogg files in a binary column.

``mux`` stores a payload of 8-bit samples as two logical Ogg streams whose packets alternate; ``demux`` verifies each page's
checksum, reassembles packets from lacing values, separates the streams by serial number and derives timestamps from granule
positions. Nulls and empty texts become one block of spaces, so every row has a file. A file that is damaged gives an ``error``
and null fields, never a crash. Extra columns pass through; equal payloads give equal files.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads are padded with spaces to a positive multiple of this.
BLOCK = 192
RATE = 8000
#: Samples in a packet; a page ends after so many packets.
PACKET = 1536
PAGE_PACKETS = 20
#: Fixed values of the format.
MAGIC = b"OggS"
CONTINUED, BOS, EOS = 1, 2, 4
#: The header packet of each stream: name, rate, samples in a packet, stream number, streams.
HEAD = struct.Struct("<8sIIBB")
NAME = b"PCM8U\0\0\0"
PAGE = struct.Struct("<4sBBqIIIB")

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A file that isn't a whole, intact Ogg file of this kind."""


def checksum(data: bytes) -> int:
    """Ogg's CRC: polynomial 04c11db7, most significant bit first, from 0. That is zlib's CRC over bit-reversed bytes, reversed."""
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def write_ogg(payload: bytes) -> bytes:
    """Two logical streams: packets 0, 2, ... in the first, 1, 3, ... in the second."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    serials = [0x7469, 0x6465]
    out = [_page(BOS, 0, serials[s], 0, _lacing(HEAD.size), HEAD.pack(NAME, RATE, PACKET, s, 2)) for s in (0, 1)]
    turns: list[list[bytes]] = [[], []]
    for s in (0, 1):
        own, granule, number = packets[s::2], 0, 1
        groups = [own[i : i + PAGE_PACKETS] for i in range(0, len(own), PAGE_PACKETS)] or [[]]
        for i, group in enumerate(groups):
            granule += sum(map(len, group))
            turns[s].append(_page(EOS * (i == len(groups) - 1), granule, serials[s], number, b"".join(_lacing(len(p)) for p in group), b"".join(group)))
            number += 1
    for i in range(max(map(len, turns))):
        out += [t[i] for t in turns if i < len(t)]
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, number, lacing values, body) of each page, its checksum verified."""
    view, at = memoryview(media), 0
    while at < len(view):
        if len(view) - at < PAGE.size:
            raise OggError("a page's header is cut")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(view, at)
        if magic != MAGIC or version:
            raise OggError("no page starts here")
        lacing = bytes(view[at + PAGE.size : at + PAGE.size + n])
        start = at + PAGE.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(view):
            raise OggError("a page is cut")
        if checksum(bytes(view[at : at + 22]) + b"\0\0\0\0" + bytes(view[at + 26 : end])) != crc:
            raise OggError("a page's checksum is wrong")
        yield flags, granule, serial, number, lacing, view[start:end]
        at = end


def read_ogg(media: bytes) -> dict:
    """The payload and what the container says of it: streams, pages, packets, the streams' seconds from their last granule positions."""
    streams: dict[int, dict] = {}
    n_pages = 0
    for flags, granule, serial, number, lacing, body in pages(media):
        n_pages += 1
        if flags & BOS:
            if serial in streams:
                raise OggError("a stream starts twice")
            streams[serial] = {"packets": [], "part": [], "next": 0, "granule": 0, "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or number != s["next"]:
            raise OggError("a page is missing or out of order")
        if bool(flags & CONTINUED) != bool(s["part"]):
            raise OggError("a packet isn't continued")
        s["next"], at, size = number + 1, 0, 0
        for value in lacing:
            size += value
            if value < 255:
                s["packets"].append(b"".join([*s["part"], body[at : at + size]]))
                s["part"], at, size = [], at + size, 0
        if size:
            s["part"] = [*s["part"], bytes(body[at : at + size])]
        if granule < s["granule"] and granule != -1:
            raise OggError("granule positions fall")
        s["granule"], s["ended"] = max(granule, s["granule"]), bool(flags & EOS)
    order: dict[int, dict] = {}
    for s in streams.values():
        if not s["packets"] or len(s["packets"][0]) != HEAD.size or s["part"] or not s["ended"]:
            raise OggError("a stream isn't whole")
        name, rate, _, place, _ = HEAD.unpack(s["packets"][0])
        if name != NAME or not rate:
            raise OggError("a stream of another kind")
        s["data"], s["rate"] = s["packets"][1:], rate
        if sum(map(len, s["data"])) != s["granule"]:
            raise OggError("granule positions don't fit the samples")
        order[place] = s
    if sorted(order) != list(range(len(order))) or not order:
        raise OggError("a stream is missing")
    turns = [order[i]["data"] for i in range(len(order))]
    packets = [t[i] for i in range(max(map(len, turns))) for t in turns if i < len(t)]
    return {
        "payload": b"".join(packets), "streams": len(order), "pages": n_pages, "packets": len(packets),
        "stream_ms": [round(1000 * order[i]["granule"] / order[i]["rate"], 3) for i in range(len(order))],
    }


def _added(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def mux(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replaces the binary column ``payload`` by the Ogg file ``media``; null stays null."""
    rest = df.drop(media) if media != payload else df
    schema = T.StructType([*(f for f in rest.schema.fields if f.name != payload), T.StructField(media, T.BinaryType())])

    def encode(batches):
        for b in batches:
            files = pa.array([None if x is None else write_ogg(x) for x in b.column(payload).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), files], names=schema.names)

    return rest.mapInArrow(encode, schema)


def demux(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what ``read_ogg`` finds and the file's size and hash; for null or damaged files the fields are null and ``ogg_error`` says why."""
    fields = {"payload": T.BinaryType(), "streams": T.LongType(), "pages": T.LongType(), "packets": T.LongType(), "stream_ms": T.ArrayType(T.DoubleType()), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "ogg_error": T.StringType()}
    rest = df.drop(*fields)
    schema = T.StructType([*(f for f in rest.schema.fields if f.name != media), *(T.StructField(k, v) for k, v in fields.items())])
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.string(), pa.string()]

    def decode(batches):
        for b in batches:
            rows = []
            for x in b.column(media).to_pylist():
                row: dict = {"ogg_error": "null"}
                if x is not None:
                    try:
                        row = read_ogg(x)
                    except OggError as e:
                        row = {"ogg_error": str(e)}
                    row |= {"media_bytes": len(x), "media_sha256": hashlib.sha256(x).hexdigest()}
                rows.append(row)
            own = [pa.array([r.get(k) for r in rows], kind) for k, kind in zip(fields, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[: -len(fields)]), *own], names=schema.names)

    return rest.mapInArrow(decode, schema)


def op8_ogg(docs: DataFrame) -> DataFrame:
    """Texts through Ogg files and back, as digests. Null texts count as empty; repeated rows give repeated results."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    padded = F.greatest(F.ceil(n / BLOCK), F.lit(1)) * BLOCK
    stored = mux(docs.select("doc_id", n.cast("long").alias("n_bytes"), F.rpad(raw, padded.cast("int"), F.lit(b" ")).alias("payload")))
    back = demux(stored)
    size = F.octet_length("payload").cast("long")
    return back.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.format_string("streams=%d;pages=%d;packets=%d;ms=%s", "streams", "pages", "packets", F.array_join(F.transform("stream_ms", lambda x: x.cast("string")), "+")).alias("feature"),
    )
