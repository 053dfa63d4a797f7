"""Operator 8: media columns in Ogg.

Writing: a payload of 8-bit samples is cut into packets of PACKET samples, dealt
in turn to STREAMS logical streams; a stream's packets are laced into segments
of at most 255 bytes, segments fill pages of at most 255 of them, and packets
may run on into the next page. A page's granule position is its stream's number
of samples up to the last packet that ends on it (-1 if none does); its checksum
is the container's CRC (polynomial 0x04c11db7, not reflected, initial 0). The
streams' pages are interleaved by time.

Reading: page checksums are verified, streams are told apart by serial number,
packets are put together from the lacing values, and each packet's time is
derived from its page's granule position. Damage is reported, not raised: a page
with a bad checksum is skipped (bytes up to the next capture pattern count as
lost), and a packet that lost a part is dropped.

Results: the payload read back equals the payload written. Null counts as
empty; an empty stored form has no packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdure.llm.common import map_batches

PACKET, STREAMS, RATE = 960, 2, 8000
HEADER = struct.Struct("<4sBBqIIIB")
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC: bit-reversed, it is zlib's over bit-reversed bytes without the two inversions."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def write_stream(packets: list[bytes], serial: int) -> list[tuple[int, bytes]]:
    """(time of its last packet, page) of one logical stream."""
    sizes = [len(p) for p in packets]
    whole = b"".join(packets)
    lacing = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    values = np.frombuffer(lacing, np.uint8).astype(np.int64)
    ends, done = values < 255, np.cumsum(values)
    out, at, granule = [], 0, 0
    for number, a in enumerate(range(0, len(values), 255)):
        b = min(a + 255, len(values))
        last = np.flatnonzero(ends[a:b])
        granule = int(done[a + last[-1]]) if len(last) else granule
        flags = (CONTINUED if a and not ends[a - 1] else 0) | (0 if a else FIRST) | (LAST if b == len(values) else 0)
        out.append((granule, _page(flags, granule if len(last) else -1, serial, number, lacing[a:b], whole[at : int(done[b - 1])])))
        at = int(done[b - 1])
    return out


def write(payload: bytes, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    """The stored form of a payload."""
    packets = [payload[a : a + packet] for a in range(0, len(payload), packet)]
    pages = [(time, i, n, page) for i in range(streams) for n, (time, page) in enumerate(write_stream(packets[i::streams], i + 1))]
    return b"".join(p[3] for p in sorted(pages, key=lambda p: p[:3]))


def read(stored: bytes) -> dict:
    """streams: serial -> [(end time in samples, packet)]; pages; bad: pages with a bad checksum; lost: skipped bytes; dropped: broken packets."""
    state: dict[int, dict] = {}
    pages = bad = lost = dropped = at = 0
    while at < len(stored):
        if stored[at : at + 4] != CAPTURE or at + HEADER.size > len(stored):
            after = stored.find(CAPTURE, at + 1)
            after = len(stored) if after < 0 else after
            lost, at = lost + after - at, after
            continue
        _, _, flags, granule, serial, number, crc, n = HEADER.unpack_from(stored, at)
        body_at = at + HEADER.size + n
        lacing = np.frombuffer(stored[at + HEADER.size : body_at], np.uint8).astype(np.int64)
        end = body_at + int(lacing.sum())
        page = stored[at:end]
        if len(lacing) < n or end > len(stored) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            after = stored.find(CAPTURE, at + 1)
            after = len(stored) if after < 0 else after
            lost, at = lost + after - at, after
            continue
        pages += 1
        s = state.setdefault(serial, {"next": 0, "open": None, "packets": []})
        if number != s["next"]:
            dropped += s["open"] is not None
            s["open"] = None
        s["next"] = number + 1
        cuts = np.flatnonzero(lacing < 255)
        offsets = (body_at + np.cumsum(lacing)[cuts]).tolist()
        begin, fresh = body_at, []
        for i, stop in enumerate(offsets):
            part, begin = stored[begin:stop], stop
            if i == 0 and flags & CONTINUED:
                if s["open"] is None:
                    dropped += 1
                    continue
                part = s["open"] + part
            fresh.append(part)
        tail = stored[begin:end]
        if tail or (len(lacing) and lacing[-1] == 255):
            s["open"] = (s["open"] or b"") + tail if not offsets and flags & CONTINUED and s["open"] is not None else None if not offsets and flags & CONTINUED else tail
        else:
            s["open"] = None
        # times: back from the granule position of the page's last packet
        time, timed = granule, []
        for part in reversed(fresh):
            timed.append((time, part))
            time -= len(part)
        s["packets"].extend(reversed(timed))
        at = end
    return {"streams": {k: v["packets"] for k, v in state.items()}, "pages": pages, "bad": bad, "lost": lost, "dropped": dropped}


def payload_of(stored: bytes) -> tuple[bytes, dict]:
    """The payload, its streams' packets dealt together again by turn, and what was read."""
    found = read(stored)
    lanes = [found["streams"][k] for k in sorted(found["streams"])]
    packets = [b""] * sum(map(len, lanes))
    for i, lane in enumerate(lanes):
        packets[i :: len(lanes)] = [p for _, p in lane]
    return b"".join(packets), found


def feature(payload: bytes, found: dict) -> str:
    """What the stored form holds: streams, pages, packets, seconds, and the samples' mean and deviation."""
    lanes = found["streams"].values()
    samples = np.frombuffer(payload, np.uint8)
    total, squares, n = int(samples.sum(dtype=np.int64)), int(np.square(samples, dtype=np.int64).sum()), max(1, len(samples))
    mean = total / n
    deviation = max(0.0, squares / n - mean * mean) ** 0.5
    ends = max((lane[-1][0] for lane in lanes if lane), default=0)
    return f"streams={len(lanes)};pages={found['pages']};bad={found['bad']};packets={sum(map(len, lanes))};seconds={ends / RATE:.4f};mean={mean:.4f};std={deviation:.4f}"


def padded(text: str | None, to: int = 192) -> bytes:
    """The text as UTF-8 and bytes 32 up to a positive multiple of ``to``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(to, -(-len(raw) // to) * to) - len(raw))


OWN = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def _batches(df: DataFrame, drop: str, schema: T.StructType, row) -> DataFrame:
    """df without column ``drop``, with the columns of schema that row(value) gives; 200 rows at once."""
    rest = df.drop(*schema.names) if drop not in schema.names else df.drop(*(n for n in schema.names if n != drop))
    fields = [f for f in rest.schema.fields if f.name != drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())] for f in schema.fields]
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                rows = [row(v) for v in batch.column(drop).to_pylist()]
                kept = [f.name for f in fields]
                more = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *more], names=[*kept, *schema.names])

    return map_batches(rest, run, T.StructType([*fields, *schema.fields]))


def encode(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """df with binary column ``to`` in place of ``text``: its padded bytes' stored form. No shuffle."""
    return _batches(df, text, T.StructType([T.StructField(to, T.BinaryType())]), lambda t: [write(padded(t))])


def decode(df: DataFrame, media: str = "media", to: str = "payload") -> DataFrame:
    """df with binary column ``to`` and string column feature in place of ``media``; null counts as empty. No shuffle."""

    def row(stored: bytes | None) -> list:
        payload, found = payload_of(stored or b"")
        return [payload, feature(payload, found)]

    return _batches(df, media, T.StructType([T.StructField(to, T.BinaryType()), T.StructField("feature", T.StringType())]), row)


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of OWN in place of ``text``: stores each text, reads it back and describes both. No shuffle."""

    def row(t: str | None) -> list:
        raw = padded(t)
        stored = write(raw)
        payload, found = payload_of(stored)
        size = len((t or "").encode("utf-8", "surrogatepass"))
        return [size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, found)]

    return _batches(df, text, OWN, row)


def op8_ogg(spark, sf_dir: str) -> DataFrame:
    """Every document's text as stored media, read back."""
    from verdure.llm.common import table

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
