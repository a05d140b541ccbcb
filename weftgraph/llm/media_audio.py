"""Media columns, MPEG audio: frame parsing with resynchronisation, and lossless payload streams.

``parse`` walks a byte string frame by frame: it skips ID3v2 and ID3v1 tags, reads text frames,
finds Xing/Info and VBRI tables, verifies the CRC-16 of protected layer III frames, and stores the
exact duration in samples with the byte offset of every frame. Where the next header does not
follow, it moves on byte by byte until two consistent headers stand one frame apart, counting
what it skipped. ``pack`` writes a payload as ancillary data of silent MPEG-1 layer III frames
(48 kHz, mono, CRC, variable bit rate) after an ID3v2.3 tag with the length and a Xing frame with
table of contents; ``payload`` reads it back. An ID3v1 tag ends the stream, so that payload never
stands where a reader looks for that tag, whatever its bytes are.

A null text is empty; every payload is padded with bytes 0 to a positive multiple of 64. An empty
or foreign byte string parses to no frames, an empty table gives no rows. Equal texts give equal
streams. Only the id and the text are read: other columns, of whatever names, are ignored. A row's
memory is a small multiple of its text, however long.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import lean, materialize

# Fixed values of the MPEG audio standard: kbit/s by (version 1 or 2, layer), Hz by version, samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


@dataclass(frozen=True)
class Header:
    version: int  # bits of the header: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of side information (layer III)


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The frame header in 4 bytes; None if they are none (reserved values and free format included)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_at, bits_at = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bits_at in (0, 15) or word[3] & 3 == 2:
        return None
    kind = 1 if version == 3 else 2
    kbps, rate, samples, pad = BITRATES[kind, layer][bits_at], RATES[version][rate_at], SAMPLES[kind, layer], word[2] >> 1 & 1
    size = (12_000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else ((17 if mono else 32) if kind == 1 else (9 if mono else 17))
    return Header(version, layer, not word[1] & 1, kbps, rate, mono, size, samples, side)


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """CRC-16 of the standard: polynomial 0x8005, initial value 0xFFFF."""
    table, crc = _crc_table(), 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ byte]
    return crc


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of each audio frame: the seek table
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    resyncs: int = 0
    checked: int = 0
    bad_crc: int = 0
    kbps: dict[int, int] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tag(data: bytes, at: int, tags: dict[str, str]) -> int:
    """End of the ID3v2 tag at `at`; its text frames go to tags."""
    end = min(len(data), at + 10 + _syncsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 0x10 else 0))
    version, pos = data[at + 3], at + 10
    while version in (3, 4) and pos + 10 <= end and data[pos] != 0:
        name, raw = data[pos : pos + 4].decode("latin-1"), data[pos + 4 : pos + 8]
        size = _syncsafe(raw) if version == 4 else struct.unpack(">I", raw)[0]
        body = data[pos + 10 : min(end, pos + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        pos += 10 + size
    return end


def _vbr(frame: bytes, h: Header) -> dict | None:
    """A Xing/Info or VBRI table in a frame, if it holds one."""
    at = 4 + h.side + (2 if h.protected else 0)
    for at in (at, 4 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            kind, flags, pos, out = frame[at : at + 4].decode(), struct.unpack_from(">I", frame, at + 4)[0], at + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= pos + 4:
                    out[name] = struct.unpack_from(">I", frame, pos)[0]
                    pos += 4
            if flags & 4 and len(frame) >= pos + 100:
                out["toc"] = list(frame[pos : pos + 100])
            return {"kind": kind, **out}
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        size, frames = struct.unpack_from(">II", frame, 46)
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return None


def parse(data: bytes) -> Stream:
    """All that a byte string holds as MPEG audio; never fails, whatever the bytes are."""
    out, at, end = Stream(), 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["id3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    locked, offsets, n = None, out.offsets, 0  # locked: what all headers of the stream have in common
    while at + 4 <= end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _tag(data, at, out.tags)
            continue
        h = header(data[at : at + 4])
        ok = h is not None and at + h.size <= end
        kind = (h.version, h.layer, h.rate) if ok else None
        if ok and kind != locked:  # a lone header may be payload: the next must follow, or the end
            after = at + h.size
            then = header(data[after : after + 4])
            ok = after == end or data[after : after + 3] == b"ID3" or (then is not None and (then.version, then.layer, then.rate) == kind)
            out.resyncs += ok and bool(offsets)
        if not ok:
            step = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end if step < 0 else step)
            step = tag if tag >= 0 else step
            step = end if step < 0 else step
            out.skipped += step - at
            at, locked = step, None
            continue
        locked = kind
        if not n and h.layer == 3 and (table := _vbr(data[at : at + h.size], h)):
            out.table, out.rate = table, h.rate
            at, n = at + h.size, 1
            continue
        n += 1
        if h.protected and h.layer == 3:
            out.checked += 1
            out.bad_crc += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != data[at + 4] << 8 | data[at + 5]
        offsets.append(at)
        out.samples += h.samples
        out.rate = out.rate or h.rate
        out.kbps[h.kbps] = out.kbps.get(h.kbps, 0) + 1
        at += h.size
    out.skipped += max(0, end - at)
    return out


#: Fixed value of the format: an ID3v1 tag is 128 bytes, here with the title "payload" and no genre.
ID3V1 = b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"
_SIZES = [3 * k for k in BITRATES[1, 3][1:]]  # bytes of 48 kHz frames
_OVER = 4 + 2 + 17
_HEADS = []
for _i, _size in enumerate(_SIZES):
    _word = bytes((0xFF, 0xFA, _i + 1 << 4 | 1 << 2, 0xC0))
    _HEADS.append(_word + struct.pack(">H", crc16(_word[2:] + bytes(17))) + bytes(17))
_ROOM = [s - _OVER for s in _SIZES]


def pack(payload: bytes) -> bytes:
    """An MPEG-1 layer III stream that carries payload: full frames at 320 kbit/s, the last as small as it can be, then an ID3v1 tag."""
    frames, at, top = [], 0, _ROOM[-1]
    while at < len(payload):
        part = payload[at : at + top]
        k = bisect_left(_ROOM, len(part))
        frames.append(_HEADS[k] + part + bytes(_ROOM[k] - len(part)))
        at += top
    body = b"".join(frames)
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    item = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(item)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + item
    total, ends, pos = 144 + len(body), [], 144
    for f in frames:
        ends.append(pos)
        pos += len(f)
    toc = bytes(min(255, 256 * ends[i * len(frames) // 100] // total) if frames else 0 for i in range(100))
    xing = b"\xff\xfb\x34\xc0" + bytes(17) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return tag + xing.ljust(144, b"\0") + body + ID3V1


def payload(data: bytes, stream: Stream) -> bytes:
    """What pack() stored."""
    parts = []
    for at in stream.offsets:
        h = header(data[at : at + 4])
        parts.append(data[at + 4 + 2 * h.protected + h.side : at + h.size])
    return b"".join(parts)[: int(stream.tags.get("payload_bytes", 0))]


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG stream."""

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([pack(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def seek_digest(offsets: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(offsets)}Q", *offsets))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate int, seek_offsets array<long>, bad_crc long, skipped_bytes long"


def features(media: DataFrame, seek_table: bool = True) -> DataFrame:
    """doc_id, n_bytes and what parse() and payload() give for the media column; a null media is empty."""
    schema = "doc_id long, n_bytes long, " + (FEATURES if seek_table else FEATURES.replace("seek_offsets array<long>, ", ""))

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                data = data or b""
                s = parse(data)
                own = payload(data, s)
                text = f"mpeg1l3 frames={len(s.offsets)} samples={s.samples} rate={s.rate} table={s.table.get('frames', -1)} crc={s.checked - s.bad_crc}/{s.checked} kbps={','.join(f'{k}x{n}' for k, n in sorted(s.kbps.items()))} seek={seek_digest(s.offsets):08x}"
                row = [len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(data), hashlib.sha256(data).hexdigest(), text, len(s.offsets), s.samples, s.rate, s.offsets, s.bad_crc, s.skipped]
                rows.append(row if seek_table else row[:9] + row[10:])
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")[2:]]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)


def store_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seek_table: bool = True) -> DataFrame:
    """Writes the media column to the shared folder, reads the stored bytes back and describes them."""
    return features(materialize(to_media(docs, doc_id, text), "media"), seek_table)
