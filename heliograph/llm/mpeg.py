"""MPEG audio columns: a Layer III stream reader, and a writer that carries bytes losslessly.

The reader takes any bytes: it reads an ID3v2 tag (versions 2 to 4; what does not fit in it is left out), finds frame
headers again after damage (a header counts if another one, or the end, follows where its length says, or if it fits the
frame before), checks the CRC-16 of protected frames, reads Xing/Info and VBRI variable-bitrate tables and the ID3v1
trailer, and returns exact durations (samples over rate, summed for each rate) with the byte offset of every frame.
The writer makes a silent stream
(side information all zero, so each frame's main data is empty) whose ancillary bytes are the payload,
framed at varying bitrates behind an Info frame with frame count, byte count and seek table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3, Layer III).
KBPS_V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBPS_V2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

MONO, RATE = 3, 1  # the writer's: MPEG-1, mono, 48 kHz
OVERHEAD = 4 + 2 + 17  # header, checksum, side information
TAG = b"TAG"


@dataclass(slots=True)
class Header:
    version: int
    bitrate: int
    rate: int
    length: int
    samples: int
    mono: bool
    protected: bool

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@dataclass(slots=True)
class Stream:
    frames: int = 0
    samples: dict[int, int] = field(default_factory=dict)  # by rate
    bad_checksums: int = 0
    skipped: int = 0
    bitrates: dict[int, int] = field(default_factory=dict)
    tags: dict[str, bytes] = field(default_factory=dict)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""
    carried: int | None = None  # bytes of the payload, as the writer's tag says

    @property
    def seconds(self) -> Fraction:
        return sum((Fraction(n, rate) for rate, n in self.samples.items()), Fraction(0))


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The Layer III header in four bytes, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, word[1] >> 1 & 3
    rate_at, kbps_at = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer != 1 or rate_at == 3 or kbps_at in (0, 15) or word[3] & 3 == 2:
        return None
    kbps, rate = (KBPS_V1 if version == 3 else KBPS_V2)[kbps_at], RATES[version][rate_at]
    samples = 1152 if version == 3 else 576
    return Header(version, kbps, rate, samples * kbps * 125 // rate + (word[2] >> 1 & 1), samples, word[3] >> 6 == MONO, not word[1] & 1)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 8005 (hex), start value all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _number(data: bytes, at: int, n: int, safe: bool) -> int:
    """A big-endian number of ``n`` bytes, of seven bits each if ``safe``."""
    out = 0
    for byte in data[at : at + n]:
        out = out << 7 | byte & 127 if safe else out << 8 | byte
    return out


def _frames(body: bytes, version: int) -> Iterator[tuple[str, bytes]]:
    """(id, content) of a tag's frames, up to padding or the first that does not fit."""
    wide = 4 if version > 2 else 3
    head = 10 if version > 2 else 6
    at = 0
    while at + head <= len(body) and re.fullmatch(rb"[A-Z][A-Z0-9]+", name := body[at : at + wide]):
        n = _number(body, at + wide, wide, version == 4)
        flags = body[at + 9] if version == 4 else 0
        content = body[at + head : at + head + n]
        if len(content) < n:
            return
        if flags & 1:  # the length before unsynchronisation
            content = content[4:]
        if flags & 2:
            content = content.replace(b"\xff\0", b"\xff")
        yield name.decode("ascii"), content
        at += head + n


def _id3v2(data: bytes, out: Stream) -> int:
    """Reads the tag's frames, of several with one id the first; the offset behind the tag, 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    version, flags = data[3], data[5]
    end = 10 + _number(data, 6, 4, True)
    body = data[10:end]
    if 2 <= version <= 4:
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 0x40 and version > 2:  # an extended header, whose size counts itself in version 4
            body = body[_number(body, 0, 4, version == 4) + 4 * (version == 3) :]
        for name, content in _frames(body, version):
            out.tags.setdefault(name, content)
            owner, _, rest = content.partition(b"\0")
            if name == "PRIV" and owner == b"payload" and len(rest) >= 8 and out.carried is None:
                out.carried = struct.unpack("<Q", rest[:8])[0]
    return min(len(data), end + 10 * (version == 4 and flags & 0x10 > 0))


def _table(frame: bytes, main: bytes, out: Stream) -> bool:
    """Reads a variable-bitrate table, if the first frame holds one; fields that it cuts short stay unknown."""
    if main[:4] in (b"Xing", b"Info") and len(main) >= 8:
        flags, p = _number(main, 4, 4, False), 8
        if flags & 1:
            out.vbr_frames, p = _number(main, p, 4, False) if len(main) >= p + 4 else None, p + 4
        if flags & 2:
            out.vbr_bytes, p = _number(main, p, 4, False) if len(main) >= p + 4 else None, p + 4
        if flags & 4 and len(main) >= p + 100:
            out.toc = main[p : p + 100]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.vbr_bytes, out.vbr_frames, entries, _, width = struct.unpack(">IIHHH", frame[46:60])
        out.toc = frame[62 : 62 + entries * width]
        return True
    return False


def _confirmed(data: bytes, at: int, end: int) -> bool:
    """Whether a header stands at ``at`` and another one, or the end, where its frame ends."""
    h = header(data[at : at + 4])
    return h is not None and (at + h.length == end or at + h.length < end and header(data[at + h.length : at + h.length + 4]) is not None)


def _resync(data: bytes, at: int, end: int) -> int:
    """The next offset from ``at`` with a confirmed header; ``end`` if there is none."""
    while 0 <= (at := data.find(b"\xff", at, end)) < end:
        if _confirmed(data, at, end):
            return at
        at += 1
    return end


def read(data: bytes) -> Stream:
    """Everything in a stream; bytes that belong to no frame are counted as skipped."""
    out, body = Stream(), []
    end = len(data)
    at = _id3v2(data, out)
    if end - at >= 128 and data[-128:-125] == TAG:
        end -= 128
        out.tags["TAG"] = data[end:]
    last: Header | None = None
    seen = False
    while at < end:
        h = header(data[at : at + 4])
        if h is None or at + h.length > end or not (_confirmed(data, at, end) or last and (last.version, last.rate, last.mono) == (h.version, h.rate, h.mono)):
            found = _resync(data, at + 1, end)
            out.skipped += found - at
            at = found
            continue
        last = h
        start = at + 4 + 2 * h.protected
        if h.protected and crc16(data[at + 2 : at + 4] + data[start : start + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big"):
            out.bad_checksums += 1
        main = data[start + h.side : at + h.length]
        first, seen = not seen, True
        if not (first and _table(data[at : at + h.length], main, out)):
            out.offsets.append(at)
            out.frames += 1
            out.samples[h.rate] = out.samples.get(h.rate, 0) + h.samples
            out.bitrates[h.bitrate] = out.bitrates.get(h.bitrate, 0) + 1
            body.append(main)
        at += h.length
    out.payload = b"".join(body)[: out.carried]
    return out


def _frame_head(kbps_at: int) -> bytes:
    word = bytes((0xFF, 0xFA, kbps_at << 4 | RATE << 2, MONO << 6))
    side = bytes(17)
    return word + crc16(word[2:] + side).to_bytes(2, "big") + side


@lru_cache(maxsize=1)
def _sizes() -> list[tuple[int, int, bytes]]:
    """(bytes carried, frame length, head) of each bitrate."""
    heads = [_frame_head(k) for k in range(1, 15)]
    lengths = [header(x[:4]).length for x in heads]
    return [(n - OVERHEAD, n, x) for n, x in zip(lengths, heads, strict=True)]


def write(payload: bytes) -> bytes:
    """A stream that carries ``payload``: full frames at the highest bitrate, the rest in the smallest that holds it."""
    room = _sizes()
    most, _, head = room[-1]
    frames = [head + payload[i : i + most] for i in range(0, len(payload) - most + 1, most)]
    if rest := payload[len(frames) * most :] if payload else b"":
        hold, _, head = next(x for x in room if x[0] >= len(rest))
        frames.append(head + rest + bytes(hold - len(rest)))
    total = sum(map(len, frames))
    starts, at = [], 0
    for x in frames:
        starts.append(at)
        at += len(x)
    toc = bytes(min(255, starts[len(starts) * i // 100] * 256 // total) if total else 0 for i in range(100))
    hold, _, head = next(x for x in room if x[0] >= 116)
    info = b"Info" + struct.pack(">III", 7, len(frames), total) + toc
    private = b"payload\0" + struct.pack("<QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + head + info + bytes(hold - len(info)) + b"".join(frames) + TAG + bytes(125)


def features(s: Stream) -> str:
    """Frame count, exact duration, bitrates, table and checksum state, and a digest of the seek offsets."""
    rates = ";".join(f"{k}x{n}" for k, n in sorted(s.bitrates.items()))
    seconds = "+".join(f"{n}/{rate}" for rate, n in sorted(s.samples.items())) or "0"
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}Q", *s.offsets))
    return f"frames={s.frames} seconds={seconds} kbps={rates} table={s.vbr_frames},{s.vbr_bytes} bad={s.bad_checksums} skipped={s.skipped} seek={seek}"


MEDIA = "doc_id long, media binary"
FACTS = (
    "doc_id long, frames long, samples map<int,long>, seconds double, bad_checksums long, skipped long, table_frames long, table_bytes long, toc binary,"
    " offsets array<long>, payload binary"
)
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with zero bytes up to a positive multiple of 64, and the length before."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Few rows at a time, so that a batch of long texts is not held in several forms at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0), part.column(1)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: the stream that carries each text's padded bytes. Null text: empty, as 64 zero bytes."""

    def run(batches):
        for ids, texts in _rows(batches):
            yield pa.record_batch([ids, pa.array([write(padded(t.as_py())[0]) for t in texts], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MEDIA)


def decode(media: DataFrame) -> DataFrame:
    """Durations (samples by rate, and seconds), checksum counts, tables, frame offsets and carried bytes of each stream of (doc_id, media).

    Null media or bytes without a frame give 0 frames; damaged parts are skipped and counted.
    """

    def run(batches):
        for ids, blobs in _rows(batches):
            got = [read(x.as_py() or b"") for x in blobs]
            columns = {
                "frames": ([s.frames for s in got], pa.int64()), "samples": ([list(s.samples.items()) for s in got], pa.map_(pa.int32(), pa.int64())),
                "seconds": ([float(s.seconds) for s in got], pa.float64()), "bad_checksums": ([s.bad_checksums for s in got], pa.int64()),
                "skipped": ([s.skipped for s in got], pa.int64()), "table_frames": ([s.vbr_frames for s in got], pa.int64()),
                "table_bytes": ([s.vbr_bytes for s in got], pa.int64()), "toc": ([s.toc for s in got], pa.binary()),
                "offsets": ([s.offsets for s in got], pa.list_(pa.int64())), "payload": ([s.payload for s in got], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict({"doc_id": ids} | {k: pa.array(x, kind) for k, (x, kind) in columns.items()})

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, FACTS)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text as a stream, reads it back and returns digests of both, one row per row of ``docs``.

    Writing and reading happen in one pass, so the streams do not travel. Null text counts as empty.
    """

    def run(batches):
        for ids, texts in _rows(batches):
            out = []
            for t in texts:
                payload, n = padded(t.as_py())
                blob = write(payload)
                got = read(blob)
                out.append((n, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), features(got)))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*out, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST)
