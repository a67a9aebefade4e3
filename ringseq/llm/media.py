"""MPEG audio columns: streams are parsed to exact durations and frame offsets; bytes can be carried in silent streams.

parse() reads ID3 tags (v1; v2.2 to v2.4 with extended headers and unsynchronization), finds frame headers and falls back into
step after damage (a header counts where the next one follows at its frame's end, or the stream ends there), reads Xing, Info
and VBRI tables with their seek points and the encoder's delay and padding, verifies the checksums of Layers I, II and III, and
gives samples, rate and the byte offset of every frame. carry() makes a Layer III stream, mono, 48 kHz, of silent frames that
hold 192, 384, 576 or 768 bytes each as ancillary data, with an ID3v2 tag, a Xing table and a checksum in each frame;
carried() reads them back.

Defined results: null and empty payloads carry as one unit of padding; null media parse to no frames; bytes that are not
MPEG audio parse to no frames, with all bytes skipped; equal payloads give equal streams; compressed or encrypted tag frames
are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped

# Fixed values of the MPEG audio header: kbit/s by (MPEG 1, layer), Hz by version bits, samples of a frame.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Layer II: bits of an allocation by subband, runs of (subbands, bits): high and low rates of MPEG 1, few channels' bits, MPEG 2.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

#: Bytes of a unit of payload, and kbit/s of the frame that holds so many units.
UNIT, RATE_OF_UNITS = 192, {1: 80, 2: 160, 3: 224, 4: 320}
UNITS_OF_RATE = {r: k for k, r in RATE_OF_UNITS.items()}
SIDE = 17
_SUMS: dict[bytes, int] = {}


@dataclass
class Header:
    length: int
    samples: int
    rate: int
    kbps: int
    layer: int
    mpeg1: bool
    mono: bool
    checked: bool
    same: int
    joint: int


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """Of 32 bits; None if they are no header, or of free format."""
    if word not in _HEADERS:
        version, layer, rate_i, hz_i = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
        if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate_i in (0, 15) or hz_i == 3 or word & 3 == 2:
            _HEADERS[word] = None
        else:
            mpeg1 = version == 3
            kbps, hz, samples, pad = KBPS[mpeg1, layer][rate_i], HZ[version][hz_i], SAMPLES[mpeg1, layer], word >> 9 & 1
            length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
            _HEADERS[word] = Header(length, samples, hz, kbps, layer, mpeg1, word >> 6 & 3 == 3, not word >> 16 & 1, word & 0xFFFE0C00, 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32)
    return _HEADERS[word]


def crc16(data: bytes) -> int:
    if data not in _SUMS:
        if len(_SUMS) > 65536:
            _SUMS.clear()
        c = 0xFFFF
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        _SUMS[data] = c
    return _SUMS[data]


def checked_bits(h: Header, data: bytes) -> int:
    """How many bits after the checksum it covers; data: the frame from there on."""
    if h.layer == 3:
        return 8 * (32 if h.mpeg1 and not h.mono else SIDE if h.mpeg1 or not h.mono else 9)
    channels, joint = 1 if h.mono else 2, 32 if h.mono else h.joint
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + joint)
    each = h.kbps // channels
    if not h.mpeg1:
        table = "lsf"
    elif 56 <= each and (h.rate == 48000 or each <= 80):
        table = "a"
    elif each >= 96:
        table = "b"
    else:
        table = "c" if h.rate != 32000 else "d"
    word, size = int.from_bytes(data[:40], "big") << 8 * max(0, 40 - len(data)), 320
    used = at = band = 0
    for n, bits in ALLOCATION[table]:
        for _ in range(n):
            for _ in range(channels if band < joint else 1):
                some = word >> size - at - bits & (1 << bits) - 1
                used += (some > 0) * (1 if band < joint else channels)
                at += bits
            band += 1
    return at + 2 * used  # and the choice of scale factors, for each band and channel that has samples


def crc16_of_bits(data: bytes, bits: int) -> int:
    c = 0xFFFF
    for i in range(bits):
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ (data[i >> 3] >> 7 - (i & 7) & 1) else 0)) & 0xFFFF
    return c


@dataclass
class Stream:
    samples: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    seek: list[int] = field(default_factory=list)
    delay: int = 0
    padding: int = 0
    checked: int = 0
    failed: int = 0
    resyncs: int = 0
    skipped: int = 0


def _size7(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _plain(data: bytes) -> bytes:
    """Without unsynchronization."""
    return data.replace(b"\xff\0", b"\xff")


def _id3(data: bytes, at: int, tags: dict[str, str]) -> int:
    """End of the ID3v2 tag at `at`; its text frames go to tags, by the frame's name or a TXXX frame's description."""
    major, flags, end = data[at + 3], data[at + 5], at + 10 + _size7(data[at + 6 : at + 10])
    body = data[at + 10 : end]
    whole, i = bool(flags & 128), 0
    if whole and major < 4:
        body = _plain(body)
    if flags & 64 and major > 2 and len(body) >= 4:
        i = _size7(body) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    wide, head = (4, 10) if major > 2 else (3, 6)
    while 2 <= major <= 4 and not (major == 2 and flags & 64) and i + head <= len(body) and body[i]:
        name, size = body[i : i + wide].decode("latin-1"), body[i + wide : i + 2 * wide]
        n = _size7(size) if major == 4 else int.from_bytes(size, "big")
        form, text = body[i + 9] if wide == 4 else 0, body[i + head : i + head + n]
        i += head + n
        if form & (0x0C if major == 4 else 0xC0):  # compressed or encrypted
            continue
        if major == 4:
            text = text[(form >> 6 & 1) + 4 * (form & 1) :]  # a group's mark, the length before unsynchronization
            text = _plain(text) if whole or form & 2 else text
        elif major == 3:
            text = text[form >> 5 & 1 :]
        if name[0] == "T" and text:
            said = text[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1"), "replace")
            key, _, value = said.partition("\0") if name in ("TXXX", "TXX") else (name, "", said)
            tags[key] = value.rstrip("\0")
    return end + 10 * bool(flags & 16 and major == 4)


def _table(data: bytes, x: int, at: int, out: Stream) -> None:
    """A Xing or Info table at x, or a VBRI table of the frame at `at`."""
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, y = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out.table = data[x : x + 4].decode()
        if flags & 1:
            out.table_frames, y = int.from_bytes(data[y : y + 4], "big"), y + 4
        if flags & 2:
            out.table_bytes, y = int.from_bytes(data[y : y + 4], "big"), y + 4
        if flags & 4:
            toc, y = data[y : y + 100], y + 100
            out.seek = [at + b * max(0, out.table_bytes) // 256 for b in toc]  # of every hundredth of the duration
        y += 4 * bool(flags & 8)
        if data[y : y + 4] in (b"LAME", b"Lavc", b"Lavf") and len(data) >= y + 24:
            trim = int.from_bytes(data[y + 21 : y + 24], "big")
            out.delay, out.padding = trim >> 12, trim & 0xFFF
    elif data[at + 36 : at + 40] == b"VBRI":
        word = lambda i, n: int.from_bytes(data[at + i : at + i + n], "big")
        out.table, out.delay, out.table_bytes, out.table_frames = "VBRI", word(42, 2), word(46, 4), word(50, 4)
        entries, scale, size, place = word(54, 2), word(56, 2), word(58, 2), at
        for i in range(entries if 1 <= size <= 4 and at + 62 + entries * size <= len(data) else 0):
            place += word(62 + i * size, size) * scale
            out.seek.append(place)


def parse(data: bytes | None) -> Stream:
    out, data = Stream(), data or b""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3(data, at, out.tags)
    # where an ID3v1 tag may begin: it is none where it lies in a frame that ends with the stream or that another follows
    v1 = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    word = lambda i: int.from_bytes(data[i : i + 4], "big") if i + 4 <= end else -1
    kind, good = None, False
    while at + 4 <= end and at != v1:
        h = header(word(at))
        ok = h is not None and at + h.length <= end and (kind is None or h.same == kind)
        if ok and (not good or at < v1 < at + h.length < end):  # out of step, or over what may be a tag: the next header has to follow too
            after = at + h.length
            ok = after in (v1, end) or (n := header(word(after))) is not None and n.same == h.same
        if not ok:
            out.resyncs += good
            good = False
            stop = v1 if at < v1 else end
            n = data.find(b"\xff", at + 1, stop)
            n = stop if n < 0 else n
            out.skipped += n - at
            at = n
            continue
        first, good, kind = kind is None, True, h.same
        if h.checked:
            bits = checked_bits(h, data[at + 6 : at + 46])
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8]
            if len(covered) * 8 >= 16 + bits:
                out.checked += 1
                out.failed += (crc16(covered) if bits % 8 == 0 else crc16_of_bits(covered, 16 + bits)) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first:
            if h.layer == 3:
                _table(data, at + 4 + (32 if h.mpeg1 and not h.mono else SIDE if h.mpeg1 or not h.mono else 9) + 2 * h.checked, at, out)
            if out.table:
                out.rate, at = h.rate, at + h.length
                continue
        out.offsets.append(at)
        out.kbps.append(h.kbps)
        out.samples += h.samples
        out.rate = h.rate
        at += h.length
    if at == v1 < end:
        end = v1
        out.tags.setdefault("TIT2", data[v1 + 3 : v1 + 33].decode("latin-1").rstrip("\0 "))
    out.skipped += end - at
    return out


def _frame_header(kbps: int, checked: bool) -> bytes:
    """MPEG 1 Layer III, 48 kHz, mono."""
    return (0x7FF << 21 | 3 << 19 | 1 << 17 | (not checked) << 16 | KBPS[True, 3].index(kbps) << 12 | 1 << 10 | 3 << 6).to_bytes(4, "big")


def padded(payload: bytes) -> bytes:
    """Blanks up to a positive multiple of UNIT."""
    return payload.ljust(max(1, -(-len(payload) // UNIT)) * UNIT)


def carry(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds the payload, a positive multiple of UNIT; n_bytes, its length without padding, goes to a tag."""
    units = len(payload) // UNIT
    quads, rest = divmod(units, 4)
    parts = []
    for n, k in ((quads, 4), (1, rest)):
        if n and k:
            head = _frame_header(RATE_OF_UNITS[k], True)
            head += crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)
            frames = np.zeros((n, 3 * RATE_OF_UNITS[k]), np.uint8)
            frames[:, : len(head)] = np.frombuffer(head, np.uint8)
            frames[:, len(head) : len(head) + k * UNIT] = np.frombuffer(payload, np.uint8, n * k * UNIT, 0 if k == 4 else quads * 4 * UNIT).reshape(n, -1)
            parts.append(frames.tobytes())
    body = b"".join(parts)
    ends = [960 * i for i in range(quads + 1)]
    toc = bytes(min(255, 256 * ends[min(quads, i * (quads + bool(rest)) // 100)] // max(1, len(body))) for i in range(100))
    info = (_frame_header(64, False) + bytes(SIDE) + b"Xing" + (7).to_bytes(4, "big") + (quads + bool(rest)).to_bytes(4, "big") + (192 + len(body)).to_bytes(4, "big") + toc).ljust(192, b"\0")
    text = b"\0payload-bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\3\0\0" + size + tag + info + body


def carried(data: bytes, stream: Stream) -> bytes:
    """The payload, padding included."""
    skip = 6 + SIDE
    return b"".join([data[i + skip : i + skip + UNIT * UNITS_OF_RATE[r]] for i, r in zip(stream.offsets, stream.kbps)])


def stored(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """docs with the column `to` in place of a text: its UTF-8 as a stream."""

    def f(texts: list[str | None]) -> list[bytes]:
        raw = [(x or "").encode("utf-8") for x in texts]
        return [carry(padded(b), len(b)) for b in raw]

    return mapped(docs, text, to, "binary", f, keep=False)


#: What parsed() gives.
PARSED = "struct<samples:long,rate:int,frames:long,offsets:array<long>,kbps:array<int>,tags:map<string,string>,table:string,table_frames:long,table_bytes:long,seek:array<long>,delay:int,padding:int,checked:long,failed:long,resyncs:long,skipped:long>"


def parsed(media: DataFrame, column: str = "media", to: str = "audio") -> DataFrame:
    """media with a struct of exact samples and rate, every frame's byte offset and kbit/s, tags, the table's claims and seek points,
    the samples to leave out at both ends, and what was damaged."""

    def f(streams: list[bytes | None]) -> list[dict]:
        return [vars(x) | {"frames": len(x.offsets), "tags": list(x.tags.items())} for x in map(parse, streams)]

    return mapped(media, column, to, PARSED, f)


DIGEST = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"


def digests(media: DataFrame, column: str = "media", to: str = "digest") -> DataFrame:
    """In place of streams made by carry(), a struct of what is read back."""

    def one(data: bytes) -> dict:
        x = parse(data)
        payload = carried(data, x)
        seek = zlib.crc32(np.array(x.offsets, "<i8").tobytes())
        feature = f"rate={x.rate};samples={x.samples};frames={len(x.offsets)};kbps={sum(x.kbps) / max(1, len(x.kbps)):.3f};table={x.table}:{x.table_frames};checked={x.checked};failed={x.failed};resyncs={x.resyncs};seek={seek:08x}"
        return {"n_bytes": int(x.tags["payload-bytes"]), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature}

    return mapped(media, column, to, DIGEST, lambda streams: [one(x) for x in streams], keep=False)
