"""Motion-JPEG in AVI: lossless intra frames (JPEG process 14), RIFF index parsing and shot detection.

A sample is coded as a Huffman category code followed by its category's extra bits. The table used by the writer
gives category s a code of 9 - s bits, so that every sample takes nine bits and a whole frame can be unpacked with
array shifts. The reader takes any Huffman table; one without that property is decoded bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 64
MOST_ROWS = 64
FRAME_MS = 40
#: Markers and tags of the JPEG, RIFF and AVI formats (fixed values).
SOI, EOI, SOF3, DHT, SOS, COM = 0xD8, 0xD9, 0xC3, 0xC4, 0xDA, 0xFE


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


_COUNTS = bytes([1] * 9 + [0] * 7)
_SYMBOLS = bytes(range(8, -1, -1))


def _words() -> np.ndarray:
    """Nine-bit word of each difference from -255 to 255."""
    codes = _codes(_COUNTS, _SYMBOLS)
    words = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        words[d + 255] = (codes[s][0] << s) | (d if d >= 0 else d + (1 << s) - 1)
    return words


_WORDS = _words()
_DIFFS = np.zeros(512, np.int16)
_DIFFS[_WORDS] = np.arange(-255, 256)
_DHT = struct.pack(">BBHB", 0xFF, DHT, 2 + 17 + len(_SYMBOLS), 0) + _COUNTS + _SYMBOLS


def _head(rows: int, width: int) -> bytes:
    sof = struct.pack(">BBHBHHBBBB", 0xFF, SOF3, 11, 8, rows, width, 1, 1, 0x11, 0)
    sos = struct.pack(">BBHBBBBBB", 0xFF, SOS, 8, 1, 1, 0x00, 1, 0, 0)
    return bytes([0xFF, SOI]) + _DHT + sof + sos


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG of each frame; frames: (n, rows, width) uint8, width a multiple of 8."""
    n, rows, width = frames.shape
    wide = frames.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    diff[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    diff[:, 0, 0] = wide[:, 0, 0] - 128
    c = _WORDS[diff + 255].reshape(n, -1, 8)
    packed = np.empty((n, c.shape[1], 9), np.uint8)
    packed[:, :, 0] = c[:, :, 0] >> 1
    for b in range(1, 8):
        packed[:, :, b] = ((c[:, :, b - 1] & ((1 << b) - 1)) << (8 - b)) | (c[:, :, b] >> (1 + b))
    packed[:, :, 8] = c[:, :, 7] & 255
    head, end = _head(rows, width), bytes([0xFF, EOI])
    return [head + scan.tobytes().replace(b"\xff", b"\xff\x00") + end for scan in packed]


def decode_frame(data: bytes) -> np.ndarray:
    """Samples of a lossless one-component JPEG with predictor 1."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, tables, shape = 2, {}, None
    while True:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == DHT:
            while body:
                counts = body[1:17]
                tables[body[0] & 15] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == SOF3:
            shape = struct.unpack(">HH", body[1:5])
        elif marker == SOS:
            table = tables[body[2] >> 4]
            break
    rows, width = shape
    scan = data[at : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    if table == (_COUNTS, _SYMBOLS) and rows * width % 8 == 0:
        p = np.frombuffer(scan, np.uint8).reshape(-1, 9).astype(np.uint16)
        words = np.empty((len(p), 8), np.uint16)
        for j in range(8):
            words[:, j] = ((p[:, j] & ((1 << (8 - j)) - 1)) << (j + 1)) | (p[:, j + 1] >> (7 - j))
        diff = _DIFFS[words.reshape(rows, width)].astype(np.int32)
    else:
        diff = _any_table(scan, table, rows * width).reshape(rows, width)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return (np.cumsum(diff, axis=1) & 255).astype(np.uint8)


def _any_table(scan: bytes, table: tuple[bytes, bytes], n: int) -> np.ndarray:
    symbol = {(length, code): s for s, (code, length) in _codes(*table).items()}
    bits, at, out = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0, np.zeros(n, np.int32)
    for i in range(n):
        code = length = 0
        while (length, code) not in symbol:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        s, value = symbol[length, code], 0
        for _ in range(s):
            value, at = value << 1 | bits[at], at + 1
        out[i] = value if not s or value >> (s - 1) else value - (1 << s) + 1
    return out


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], rows: int, width: int = WIDTH) -> bytes:
    """An AVI file with one MJPG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, len(frames), 0, 1, most, width, rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, FRAME_MS, 1000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, rows, 1, 8, b"MJPG", rows * width, 0, 0, 0, 0)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The coded frames of the first video stream, found through idx1 (or by walking movi where there is none), and
    the milliseconds a frame lasts."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index, ms = 12, None, None, float(FRAME_MS)
    while at + 8 <= len(data):
        tag, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if tag == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            ms = int.from_bytes(data[at + 20 : at + 24], "little") / 1000
        elif tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + n)
        elif tag == b"idx1":
            index = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if movi is None:
        return [], ms
    frames = []
    if index is not None:
        entries = [struct.unpack_from("<4sIII", index, k) for k in range(0, len(index) - 15, 16)]
        base = 0 if entries and data[entries[0][2] : entries[0][2] + 4] == entries[0][0] else movi[0]
        frames = [data[base + o + 8 : base + o + 8 + n] for tag, _, o, n in entries if tag[2:] in (b"dc", b"db")]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + (n & 1)
    return frames, ms


def shots(frames: list[np.ndarray], window: int = 12, least: float = 0.2, spread: float = 3.0) -> list[tuple[int, int]]:
    """Clips as (first frame, end frame). A cut lies where the histogram difference exceeds `least` and the mean plus
    `spread` deviations of the differences since the last cut, `window` at most."""
    if not frames:
        return []
    hist = np.stack([np.bincount(f.ravel() >> 3, minlength=32) / f.size for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts, recent = [0], []
    for t, d in enumerate(diff, 1):
        if d > least and d > (np.mean(recent) + spread * np.std(recent) if len(recent) > 1 else least):
            cuts.append(t)
            recent = []
        else:
            recent = [*recent[1 - window :], d]
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True))
