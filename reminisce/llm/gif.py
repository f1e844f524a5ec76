"""GIF streams: LZW codes, palettes, disposal, transparency and timed frames, without an imaging library."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_SINGLES = [bytes([i]) for i in range(256)]


@dataclass
class Frame:
    """One frame: its own indices, and the whole canvas (height, width, 4) once it is drawn."""

    delay_ms: int
    disposal: int
    left: int
    top: int
    indices: np.ndarray
    canvas: np.ndarray


def _widths(base: int, n: int) -> np.ndarray:
    """Bits of each of the n codes that follow a clear code, clear = 2**base: one more when the table outgrows them, 12 at most."""
    table = (1 << base) + 1 + np.arange(n)
    return np.minimum(12, np.floor(np.log2(table)).astype(np.int64) + 1)


_FULL = {base: _widths(base, 4096) for base in range(2, 9)}


def lzw_encode(data: bytes, base: int = 8) -> bytes:
    """The code stream of data, whose values are below 2**base; the table is cleared when full."""
    clear, codes, widths, run = 1 << base, [1 << base], [base + 1], 0
    first = clear + 2
    segments: list[tuple[int, int]] = []  # (where the codes after a clear begin, how many)
    table: dict[int, int] = {}
    following, begin = first, 1
    it = iter(data)
    prefix = next(it, None)
    add = codes.append
    if prefix is not None:
        for byte in it:
            key = prefix << 8 | byte
            if key in table:
                prefix = table[key]
                continue
            add(prefix)
            if following < 4096:
                table[key] = following
                following += 1
            else:
                add(clear)
                segments.append((begin, len(codes) - begin))
                begin, following, table = len(codes), first, {}
            prefix = byte
        add(prefix)
    add(clear + 1)
    segments.append((begin, len(codes) - begin))
    full = _FULL[base]
    sizes = np.concatenate([widths, *(full[:n] if n <= 4096 else np.r_[full, np.full(n - 4096, 12)] for _, n in segments)])
    values = np.array(codes, np.uint16)
    bits = (values[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < sizes[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, base: int) -> bytes:
    """The values of a code stream up to its end code, or to its last whole code if it has none."""
    clear, end = 1 << base, (1 << base) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    out: list[bytes] = []
    add, at, start = out.append, 0, [*_SINGLES[:clear], b"", b""]
    powers = 1 << np.arange(12)
    while at < len(bits):
        # the codes up to the next clear code, read by the width each has if none comes sooner
        found, here, count = [], at, 0
        while here < len(bits):
            width = int(_FULL[base][min(count, 4095)])
            n = int(np.searchsorted(_FULL[base], width, "right")) - count if width < 12 else 4096
            n = min(n, (len(bits) - here) // width)
            if n <= 0:
                here = len(bits)
                break
            codes = bits[here : here + n * width].reshape(n, width) @ powers[:width]
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                found.extend(codes[: stop[0]].tolist())
                here += (int(stop[0]) + 1) * width
                if codes[stop[0]] == end:
                    at = len(bits)
                break
            found.extend(codes.tolist())
            here += n * width
            count += n
        at = max(at, here) if at < len(bits) else at
        table, last = start[:], None
        grow = table.append
        for code in found:
            if last is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code beyond the table")
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    grow(last + entry[:1])
            add(entry)
            last = entry
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _split(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(frames: list[np.ndarray], palette: np.ndarray, delay_ms: int = 100) -> bytes:
    """A GIF of frames of equal shape (height, width), 8-bit indices into a palette of (256, 3)."""
    height, width = frames[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for x in frames:
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay_ms // 10, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, x.shape[1], x.shape[0], 0), b"\x08", _split(lzw_encode(x.tobytes()))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> list[Frame]:
    """The frames of a GIF, each drawn over what the disposal of the one before leaves. A stream that ends early has its missing pixels as index 0."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    canvas, frames = np.zeros((height, width, 4), np.uint8), []
    delay, disposal, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10, body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        if palette is None:
            raise ValueError("a GIF frame without a palette")
        base = data[at]
        stream, at = _blocks(data, at + 1)
        values = np.zeros(w * h, np.uint8)
        read = np.frombuffer(lzw_decode(stream, base), np.uint8)[: w * h]
        values[: len(read)] = read
        values = values.reshape(h, w)
        if flags & 0x40:  # interlaced: four passes over the rows
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            values = values[np.argsort(rows)]
        before = canvas.copy() if disposal == 3 else None
        seen = values[: max(0, height - top), : max(0, width - left)]
        drawn = np.dstack([palette[np.minimum(seen, len(palette) - 1)], np.full(seen.shape, 255, np.uint8)])
        part = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        part[...] = drawn if clear is None else np.where((seen == clear)[..., None], part, drawn)
        frames.append(Frame(delay, disposal, left, top, values, canvas.copy()))
        if disposal == 2:
            part[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None
    return frames
