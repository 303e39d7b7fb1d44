"""Bytes to BGR images and back, without an imaging library: PNG (8-bit, not interlaced) and uncompressed BMP."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"


class DecodeError(ValueError):
    pass


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey or BGR image."""
    h, w = image.shape[:2]
    body = image if image.ndim == 2 else image[..., ::-1]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(body).reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return _PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _undo(raw: np.ndarray, step: int) -> np.ndarray:
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    last = np.zeros(rows.shape[1], np.uint8)
    for k, row in enumerate(rows):
        if kinds[k] == 1:
            row[:] = row.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()
        elif kinds[k] == 2:
            row += last
        elif kinds[k] in (3, 4):
            values, up = row.tolist(), last.tolist()
            for j in range(len(values)):
                a, b, c = (values[j - step], up[j], up[j - step]) if j >= step else (0, up[j], 0)
                if kinds[k] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                values[j] = (values[j] + guess) & 255
            row[:] = values
        elif kinds[k]:
            raise DecodeError("row filter")
        last = row
    return rows


def _png(data: bytes) -> np.ndarray:
    at, head, packed, palette = 8, None, b"", None
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise DecodeError("checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None:
        raise DecodeError("header")
    w, h, depth, colour, _, _, interlace = head
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or interlace or not step or not w or not h:
        raise DecodeError("a kind of PNG that is not read here")
    raw = zlib.decompressobj().decompress(packed, h * (w * step + 1) + 1)
    if len(raw) != h * (w * step + 1):
        raise DecodeError("size")
    px = _undo(np.frombuffer(raw, np.uint8).reshape(h, -1), step).reshape(h, w, step)
    if colour == 3:
        if palette is None:
            raise DecodeError("palette")
        px = palette[px[..., 0]]
    elif colour in (0, 4):
        px = np.repeat(px[..., :1], 3, axis=2)
    return np.ascontiguousarray(px[..., 2::-1])


def _bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, depth, packing = struct.unpack("<IIiiHHI", data[10:34])
    if size < 40 or packing not in (0, 3) or depth not in (24, 32) or w <= 0 or not h:
        raise DecodeError("a kind of BMP that is not read here")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data[start : start + stride * abs(h)], np.uint8)
    if len(rows) != stride * abs(h):
        raise DecodeError("size")
    px = rows.reshape(abs(h), stride)[:, : w * depth // 8].reshape(abs(h), w, -1)[..., :3]
    return np.ascontiguousarray(px[::-1] if h > 0 else px)


def decode(data: bytes) -> np.ndarray:
    """The BGR image of PNG or BMP bytes; DecodeError for anything else."""
    try:
        if data[:8] == _PNG:
            return _png(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (zlib.error, struct.error, ValueError, IndexError) as e:
        raise DecodeError(str(e)) from e
    raise DecodeError("unknown format")
