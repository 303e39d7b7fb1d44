"""Media columns: lossless PNG in binary columns, and hashes of low-frequency cosine coefficients.

The writer and reader of PNG are our own: signature, chunks with checksums,
zlib streams, and all five row filters undone with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576
PAD = 255


class MediaError(ValueError):
    """Bytes that are not a PNG of the kinds read here, or damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """Rows with a filter byte each, image of (rows, bytes) of one byte a pixel."""
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up = np.zeros_like(image)
    up[1:] = image[:-1]
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    if kind == 0:
        body = image
    elif kind == 1:
        body = image - left
    elif kind == 2:
        body = image - up
    elif kind == 3:
        body = image - ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    else:
        body = image - _nearest(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
    return np.concatenate([np.full((len(image), 1), kind, np.uint8), body], axis=1)


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and corner the one nearest to left + up - corner."""
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def _chosen(image: np.ndarray, step: int = 2048) -> np.ndarray:
    """Rows with a filter byte each: of the filters 0 to 2 the one with the least sum of absolute differences, the first of equal ones."""
    out = np.empty((len(image), image.shape[1] + 1), np.uint8)
    for at in range(0, len(image), step):
        part = image[at : at + step]
        above = image[max(0, at - 1) : at + len(part) - 1]
        along, down = part.copy(), part.copy()
        along[:, 1:] -= part[:, :-1]
        down[len(part) - len(above) :] -= above
        kinds = (part, along, down)
        best = np.argmin([abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in kinds], axis=0)
        out[at : at + step, 0] = best
        out[at : at + step, 1:] = np.where(best[:, None] == 0, part, np.where(best[:, None] == 1, along, down))
    return out


def write_png(image: np.ndarray, row_filter: int | None = None, level: int = 6, chunk: int = 1 << 20) -> bytes:
    """An 8-bit grey PNG of a (rows, columns) uint8 array; row_filter: of all rows, or None for a choice by row."""
    rows, columns = image.shape
    body = _chosen(image) if row_filter is None else _filtered(image, row_filter)
    packed = zlib.compress(body.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[k : k + chunk]) for k in range(0, len(packed), chunk)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, last = 8, b""
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("a chunk is cut off")
        n, last = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(last + body)):
            raise MediaError(f"chunk {last!r}: checksum")
        yield last, body
        at += 12 + n
        if last == b"IEND":
            return
    raise MediaError("no end chunk")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """(rows, bytes) behind filter bytes; step: bytes a pixel."""
    kinds, body = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("an unknown row filter")
    if not kinds.any():
        return body
    width = body.shape[1]
    along = kinds == 1
    if along.any():  # undone by itself, a row needs no other
        rows_ = np.pad(body[along], ((0, 0), (0, -width % step)))
        body[along] = np.cumsum(rows_.reshape(len(rows_), -1, step), axis=1, dtype=np.uint8).reshape(len(rows_), -1)[:, :width]
    if kinds.max() <= 2:
        # runs of rows that add to the row above: running sums from the row before each run, all at once
        sums = np.cumsum(body, axis=0, dtype=np.uint8)
        first = np.maximum.accumulate(np.where(kinds != 2, np.arange(len(kinds)), 0))
        return sums - np.where(first[:, None] > 0, sums[np.maximum(first - 1, 0)], 0).astype(np.uint8)
    before = np.zeros(width, np.uint8)
    for k, kind in enumerate(kinds):
        row = body[k]
        if kind == 2:
            row += before
        elif kind == 3:
            for j in range(0, width, step):
                left = row[j - step : j].astype(np.uint16) if j else np.uint16(0)
                here = slice(j, j + step)
                row[here] += ((left + before[here]) // 2).astype(np.uint8)
        elif kind == 4:
            zero = np.zeros(step, np.int16)
            for j in range(0, width, step):
                here, was = slice(j, j + step), slice(j - step, j)
                a, c = (row[was].astype(np.int16), before[was].astype(np.int16)) if j else (zero, zero)
                row[here] += _nearest(a, before[here].astype(np.int16), c).astype(np.uint8)
        before = row
    return body


#: Samples a pixel by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes, most: int = 1 << 31) -> np.ndarray:
    """(rows, columns) or (rows, columns, channels) uint8 of an 8-bit PNG without interlacing or palette; damaged bytes raise MediaError,
    and so do headers that claim more than ``most`` bytes, which no text column can hold."""
    head, packed, ended = None, [], False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise MediaError("no header")
    columns, rows, depth, colour, method, filters, interlace = head
    if depth != 8 or colour not in CHANNELS or method or filters or interlace or not rows or not columns:
        raise MediaError("a kind of PNG that is not read here")
    step = CHANNELS[colour]
    need = rows * (columns * step + 1)
    if need > most:
        raise MediaError("too large")
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(packed), need + 1)
        if len(raw) == need and not stream.eof:  # the stream's own checksum comes last
            raw += stream.decompress(stream.unconsumed_tail, 1)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != need or not stream.eof:
        raise MediaError("samples and size differ")
    image = _unfiltered(np.frombuffer(raw, np.uint8).reshape(rows, -1), step)
    return image if step == 1 else image.reshape(rows, columns, step)


def payload(text: str | None, unit: int = WIDTH) -> bytes:
    """UTF-8 of a text with PAD appended up to a positive multiple of unit."""
    data = (text or "").encode()
    return data + bytes([PAD]) * ((-len(data)) % unit or (0 if data else unit))


def _cosines(n: int, most: int) -> np.ndarray:
    k, x = np.arange(most)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


SIDE, KEPT = 32, 8
_COSINES = _cosines(SIDE, KEPT)


def _shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE equal parts of an axis; shorter axes repeat their samples."""
    n = image.shape[axis]
    if n < SIDE:
        return np.take(image, np.arange(SIDE) * n // SIDE, axis=axis)
    cuts = np.arange(SIDE) * n // SIDE
    return np.add.reduceat(image, cuts, axis=axis) / np.expand_dims(np.diff(np.append(cuts, n)), 1 - axis)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the KEPT x KEPT lowest cosine coefficients of the shrunk image exceed their median."""
    if image.ndim == 3:
        image = image[..., : 3 if image.shape[2] > 2 else 1].mean(axis=2)
    if image.shape[0] >= SIDE:
        image = _shrunk(image.astype(np.uint64), 0)
        small = _shrunk(image, 1)
    else:
        small = _shrunk(_shrunk(image.astype(np.float64), 1), 0)
    low = (_COSINES @ small @ _COSINES.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_filter: int | None = None, level: int = 6) -> DataFrame:
    """doc_id, n_bytes and media (binary): each text's payload as a grey PNG of WIDTH columns.

    Null and empty texts store one row of PAD. Repeated rows and null ids stay.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    data = payload(text)
                    sizes.append(len((text or "").encode()))
                    media.append(write_png(np.frombuffer(data, np.uint8).reshape(-1, WIDTH), row_filter, level))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(media: DataFrame) -> DataFrame:
    """FEATURES of each stored medium, from its bytes read back.

    Media that are null or damaged have an error and null features; they do
    not end the job.
    """

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                try:
                    image = read_png(data or b"")
                except MediaError as e:
                    rows.append((None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None, str(e)))
                    continue
                back = image.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image), None))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
