"""PDF pages: how to read each, guards as expressions, and a writer and reader of image-only PDFs.

The reader takes what the writer makes and files like it: pages that draw one
Flate-packed image. Anything else is PDF_DECODE_FAILED; another codec can take
read_pages' place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import Settings


class PdfError(ValueError):
    """code: the reason code of the failure."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code} {detail}".strip())
        self.code, self.detail = code, detail


def read_source(s: Settings = Settings()) -> Column:
    """embedded, or render@dpi, of columns n_objects, sole_is_image, coverage, upright, native_dpi."""
    sole = (F.col("n_objects") == 1) & F.col("sole_is_image") & (F.col("coverage") >= s.pdf_page_image_coverage)
    native = F.concat(F.lit("render@"), F.round(F.least(F.col("native_dpi"), F.lit(float(s.pdf_max_dpi)))).cast("int").cast("string"))
    return F.when(sole & F.col("upright"), "embedded").when(sole & F.col("native_dpi").isNotNull(), native).otherwise(F.lit(f"render@{s.pdf_render_dpi}"))


def page_guard(page_count: Column, most: int = Settings().pdf_max_pages) -> Column:
    """A file with too many pages is refused as a whole, never cut."""
    return F.when(page_count == 0, "PDF_NO_PAGES").when(page_count > most, "PDF_TOO_MANY_PAGES")


def points(pixels: Column, dpi: int) -> Column:
    return pixels * 72 / dpi


def write(images: list[np.ndarray | None], dpi: int = Settings().pdf_out_dpi) -> bytes:
    """A PDF of (rows, columns) or (rows, columns, 3 BGR) uint8 images, packed without loss; missing ones are left out."""
    images = [i for i in images if i is not None and i.size]
    if not images:
        raise PdfError("PDF_NO_PAGES")
    objects: list[bytes] = []
    kids = []
    for n, image in enumerate(images):
        h, w = image.shape[:2]
        colour = image.ndim == 3
        data = zlib.compress(np.ascontiguousarray(image[..., ::-1] if colour else image).tobytes())
        page, draw, picture = 3 + 3 * n, 4 + 3 * n, 5 + 3 * n
        kids.append(page)
        wp, hp = w * 72 / dpi, h * 72 / dpi
        content = b"q %.4f 0 0 %.4f 0 0 cm /Im Do Q" % (wp, hp)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Contents %d 0 R /Resources << /XObject << /Im %d 0 R >> >> >>" % (wp, hp, draw, picture))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /%s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, b"DeviceRGB" if colour else b"DeviceGray", len(data), data))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), *objects]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


_OBJECT = re.compile(rb"(\d+) 0 obj\s*(<<.*?>>)\s*(?:stream\r?\n|endobj)", re.S)


def read_pages(data: bytes, s: Settings = Settings()) -> Iterator[tuple[int, np.ndarray, str]]:
    """(page from 1, BGR image, source) of each page, in order."""
    at = data[:1024].find(b"%PDF-")
    if at < 0:
        raise PdfError("PDF_DECODE_FAILED", "no header")
    if b"/Encrypt" in data:
        raise PdfError("PDF_DECODE_FAILED", "encrypted")
    objects: dict[int, tuple[bytes, int]] = {}
    place = at
    while (m := _OBJECT.search(data, place)) is not None:
        objects[int(m[1])] = (m[2], m.end())
        length = re.search(rb"/Length (\d+)", m[2])
        place = m.end() + (int(length[1]) if length and not m[0].endswith(b"endobj") else 0)
    tree = next((o for o, _ in objects.values() if b"/Type /Pages" in o), None)
    if tree is None:
        raise PdfError("PDF_DECODE_FAILED", "no page tree")
    kids = [int(k) for k in re.findall(rb"(\d+) 0 R", (re.search(rb"/Kids \[(.*?)\]", tree, re.S) or [b"", b""])[1])]
    if not kids:
        raise PdfError("PDF_NO_PAGES")
    if len(kids) > s.pdf_max_pages:
        raise PdfError("PDF_TOO_MANY_PAGES", f"{len(kids)} > {s.pdf_max_pages}")
    for n, kid in enumerate(kids, 1):
        used = re.search(rb"/XObject << /\w+ (\d+) 0 R", objects.get(kid, (b"", 0))[0])
        head, start = objects.get(int(used[1]), (b"", 0)) if used else (b"", 0)
        size = [re.search(rb"/%s (\d+)" % k, head) for k in (b"Width", b"Height", b"Length")]
        if b"/FlateDecode" not in head or not all(size):
            raise PdfError("PDF_DECODE_FAILED", f"page {n}: no plain image")
        w, h, length = (int(x[1]) for x in size)
        colours = 3 if b"/DeviceRGB" in head else 1
        try:
            raw = zlib.decompressobj().decompress(data[start : start + length], w * h * colours + 1)
        except zlib.error as e:
            raise PdfError("PDF_DECODE_FAILED", str(e)) from e
        if len(raw) != w * h * colours:
            raise PdfError("PDF_DECODE_FAILED", f"page {n}: wrong size")
        image = np.frombuffer(raw, np.uint8).reshape(h, w, colours)
        yield n, np.ascontiguousarray(image[..., ::-1] if colours == 3 else np.repeat(image, 3, axis=2)), "embedded"
