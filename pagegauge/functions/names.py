"""Names and first bytes of files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
INPUTS = (*IMAGES, ".pdf")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def is_image(path: Column) -> Column:
    """An image's suffix, and not one of our own results."""
    return suffix(path).isin(*IMAGES) & ~path.endswith(".out.png")


def is_input(path: Column) -> Column:
    return suffix(path).isin(*INPUTS)


def is_pdf(content: Column) -> Column:
    """%PDF- within the first 1024 bytes, whatever the name says."""
    return F.contains(F.substring(content, 1, 1024), F.encode(F.lit("%PDF-"), "UTF-8"))


def frame_name(background: Column, video: Column, index: Column) -> Column:
    return F.concat(background, F.lit("-"), video, F.lit("-"), F.lpad(index.cast("string"), 4, "0"), F.lit(".png"))


def sampled(index: Column, stride: int) -> Column:
    """Every stride-th frame, frames counted from 1."""
    return index % stride == 0
