"""The reason codes: severity, who can act on them first, and what to tell whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (code, severity, audience); fixed values, in catalogue order.
CODES = (
    ("FILE_EMPTY", "fail", "system"),
    ("MISSING_FILE", "fail", "system"),
    ("DECODE_FAILED", "fail", "system"),
    ("INFERENCE_FAILED", "fail", "system"),
    ("MODEL_MISSING", "fail", "system"),
    ("UNAUTHORIZED", "fail", "system"),
    ("PDF_DECODE_FAILED", "fail", "system"),
    ("PDF_NO_PAGES", "fail", "system"),
    ("PDF_TOO_MANY_PAGES", "fail", "operator"),
    ("PDF_MULTIPAGE", "fail", "system"),
    ("SERVER_BUSY", "fail", "system"),
    ("LOW_RESOLUTION", "fail", "capturer"),
    ("SUBJECT_NOT_FOUND", "fail", "capturer"),
    ("SUBJECT_FILLS_FRAME", "warn", "capturer"),
    ("RECOVERED_BY_EDGE_FALLBACK", "warn", "operator"),
    ("RECOVERED_BY_MASK_FALLBACK", "warn", "operator"),
    ("QUAD_NOT_FOUND", "fail", "capturer"),
    ("TOO_SMALL", "fail", "capturer"),
    ("NOT_CONVEX", "fail", "capturer"),
    ("CLIPPED_EDGE", "warn", "capturer"),
    ("CONTENT_CLIPPED", "fail", "capturer"),
    ("CONTENT_OUTSIDE_CROP", "fail", "capturer"),
    ("NO_CROP_DETECTED", "fail", "capturer"),
    ("EXTREME_SKEW", "warn", "capturer"),
    ("TEXT_NOT_LEVEL", "fail", "capturer"),
    ("MULTIPLE_DOCUMENTS", "warn", "capturer"),
    ("FALLBACK_ORIGINAL", "fail", "operator"),
    ("DETECTOR_DISAGREEMENT", "warn", "operator"),
    ("BLURRY", "fail", "capturer"),
    ("GLARE", "warn", "capturer"),
    ("TOO_DARK", "warn", "capturer"),
)
SEVERITY = {code: severity for code, severity, _ in CODES}
AUDIENCE = {code: audience for code, _, audience in CODES}
FAILS = tuple(code for code, severity, _ in CODES if severity == "fail")
#: Codes about the frame's edge; a page that was cropped before says nothing by them.
BORDER = ("CLIPPED_EDGE", "CONTENT_CLIPPED", "NO_CROP_DETECTED", "SUBJECT_FILLS_FRAME", "RECOVERED_BY_MASK_FALLBACK")
#: Emitted outside the catalogue.
EXTRA = ("PAGE_OUT_OF_RANGE",)

#: code -> (what happened, what the person taking the picture does about it or None, what an operator does).
TEXTS = {
    "FILE_EMPTY": ("The file holds no bytes.", None, "Have the file sent again."),
    "MISSING_FILE": ("The request carries no file.", None, "Send the file in the form field named file."),
    "DECODE_FAILED": ("The bytes are no image that can be read here.", "Save the picture as PNG or JPEG.", "Look at the file's format and whether it is whole."),
    "INFERENCE_FAILED": ("A model broke off on this page.", None, "Try once more; if it goes on, look at the worker's log."),
    "MODEL_MISSING": ("The chosen model has no weights here.", None, "Install the weights or choose another detector."),
    "UNAUTHORIZED": ("No known key came with the request.", None, "Check the key in the request header."),
    "PDF_DECODE_FAILED": ("The PDF cannot be opened.", "Save the PDF without a password.", "Look for a password or damage."),
    "PDF_NO_PAGES": ("The PDF has no pages.", "Choose another file.", "Check how the PDF was made."),
    "PDF_TOO_MANY_PAGES": ("The PDF has more pages than are taken.", "Split the file.", "Split the file or raise the limit."),
    "PDF_MULTIPAGE": ("Only one page can be answered here.", None, "Use the interface for several pages."),
    "SERVER_BUSY": ("All places are taken just now.", "Try again in a moment.", "Send less at a time."),
    "LOW_RESOLUTION": ("The page has too few pixels.", "Move closer and use the full resolution.", "Ask for a larger picture."),
    "SUBJECT_NOT_FOUND": ("No page stands out from what lies around it.", "Lay the page on a dark, plain surface.", "Ask for a picture on a plain surface."),
    "SUBJECT_FILLS_FRAME": ("The page takes up the whole frame.", "Step back a little.", "Nothing; this code is no longer given."),
    "RECOVERED_BY_EDGE_FALLBACK": ("The page was found by its edges only.", None, "Check that the cut is right."),
    "RECOVERED_BY_MASK_FALLBACK": ("The page was found by its outline only.", None, "Check that the cut is right."),
    "QUAD_NOT_FOUND": ("The page's four corners were not found.", "Keep all four corners in view.", "Cut the page by hand."),
    "TOO_SMALL": ("The page is small within the picture.", "Move closer.", "Ask for a closer picture."),
    "NOT_CONVEX": ("The corners found make no page.", "Flatten the page and try again.", "Cut the page by hand."),
    "CLIPPED_EDGE": ("The page touches the picture's edge.", "Leave some room around the page.", "Check that nothing is cut off."),
    "CONTENT_CLIPPED": ("Print runs out of the picture.", "Take in the whole page.", "Ask for a picture of the whole page."),
    "CONTENT_OUTSIDE_CROP": ("The cut leaves part of the page out.", "Flatten the page and take it whole.", "Cut the page by hand."),
    "NO_CROP_DETECTED": ("The cut is no more than the picture's frame.", "Leave some room around the page.", "Cut the page by hand."),
    "EXTREME_SKEW": ("The page was taken at a steep angle.", "Hold the camera above the page.", "Check that small print can be read."),
    "TEXT_NOT_LEVEL": ("The lines of text are not level.", "Hold the camera straight.", "Turn the page by hand."),
    "MULTIPLE_DOCUMENTS": ("There may be more than one page.", "Take one page at a time.", "Check which page is meant."),
    "FALLBACK_ORIGINAL": ("The picture is returned as it came.", None, "Cut the page by hand."),
    "DETECTOR_DISAGREEMENT": ("Two ways to find the page differ.", None, "Check that the cut is right."),
    "BLURRY": ("The page is out of focus.", "Hold still and let the camera focus.", "Ask for a sharper picture."),
    "GLARE": ("Bright spots cover part of the page.", "Move away from direct light.", "Check that print under the spots can be read."),
    "TOO_DARK": ("The page is dark.", "Turn on more light.", "Brighten the page or ask for another picture."),
}


def frame(spark: SparkSession) -> DataFrame:
    """code, severity, audience, message, hints (map by audience)."""
    rows = [(c, s, a, TEXTS[c][0], {k: v for k, v in (("capturer", TEXTS[c][1]), ("operator", TEXTS[c][2])) if v}) for c, s, a in CODES]
    return spark.createDataFrame(rows, "code string, severity string, audience string, message string, hints map<string,string>")


def specs() -> Column:
    """code -> struct<severity, audience, hints>, as a literal map."""
    def hints(c: str) -> Column:
        both = [(who, text) for who, text in (("capturer", TEXTS[c][1]), ("operator", TEXTS[c][2])) if text]
        return F.create_map(*[F.lit(x) for pair in both for x in pair]) if both else F.create_map().cast("map<string,string>")

    return F.create_map(*[x for c, severity, audience in CODES for x in (F.lit(c), F.struct(F.lit(severity).alias("severity"), F.lit(audience).alias("audience"), hints(c).alias("hints")))])


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_of(code: Column) -> Column:
    return F.try_element_at(literal_map(SEVERITY), code)


def hint_of(hints: Column, audience: Column) -> Column:
    """The hint for an audience, the operator's where it has none."""
    return F.coalesce(F.try_element_at(hints, audience), F.try_element_at(hints, F.lit("operator")))
