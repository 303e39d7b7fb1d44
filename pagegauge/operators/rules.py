"""The rule engine: measurements of a page to an ordered list of reason codes and a verdict, as Column expressions.

A page is a row with the measurements as columns; null means not measured and
no rule fires on it. Codes come out in a fixed order.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import catalogue
from ..plans.catalogue import BORDER, FAILS
from ..plans.config import Settings

#: Detectors with a confidence floor of their own.
FLOORS = {"corner-regression": 0.45}


def code(name: str, condition: Column) -> Column:
    return F.when(condition, F.lit(name))


def listed(*codes: Column) -> Column:
    """The codes that fired, in the order given."""
    return F.filter(F.array(*[c.cast("string") for c in codes]), lambda c: c.isNotNull())


def floor(detector: Column, s: Settings) -> Column:
    out = F.lit(s.no_crop_min_confidence)
    for name, value in FLOORS.items():
        out = F.when(detector == name, F.lit(value)).otherwise(out)
    return out


def struggled(s: Settings) -> Column:
    return F.coalesce(F.col("detector_confidence") < s.no_crop_min_confidence, F.lit(False)) | F.coalesce(F.col("corners_outside_px") > s.border_margin_px, F.lit(False))


def no_crop(s: Settings) -> Column:
    """The cut lost the page, or is no more than the frame and the detector struggled."""
    lost = F.coalesce(F.col("detector_confidence") < floor(F.col("detector"), s), F.lit(False)) & (F.coalesce(F.col("corners_outside_px"), F.lit(0.0)) > s.no_crop_corner_outside_px)
    frame = (F.coalesce(F.col("quad_area_ratio"), F.lit(0.0)) > s.no_crop_area_ratio) & (F.coalesce(F.col("touches_border"), F.lit(0)) >= s.no_crop_touched_edges) & struggled(s)
    return lost | frame


def geometry_codes(s: Settings) -> list[Column]:
    return [
        code("NOT_CONVEX", ~F.col("is_convex")),
        code("TOO_SMALL", F.col("quad_area_ratio") < s.min_quad_area_ratio),
        code("EXTREME_SKEW", F.col("skew_ratio") > s.max_skew_ratio),
        F.when(no_crop(s), F.lit("NO_CROP_DETECTED")).when(F.col("touches_border") >= 1, F.lit("CLIPPED_EDGE")),
    ]


def abandoned_code(s: Settings) -> Column:
    return code("CONTENT_OUTSIDE_CROP", (F.col("abandoned_ratio") >= s.max_abandoned_ratio) & (F.col("abandoned_structure") >= s.abandoned_structure_ratio) & (F.col("mask_quad_fit") >= s.min_mask_quad_fit))


def clipped(reasons: Column, s: Settings) -> Column:
    """Ink at the frame's edge makes the warning about the edge a failure, at the end of the list."""
    fires = F.coalesce(F.col("border_ink_ratio") > s.max_border_ink_ratio, F.lit(False)) & (F.coalesce(F.col("quad_area_ratio"), F.lit(0.0)) <= s.no_crop_area_ratio)
    return F.when(fires, F.concat(F.filter(reasons, lambda c: c != "CLIPPED_EDGE"), F.array(F.lit("CONTENT_CLIPPED")))).otherwise(reasons)


def quality_codes(s: Settings) -> list[Column]:
    return [
        code("LOW_RESOLUTION", F.col("long_side_px") < s.min_long_side_px),
        code("BLURRY", F.col("blur_score") < s.min_blur_score),
        code("GLARE", F.col("glare_ratio") > s.glare_ratio),
        code("TOO_DARK", F.col("median_brightness") < s.min_median_brightness),
        code("TEXT_NOT_LEVEL", F.abs(F.col("text_skew_deg")) > s.max_text_skew_deg),
    ]


def suppressed(reasons: Column, pre_cropped: Column, gate: float) -> Column:
    """Without codes about the edge where the page was cropped before, unless its area stays under the gate."""
    small = F.coalesce(F.col("quad_area_ratio") < gate, F.lit(False))
    return F.when(F.coalesce(pre_cropped, F.lit(False)) & ~small, F.filter(reasons, lambda c: ~c.isin(*BORDER))).otherwise(reasons)


def verdict(reasons: Column) -> Column:
    return F.when(F.exists(reasons, lambda c: c.isin(*FAILS)), F.lit("fail")).when(F.size(reasons) > 0, F.lit("warn")).otherwise(F.lit("pass"))


def deskew_angle(s: Settings) -> Column:
    """The angle to turn the page by, null where it is level enough or too far off."""
    angle = F.abs(F.col("text_skew_deg"))
    return F.when(F.lit(s.deskew) & (angle >= s.text_skew_step_deg / 2) & (angle <= s.max_text_skew_deg), F.col("text_skew_deg"))


def page_codes(s: Settings = Settings(), pre_cropped: Column | None = None, gate: float | None = None) -> Column:
    """All codes of a page in order, after those in recovered. Without a quad (has_quad false) the list ends early."""
    pre = F.col("pre_cropped") if pre_cropped is None else pre_cropped
    gate = s.pre_cropped_min_area if gate is None else gate
    recovered = F.coalesce(F.col("recovered"), F.array().cast("array<string>"))
    lost = F.concat(recovered, listed(F.when(F.col("alpha_coverage") < s.min_alpha_coverage, F.lit("SUBJECT_NOT_FOUND")).otherwise(F.lit("QUAD_NOT_FOUND")), F.lit("FALLBACK_ORIGINAL")))
    found = listed(
        code("DETECTOR_DISAGREEMENT", F.col("detector_iou") < s.min_detector_iou),
        code("MULTIPLE_DOCUMENTS", F.col("contour_candidates") >= 2),
        *geometry_codes(s),
        abandoned_code(s),
    )
    found = F.concat(clipped(F.concat(recovered, found), s), listed(*quality_codes(s)))
    return suppressed(F.when(F.col("has_quad"), found).otherwise(lost), pre, gate)


def judged(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """pages with reasons (array<string>), verdict and deskew_applied_deg."""
    return pages.withColumn("reasons", page_codes(s)).withColumn("verdict", verdict(F.col("reasons"))).withColumn("deskew_applied_deg", deskew_angle(s))


#: code -> (measure, the setting it is held against): what a reason's detail tells.
GROUNDS = {
    "SUBJECT_NOT_FOUND": ("alpha_coverage", "min_alpha_coverage"),
    "TOO_SMALL": ("quad_area_ratio", "min_quad_area_ratio"),
    "EXTREME_SKEW": ("skew_ratio", "max_skew_ratio"),
    "CONTENT_CLIPPED": ("border_ink_ratio", "max_border_ink_ratio"),
    "CONTENT_OUTSIDE_CROP": ("abandoned_ratio", "max_abandoned_ratio"),
    "NO_CROP_DETECTED": ("quad_area_ratio", "no_crop_area_ratio"),
    "TEXT_NOT_LEVEL": ("text_skew_deg", "max_text_skew_deg"),
    "DETECTOR_DISAGREEMENT": ("detector_iou", "min_detector_iou"),
    "LOW_RESOLUTION": ("long_side_px", "min_long_side_px"),
    "BLURRY": ("blur_score", "min_blur_score"),
    "GLARE": ("glare_ratio", "glare_ratio"),
    "TOO_DARK": ("median_brightness", "min_median_brightness"),
    "CLIPPED_EDGE": ("touches_border", None),
    "MULTIPLE_DOCUMENTS": ("contour_candidates", None),
}


def detail(c: Column, s: Settings = Settings(), columns: Collection[str] | None = None) -> Column:
    """The figures a code rests on, as "measure value, limit": null where it rests on none. columns: those at hand, all by default."""
    out = F.lit(None).cast("string")
    for name, (measure, limit) in GROUNDS.items():
        if columns is None or measure in columns:
            value = F.round(F.col(measure).cast("double"), 4).cast("string")
            said = F.concat(F.lit(f"{measure} "), F.coalesce(value, F.lit("not measured")), F.lit("" if limit is None else f", limit {getattr(s, limit):g}"))
            out = F.when(c == name, said).otherwise(out)
    if columns is None or "error_detail" in columns:
        out = F.coalesce(out, F.when(c == F.col("error"), F.nullif(F.col("error_detail"), F.lit(""))))
    return out


def told(reasons: Column, s: Settings = Settings(), columns: Collection[str] | None = None) -> Column:
    """Codes as array<struct<code,severity,audience,hint,detail>> for the settings' audience."""
    return F.transform(for_audience(reasons, catalogue.specs(), s.hint_audience), lambda r: F.struct(r["code"].alias("code"), r["severity"].alias("severity"), r["audience"].alias("audience"), r["hint"].alias("hint"), detail(r["code"], s, columns).alias("detail")))


def first_failing(reasons: Column) -> Column:
    """The first code that fails a page, null if none does."""
    return F.get(F.filter(reasons, lambda c: catalogue.severity_of(c) == "fail"), F.lit(0))


def for_audience(reasons: Column, catalogue_map: Column, audience: str | None) -> Column:
    """Codes as struct<code,severity,audience,hint>; no audience: each code's own."""
    def one(c: Column) -> Column:
        spec = catalogue_map[c]
        who = F.lit(audience) if audience else spec["audience"]
        return F.struct(c.alias("code"), spec["severity"].alias("severity"), who.alias("audience"), F.coalesce(F.try_element_at(spec["hints"], who), F.try_element_at(spec["hints"], F.lit("operator"))).alias("hint"))

    return F.transform(reasons, one)


RANK = {"pass": 0, "warn": 1, "fail": 2}


def rank(v: Column) -> Column:
    return F.when(v == "fail", 2).when(v == "warn", 1).otherwise(0)


def unrank(r: Column) -> Column:
    """The verdict of a rank; null (no pages) is a failure."""
    return F.when(r == 0, "pass").when(r == 1, "warn").otherwise("fail")


def cascade(s: Settings = Settings()) -> tuple[Column, Column, Column]:
    """(chosen, fallback_used, recovered) of columns primary, mask, edge (structs or null), mask_ok, edge_ok, alpha_coverage.

    The outline stands in for a missing primary quad if it passes the gate; the
    edges then replace a missing quad, or any quad where hardly anything stands out.
    """
    by_mask = F.col("primary").isNull() & F.col("mask").isNotNull() & F.coalesce(F.col("mask_ok"), F.lit(False))
    first = F.coalesce(F.col("primary"), F.when(by_mask, F.col("mask")))
    by_edge = F.lit(s.enable_edge_fallback) & (first.isNull() | F.coalesce(F.col("alpha_coverage") < s.min_alpha_coverage, F.lit(False))) & F.col("edge").isNotNull() & F.coalesce(F.col("edge_ok"), F.lit(False))
    used = F.when(by_edge, "edge_detect").when(by_mask, "mask_contour").otherwise("none")
    recovered = listed(code("RECOVERED_BY_MASK_FALLBACK", by_mask), code("RECOVERED_BY_EDGE_FALLBACK", by_edge))
    return F.when(by_edge, F.col("edge")).otherwise(first), used, recovered
