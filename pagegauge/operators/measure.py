"""The measuring stage: bytes of a file to rows of measured pages, in Arrow batches, then rules as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..plans.config import Settings, provider_list
from ..sources import codecs, pdf
from . import detect, rules

PAGE = (
    "file string, page int, page_count int, pdf_source string, error string, error_detail string, has_quad boolean, recovered array<string>, "
    "alpha_coverage double, contour_candidates int, quad_area_ratio double, skew_ratio double, is_convex boolean, touches_border int, corners_outside_px double, "
    "border_ink_ratio double, abandoned_ratio double, abandoned_structure double, mask_quad_fit double, est_dpi double, blur_score double, glare_ratio double, "
    "median_brightness double, text_skew_deg double, deskew_applied_deg double, pre_cropped boolean, fallback_used string, detector string, detector_confidence double, detector_iou double, "
    "long_side_px int, corners array<struct<x:double,y:double>>, image binary"
)
COLUMNS = [c.strip().split(" ")[0] for c in PAGE.replace("array<struct<x:double,y:double>>", "a").split(",")]


class ModelMissing(RuntimeError):
    pass


#: Scorers by their model's path, one a worker process, however many tasks it runs.
_SESSIONS: dict[str, Callable] = {}


def onnx_scorer(path: str, providers: str = "", require_gpu: bool = False) -> Callable:
    """A function from a batch of (1, 3, side, side) float32 to the model's outputs."""
    try:
        import onnxruntime
    except ImportError as e:
        raise ModelMissing("no runtime for models here") from e
    able = onnxruntime.get_available_providers()
    if require_gpu and "CUDAExecutionProvider" not in able:
        raise ModelMissing("a GPU is required and none is here")
    try:
        session = onnxruntime.InferenceSession(path, providers=provider_list(providers) or able)
    except Exception as e:  # noqa: BLE001  whatever keeps a model from loading, it is missing
        raise ModelMissing(str(e)[:200]) from e
    name = session.get_inputs()[0].name
    return lambda batch: session.run(None, {name: batch})


def model_input(image: np.ndarray, side: int = 256) -> np.ndarray:
    """(1, 3, side, side) float32 from 0 to 1 of a picture squeezed to a square, grey ones in three equal planes."""
    h, w = image.shape[:2]
    y, x = np.mgrid[:side, :side].astype(float)
    small = k.sample(image, (x + 0.5) * w / side - 0.5, (y + 0.5) * h / side - 0.5)
    small = np.repeat(small[..., None], 3, axis=2) if small.ndim == 2 else small[..., :3]
    return np.ascontiguousarray(small.astype(np.float32).transpose(2, 0, 1)[None] / 255)


def regressed(image: np.ndarray, s: Settings, load: Callable = onnx_scorer) -> list[tuple[np.ndarray, float]]:
    """The quad of a corner model: heat maps of four corners, or points and whether there is an object."""
    if not s.corner_model:
        raise ModelMissing("no weights for this detector here")
    key = f"{s.corner_model}|{s.onnx_providers}|{s.require_gpu}|{getattr(load, '__qualname__', load)}"
    if key not in _SESSIONS:
        _SESSIONS[key] = load(s.corner_model, s.onnx_providers, s.require_gpu)
    outputs, (h, w) = _SESSIONS[key](model_input(image)), image.shape[:2]
    if s.corner_head == "point":
        found = k.point_corners(outputs[0], float(np.ravel(outputs[1])[0]), h, w)
    else:
        found = k.heatmap_corners(np.asarray(outputs[0]).reshape(4, *np.shape(outputs[0])[-2:]), h, w)
    return [found] if found else []


detect.register(detect.Detector("mask-contour", lambda image, mask, s: [] if mask is None else k.mask_quads(mask, s.approx_poly_epsilon_ratio, s.candidate_area_ratio), None, True))
detect.register(detect.Detector("edge-hough", lambda image, mask, s: k.edge_quad(image), None))
detect.register(detect.Detector("corner-regression", lambda image, mask, s: regressed(image, s), 0.45))


@dataclass(frozen=True)
class Pipeline:
    """How pages are measured. segment: work image -> mask or None; the default parts bright from dark and is no neural model."""

    settings: Settings = field(default_factory=lambda: Settings(detector="mask-contour"))
    segment: Callable | None = k.bright_mask
    decode: Callable = codecs.decode
    read_pdf: Callable = pdf.read_pages
    keep_images: bool = True


def _skew(o: np.ndarray) -> float:
    side = lambda a, b: float(np.hypot(*(o[a] - o[b])))
    pairs = [(side(0, 1), side(2, 3)), (side(3, 0), side(1, 2))]
    return max([max(p) / min(p) for p in pairs if min(p) > 1e-6], default=float("inf"))


def _convex(o: np.ndarray) -> bool:
    t = np.trunc(o)
    e = np.roll(t, -1, axis=0) - t
    turns = e[:, 0] * np.roll(e[:, 1], -1) - e[:, 1] * np.roll(e[:, 0], -1)
    return bool((turns > 0).all() or (turns < 0).all())


def _area(q: np.ndarray) -> float:
    return float(abs(np.sum(q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1])) / 2)


def measure_page(image: np.ndarray, p: Pipeline, pre_cropped: bool) -> dict:
    """Measurements of one page; an error code stands in for them where a step breaks off."""
    s = p.settings
    out: dict = {"pre_cropped": pre_cropped, "detector": s.detector, "fallback_used": "none", "recovered": [], "has_quad": False, "contour_candidates": 0, "touches_border": 0, "corners_outside_px": 0.0}
    work = k.resized(image, s.work_height)
    h, w = work.shape[:2]
    ratio = image.shape[0] / h
    try:
        mask = p.segment(work) if p.segment else None
        found = detect.get(s.detector).run(work, mask, s)
    except ModelMissing as e:
        return {"error": "MODEL_MISSING", "error_detail": str(e)}
    except Exception as e:  # noqa: BLE001  a page that a model breaks off on is a row with that error
        return {"error": "INFERENCE_FAILED", "error_detail": str(e)[:200]}
    out["alpha_coverage"] = None if mask is None else float(mask.mean())
    gate = lambda q: _convex(k.order_corners(q)) and _area(q) / (h * w) >= s.min_quad_area_ratio and _skew(k.order_corners(q)) <= s.max_skew_ratio
    best = max(enumerate(found), key=lambda x: (gate(x[1][0]), _area(x[1][0]), x[1][1], -x[0]), default=None)
    quad, confidence = best[1] if best else (None, None)
    by_mask = k.mask_quads(mask, s.approx_poly_epsilon_ratio, s.candidate_area_ratio) if mask is not None else []
    out["contour_candidates"] = len(by_mask)
    if quad is None and s.detector != "mask-contour" and by_mask and gate(by_mask[0][0]):
        (quad, confidence), out["fallback_used"], out["detector"] = by_mask[0], "mask_contour", "mask-contour"
        out["recovered"].append("RECOVERED_BY_MASK_FALLBACK")
    low = out["alpha_coverage"] is not None and out["alpha_coverage"] < s.min_alpha_coverage
    if s.enable_edge_fallback and (quad is None or low):
        other = k.edge_quad(work)
        if other and gate(other[0][0]):
            (quad, confidence), out["fallback_used"], out["detector"] = other[0], "edge_detect", "edge-hough"
            out["recovered"].append("RECOVERED_BY_EDGE_FALLBACK")
    if quad is None:
        out["image"] = codecs.encode_png(image) if p.keep_images else None
        return out
    o = k.order_corners(quad)
    out |= {"has_quad": True, "detector_confidence": confidence, "quad_area_ratio": _area(quad) / (h * w), "skew_ratio": _skew(o), "is_convex": _convex(o)}
    m = s.border_margin_px
    out["touches_border"] = int(sum(x <= m or y <= m or x >= w - 1 - m or y >= h - 1 - m for x, y in o))
    out["corners_outside_px"] = float(max(0, -o[:, 0].min(), -o[:, 1].min(), o[:, 0].max() - (w - 1), o[:, 1].max() - (h - 1)))
    if s.cross_check_detectors:
        other = k.edge_quad(work) if out["detector"] != "edge-hough" else by_mask
        if other:
            out["detector_iou"] = k.iou(quad, other[0][0], h, w)
    out["abandoned_ratio"], out["abandoned_structure"] = k.content_outside(work, quad, mask, s.abandoned_erode_ratio)
    out["mask_quad_fit"] = k.mask_fit(mask)
    if s.contain_paper_contour and mask is not None and mask.any():
        quad = k.containing_quad(quad, k.outline(k.largest(mask)).astype(float), h, w, s.edge_grow_percentile, s.max_edge_grow_ratio)
    quad = k.expanded(quad, s.edge_expand_px, h, w)
    full = k.order_corners(quad) * ratio
    out["border_ink_ratio"] = k.ink_at_border(image, full, s.content_clip_band_ratio, m, s.border_paper_min_ratio, s.border_paper_percentile)
    page = k.flatten(image, full)
    if s.auto_rotate_portrait and page.shape[1] > page.shape[0]:
        page = np.ascontiguousarray(np.rot90(page))
    out |= {"long_side_px": max(page.shape[:2]), "est_dpi": max(page.shape[:2]) / 11.69, "blur_score": k.blur_score(page), "glare_ratio": k.glare_ratio(page), "median_brightness": k.median_brightness(page), "text_skew_deg": k.text_skew(page, s.text_skew_step_deg)}
    angle = out["text_skew_deg"]
    if s.deskew and angle is not None and s.text_skew_step_deg / 2 <= abs(angle) <= s.max_text_skew_deg:
        page = k.turned(page, angle)
    out["corners"] = [{"x": float(x), "y": float(y)} for x, y in full]
    out["image"] = codecs.encode_png(page) if p.keep_images else None
    return out


def _pages(content: bytes, p: Pipeline) -> Iterator[tuple[int, np.ndarray, str | None, bool]]:
    if b"%PDF-" in content[:1024]:
        for number, image, source in p.read_pdf(content, p.settings):
            yield number, image, source, p.settings.pdf_pre_cropped and source == "embedded"
    else:
        yield 1, p.decode(content), None, p.settings.pre_cropped


def measure_file(file: str, content: bytes, p: Pipeline) -> list[dict]:
    """Rows of a file's pages. Whatever keeps the file from being read is one row with the error."""
    failed = lambda code, detail="": [{"file": file, "page_count": 0, "error": code, "error_detail": detail}]
    if not content:
        return failed("FILE_EMPTY")
    try:
        rows = [{"file": file, "page": n, "pdf_source": source, **measure_page(image, p, pre)} for n, image, source, pre in _pages(content, p)]
    except codecs.DecodeError as e:
        return failed("DECODE_FAILED", str(e))
    except pdf.PdfError as e:
        return failed(e.code, e.detail)
    return [r | {"page_count": len(rows)} for r in rows]


def measured(files: DataFrame, p: Pipeline = Pipeline()) -> DataFrame:
    """PAGE rows of files (file, content), a few files at a time, so that a worker holds few images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                frame = pd.DataFrame(measure_file(file, bytes(content) if content is not None else b"", p))
                yield frame.reindex(columns=COLUMNS).astype(object).where(lambda d: d.notna(), None)

    return files.select("file", "content").mapInPandas(run, PAGE)


def judged(files: DataFrame, p: Pipeline = Pipeline()) -> DataFrame:
    """measured() with reasons, verdict and told: an error is the only reason of its row. told: each reason's severity,
    the hint for the settings' audience, and the figures it rests on."""
    s = p.settings
    rows = measured(files, p)
    gate = F.when(F.col("pdf_source").isNotNull(), s.pdf_pre_cropped_min_area).otherwise(s.pre_cropped_min_area)
    codes = F.when(F.col("error").isNotNull(), F.array(F.col("error"))).otherwise(rules.page_codes(s, gate=gate))
    return rows.withColumn("reasons", codes).withColumn("verdict", rules.verdict(F.col("reasons"))).withColumn("told", rules.told(F.col("reasons"), s))
