"""Settings of the gate: typed values, overridable from the environment and then by the caller."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "PAGEGAUGE_"


@dataclass(frozen=True)
class Settings:
    """Thresholds and switches. Results depend on these defaults."""

    work_height: int = 500
    approx_poly_epsilon_ratio: float = 0.02
    min_alpha_coverage: float = 0.05
    min_quad_area_ratio: float = 0.2
    candidate_area_ratio: float = 0.05
    max_skew_ratio: float = 1.8
    border_margin_px: int = 2
    content_clip_band_ratio: float = 0.01
    border_paper_min_ratio: float = 0.6
    border_paper_percentile: float = 90.0
    max_abandoned_ratio: float = 0.1
    abandoned_structure_ratio: float = 0.1
    min_mask_quad_fit: float = 0.85
    abandoned_erode_ratio: float = 0.06
    max_border_ink_ratio: float = 0.08
    no_crop_area_ratio: float = 0.9
    contain_paper_contour: bool = True
    max_edge_grow_ratio: float = 0.05
    edge_grow_percentile: float = 95.0
    no_crop_min_confidence: float = 0.9
    no_crop_corner_outside_px: int = 8
    no_crop_touched_edges: int = 3
    min_long_side_px: int = 600
    min_blur_score: float = 25.0
    glare_ratio: float = 0.02
    min_median_brightness: float = 60.0
    max_text_skew_deg: float = 8.0
    text_skew_step_deg: float = 1.0
    enable_edge_fallback: bool = True
    edge_expand_px: int = 0
    auto_rotate_portrait: bool = False
    deskew: bool = True
    pre_cropped: bool = False
    pre_cropped_min_area: float = 0.0
    pdf_pre_cropped_min_area: float = 0.9
    pdf_pre_cropped: bool = True
    pdf_max_pages: int = 50
    pdf_render_dpi: int = 200
    pdf_max_dpi: int = 400
    pdf_out_dpi: int = 300
    pdf_page_image_coverage: float = 0.9
    hint_audience: str = "capturer"
    onnx_providers: str = ""
    require_gpu: bool = False
    detector: str = "corner-regression"
    corner_model: str = ""
    corner_head: str = "heatmap"
    cross_check_detectors: bool = False
    min_detector_iou: float = 0.85

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides) -> Settings:
        """Defaults, then PAGEGAUGE_<FIELD> from the environment, then overrides that are not None."""
        env = os.environ if env is None else env
        values = {f.name: coerce(env[PREFIX + f.name.upper()], type(f.default)) for f in fields(cls) if PREFIX + f.name.upper() in env}
        unknown = set(overrides) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"no such settings: {sorted(unknown)}")
        return cls(**values | {k: v for k, v in overrides.items() if v is not None})


def coerce(text: str, kind: type):
    return text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)


def provider_list(text: str) -> list[str]:
    """Names between commas, blanks dropped."""
    return [x.strip() for x in text.split(",") if x.strip()]
