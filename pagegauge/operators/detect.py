"""Choice among candidate quads, cross-checks, and how detectors plug in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


@dataclass(frozen=True)
class Detector:
    """A way to find pages' corners. run: (image, mask, settings) -> list of (corners, confidence), best first, on numpy arrays."""

    name: str
    run: Callable | None
    low_confidence: float | None = None
    uses_mask: bool = False


REGISTRY: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    REGISTRY[detector.name] = detector
    return detector


def get(name: str) -> Detector:
    if name not in REGISTRY:
        raise KeyError(f"no detector {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def best_candidate(candidates: DataFrame, image_area: float, min_area: float = 0.2, max_skew: float = 1.8, by: str = "image_id") -> DataFrame:
    """The candidate of each image that passes the gate, then has the most area, then confidence, then came first (ordinal)."""
    area = g.quad_area(F.col("c")) / image_area
    rows = candidates.select(by, "ordinal", "c", "confidence", area.alias("area_ratio")).withColumn("passes", g.passes_gate(F.col("c"), F.col("area_ratio"), min_area, max_skew))
    best = F.max(F.struct("passes", "area_ratio", "confidence", (-F.col("ordinal")).alias("first")))
    return rows.groupBy(by).agg(best.alias("b")).select(by, F.col("b.passes").alias("passes"), F.col("b.area_ratio").alias("area_ratio"), F.col("b.confidence").alias("confidence"), (-F.col("b.first")).alias("ordinal"))


def grid_iou(a: Column, b: Column, height: int, width: int, step: int) -> Column:
    """Intersection over union of two quads on every step-th pixel of a frame; 0 if neither covers any."""
    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step)), lambda x: F.struct(y.alias("y"), x.alias("x")))))

    def counted(q: Column) -> Column:
        # 1: in the first, 2: in the second, 3: in both
        where = F.transform(points, lambda p: g.inside(q["a"], p["x"], p["y"]).cast("int") + 2 * g.inside(q["b"], p["x"], p["y"]).cast("int"))
        return g.let(where, lambda k: F.struct(F.size(F.filter(k, lambda v: v == 3)).alias("i"), F.size(F.filter(k, lambda v: v > 0)).alias("u")))

    both = F.struct(g.order_corners(a).alias("a"), g.order_corners(b).alias("b"))
    return g.let(g.let(both, counted), lambda h: F.when(h["u"] > 0, h["i"] / h["u"]).otherwise(F.lit(0.0)))
