"""Projections of the given tables into the engine's schemas, as frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import rules
from .config import Settings

HEIGHT, WIDTH = 500, 400
_BASES = ((80, 90), (320, 90), (320, 410), (80, 410))
_FRAME = ((2, 2), (397, 2), (397, 497), (2, 497))
DETECTORS = ("mask-contour", "edge-hough", "corner-regression")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, e, c (corners), confidence, detector: one page frame per vector; every fourth is about as large as the frame."""
    e = lambda k: F.col("embedding")[k].cast("double")
    big = F.col("vec_id") % 4 == 0
    jitter = F.when(big, F.lit(40.0)).otherwise(F.lit(400.0))
    points = [(F.when(big, F.lit(float(fx))).otherwise(F.lit(float(bx))) + jitter * e(2 * k), F.when(big, F.lit(float(fy))).otherwise(F.lit(float(by))) + jitter * e(2 * k + 1)) for k, ((bx, by), (fx, fy)) in enumerate(zip(_BASES, _FRAME, strict=True))]
    names = F.element_at(F.array(*[F.lit(d) for d in DETECTORS]), (F.col("vec_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"), g.corners(*points).alias("c"), (((F.col("vec_id") * 37) % 1000).cast("double") / 1000).alias("confidence"), names.alias("detector"))


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


SQL_QUADS = f"""
raw AS (SELECT vec_id, embedding AS e, vec_id % 4 = 0 AS big, CASE WHEN vec_id % 4 = 0 THEN 40::DOUBLE ELSE 400::DOUBLE END AS j FROM embeddings),
quads AS (SELECT vec_id, e, ((vec_id * 37) % 1000)::DOUBLE / 1000 AS confidence,
  CASE vec_id % 3 WHEN 0 THEN 'mask-contour' WHEN 1 THEN 'edge-hough' ELSE 'corner-regression' END AS detector,
  {_list(f"(CASE WHEN big THEN {f[0]} ELSE {b[0]} END)::DOUBLE + j * e[{2 * k + 1}]::DOUBLE" for k, (b, f) in enumerate(zip(_BASES, _FRAME, strict=True)))} AS xs,
  {_list(f"(CASE WHEN big THEN {f[1]} ELSE {b[1]} END)::DOUBLE + j * e[{2 * k + 2}]::DOUBLE" for k, (b, f) in enumerate(zip(_BASES, _FRAME, strict=True)))} AS ys FROM raw),
sums AS (SELECT *, {_list(f"xs[{k}] + ys[{k}]" for k in range(1, 5))} AS s, {_list(f"ys[{k}] - xs[{k}]" for k in range(1, 5))} AS d FROM quads),
picks AS (SELECT *, [list_position(s, list_min(s)), list_position(d, list_min(d)), list_position(s, list_max(s)), list_position(d, list_max(d))] AS o FROM sums),
ordered AS (SELECT *, {_list(f"xs[o[{k}]]" for k in range(1, 5))} AS ox, {_list(f"ys[o[{k}]]" for k in range(1, 5))} AS oy FROM picks)"""


def _cross(k: int, cast: str = "") -> str:
    a, b, c = k % 4 + 1, (k + 1) % 4 + 1, (k + 2) % 4 + 1
    x, y = (lambda n: f"trunc(ox[{n}])"), (lambda n: f"trunc(oy[{n}])")
    return f"(({x(b)} - {x(a)}) * ({y(c)} - {y(b)}) - ({y(b)} - {y(a)}) * ({x(c)} - {x(b)}))"


_TURNS = ", ".join(_cross(k) for k in range(4))
_SIDE = lambda a, b: f"sqrt((ox[{a}] - ox[{b}]) * (ox[{a}] - ox[{b}]) + (oy[{a}] - oy[{b}]) * (oy[{a}] - oy[{b}]))"
SQL_AREA = "abs(" + " + ".join(f"(xs[{k}] * ys[{k % 4 + 1}] - xs[{k % 4 + 1}] * ys[{k}])" for k in range(1, 5)) + ") / 2"
SQL_GEO = f"""
sides AS (SELECT *, {_SIDE(1, 2)} AS st, {_SIDE(2, 3)} AS sr, {_SIDE(3, 4)} AS sb, {_SIDE(4, 1)} AS sl FROM ordered),
geo AS (SELECT *, {SQL_AREA} AS area, ({SQL_AREA}) / {HEIGHT * WIDTH}.0::DOUBLE AS quad_area_ratio,
  (least({_TURNS}) > 0 OR greatest({_TURNS}) < 0) AS is_convex,
  coalesce(greatest(CASE WHEN least(st, sb) > 1e-6 THEN greatest(st, sb) / least(st, sb) END, CASE WHEN least(sl, sr) > 1e-6 THEN greatest(sl, sr) / least(sl, sr) END), 'infinity'::DOUBLE) AS skew_ratio,
  {" + ".join(f"(xs[{k}] <= 2 OR ys[{k}] <= 2 OR xs[{k}] >= {WIDTH - 3} OR ys[{k}] >= {HEIGHT - 3})::INT" for k in range(1, 5))} AS touches_border,
  greatest(0::DOUBLE, -list_min(xs), -list_min(ys), list_max(xs) - {WIDTH - 1}, list_max(ys) - {HEIGHT - 1}) AS corners_outside_px FROM sides)"""


def geometry_metrics(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """pages (c, confidence, detector) with the geometry measurements the rules read."""
    return (
        pages.withColumn("quad_area_ratio", g.quad_area(F.col("c")) / float(HEIGHT * WIDTH))
        .withColumn("skew_ratio", g.skew_ratio(F.col("c")))
        .withColumn("is_convex", g.is_convex(F.col("c")))
        .withColumn("touches_border", g.touches_border(F.col("c"), HEIGHT, WIDTH, s.border_margin_px))
        .withColumn("corners_outside_px", g.corners_outside(F.col("c"), HEIGHT, WIDTH))
        .withColumn("detector_confidence", F.col("confidence"))
    )


#: Measurements from further vector values: name -> (value's place from 1, factor, offset); values lie within about +-0.45.
MEASURES = {
    "alpha_coverage": (9, 1.0, 0.25),
    "border_ink_ratio": (10, 0.5, 0.0),
    "abandoned_ratio": (11, 1.0, 0.0),
    "abandoned_structure": (12, 1.0, 0.1),
    "mask_quad_fit": (13, 1.0, 0.9),
    "blur_score": (14, 200.0, 40.0),
    "glare_ratio": (15, 0.1, 0.0),
    "median_brightness": (16, 300.0, 120.0),
    "text_skew_deg": (17, 40.0, 0.0),
    "detector_iou": (18, 0.5, 0.95),
}


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every measurement; each eleventh lacks its quality measurements."""
    pages = geometry_metrics(quads(spark, sf_dir))
    value = lambda k, a, b: F.when(F.col("vec_id") % 11 != 0, F.col("e")[k - 1].cast("double") * a + b)
    for name, (k, a, b) in MEASURES.items():
        pages = pages.withColumn(name, value(k, a, b))
    return (
        pages.withColumn("long_side_px", (F.col("vec_id") * 53 % 1200 + 100).cast("int"))
        .withColumn("contour_candidates", (F.col("vec_id") % 7 % 3).cast("int"))
        .withColumn("has_quad", F.col("vec_id") % 13 != 0)
        .withColumn("pre_cropped", F.col("vec_id") % 5 == 0)
        .withColumn("fallback_used", F.when(F.col("vec_id") % 17 == 0, "mask_contour").when(F.col("vec_id") % 19 == 0, "edge_detect").otherwise("none"))
        .withColumn("recovered", rules.listed(rules.code("RECOVERED_BY_MASK_FALLBACK", F.col("vec_id") % 17 == 0), rules.code("RECOVERED_BY_EDGE_FALLBACK", F.col("vec_id") % 19 == 0)))
    )


SQL_METRICS = f"""
metrics AS (SELECT *, confidence AS detector_confidence, {", ".join(f"CASE WHEN vec_id % 11 <> 0 THEN e[{k}]::DOUBLE * {a}::DOUBLE + {b}::DOUBLE END AS {n}" for n, (k, a, b) in MEASURES.items())},
  (vec_id * 53 % 1200 + 100)::INT AS long_side_px, (vec_id % 7 % 3)::INT AS contour_candidates, vec_id % 13 <> 0 AS has_quad, vec_id % 5 = 0 AS pre_cropped,
  CASE WHEN vec_id % 17 = 0 THEN 'mask_contour' WHEN vec_id % 19 = 0 THEN 'edge_detect' ELSE 'none' END AS fallback_used FROM geo)"""

_NO_CROP = "((coalesce(detector_confidence < CASE WHEN detector = 'corner-regression' THEN 0.45::DOUBLE ELSE 0.9::DOUBLE END, false) AND corners_outside_px > 8) OR (quad_area_ratio > 0.9::DOUBLE AND touches_border >= 3 AND (coalesce(detector_confidence < 0.9::DOUBLE, false) OR corners_outside_px > 2)))"
SQL_GEOMETRY_CODES = f"CASE WHEN NOT is_convex THEN 'NOT_CONVEX' END, CASE WHEN quad_area_ratio < 0.2::DOUBLE THEN 'TOO_SMALL' END, CASE WHEN skew_ratio > 1.8::DOUBLE THEN 'EXTREME_SKEW' END, CASE WHEN {_NO_CROP} THEN 'NO_CROP_DETECTED' WHEN touches_border >= 1 THEN 'CLIPPED_EDGE' END"
SQL_NO_CROP = _NO_CROP
SQL_ABANDONED = "CASE WHEN abandoned_ratio >= 0.1::DOUBLE AND abandoned_structure >= 0.1::DOUBLE AND mask_quad_fit >= 0.85::DOUBLE THEN 'CONTENT_OUTSIDE_CROP' END"
SQL_QUALITY = "CASE WHEN long_side_px < 600 THEN 'LOW_RESOLUTION' END, CASE WHEN blur_score < 25 THEN 'BLURRY' END, CASE WHEN glare_ratio > 0.02::DOUBLE THEN 'GLARE' END, CASE WHEN median_brightness < 60 THEN 'TOO_DARK' END, CASE WHEN abs(text_skew_deg) > 8 THEN 'TEXT_NOT_LEVEL' END"
_RECOVERED = "CASE WHEN vec_id % 17 = 0 THEN 'RECOVERED_BY_MASK_FALLBACK' END, CASE WHEN vec_id % 19 = 0 THEN 'RECOVERED_BY_EDGE_FALLBACK' END"
kept = lambda items: f"list_filter([{items}], lambda x: x IS NOT NULL)"
SQL_BORDER = "x NOT IN ('CLIPPED_EDGE', 'CONTENT_CLIPPED', 'NO_CROP_DETECTED', 'SUBJECT_FILLS_FRAME', 'RECOVERED_BY_MASK_FALLBACK')"
SQL_CLIP_FIRES = "(coalesce(border_ink_ratio > 0.08::DOUBLE, false) AND quad_area_ratio <= 0.9::DOUBLE)"
WARNS = "('SUBJECT_FILLS_FRAME', 'RECOVERED_BY_EDGE_FALLBACK', 'RECOVERED_BY_MASK_FALLBACK', 'CLIPPED_EDGE', 'EXTREME_SKEW', 'MULTIPLE_DOCUMENTS', 'DETECTOR_DISAGREEMENT', 'GLARE', 'TOO_DARK')"
SQL_VERDICT = f"CASE WHEN len(list_filter(reasons, lambda x: x NOT IN {WARNS})) > 0 THEN 'fail' WHEN len(reasons) > 0 THEN 'warn' ELSE 'pass' END"
SQL_JUDGED = f"""
first AS (SELECT *, {kept(_RECOVERED + ", CASE WHEN detector_iou < 0.85::DOUBLE THEN 'DETECTOR_DISAGREEMENT' END, CASE WHEN contour_candidates >= 2 THEN 'MULTIPLE_DOCUMENTS' END, " + SQL_GEOMETRY_CODES + ", " + SQL_ABANDONED)} AS r1,
  {kept(_RECOVERED + ", CASE WHEN alpha_coverage < 0.05::DOUBLE THEN 'SUBJECT_NOT_FOUND' ELSE 'QUAD_NOT_FOUND' END, 'FALLBACK_ORIGINAL'")} AS lost, {kept(SQL_QUALITY)} AS q FROM metrics),
second AS (SELECT *, CASE WHEN has_quad THEN list_concat(CASE WHEN {SQL_CLIP_FIRES} THEN list_append(list_filter(r1, lambda x: x <> 'CLIPPED_EDGE'), 'CONTENT_CLIPPED') ELSE r1 END, q) ELSE lost END AS r2 FROM first),
third AS (SELECT *, CASE WHEN pre_cropped THEN list_filter(r2, lambda x: {SQL_BORDER}) ELSE r2 END AS reasons FROM second),
judged AS (SELECT *, {SQL_VERDICT} AS verdict, CASE WHEN abs(text_skew_deg) >= 0.5::DOUBLE AND abs(text_skew_deg) <= 8 THEN text_skew_deg END AS deskew_applied_deg FROM third)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(metrics(spark, sf_dir))


def sql(*parts: str, tail: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + tail


def file_of(vec_id: Column) -> Column:
    """Pages belong to files of four."""
    return F.concat(F.lit("scan-"), F.lpad(F.floor(vec_id / 4).cast("string"), 6, "0"), F.lit(".pdf"))


SQL_FILE = "concat('scan-', lpad((vec_id // 4)::VARCHAR, 6, '0'), '.pdf')"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, expect_verdict, verdict, iou of labelled documents: expectation from labels, verdict from the text's size."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    labels = read(spark, sf_dir, "labels")
    expect = F.when(F.col("toxic") == 1, "warn").when(F.col("quality") == 1, "pass").otherwise("fail")
    got = F.when(F.col("n") < 300, "fail").when(F.col("n") < 900, "warn").otherwise("pass")
    return docs.join(labels, "doc_id", "left").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("file"), F.when(F.col("quality").isNotNull(), expect).alias("expect_verdict"), got.alias("verdict"), F.when(F.col("quality").isNotNull(), (F.col("n") % 101).cast("double") / 100).alias("iou"))


SQL_LABELLED = """
labelled AS (SELECT concat('doc-', doc_id) AS file, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'warn' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS expect_verdict,
  CASE WHEN length(text) < 300 THEN 'fail' WHEN length(text) < 900 THEN 'warn' ELSE 'pass' END AS verdict,
  CASE WHEN quality IS NOT NULL THEN (length(text) % 101)::DOUBLE / 100 END AS iou
  FROM documents LEFT JOIN labels USING (doc_id))"""


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (seconds), seconds (service time), level (parallel requests) of each request."""
    return read(spark, sf_dir, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("us"), F.abs("value").alias("seconds"), F.pow(F.lit(2.0), F.col("user_id") % 6).cast("int").alias("level"), "event_type")


SQL_TRAFFIC = """
traffic AS (SELECT event_id, epoch_us(ts) AS us, abs(value) AS seconds, (2 ** (user_id % 6))::INT AS level, event_type FROM events)"""
