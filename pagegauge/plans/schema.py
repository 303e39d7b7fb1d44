"""Schemas of the engine's tables, declared once; nothing is inferred."""

from pyspark.sql import types as T

CORNER = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
CORNERS = T.ArrayType(CORNER)
REASON = T.StructType([T.StructField("code", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("detail", T.StringType())])
FILE = T.StructType([T.StructField("file", T.StringType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: Report metrics in column order: name -> (type, nullable).
METRIC_FIELDS = (
    ("alpha_coverage", "double", True),
    ("contour_candidates", "int", False),
    ("quad_area_ratio", "double", True),
    ("skew_ratio", "double", True),
    ("is_convex", "boolean", True),
    ("touches_border", "int", False),
    ("corners_outside_px", "double", False),
    ("border_ink_ratio", "double", True),
    ("abandoned_ratio", "double", True),
    ("abandoned_structure", "double", True),
    ("mask_quad_fit", "double", True),
    ("est_dpi", "double", True),
    ("blur_score", "double", True),
    ("glare_ratio", "double", True),
    ("median_brightness", "double", True),
    ("text_skew_deg", "double", True),
    ("deskew_applied_deg", "double", True),
    ("pre_cropped", "boolean", False),
    ("page", "int", True),
    ("pdf_source", "string", True),
    ("fallback_used", "string", False),
    ("detector", "string", True),
    ("detector_confidence", "double", True),
    ("detector_iou", "double", True),
)
METRICS = T.StructType([T.StructField(n, {"double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType()}[t], True) for n, t, _ in METRIC_FIELDS])
REPORT_COLUMNS = ("file", "verdict", "reasons", "seconds", *(n for n, _, _ in METRIC_FIELDS), "iou_vs_label", "expect_verdict")
LABEL = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("corners", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("expect_verdict", T.StringType()),
        T.StructField("expect_reasons", T.ArrayType(T.StringType())),
    ]
)
