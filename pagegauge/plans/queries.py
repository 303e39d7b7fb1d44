"""Registered queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import names as nm
from ..operators import capacity, detect, pixels, report, rules, service
from . import bridges as b
from . import catalogue
from .config import Settings

S = Settings()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _points(prefix: str, c, n: int = 4):
    return [x for k in range(n) for x in (F.round(c[k]["x"], 4).alias(f"{prefix}x{k + 1}"), F.round(c[k]["y"], 4).alias(f"{prefix}y{k + 1}"))]


def _sql_points(xs: str, ys: str, n: int = 4) -> str:
    return ", ".join(f"round({xs}[{k}], 4) AS x{k}, round({ys}[{k}], 4) AS y{k}" for k in range(1, n + 1))


# --- geometry


@query(b.sql(b.SQL_QUADS, tail=f"SELECT vec_id, {_sql_points('ox', 'oy')} FROM ordered"))
def geo_order_corners(spark, d):
    return b.quads(spark, d).select("vec_id", *_points("", g.order_corners(F.col("c"))))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, round(area, 4) AS area FROM geo"))
def geo_quad_area(spark, d):
    return b.quads(spark, d).select("vec_id", F.round(g.quad_area(F.col("c")), 4).alias("area"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, is_convex FROM geo"))
def geo_is_convex(spark, d):
    return b.quads(spark, d).select("vec_id", g.is_convex(F.col("c")).alias("is_convex"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, CASE WHEN isinf(skew_ratio) THEN -1 ELSE round(skew_ratio, 4) END AS skew_ratio FROM geo"))
def geo_skew_ratio(spark, d):
    r = g.skew_ratio(F.col("c"))
    return b.quads(spark, d).select("vec_id", F.when(r == float("inf"), F.lit(-1.0)).otherwise(F.round(r, 4)).alias("skew_ratio"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, touches_border FROM geo"))
def geo_touches_border(spark, d):
    return b.quads(spark, d).select("vec_id", g.touches_border(F.col("c"), b.HEIGHT, b.WIDTH, S.border_margin_px).alias("touches_border"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, round(corners_outside_px, 4) AS outside FROM geo"))
def geo_corners_outside(spark, d):
    return b.quads(spark, d).select("vec_id", F.round(g.corners_outside(F.col("c"), b.HEIGHT, b.WIDTH), 4).alias("outside"))


def _sql_expand(px: int) -> str:
    mx, my = "(xs[1] + xs[2] + xs[3] + xs[4]) / 4", "(ys[1] + ys[2] + ys[3] + ys[4]) / 4"
    cells = []
    for k in range(1, 5):
        n = f"sqrt((xs[{k}] - mx) * (xs[{k}] - mx) + (ys[{k}] - my) * (ys[{k}] - my))"
        for axis, top in (("x", b.WIDTH), ("y", b.HEIGHT)):
            cells.append(f"round(least(greatest({axis}s[{k}] + ({axis}s[{k}] - m{axis}) * CASE WHEN {n} > 1e-6 THEN {px} / {n} ELSE 0 END, 0), {top - 1}), 4) AS {axis}{k}")
    return b.sql(b.SQL_QUADS, f"\nmid AS (SELECT *, {mx} AS mx, {my} AS my FROM quads)", tail=f"SELECT vec_id, {', '.join(cells)} FROM mid")


@query(_sql_expand(7))
def geo_expand(spark, d):
    return b.quads(spark, d).select("vec_id", *_points("", g.expand(F.col("c"), 7, b.HEIGHT, b.WIDTH)))


@query("SELECT p_partkey, round(greatest(p_size * 40, p_retailprice) / 11.69::DOUBLE, 4) AS est_dpi FROM part")
def geo_estimate_dpi(spark, d):
    return b.read(spark, d, "part").select("p_partkey", F.round(g.estimate_dpi((F.col("p_size") * 40).cast("double"), F.col("p_retailprice")), 4).alias("est_dpi"))


_DEN = "((xs[1] - xs[3]) * (ys[2] - ys[4]) - (ys[1] - ys[3]) * (xs[2] - xs[4]))"
_DA, _DB = "(xs[1] * ys[3] - ys[1] * xs[3])", "(xs[2] * ys[4] - ys[2] * xs[4])"


@query(
    b.sql(
        b.SQL_QUADS,
        tail=f"SELECT vec_id, CASE WHEN abs({_DEN}) >= 1e-6 THEN round(({_DA} * (xs[2] - xs[4]) - (xs[1] - xs[3]) * {_DB}) / {_DEN}, 3) END AS x, CASE WHEN abs({_DEN}) >= 1e-6 THEN round(({_DA} * (ys[2] - ys[4]) - (ys[1] - ys[3]) * {_DB}) / {_DEN}, 3) END AS y, (abs(degrees(atan2(ys[2] - ys[1], xs[2] - xs[1]))) < 45 OR abs(degrees(atan2(ys[2] - ys[1], xs[2] - xs[1]))) > 135) AS horizontal FROM quads",
    )
)
def geo_line_intersect(spark, d):
    c = F.col("c")
    p = g.intersect(c[0], c[2], c[1], c[3])
    return b.quads(spark, d).select("vec_id", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"), g.is_horizontal(c[0], c[1]).alias("horizontal"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, (is_convex AND quad_area_ratio >= 0.2::DOUBLE AND skew_ratio <= 1.8::DOUBLE) AS passes FROM geo"))
def geo_filter_pass(spark, d):
    rows = b.quads(spark, d)
    return rows.select("vec_id", g.passes_gate(F.col("c"), g.quad_area(F.col("c")) / float(b.HEIGHT * b.WIDTH), S.min_quad_area_ratio, S.max_skew_ratio).alias("passes"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, tail="SELECT vec_id, greatest(trunc(sb), trunc(st))::INT AS width, greatest(trunc(sr), trunc(sl))::INT AS height, round(ox[1] * 2.5::DOUBLE, 4) AS left_full FROM geo"))
def geo_warp_size(spark, d):
    rows = b.quads(spark, d).select("vec_id", g.warp_size(F.col("c")).alias("s"), g.scaled(g.order_corners(F.col("c")), F.lit(2.5)).alias("f"))
    return rows.select("vec_id", "s.width", "s.height", F.round(F.col("f")[0]["x"], 4).alias("left_full"))


_IN = lambda q, x, y: "(" + " OR ".join(f"{agg}({', '.join(f'({q}x[{k % 4 + 1}] - {q}x[{k}]) * ({y} - {q}y[{k}]) - ({q}y[{k % 4 + 1}] - {q}y[{k}]) * ({x} - {q}x[{k}])' for k in range(1, 5))}) {op} 0" for agg, op in (("least", ">="), ("greatest", "<="))) + ")"
_PAIRED = """
a AS (SELECT vec_id, ox AS fax, oy AS fay FROM ordered),
bq AS (SELECT vec_id - 1 AS vec_id, ox AS fbx, oy AS fby FROM ordered),
both_ AS (SELECT * FROM a JOIN bq USING (vec_id)),
cells AS (SELECT vec_id, fax, fay, fbx, fby, y.y AS py, x.x AS px FROM both_, (SELECT unnest(range(0, 500, 25)) AS y) y, (SELECT unnest(range(0, 400, 20)) AS x) x)"""
_PAIRED = _PAIRED.replace("range(0, 400, 20)", "range(0, 400, 25)")


@query(b.sql(b.SQL_QUADS, _PAIRED, f"\nhit AS (SELECT vec_id, {_IN('fa', 'px', 'py')} AS ia, {_IN('fb', 'px', 'py')} AS ib FROM cells)", tail="SELECT vec_id, round(coalesce(count(*) FILTER (ia AND ib)::DOUBLE / nullif(count(*) FILTER (ia OR ib), 0), 0), 6) AS iou FROM hit GROUP BY vec_id"))
def geo_iou_grid(spark, d):
    rows = b.quads(spark, d)
    other = rows.select((F.col("vec_id") - 1).alias("v2"), F.col("c").alias("c2"))
    return rows.join(other, F.col("vec_id") == F.col("v2")).select("vec_id", F.round(detect.grid_iou(F.col("c"), F.col("c2"), b.HEIGHT, b.WIDTH, 25), 6).alias("iou"))


# --- detection

_CANDIDATES = "\ncand AS (SELECT *, vec_id // 3 AS image_id, vec_id % 3 AS ordinal, (is_convex AND quad_area_ratio >= 0.2::DOUBLE AND skew_ratio <= 1.8::DOUBLE) AS passes FROM geo)"


def _candidates(spark, d):
    return b.quads(spark, d).withColumn("image_id", F.floor(F.col("vec_id") / 3)).withColumn("ordinal", (F.col("vec_id") % 3).cast("int"))


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, _CANDIDATES, "\nranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY passes DESC, quad_area_ratio DESC, confidence DESC, ordinal) AS k FROM cand)", tail="SELECT image_id, passes, round(quad_area_ratio, 4) AS area_ratio, confidence, ordinal::INT AS ordinal FROM ranked WHERE k = 1"))
def det_best_candidate(spark, d):
    best = detect.best_candidate(_candidates(spark, d), float(b.HEIGHT * b.WIDTH))
    return best.select("image_id", "passes", F.round("area_ratio", 4).alias("area_ratio"), "confidence", "ordinal")


@query(b.sql(b.SQL_QUADS, b.SQL_GEO, _CANDIDATES, tail="SELECT image_id, count(*) FILTER (quad_area_ratio >= 0.05::DOUBLE) AS n FROM cand GROUP BY image_id"))
def det_candidate_filter(spark, d):
    rows = _candidates(spark, d).withColumn("a", g.quad_area(F.col("c")) / float(b.HEIGHT * b.WIDTH))
    return rows.groupBy("image_id").agg(F.count_if(F.col("a") >= S.candidate_area_ratio).alias("n"))


_CROSS = b.sql(b.SQL_QUADS, _PAIRED, f"\nhit AS (SELECT vec_id, {_IN('fa', 'px', 'py')} AS ia, {_IN('fb', 'px', 'py')} AS ib FROM cells),\nious AS (SELECT vec_id, coalesce(count(*) FILTER (ia AND ib)::DOUBLE / nullif(count(*) FILTER (ia OR ib), 0), 0) AS iou FROM hit GROUP BY vec_id)", tail="SELECT vec_id, iou < 0.85::DOUBLE AS disagrees FROM ious WHERE vec_id % 2 = 0")


@query(_CROSS)
def det_cross_check(spark, d):
    """Two detectors' quads of one image: even ids are the first detector's, the next odd ids the other's."""
    rows = b.quads(spark, d)
    first = rows.where("vec_id % 2 = 0").select("vec_id", "c")
    other = rows.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("v2"), F.col("c").alias("c2"))
    return first.join(other, F.col("vec_id") == F.col("v2")).select("vec_id", (detect.grid_iou(F.col("c"), F.col("c2"), b.HEIGHT, b.WIDTH, 25) < S.min_detector_iou).alias("disagrees"))


_CASCADE = """
c0 AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN 'p' END AS prim, CASE WHEN vec_id % 5 <> 0 THEN 'm' END AS mask, CASE WHEN vec_id % 4 <> 0 THEN 'e' END AS edge,
  vec_id % 7 <> 0 AS mask_ok, vec_id % 2 = 0 AS edge_ok, CASE WHEN vec_id % 11 <> 0 THEN e[9]::DOUBLE + 0.25::DOUBLE END AS alpha FROM embeddings_e),
c1 AS (SELECT *, prim IS NULL AND mask IS NOT NULL AND mask_ok AS by_mask FROM c0),
c2 AS (SELECT *, coalesce(prim, CASE WHEN by_mask THEN mask END) AS first_ FROM c1),
c3 AS (SELECT *, (first_ IS NULL OR coalesce(alpha < 0.05::DOUBLE, false)) AND edge IS NOT NULL AND edge_ok AS by_edge FROM c2)"""


@query("WITH embeddings_e AS (SELECT vec_id, embedding AS e FROM embeddings)," + _CASCADE + "\nSELECT vec_id, CASE WHEN by_edge THEN edge ELSE first_ END AS chosen, CASE WHEN by_edge THEN 'edge_detect' WHEN by_mask THEN 'mask_contour' ELSE 'none' END AS fallback_used, array_to_string(list_filter([CASE WHEN by_mask THEN 'RECOVERED_BY_MASK_FALLBACK' END, CASE WHEN by_edge THEN 'RECOVERED_BY_EDGE_FALLBACK' END], lambda x: x IS NOT NULL), '|') AS recovered FROM c3")
def det_cascade(spark, d):
    v = F.col("vec_id")
    rows = b.read(spark, d, "embeddings").select(
        v,
        F.when(v % 3 != 0, "p").alias("primary"),
        F.when(v % 5 != 0, "m").alias("mask"),
        F.when(v % 4 != 0, "e").alias("edge"),
        (v % 7 != 0).alias("mask_ok"),
        (v % 2 == 0).alias("edge_ok"),
        F.when(v % 11 != 0, F.col("embedding")[8].cast("double") + 0.25).alias("alpha_coverage"),
    )
    chosen, used, recovered = rules.cascade(S)
    return rows.select("vec_id", chosen.alias("chosen"), used.alias("fallback_used"), report.joined_reasons(recovered).alias("recovered"))


# --- rules

_CODES = "array_to_string({}, '|') AS reasons"
_UP_TO_METRICS = (b.SQL_QUADS, b.SQL_GEO, b.SQL_METRICS)
_ALL = (*_UP_TO_METRICS, b.SQL_JUDGED)


def _codes(spark, d, *columns):
    return b.metrics(spark, d).select("vec_id", report.joined_reasons(rules.listed(*columns)).alias("reasons"))


@query(b.sql(*_UP_TO_METRICS, tail=f"SELECT vec_id, {_CODES.format(b.kept(b.SQL_GEOMETRY_CODES))} FROM metrics"))
def rule_geometry_reasons(spark, d):
    return _codes(spark, d, *rules.geometry_codes(S))


@query(b.sql(*_UP_TO_METRICS, tail=f"SELECT vec_id, {b.SQL_NO_CROP} AS no_crop FROM metrics"))
def rule_no_crop(spark, d):
    return b.metrics(spark, d).select("vec_id", rules.no_crop(S).alias("no_crop"))


@query(b.sql(*_UP_TO_METRICS, f"\nfirst AS (SELECT *, {b.kept(b.SQL_GEOMETRY_CODES)} AS r FROM metrics)", tail=f"SELECT vec_id, array_to_string(CASE WHEN {b.SQL_CLIP_FIRES} THEN list_append(list_filter(r, lambda x: x <> 'CLIPPED_EDGE'), 'CONTENT_CLIPPED') ELSE r END, '|') AS reasons FROM first"))
def rule_content_clipped(spark, d):
    return b.metrics(spark, d).select("vec_id", report.joined_reasons(rules.clipped(rules.listed(*rules.geometry_codes(S)), S)).alias("reasons"))


@query(b.sql(*_UP_TO_METRICS, tail=f"SELECT vec_id, {_CODES.format(b.kept(b.SQL_QUALITY))} FROM metrics"))
def rule_quality(spark, d):
    return _codes(spark, d, *rules.quality_codes(S))


@query(b.sql(*_UP_TO_METRICS, tail=f"SELECT vec_id, {_CODES.format(b.kept(b.SQL_ABANDONED))} FROM metrics"))
def rule_abandoned(spark, d):
    return _codes(spark, d, rules.abandoned_code(S))


@query(b.sql(*_UP_TO_METRICS, tail="SELECT vec_id, contour_candidates >= 2 AS several FROM metrics"))
def rule_multi_doc(spark, d):
    return b.metrics(spark, d).select("vec_id", (F.col("contour_candidates") >= 2).alias("several"))


@query(b.sql(*_UP_TO_METRICS, f"\nfirst AS (SELECT *, {b.kept(b.SQL_GEOMETRY_CODES)} AS r FROM metrics)", tail=f"SELECT vec_id, array_to_string(CASE WHEN pre_cropped AND NOT coalesce(quad_area_ratio < 0.9::DOUBLE, false) THEN list_filter(r, lambda x: {b.SQL_BORDER}) ELSE r END, '|') AS reasons FROM first"))
def rule_pre_cropped(spark, d):
    codes = rules.listed(*rules.geometry_codes(S))
    return b.metrics(spark, d).select("vec_id", report.joined_reasons(rules.suppressed(codes, F.col("pre_cropped"), S.pdf_pre_cropped_min_area)).alias("reasons"))


@query(b.sql(*_ALL, tail="SELECT vec_id, array_to_string(reasons, '|') AS reasons, verdict FROM judged"))
def rule_verdict(spark, d):
    return b.judged(spark, d).select("vec_id", report.joined_reasons(F.col("reasons")).alias("reasons"), "verdict")


@query(b.sql(*_ALL, tail="SELECT vec_id, round(deskew_applied_deg, 4) AS deskew_applied_deg FROM judged"))
def rule_deskew_gate(spark, d):
    return b.judged(spark, d).select("vec_id", F.round("deskew_applied_deg", 4).alias("deskew_applied_deg"))


_SPEC = "spec(code, severity, audience) AS (VALUES " + ", ".join(f"('{c}', '{s}', '{a}')" for c, s, a in catalogue.CODES) + ")"


@query(b.sql(*_ALL, "\n" + _SPEC, "\neach_ AS (SELECT vec_id, unnest(reasons) AS code FROM judged)", tail="SELECT audience, severity, count(*) AS n FROM each_ JOIN spec USING (code) GROUP BY audience, severity"))
def rule_reason_lookup(spark, d):
    """Codes joined to the catalogue, counted by audience and severity."""
    each = b.judged(spark, d).select(F.explode("reasons").alias("c"))
    return each.join(catalogue.frame(spark), F.col("c") == F.col("code")).groupBy("audience", "severity").agg(F.count(F.lit(1)).alias("n"))


_q = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
_HINTS = "hints(code, audience, capturer, operator) AS (VALUES " + ", ".join(f"('{c}', '{a}', {_q(catalogue.TEXTS[c][1])}, {_q(catalogue.TEXTS[c][2])})" for c, _, a in catalogue.CODES) + ")"


@query("WITH " + _HINTS + "\nSELECT code, a.who AS audience, CASE a.who WHEN 'capturer' THEN coalesce(capturer, operator) ELSE operator END AS hint FROM hints, (VALUES ('capturer'), ('operator'), ('system')) a(who)")
def rule_audience_hints(spark, d):
    whos = spark.createDataFrame([("capturer",), ("operator",), ("system",)], "who string")
    return catalogue.frame(spark).drop("audience").join(F.broadcast(whos)).select("code", F.col("who").alias("audience"), catalogue.hint_of(F.col("hints"), F.col("who")).alias("hint"))


# --- pixels

_PX = """px AS (SELECT vec_id AS image_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x, floor(least(greatest((embedding[k]::DOUBLE + 0.5::DOUBLE) * 255, 0), 255))::INT AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k) r)"""
_MIRROR = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= 8 THEN 14 - ({e}) ELSE {e} END"


@query(
    "WITH "
    + _PX
    + f""", lap AS (SELECT c.image_id, (u.v + w.v + l.v + r.v - 4 * c.v)::DOUBLE AS l FROM px c
  JOIN px u ON u.image_id = c.image_id AND u.x = c.x AND u.y = ({_MIRROR("c.y - 1")}) JOIN px w ON w.image_id = c.image_id AND w.x = c.x AND w.y = ({_MIRROR("c.y + 1")})
  JOIN px l ON l.image_id = c.image_id AND l.y = c.y AND l.x = ({_MIRROR("c.x - 1")}) JOIN px r ON r.image_id = c.image_id AND r.y = c.y AND r.x = ({_MIRROR("c.x + 1")}))
SELECT image_id, round(sum(l * l) / 64 - (sum(l) / 64) * (sum(l) / 64), 4) AS blur_score FROM lap GROUP BY image_id"""
)
def pix_laplacian_var(spark, d):
    return pixels.laplacian_variance(b.read(spark, d, "embeddings"))


@query("WITH " + _PX + " SELECT image_id, round(avg((v >= 250)::INT::DOUBLE), 6) AS glare_ratio FROM px GROUP BY image_id")
def pix_glare(spark, d):
    return pixels.glare(pixels.pixels(b.read(spark, d, "embeddings")))


@query("WITH " + _PX + " SELECT image_id, median(v)::DOUBLE AS median_brightness FROM px GROUP BY image_id")
def pix_median(spark, d):
    return pixels.brightness(pixels.pixels(b.read(spark, d, "embeddings")))


@query("WITH " + _PX + ", rws AS (SELECT image_id, y, sum((v < 128)::INT) AS ink FROM px GROUP BY image_id, y), df AS (SELECT image_id, (ink - lag(ink) OVER (PARTITION BY image_id ORDER BY y))::DOUBLE AS d FROM rws) SELECT image_id, round(var_pop(d), 4) AS score FROM df WHERE d IS NOT NULL GROUP BY image_id")
def pix_row_profile(spark, d):
    return pixels.profile_score(pixels.pixels(b.read(spark, d, "embeddings")))


@query("WITH " + _PX + ", m AS (SELECT a.image_id, a.y, a.x, sum(n.v)::DOUBLE / count(*) AS m FROM px a JOIN px n ON n.image_id = a.image_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 GROUP BY 1, 2, 3), p AS (SELECT image_id, quantile_cont(m, 0.9) AS p FROM m GROUP BY image_id) SELECT image_id, count(*) FILTER (m >= 0.6::DOUBLE * p) AS n_paper FROM m JOIN p USING (image_id) GROUP BY image_id")
def pix_box_paper_mask(spark, d):
    return pixels.paper_mask(pixels.pixels(b.read(spark, d, "embeddings")))


_DARK = lambda w: f"round(avg((v < 100)::INT::DOUBLE) FILTER ({w}), 6)"


@query("WITH " + _PX + f", s AS (SELECT image_id, {_DARK('y < 2')} AS top, {_DARK('y >= 6')} AS bottom, {_DARK('x < 2')} AS \"left\", {_DARK('x >= 6')} AS \"right\" FROM px GROUP BY image_id) SELECT *, greatest(top, bottom, \"left\", \"right\") AS border_ink FROM s")
def pix_ink_ratio(spark, d):
    return pixels.ink_ratio(pixels.pixels(b.read(spark, d, "embeddings")))


@query(
    "WITH RECURSIVE "
    + _PX
    + """, dark AS (SELECT image_id, y * 8 + x AS k, y, x FROM px WHERE v < 100),
reach(image_id, k, l) AS (SELECT image_id, k, k FROM dark UNION SELECT r.image_id, n.k, r.l FROM reach r JOIN dark c ON c.image_id = r.image_id AND c.k = r.k JOIN dark n ON n.image_id = c.image_id AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1),
lab AS (SELECT image_id, k, min(l) AS l FROM reach GROUP BY 1, 2), comp AS (SELECT image_id, l, count(*) AS c FROM lab GROUP BY 1, 2), s AS (SELECT image_id, count(*) AS n, max(c) AS m FROM comp GROUP BY 1)
SELECT e.vec_id AS image_id, coalesce(n, 0) AS n_components, coalesce(m, 0) AS largest FROM embeddings e LEFT JOIN s ON s.image_id = e.vec_id"""
)
def pix_connected_components(spark, d):
    return pixels.largest_component(pixels.grid(b.read(spark, d, "embeddings")))


@query("WITH " + _PX + ", sets AS (SELECT image_id, k, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT image_id, y * 8 + x AS k, v < 120 AS a, false AS b FROM px UNION ALL SELECT image_id - 1, y * 8 + x, false, v < 120 FROM px) GROUP BY 1, 2) SELECT image_id, count(*) FILTER (a AND b) AS both_, count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS only_first FROM sets GROUP BY image_id")
def pix_mask_set_ops(spark, d):
    px = pixels.pixels(b.read(spark, d, "embeddings")).select("image_id", (F.col("y") * 8 + F.col("x")).alias("k"), (F.col("v") < 120).alias("m"))
    both = px.select("image_id", "k", F.col("m").alias("a"), F.lit(False).alias("b")).unionByName(px.select((F.col("image_id") - 1).alias("image_id"), "k", F.lit(False).alias("a"), F.col("m").alias("b")))
    sets = both.groupBy("image_id", "k").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return sets.groupBy("image_id").agg(F.count_if(F.col("a") & F.col("b")).alias("both_"), F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"))


# --- documents and reports

_PAGES = f"\npages_ AS (SELECT *, {b.SQL_FILE} AS file FROM judged),\nnumbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY vec_id) AS page FROM pages_)"


def _pages(spark, d):
    rows = b.judged(spark, d).withColumn("file", b.file_of(F.col("vec_id"))).withColumn("page_ix", F.col("vec_id"))
    return report.number_pages(rows)


@query(b.sql(*_ALL, _PAGES, tail="SELECT file, vec_id, page::INT AS page FROM numbered"))
def doc_page_numbers(spark, d):
    return _pages(spark, d).select("file", "vec_id", "page")


_WORST = "CASE max(CASE verdict WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END"


@query(b.sql(*_ALL, _PAGES, tail=f"SELECT file, {_WORST} AS verdict, count(*) AS page_count FROM numbered GROUP BY file"))
def doc_worst_page(spark, d):
    return report.roll_up(_pages(spark, d))


@query(
    b.sql(
        *_ALL,
        _PAGES,
        "\neach_ AS (SELECT file, page, unnest(reasons) AS code, generate_subscripts(reasons, 1) AS pos FROM numbered),\nfirst_seen AS (SELECT file, code, min(page * 1000 + pos) AS seen_at FROM each_ GROUP BY 1, 2),\nunions AS (SELECT file, string_agg(code, ',' ORDER BY seen_at) AS codes FROM first_seen GROUP BY file)",
        tail="SELECT f.file, coalesce(codes, '') AS codes FROM (SELECT DISTINCT file FROM numbered) f LEFT JOIN unions USING (file)",
    )
)
def doc_codes_union(spark, d):
    return report.codes_union(_pages(spark, d)).select("file", F.array_join("codes", ",").alias("codes"))


@query("WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations) SELECT conv_id, turn, CASE WHEN n = 1 THEN concat('conv-', conv_id, '.png') ELSE concat('conv-', conv_id, '.p', page, '.png') END AS name, CASE WHEN page = 1 THEN concat('conv-', conv_id, '.jpg') ELSE concat('conv-', conv_id, '.p', page, '.jpg') END AS cli_name FROM p")
def doc_output_names(spark, d):
    rows = b.read(spark, d, "conversations").select("conv_id", "turn")
    counts = rows.groupBy(F.col("conv_id").alias("cid")).agg(F.count(F.lit(1)).alias("n"))
    rows = report.number_pages(rows, "conv_id", "turn").join(counts, F.col("conv_id") == F.col("cid"))
    stem = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    return rows.select("conv_id", "turn", report.output_name(stem, F.col("n"), F.col("page")).alias("name"), report.cli_name(stem, F.lit(".jpg"), F.col("page")).alias("cli_name"))


@query("SELECT concat('conv-', conv_id) AS file, CASE WHEN count(*) <> 1 THEN 'PDF_MULTIPAGE' END AS error FROM conversations GROUP BY conv_id")
def doc_multipage_guard(spark, d):
    files = b.read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("page_count")).withColumn("file", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))
    return report.single_page_guard(files)


@query(b.sql(*_ALL, _PAGES, "\nmx AS (SELECT file, max(page) AS n FROM numbered GROUP BY file)", tail="SELECT file, 4 AS page, verdict, NULL::VARCHAR AS error FROM numbered WHERE page = 4 UNION ALL SELECT file, 4, 'fail', 'PAGE_OUT_OF_RANGE' FROM mx WHERE n < 4"))
def doc_page_selector(spark, d):
    return report.page_guard(_pages(spark, d), 4)


@query(b.sql(*_ALL, tail="SELECT count(*) AS n FROM judged WHERE vec_id % 9 <> 0 AND verdict <> 'fail'"))
def doc_skip_fail(spark, d):
    rows = b.judged(spark, d).withColumn("image", F.when(F.col("vec_id") % 9 != 0, F.lit("x")))
    return report.kept_pages(rows, True).agg(F.count(F.lit(1)).alias("n"))


@query(b.sql(*_ALL, tail="SELECT verdict, count(*) AS n FROM judged GROUP BY verdict"))
def rep_verdict_counts(spark, d):
    return report.verdict_counts(b.judged(spark, d))


@query(b.sql(*_ALL, tail="SELECT code, count(*) AS n FROM (SELECT unnest(reasons) AS code FROM judged) GROUP BY code"))
def rep_code_counts(spark, d):
    return report.code_counts(b.judged(spark, d))


_TIMED = "round((CASE WHEN vec_id % 10 = 0 THEN 0 ELSE vec_id % 997 END)::DOUBLE / 1000 / 3, 3)"


def _timed(spark, d):
    v = F.col("vec_id")
    return b.judged(spark, d).withColumn("seconds", F.round(F.when(v % 10 == 0, F.lit(0)).otherwise(v % 997).cast("double") / 1000 / 3, 3))


@query(b.sql(*_ALL, tail=f"SELECT round(median(s), 3) AS median_seconds FROM (SELECT {_TIMED} AS s FROM judged) WHERE s > 0"))
def rep_seconds_median(spark, d):
    return report.seconds_median(_timed(spark, d))


@query(b.sql(*_ALL, f"\ntimed AS (SELECT verdict, {_TIMED} AS s FROM judged)", tail="SELECT count(*) AS n, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'warn') AS n_warn, count(*) FILTER (verdict = 'fail') AS n_fail, round(median(CASE WHEN s > 0 THEN s END), 3) AS median_seconds FROM timed"))
def rep_summary(spark, d):
    return report.summary(_timed(spark, d))


@query(b.sql(b.SQL_LABELLED, tail="SELECT file, verdict, expect_verdict, iou FROM labelled"))
def rep_label_join(spark, d):
    return b.labelled(spark, d).select("file", "verdict", "expect_verdict", "iou")


_PCT = lambda p, n: f"round(100::DOUBLE * {p} / nullif({n}, 0), 2)"


@query(
    b.sql(
        b.SQL_LABELLED,
        "\nc AS (SELECT count(*) AS n, count(iou) AS ni, count(*) FILTER (iou >= 0.9::DOUBLE) AS ng, count(*) FILTER (expect_verdict <> 'pass' AND verdict = 'pass') AS fp, count(*) FILTER (expect_verdict = 'pass' AND verdict = 'fail') AS ff, count(*) FILTER (expect_verdict = 'pass') AS p FROM labelled WHERE expect_verdict IS NOT NULL)",
        tail=f"SELECT n AS n_labelled, {_PCT('ng', 'ni')} AS crop_rate_pct, fp AS n_false_pass, {_PCT('fp', 'n')} AS false_pass_pct, {_PCT('fp', '(n - p)')} AS false_pass_pct_by_class, ff AS n_false_fail, {_PCT('ff', 'n')} AS false_fail_pct, {_PCT('ff', 'p')} AS false_fail_pct_by_class FROM c",
    )
)
def rep_accuracy(spark, d):
    return report.accuracy(b.labelled(spark, d))


@query(b.sql(b.SQL_LABELLED, tail="SELECT expect_verdict, verdict, count(*) AS n FROM labelled WHERE expect_verdict <> verdict GROUP BY 1, 2"))
def rep_confusion(spark, d):
    return report.confusion(b.labelled(spark, d))


@query(b.sql(b.SQL_LABELLED, tail="SELECT CASE WHEN expect_verdict <> 'pass' THEN 'false_pass' ELSE 'false_fail' END AS kind, file FROM labelled WHERE (expect_verdict <> 'pass' AND verdict = 'pass') OR (expect_verdict = 'pass' AND verdict = 'fail')"))
def rep_false_files(spark, d):
    return report.false_files(b.labelled(spark, d))


@query("WITH r AS (SELECT concat('doc-', doc_id) AS file, CASE WHEN length(text) < 300 THEN 'fail' WHEN length(text) < 900 THEN 'warn' ELSE 'pass' END AS a, CASE WHEN length(text) < 400 THEN 'fail' WHEN length(text) < 800 THEN 'warn' ELSE 'pass' END AS c FROM documents) SELECT file, a AS before, c AS after FROM r WHERE a <> c")
def rep_baseline_compare(spark, d):
    docs = b.read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("file"), F.length("text").alias("n"))
    run = lambda low, high: docs.select("file", F.when(F.col("n") < low, "fail").when(F.col("n") < high, "warn").otherwise("pass").alias("verdict"))
    return report.compare(run(400, 800), run(300, 900))


@query(b.sql(*_ALL, tail="SELECT coalesce(max(CASE verdict WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END), 0) AS exit_code FROM judged"))
def rep_exit_code(spark, d):
    return report.exit_code(b.judged(spark, d))


@query(b.sql(*_ALL, tail="SELECT vec_id, array_to_string(reasons, '|') AS reasons, len(reasons) AS n_codes, round(quad_area_ratio, 4) AS quad_area_ratio, round(blur_score, 4) AS blur_score FROM judged"))
def rep_csv_rows(spark, d):
    rows = b.judged(spark, d).withColumn("text", report.joined_reasons(F.col("reasons")))
    return rows.select("vec_id", F.col("text").alias("reasons"), F.size(report.split_reasons(F.col("text"))).cast("long").alias("n_codes"), F.round("quad_area_ratio", 4).alias("quad_area_ratio"), F.round("blur_score", 4).alias("blur_score"))


@query(b.sql(*_ALL, tail="SELECT vec_id, round(quad_area_ratio, 4) AS quad_area_ratio, round(skew_ratio, 4) AS skew_ratio, round(blur_score, 4) AS blur_score, is_convex, touches_border::INT AS touches_border FROM judged"))
def rep_metrics_json(spark, d):
    """The metrics' JSON, read back into columns."""
    rows = b.judged(spark, d)
    read = rows.select("vec_id", F.from_json(report.metrics_json(rows), "quad_area_ratio double, skew_ratio double, blur_score double, is_convex boolean, touches_border int").alias("m"))
    return read.select("vec_id", "m.*")


_GROUNDS = "CASE code " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, (m, _) in rules.GROUNDS.items()) + " END"


@query(
    b.sql(
        *_ALL,
        "\n" + _SPEC,
        "\n" + _HINTS.replace("hints(code, audience,", "hints(code, who,"),
        "\neach_ AS (SELECT vec_id, unnest(reasons) AS code, generate_subscripts(reasons, 1) AS pos FROM judged)",
        tail=f"SELECT vec_id, pos::INT AS pos, code, severity, coalesce(capturer, operator) AS hint, {_GROUNDS} AS ground FROM each_ JOIN spec USING (code) JOIN hints USING (code)",
    )
)
def rule_told(spark, d):
    """Each reason as the one who took the picture is told it, and the measure it rests on."""
    rows = b.judged(spark, d)
    each = rows.select("vec_id", F.posexplode(rules.told(F.col("reasons"), S, rows.columns)).alias("pos", "t"))
    ground = F.nullif(F.regexp_extract(F.coalesce("t.detail", F.lit("")), "^[a-z_]+", 0), F.lit(""))
    return each.select("vec_id", (F.col("pos") + 1).alias("pos"), "t.code", "t.severity", "t.hint", ground.alias("ground"))


@query(b.sql(*_ALL, tail="SELECT vec_id, list_filter(reasons, lambda c: c IN (" + ", ".join(f"'{c}'" for c, s, _ in catalogue.CODES if s == "fail") + "))[1] AS first_fail FROM judged"))
def rule_first_fail(spark, d):
    return b.judged(spark, d).select("vec_id", rules.first_failing(F.col("reasons")).alias("first_fail"))


@query(b.sql(*_ALL, _PAGES, tail="SELECT file, page::INT AS page, verdict FROM numbered WHERE file IN (SELECT DISTINCT file FROM numbered ORDER BY file LIMIT 25)"))
def rep_first_files(spark, d):
    """The pages of the first 25 files: the limit is what a trial run asks for."""
    return report.first_files(_pages(spark, d), 25).select("file", "page", "verdict")


@query(b.sql(*_ALL, _PAGES, tail="SELECT file, max(vec_id) AS vec_id, arg_max(verdict, vec_id) AS verdict FROM numbered GROUP BY file"))
def rep_latest_of_file(spark, d):
    """A baseline in which the last row of a file counts."""
    return report.latest(_pages(spark, d).select("file", "vec_id", "verdict"), "file", "vec_id")


@query(
    b.sql(
        *_ALL,
        _PAGES,
        tail=f"SELECT file, {_WORST} AS verdict, count(*) AS page_count, string_agg(verdict, ',' ORDER BY page) AS verdicts FROM numbered GROUP BY file",
    )
)
def rep_documents_json(spark, d):
    """Documents as JSON, read back: no text of numbers is compared."""
    shape = "file string, verdict string, page_count long, reasons array<string>, pages array<struct<page:int,verdict:string>>"
    read = report.documents_json(_pages(spark, d)).select(F.from_json("document", shape).alias("x"))
    return read.select("x.file", "x.verdict", "x.page_count", F.array_join("x.pages.verdict", ",").alias("verdicts"))


# --- capacity


@query(b.sql(b.SQL_TRAFFIC, "\nr AS (SELECT level, seconds, row_number() OVER (PARTITION BY level ORDER BY seconds) - 1 AS k, count(*) OVER (PARTITION BY level) AS n FROM traffic)", tail="SELECT level, n, max(seconds) FILTER (k = n // 2) AS p50, max(seconds) FILTER (k = greatest(0, (n * 95) // 100 - 1)) AS p95 FROM r GROUP BY level, n"))
def cap_latency_nearest_rank(spark, d):
    return capacity.nearest_rank(b.traffic(spark, d))


_RATES = "\nrates AS (SELECT level, count(*) AS n, count(*) / nullif((max(us + round(seconds * 1000000)::BIGINT) - min(us)) / 1000000.0::DOUBLE, 0) AS rate FROM traffic GROUP BY level)"


@query(b.sql(b.SQL_TRAFFIC, _RATES, tail="SELECT level, n, round(rate, 6) AS rate, round(max(rate) OVER (ORDER BY level), 6) AS peak_so_far FROM rates"))
def cap_throughput(spark, d):
    return capacity.running_peak(capacity.throughput(b.traffic(spark, d))).select("level", "n", F.round("rate", 6).alias("rate"), F.round("peak_so_far", 6).alias("peak_so_far"))


@query(b.sql(b.SQL_TRAFFIC, _RATES, "\npk AS (SELECT max(rate) AS peak FROM rates),\nbest AS (SELECT level, rate, peak FROM rates, pk WHERE rate >= peak * 0.9::DOUBLE ORDER BY level LIMIT 1)", tail="SELECT level, round(rate, 6) AS rate, round(peak, 6) AS peak, round(64 / peak, 4) AS wait_seconds, 64 / peak > 5 AS too_long, trunc(peak * 4)::INT AS suggested_in_flight FROM best"))
def cap_recommend(spark, d):
    best = capacity.recommend(capacity.throughput(b.traffic(spark, d)))
    return best.select("level", F.round("rate", 6).alias("rate"), F.round("peak", 6).alias("peak"), *capacity.queue_wait(F.col("peak")))


@query(b.sql(b.SQL_TRAFFIC, _RATES, tail="SELECT level, think, round(rate * think, 4) AS users_borne, greatest(1, ceil(700::DOUBLE / think / rate))::INT AS processes FROM rates, (VALUES (5), (10), (30), (60), (120)) t(think)"))
def cap_users_table(spark, d):
    return capacity.users_table(spark, capacity.throughput(b.traffic(spark, d)))


@query(b.sql(b.SQL_TRAFFIC, "\nev AS (SELECT level, us AS t_at, 1 AS d, event_id FROM traffic UNION ALL SELECT level, us + round(seconds * 1000000)::BIGINT, -1, event_id FROM traffic),\ng AS (SELECT event_id, level, d, sum(d) OVER (PARTITION BY level ORDER BY t_at, d, event_id ROWS UNBOUNDED PRECEDING) AS in_flight FROM ev)", tail="SELECT event_id, level, in_flight::BIGINT AS in_flight FROM g WHERE d = 1"))
def cap_inflight_gauge(spark, d):
    return capacity.in_flight(b.traffic(spark, d))


@query("SELECT event_id, CASE WHEN event_id * 7919 % 67108864 > 33554432 THEN 413 WHEN event_type <> 'view' AND user_id % 40 >= 32 THEN 503 ELSE 200 END AS status FROM events")
def cap_admission(spark, d):
    rows = b.read(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 67108864).alias("content_length"), F.when(F.col("event_type") != "view", "POST").otherwise("GET").alias("method"), (F.col("user_id") % 40).alias("in_flight"))
    return capacity.admission(rows, 32).select("event_id", "status")


@query("WITH s AS (SELECT median(abs(value) * 0.1::DOUBLE) AS decode, median(abs(value) * 0.5::DOUBLE) AS segment, median(abs(value)) AS total FROM events), r AS (SELECT *, greatest(total - decode - segment, 0) AS rest FROM s) SELECT round(decode, 6) AS decode, round(segment, 6) AS segment, round(rest, 6) AS rest, round(total, 6) AS total, round(decode / total, 4) AS decode_share, round(segment / total, 4) AS segment_share, round(rest / total, 4) AS rest_share FROM r")
def cap_stage_shares(spark, d):
    t = F.abs("value")
    return capacity.stage_shares(b.read(spark, d, "events").select((t * 0.1).alias("decode"), (t * 0.5).alias("segment"), t.alias("total")))


@query("SELECT p_size, least(greatest(p_size // 4, 2), 32)::INT AS level, 2 * least(greatest(p_size // 4, 2), 32)::INT AS in_flight FROM part")
def cap_concurrency(spark, d):
    c = capacity.concurrency(F.col("p_size"))
    return b.read(spark, d, "part").select("p_size", c.alias("level"), (2 * c).alias("in_flight"))


# --- service, files and the rest

_ERRORS = "CASE vec_id % 12 WHEN 1 THEN 'UNAUTHORIZED' WHEN 2 THEN 'INFERENCE_FAILED' WHEN 3 THEN 'SERVER_BUSY' WHEN 4 THEN 'DECODE_FAILED' WHEN 5 THEN 'TOO_LARGE' END"


@query(
    b.sql(
        *_ALL,
        f"\nreq AS (SELECT vec_id, verdict, {_ERRORS} AS error, CASE vec_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' ELSE 'json' END AS fmt, vec_id % 4 + 1 AS pages FROM judged)",
        tail="SELECT vec_id, CASE WHEN error = 'UNAUTHORIZED' THEN 401 WHEN error = 'TOO_LARGE' THEN 413 WHEN error IN ('INFERENCE_FAILED', 'SERVER_BUSY') THEN 503 WHEN error IS NOT NULL THEN 400 WHEN verdict = 'fail' THEN 422 ELSE 200 END AS status, CASE WHEN error = 'INFERENCE_FAILED' THEN 5 WHEN error = 'SERVER_BUSY' THEN 2 END AS retry_after, CASE WHEN fmt = 'pdf' AND verdict <> 'fail' THEN 'pdf' WHEN pages > 1 OR fmt = 'json' OR verdict = 'fail' THEN 'json' ELSE 'png' END AS kind, CASE WHEN error IS NOT NULL THEN 3 WHEN verdict = 'fail' THEN 2 WHEN verdict = 'warn' THEN 1 ELSE 0 END AS exit_code FROM req",
    )
)
def svc_status_table(spark, d):
    v = F.col("vec_id")
    k = v % 12
    error = F.when(k == 1, "UNAUTHORIZED").when(k == 2, "INFERENCE_FAILED").when(k == 3, "SERVER_BUSY").when(k == 4, "DECODE_FAILED").when(k == 5, "TOO_LARGE")
    fmt = F.when(v % 3 == 0, "png").when(v % 3 == 1, "pdf").otherwise("json")
    rows = b.judged(spark, d)
    return rows.select("vec_id", service.status(F.col("verdict"), error).alias("status"), service.retry_after(error).alias("retry_after"), service.response_kind(fmt, v % 4 + 1, F.col("verdict")).alias("kind"), service.cli_exit(F.col("verdict"), error).alias("exit_code"))


@query("WITH e AS (SELECT trim(unnest(string_split(concat(c_name, ':', lpad(c_custkey::VARCHAR, 18, 'k'), ', ', c_custkey % 7, 'short,', lpad(c_custkey::VARCHAR, 18, 'k')), ','))) AS entry, c_custkey AS row_ FROM customer), p AS (SELECT row_, CASE WHEN contains(entry, ':') THEN regexp_extract(entry, '^(.*):[^:]*$', 1) ELSE 'client' END AS name, regexp_extract(entry, '([^:]*)$', 1) AS key FROM e) SELECT name, key, CASE WHEN length(key) < 16 THEN 'short' WHEN count(*) OVER (PARTITION BY row_, key) > 1 THEN 'repeated' END AS problem FROM p")
def svc_parse_keys(spark, d):
    key = F.lpad(F.col("c_custkey").cast("string"), 18, "k")
    rows = b.read(spark, d, "customer").select(F.concat(F.col("c_name"), F.lit(":"), key, F.lit(", "), (F.col("c_custkey") % 7).cast("string"), F.lit("short,"), key).alias("keys"))
    return service.parse_keys(rows)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_name END AS token FROM customer")
def svc_bearer(spark, d):
    k = F.col("c_custkey")
    header = F.when(k % 3 == 0, F.concat(F.lit("Basic "), "c_name")).when(k % 3 == 1, F.concat(F.lit("bEaReR  "), "c_name")).otherwise("Bearer ")
    return b.read(spark, d, "customer").select("c_custkey", service.bearer(header).alias("token"))


_SUFFIX = "lower(regexp_extract(f, '(\\.[^./]+)$', 1))"
_FILES = "f0 AS (SELECT page_id, html, concat(regexp_replace(url, '[?#].*$', ''), CASE page_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.out.png' WHEN 3 THEN '.pdf' WHEN 4 THEN '' ELSE '.TIFF' END) AS f FROM pages)"


def _files(spark, d):
    k = F.col("page_id") % 6
    tail = F.when(k == 0, ".JPG").when(k == 1, ".png").when(k == 2, ".out.png").when(k == 3, ".pdf").when(k == 4, "").otherwise(".TIFF")
    return b.read(spark, d, "pages").select("page_id", "html", F.concat(F.regexp_replace("url", "[?#].*$", ""), tail).alias("f"))


@query("WITH " + _FILES + f" SELECT page_id, {_SUFFIX} AS suffix, regexp_replace(regexp_extract(f, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, ({_SUFFIX} IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff') AND NOT f LIKE '%.out.png') AS is_image, {_SUFFIX} IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff', '.pdf') AS is_input FROM f0")
def file_suffix_filter(spark, d):
    f = F.col("f")
    return _files(spark, d).select("page_id", nm.suffix(f).alias("suffix"), nm.stem(f).alias("stem"), nm.is_image(f).alias("is_image"), nm.is_input(f).alias("is_input"))


@query("SELECT page_id, sha256(html) AS sha256, CASE WHEN html = '' THEN 'FILE_EMPTY' END AS error FROM pages")
def file_sha256(spark, d):
    content = F.encode(F.col("html"), "UTF-8")
    return b.read(spark, d, "pages").select("page_id", F.sha2(content, 256).alias("sha256"), F.when(F.length(content) == 0, "FILE_EMPTY").alias("error"))


@query("SELECT page_id, contains(substr(CASE page_id % 4 WHEN 0 THEN concat('%PDF-1.7', html) WHEN 1 THEN concat(repeat('x', 120), '%PDF-1.4', html) WHEN 2 THEN concat(repeat('x', 1020), '%PDF-1.4') ELSE url END, 1, 1024), '%PDF-') AS is_pdf FROM pages")
def file_magic_sniff(spark, d):
    k = F.col("page_id") % 4
    text = F.when(k == 0, F.concat(F.lit("%PDF-1.7"), "html")).when(k == 1, F.concat(F.lit("x" * 120 + "%PDF-1.4"), "html")).when(k == 2, F.lit("x" * 1020 + "%PDF-1.4")).otherwise(F.col("url"))
    return b.read(spark, d, "pages").select("page_id", nm.is_pdf(F.encode(text, "UTF-8")).alias("is_pdf"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT % 5 = 0")
def json_ground_truth(spark, d):
    rows = b.read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.where("k % 5 = 0")


_DESC = "pd AS (SELECT p_partkey, p_size % 3 AS n_objects, p_partkey % 2 = 0 AS sole_is_image, p_retailprice / 1000 AS coverage, p_partkey % 5 <> 0 AS upright, CASE WHEN p_size % 4 <> 0 THEN p_size * 12 END::DOUBLE AS native_dpi FROM part)"


@query("WITH " + _DESC + ", w AS (SELECT *, n_objects = 1 AND sole_is_image AND coverage >= 0.9::DOUBLE AS sole FROM pd) SELECT p_partkey, CASE WHEN sole AND upright THEN 'embedded' WHEN sole AND native_dpi IS NOT NULL THEN concat('render@', round(least(native_dpi, 400))::INT) ELSE 'render@200' END AS pdf_source FROM w")
def pdf_read_decision(spark, d):
    from ..sources import pdf

    k = F.col("p_partkey")
    rows = b.read(spark, d, "part").select(k, (F.col("p_size") % 3).alias("n_objects"), (k % 2 == 0).alias("sole_is_image"), (F.col("p_retailprice") / 1000).alias("coverage"), (k % 5 != 0).alias("upright"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 12).cast("double").alias("native_dpi"))
    return rows.select("p_partkey", pdf.read_source(S).alias("pdf_source"))


@query("SELECT conv_id, CASE WHEN count(*) > 6 THEN 'PDF_TOO_MANY_PAGES' END AS error, round(max(length(text))::DOUBLE * 72 / 300, 4) AS width_pt FROM conversations GROUP BY conv_id")
def pdf_page_guard(spark, d):
    from ..sources import pdf

    rows = b.read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("px"))
    return rows.select("conv_id", pdf.page_guard(F.col("n"), 6).alias("error"), F.round(pdf.points(F.col("px").cast("double"), S.pdf_out_dpi), 4).alias("width_pt"))


@query("WITH t AS (SELECT concat('background0', l_linenumber % 3 + 1) AS bg, l_orderkey, l_linenumber, l_quantity FROM lineitem), v AS (SELECT o_orderkey, concat('background0', n + 1) AS bg FROM orders, (VALUES (0), (1), (2)) x(n)) SELECT t.bg AS background, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM t JOIN v ON v.o_orderkey = t.l_orderkey AND v.bg = t.bg WHERE l_linenumber % 2 = 0 GROUP BY t.bg")
def video_frames_by_path(spark, d):
    """Frames (lines) sampled by stride meet the truth of their own background and video, not of a namesake's."""
    frames = b.read(spark, d, "lineitem").select(F.concat(F.lit("background0"), (F.col("l_linenumber") % 3 + 1).cast("string")).alias("background"), F.col("l_orderkey").alias("stem"), F.col("l_linenumber").alias("ix"), "l_quantity")
    truth = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("ts"), F.explode(F.array(*[F.lit(f"background0{k}") for k in (1, 2, 3)])).alias("tb"))
    kept = frames.where(nm.sampled(F.col("ix"), 2))
    return kept.join(truth, (F.col("stem") == F.col("ts")) & (F.col("background") == F.col("tb"))).groupBy("background").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query(b.sql(*_ALL, _PAGES, tail="SELECT (SELECT count(*) FROM numbered) AS n_pages, (SELECT count(DISTINCT file) FROM numbered) AS n_files, verdict, code, count(*) AS n FROM (SELECT verdict, unnest(CASE WHEN len(reasons) = 0 THEN ['none'] ELSE reasons END) AS code FROM numbered) GROUP BY verdict, code"))
def qc_report_summary(spark, d):
    """The flagship report: pages and files in all, and each code's count by verdict."""
    pages = _pages(spark, d).select("file", "verdict", "reasons")
    totals = pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("file").alias("n_files"))
    each = pages.select("verdict", F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("none"))).otherwise(F.col("reasons"))).alias("code")).groupBy("verdict", "code").agg(F.count(F.lit(1)).alias("n"))
    return each.join(totals).select("n_pages", "n_files", "verdict", "code", "n")


# --- pixels measured in Python, and streams


def _photos(spark, d):
    """One synthetic photo for each row of region."""
    import pandas as pd

    from ..functions import kernels
    from ..sources import codecs

    def make(batches):
        for batch in batches:
            yield pd.DataFrame({"file": [f"photo-{n}.png" for n in batch["seed"]], "content": [codecs.encode_png(kernels.synthetic_photo(int(n), 700, 500)) for n in batch["seed"]]})

    return b.read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("seed")).mapInPandas(make, "file string, content binary")


@query()
def img_measure_synthetic(spark, d):
    from ..operators import measure

    rows = measure.judged(_photos(spark, d), measure.Pipeline(keep_images=False))
    return rows.select("file", "page", "verdict", report.joined_reasons(F.col("reasons")).alias("reasons"), *[F.round(c, 4).alias(c) for c in ("quad_area_ratio", "skew_ratio", "blur_score", "median_brightness", "text_skew_deg")])


@query()
def img_detect_edge(spark, d):
    from ..operators import measure

    rows = measure.measured(_photos(spark, d), measure.Pipeline(settings=Settings(detector="edge-hough"), keep_images=False))
    return rows.select("file", "detector", "detector_confidence", F.round("quad_area_ratio", 4).alias("quad_area_ratio"), F.size("corners").alias("n_corners"))


@query()
def pdf_round_trip(spark, d):
    """Photos measured, each written as a PDF of its page, and the PDFs measured again."""
    from ..operators import measure
    from ..sources import sinks

    once = measure.judged(_photos(spark, d))
    again = measure.judged(sinks.documents_pdf(once).select(F.concat("file", F.lit(".pdf")).alias("file"), F.col("pdf").alias("content")), measure.Pipeline(keep_images=False))
    return again.select("file", "page", "page_count", "pdf_source", "pre_cropped", "verdict")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    """Windowed counts over the events as a stream that ends with what is there."""
    import uuid

    schema = b.read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = rows.withWatermark("ts", "20 minutes").groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    name = f"stream_{uuid.uuid4().hex}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
